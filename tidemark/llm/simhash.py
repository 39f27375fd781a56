"""Operator 3: SimHash near-duplicates by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.llm.common import fresh, small_batches, table, tidy
from tidemark.llm.components import connected_components
from tidemark.session import cut

SHINGLE = 3
MAX_BITS = 3
BLOCKS = 5  # any pair within 3 bits agrees on 2 of 5 blocks: ten tables keyed by about 26 bits
CHUNK = 20_000  # fingerprints of one bucket that meet in one task; a larger bucket becomes pairs of chunks
_SLICE = 1 << 16


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the word shingles, as a signed integer; zero without words.

    Words are the runs of anything but ASCII white space after lower-casing A-Z, which is what bytes.lower and
    bytes.split do. Long texts are counted in slices, so memory stays bounded by the text.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(SHINGLE, len(words))
    stops = ends[width - 1:].tolist()
    starts = [0, *(ends[:-width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(stops), _SLICE):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at:at + _SLICE], stops[at:at + _SLICE])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(stops), bitorder="little")
    return int(bits.view("<i8")[0])


@tidy
def _fingerprints(batches):
    for texts in batches:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")


@F.pandas_udf(LongType())
def fingerprint_column(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    return _fingerprints(texts)


def _block_keys(fp: Column, blocks: int, max_bits: int) -> Column:
    """Array of keys: for every choice of blocks that a close pair may share, its number and the blocks' bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - max_bits)):
        bits = F.lit(0).cast("long")
        for i in chosen:
            bits = F.shiftleft(bits, cuts[i + 1] - cuts[i]).bitwiseOR(part[i])
        keys.append(F.xxhash64(F.lit(number), bits))
    return F.array(*keys)


def link_close(values: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, int]]:
    """Links that join every pair of `values` within `max_bits` into one tree: (new members, root) by tree.

    A value leaves the pool when it is reached, so a ball of near copies costs a few passes, not all its pairs.
    """
    pool, found = np.sort(values).view(np.uint64), []  # bitwise_count takes the absolute value of signed numbers
    while len(pool):
        root, pool = pool[0], pool[1:]
        todo = [root]
        while todo and len(pool):
            near = np.bitwise_count(pool ^ todo.pop()) <= max_bits
            if near.any():
                new, pool = pool[near], pool[~near]
                found.append((new, root))
                todo.extend(new)
    return found


def _linker(max_bits: int):
    """Rows sorted by (key, unit) -> links. One run of equal keys is held at a time, two chunks at most."""

    def links(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts) if len(parts) > 1 else parts[0]
        keys = rows[["key", "unit"]].to_numpy()
        fp = rows["fp"].to_numpy()
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        u, v = [], []
        for a, b in zip([0, *edges], [*edges, len(fp)]):
            if b - a > 1:
                for new, root in link_close(np.unique(fp[a:b]), max_bits):
                    u.append(new.view(np.int64))
                    v.append(np.full(len(new), root).view(np.int64))
        return pd.DataFrame({"u": np.concatenate(u) if u else np.array([], "i8"), "v": np.concatenate(v) if v else np.array([], "i8")})

    def run(batches):
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf[["key", "unit"]].to_numpy()
            other = np.flatnonzero((keys != keys[-1]).any(axis=1))
            last = other[-1] + 1 if len(other) else 0  # the last run may go on in the next batch
            if held and (keys[0] != held[-1][["key", "unit"]].to_numpy()[-1]).any():
                yield links(held)
                held = []
            if last:
                yield links([*held, pdf.iloc[:last]])
                held = []
            held.append(pdf.iloc[last:])
        if held:
            yield links(held)

    return run


def close_links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Links (u, v) between distinct fingerprints `fp` that connect all pairs within `max_bits`.

    Pigeonhole: of `blocks` blocks at least blocks - max_bits are equal in a close pair, so it meets under one of the
    keys. Buckets of one member are dropped after a map-side count. A bucket of n members is dealt into ceil(n / chunk)
    chunks and every pair of chunks is one unit of work, so no task holds more than two chunks.
    """
    keys = fps.select("fp", F.explode(_block_keys(F.col("fp"), blocks, max_bits)).alias("key"))
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / F.lit(chunk)).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    units = (keys.join(counts, "key").select("key", "fp", "chunks", own.alias("own")).select("*", other.alias("other"))
             .select("key", (F.least("own", "other") * F.col("chunks") + F.greatest("own", "other")).cast("long").alias("unit"), "fp"))
    dealt = units.repartition("key", "unit").sortWithinPartitions("key", "unit")
    return dealt.mapInPandas(_linker(max_bits), "u long, v long")


def _groups(docs: DataFrame, id_col: str, text_col: str, max_bits: int, blocks: int) -> DataFrame:
    """(id, fp, root, component_id) of every row; root is the smallest fingerprint of the component."""
    small_batches(docs.sparkSession)
    marked = cut(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col)).alias("fp")), "fingerprints")
    reps = cut(marked.groupBy("fp").agg(F.min("id").alias("low")), "classes")
    roots = connected_components(close_links(reps.select("fp"), max_bits, blocks))
    joined = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    return marked.join(joined.join(lows, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """One row per row of `docs`: id, `fingerprint` (16 hex digits) and `component_id`.

    component_id is the smallest id that is reached by links of at most `max_bits` differing bits. Other columns are
    ignored, whatever their names. A null text counts as empty: fingerprint zero, linked like any other. A row without
    id takes part and gets the component of its group (null if nobody in it has an id). Repeated rows stay repeated.
    An empty table gives an empty result.
    """
    return _groups(docs, id_col, text_col, max_bits, blocks).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """The rows of `docs` that stand for their component: the one with the smallest id, once.

    A group in which no row has an id keeps one row of its smallest fingerprint. The columns are those of `docs`,
    whatever their names.
    """
    groups = _groups(docs, id_col, text_col, max_bits, blocks)
    key, times, mark = (fresh(docs, n) for n in ("__id", "__n", "__fp"))
    kept = groups.filter("id = component_id").groupBy(F.col("id").alias(key)).agg(F.count(F.lit(1)).alias(times))
    # the ids are the small side, hashed; so the texts are dealt once and not sorted, but for those of repeated ids
    joined = docs.join(kept.hint("shuffle_hash"), docs[id_col] == kept[key])
    named = joined.filter(F.col(times) == 1).select(*docs.columns).unionByName(joined.filter(F.col(times) > 1).select(*docs.columns).dropDuplicates([id_col]))
    bare = groups.filter("component_id IS NULL").groupBy("root").agg(F.min("fp").alias(mark)).select(mark)
    loose = docs.filter(docs[id_col].isNull()).withColumn(mark, fingerprint_column(F.col(text_col)))
    return named.unionByName(loose.join(bare, mark, "left_semi").dropDuplicates([mark]).drop(mark))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
