"""Operator 1: benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, Memo, small_batches, table, tidy, word_hash
from tidemark.session import cut

#: Masks of five words; a zero ignores the word at that place. Together they hit every passage of 12 words or more of
#: which up to a fifth is substituted (tests/llm/test_decontaminate.py tries all patterns).
MASKS = ("11111", "111011", "101111", "110111")
WINDOW = 13  # words that must agree; the whole item or document where it is shorter
SHARE = 0.8
SHORTEST = 5  # items and documents of fewer words hold no seed: they match only as a whole, word by word
_TOKENS = 500_000  # words hashed at once
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_WHOLE = len(MASKS)  # mask number of the hash of a whole short text


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _finish(h: np.ndarray, mask: int) -> np.ndarray:
    h = (h + np.uint64(mask + 1)) * _MIX
    return h ^ (h >> np.uint64(29))


def seed_hashes(tokens: np.ndarray, ends: np.ndarray):
    """(mask, positions, hashes) for texts laid end to end; `ends` has for every token the end of its text."""
    for number, mask in enumerate(MASKS):
        at = np.arange(max(0, len(tokens) - len(mask) + 1))
        h = np.zeros(len(at), np.uint64)
        for place, offset in enumerate(i for i, bit in enumerate(mask) if bit == "1"):
            h += tokens[offset:offset + len(at)] * _PLACES[place]
        inside = at + len(mask) <= ends[:len(at)]
        yield number, at[inside], _finish(h[inside], number)


def whole_hash(tokens: np.ndarray) -> np.ndarray:
    h = np.zeros(1, np.uint64)
    for t in tokens:
        h = h * _PLACES[0] + t
    return _finish(h, _WHOLE)


def _laid_out(texts, memo: Memo):
    """Chunks of texts as (first text, token array, start of each text)."""
    first, parts, starts, size = 0, [], [0], 0
    for i, text in enumerate(texts):
        found = words(text)
        parts.append(np.fromiter(map(memo.__getitem__, found), np.uint64, len(found)))
        size += len(found)
        starts.append(size)
        if size >= _TOKENS:
            yield first, np.concatenate(parts), np.array(starts)
            first, parts, starts, size = i + 1, [], [0], 0
    if parts:
        yield first, np.concatenate(parts), np.array(starts)


def _item_hashes(batches):
    memo = Memo(word_hash)
    for pdf in batches:
        rows = []
        for item, text in zip(pdf["item"], pdf["text"]):
            tokens = np.array([memo[w] for w in words(text)], np.uint64)
            found = [(_WHOLE, 0, whole_hash(tokens)[0])] if 0 < len(tokens) < SHORTEST else [
                (m, p, h) for m, at, hs in seed_hashes(tokens, np.full(len(tokens), len(tokens))) for p, h in zip(at, hs)]
            rows += [(item, m, p, np.uint64(h).view(np.int64)) for m, p, h in found]
        yield pd.DataFrame(rows, columns=["item", "mask", "q", "hash"])


def _token_arrays(batches):
    memo = Memo(word_hash)
    for pdf in batches:
        yield pd.DataFrame({"item": pdf["item"], "item_tokens": [np.array([memo[w] for w in words(t)], np.uint64).view(np.int64) for t in pdf["text"]]})


def _filter_words(hashes: DataFrame, bits: int) -> bytes:
    """A Bloom filter with two bits a hash: `bits` bits whatever the benchmark's size, gathered by words of 64."""
    spots = F.explode(F.array(F.col("hash").bitwiseAND(bits - 1), F.shiftrightunsigned("hash", 32).bitwiseAND(bits - 1))).alias("at")
    rows = (hashes.select(spots).groupBy(F.shiftright("at", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).collect())
    out = np.zeros(bits // 64, np.int64)
    for r in rows:
        out[r["word"]] = r["bits"]
    return out.tobytes()


def _scanner(shared, bits: int):
    """Finds in every text the regions whose seeds pass the filter."""
    limit = np.uint64(bits - 1)

    def run(batches):
        table_ = np.frombuffer(shared.value, np.uint8)
        memo = Memo(word_hash, 250_000)

        def passes(h: np.ndarray) -> np.ndarray:
            a = h & limit
            ok = np.flatnonzero((table_[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & 1)
            b = (h[ok] >> np.uint64(32)) & limit
            return ok[((table_[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]

        for pdf in batches:
            ids, keys = pdf["id"].to_numpy(), pdf["key"].to_numpy()
            rows: list[tuple] = []
            for first, tokens, starts in _laid_out(pdf["text"], memo):
                ends = np.repeat(starts[1:], np.diff(starts))
                hit: list[np.ndarray] = []
                for mask, at, h in seed_hashes(tokens, ends):
                    ok = passes(h)
                    hit.append(np.column_stack([at[ok], np.full(len(ok), mask), h[ok].view(np.int64)]))
                for t in np.flatnonzero((np.diff(starts) > 0) & (np.diff(starts) < SHORTEST)):
                    h = whole_hash(tokens[starts[t]:starts[t + 1]])
                    if len(passes(h)):
                        hit.append(np.array([[starts[t], _WHOLE, h.view(np.int64)[0]]]))
                hits = np.concatenate(hit)
                if not len(hits):
                    continue
                hits = hits[np.argsort(hits[:, 0], kind="stable")]
                text_of = np.searchsorted(starts, hits[:, 0], side="right") - 1
                far = (np.diff(hits[:, 0]) > 2 * WINDOW) | (np.diff(text_of) > 0)
                cuts = [0, *(np.flatnonzero(far) + 1), len(hits)]
                for a, b in zip(cuts, cuts[1:]):
                    t = text_of[a]
                    low, high = max(starts[t], hits[a, 0] - WINDOW), min(starts[t + 1], hits[b - 1, 0] + 2 * WINDOW)
                    rows.append((ids[first + t], keys[first + t], low - starts[t], starts[t + 1] - starts[t], tokens[low:high].view(np.int64),
                                 hits[a:b, 0] - starts[t], hits[a:b, 2]))
            yield pd.DataFrame(rows, columns=["id", "key", "start", "n_words", "tokens", "at", "hash"])

    return run


def _covered(tokens: np.ndarray, item: np.ndarray, shift: int, width: int) -> tuple[int, int] | None:
    """Span of `tokens` under windows of `width` words that agree with the item in SHARE of their places."""
    low, high = max(0, shift), min(len(tokens), shift + len(item))
    if high - low < width:
        return None
    same = np.append(0, np.cumsum(tokens[low:high] == item[low - shift:high - shift]))
    good = np.flatnonzero(same[width:] - same[:-width] >= SHARE * width - 1e-9)
    return (low + int(good[0]), low + int(good[-1]) + width) if len(good) else None


def _verify(batches):
    for pdf in batches:
        rows = []
        for row in pdf.itertuples(index=False):
            width = min(WINDOW, len(row.item_tokens), row.n_words)
            span = _covered(np.asarray(row.tokens), np.asarray(row.item_tokens), row.diagonal - row.start, width)
            # fewer words than a seed: both texts whole, every word equal
            if span and (width >= SHORTEST or len(row.item_tokens) == row.n_words == span[1] - span[0] and np.array_equal(row.tokens, row.item_tokens)):
                rows.append((row.id, row.key, row.item, row.start + span[0], row.start + span[1]))
        yield pd.DataFrame(rows, columns=["id", "key", "item", "word_start", "word_end"])


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, key, item, word_start, word_end): passages of documents that overlap a benchmark item, substitutions allowed.

    Words are lower-cased \\w+ runs. Test hashes and training hashes meet in an equi-join; a training hash gets there
    if it passes a Bloom filter of the test hashes (a fixed number of bits, so the broadcast doesn't grow with either
    side; it has no false negatives). Around the hits the two texts are laid side by side along the hit's diagonal: a
    window of WINDOW words (the shorter text if it has fewer) must agree in SHARE of its places. `key` is a hash of the
    text, so that rows which repeat an id, or have none, are told apart. Null and empty texts overlap nothing; null
    items are skipped; repeated items and rows give the same spans once. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter("item IS NOT NULL AND text IS NOT NULL").distinct()
    distinct_texts = items.groupBy("text").agg(F.min("item").alias("item"))
    hashes = cut(distinct_texts.mapInPandas(_item_hashes, f"item {item_type}, mask int, q long, hash long"), "seeds")
    count = hashes.count()
    bits = 1 << min(27, max(20, (16 * count).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(_filter_words(hashes, bits))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    ids = texts.withColumn("id", F.col("id").cast("string"))
    regions = cut(ids.mapInPandas(tidy(_scanner(shared, bits)), "id string, key long, start long, n_words long, tokens array<long>, at array<long>, hash array<long>"), "regions")
    hits = regions.select("id", "key", "start", F.explode(F.arrays_zip("at", "hash")).alias("hit")).select("id", "key", "start", F.col("hit.at").alias("at"), F.col("hit.hash").alias("hash"))
    pairs = hits.join(hashes.select("item", "q", "hash"), "hash").select("id", "key", "start", "item", (F.col("at") - F.col("q")).alias("diagonal")).distinct()
    tokens = distinct_texts.mapInPandas(_token_arrays, f"item {item_type}, item_tokens array<long>")
    r = regions.select(F.col("id").alias("r_id"), F.col("key").alias("r_key"), F.col("start").alias("r_start"), "n_words", "tokens")
    laid = (pairs.join(tokens, "item").join(r, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("key") == F.col("r_key")) & (F.col("start") == F.col("r_start")))
            .select("id", "key", "item", "diagonal", "start", "n_words", "tokens", "item_tokens"))
    found = laid.mapInPandas(_verify, f"id string, key long, item {item_type}, word_start long, word_end long").distinct()
    copies = distinct_texts.withColumnRenamed("item", "kept").join(items, "text").select("kept", F.col("item").alias("copy"))
    named = found.join(copies, F.col("item") == F.col("kept")).select("id", "key", F.col("copy").alias("item"), "word_start", "word_end")
    return named.withColumn("id", F.col("id").cast(id_type))


def contaminated(docs: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """One row per contaminated document: id, key, number and list of its items, where the first overlap starts."""
    per_item = overlaps(docs, benchmark, **names).groupBy("id", "key", "item").agg(F.min("word_start").alias("word_start"), F.max("word_end").alias("word_end"))
    return per_item.groupBy("id", "key").agg(
        F.count(F.lit(1)).alias("n_items"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list("item")), lambda x: x.cast("string"))).alias("items"),
        F.min("word_start").alias("word_start"), F.max("word_end").alias("word_end"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that overlap no benchmark item, columns unchanged."""
    # stored, so that its size is known before the documents would be dealt by it
    bad = cut(contaminated(docs, benchmark, id_col=id_col, text_col=text_col).select(F.col("id").alias("__id"), F.col("key").alias("__key")), "contaminated")
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__id"]) & (F.xxhash64(docs[text_col]) == bad["__key"]), "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a passage of `benchmark`."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.lit(True).alias("contaminated"), "n_items", "items", "word_start", "word_end")
