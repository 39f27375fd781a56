"""Operator 12: prefix trie of conversations, built as a z-fast trie whose dictionary is a table.

A path is a conversation as a byte string of 24 bytes a turn: 16 bytes of a digest of all turns so far, 8 bytes of
their text length so far. Equal prefixes have equal units, so a unit names a trie node; equal digests count as equal
turns (128 bits of SHA-256). Texts themselves are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tidemark.llm.common import table
from tidemark.session import cut

UNIT, _DIGEST = 24, 16
PACK = 50_000  # ids of one node that are joined to one text before they are hashed
_EMPTY = hashlib.sha256(b"").hexdigest()


def _unit(path: str, depth: str) -> str:
    """SQL: the unit at a depth of a path from the root; empty for the root."""
    return f"if({depth} > 0, substring({path}, ({depth} - 1) * {UNIT} + 1, {UNIT}), X'')"


def _size(unit: str) -> str:
    """SQL: bytes of text above and in the node of a unit."""
    return f"coalesce(cast(conv(hex(substring({unit}, {_DIGEST + 1}, 8)), 16, 10) as bigint), 0L)"


def _fattest(low: str, high: str) -> str:
    """SQL: of the numbers above `low` up to `high`, the one divisible by the largest power of two."""
    return f"({high} & shiftleft(-1, length(bin({low} ^ {high})) - 1))"


def turn_units(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, units): every conversation's turns in order, each as the hexadecimal of a digest and a byte count.

    Null turn numbers come first; equal ones stand in the order of their digests. Null roles and texts are empty.
    Rows without an id take no part; other columns are ignored.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * _DIGEST)
    unit = F.concat(digest, F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"))
    flat = turns.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.struct(F.col(turn_col).alias("turn"), unit.alias("unit")).alias("t"))
    return flat.groupBy("id").agg(F.sort_array(F.collect_list("t"))["unit"].alias("units"))


def _chain(units: str) -> bytes:
    raw, out, digest, total = bytes.fromhex(units), [], b"", 0
    for at in range(0, len(raw), UNIT):
        digest = hashlib.sha256(digest + raw[at:at + _DIGEST]).digest()[:_DIGEST]
        total += int.from_bytes(raw[at + _DIGEST:at + UNIT], "big")
        out.append(digest + total.to_bytes(8, "big"))
    return b"".join(out)


def _path_column(units: Column) -> Column:
    @F.pandas_udf(BinaryType())
    def chained(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_chain(t) for t in texts], dtype=object)

    return chained(F.array_join(units, ""))


def _locate(pending: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """Where every path leaves the trie: `at` turns are shared; `first` and `hi` are of the edge it leaves inside.

    The fat binary search keeps an interval (a, b]: `a` is the depth of a node on the path, and no handle on the path
    lies deeper than `b`. A probe asks for the handle at the interval's 2-fattest number. Paths whose search is over
    probe for their own last unit, so that they don't meet in one partition; what they find is ignored.
    """
    handles = nodes.select(F.expr(f"substring(edge, ({_fattest('lo', 'hi')} - lo - 1) * {UNIT} + 1, {UNIT})").alias("handle"), F.col("lo").alias("n_lo"),
                           F.col("hi").alias("n_hi"), F.expr(f"substring(edge, -{UNIT}, {UNIT})").alias("n_end"))
    now = pending.select("path", "len", F.lit(0).alias("a"), F.col("len").alias("b"))
    for _ in range(steps):
        now = now.withColumn("f", F.expr(f"if(a < b, {_fattest('a', 'b')}, len)")).withColumn("probe", F.expr(_unit("path", "f")))
        now = now.join(handles, F.col("probe") == F.col("handle"), "left")
        within = F.expr(f"n_hi <= len and {_unit('path', 'n_hi')} = n_end")
        hit, active = F.expr("a < b and handle is not null"), F.expr("a < b")
        now = now.select("path", "len", F.when(hit & within, F.col("n_hi")).when(hit, F.col("n_lo")).otherwise(F.col("a")).alias("a"),
                         F.when(hit & within, F.col("b")).when(hit, F.col("n_lo")).when(active, F.col("f") - 1).otherwise(F.col("b")).alias("b"))
    edges = nodes.select(F.expr(f"substring(edge, 1, {UNIT})").alias("first"), "hi", "edge")
    now = now.filter("a < len").withColumn("probe", F.expr(_unit("path", "a + 1"))).join(edges, F.col("probe") == F.col("first"), "left")
    same = f"size(filter(sequence(1, least(hi, len) - a), i -> {_unit('edge', 'i')} = {_unit('path', 'a + i')}))"
    return now.select("path", "len", "first", "hi", F.expr(f"if(first is null, a, a + {same})").alias("at"))


def _split(nodes: DataFrame, located: DataFrame) -> DataFrame:
    """The nodes, with every edge cut at the depths where paths leave or end inside it."""
    cuts = located.filter("at < hi").groupBy("first").agg(F.sort_array(F.collect_set("at")).alias("cuts"))
    whole = nodes.withColumn("first", F.expr(f"substring(edge, 1, {UNIT})")).join(cuts, "first", "left")
    points = "concat(array(lo), coalesce(cuts, array()), array(hi))"
    pieces = whole.withColumn("p", F.expr(points)).select(
        "top", "edge", F.col("lo").alias("from"), F.expr("explode(transform(slice(p, 2, size(p)), (h, i) -> struct(p[i] as lo, h as hi)))").alias("s"))
    return pieces.select(
        F.expr(f"if(s.lo = from, top, {_unit('edge', '(s.lo - from)')})").alias("top"), "s.lo", "s.hi",
        F.expr(f"substring(edge, (s.lo - from) * {UNIT} + 1, (s.hi - s.lo) * {UNIT})").alias("edge"))


def compact_nodes(paths: DataFrame) -> DataFrame:
    """The compacted trie of the distinct `paths` (path): (top, lo, hi, edge), one row per node but the root.

    `edge` holds the node's units from depth lo + 1 to hi, `top` is the unit of its parent (empty: the root). Paths come
    in by batches: each round locates all that wait, splits the edges that they leave inside or end on, and adds at each
    exit and next turn the longest path as a new leaf. The others of that exit wait for the next round, where they leave
    deeper; so a turn that a third of all conversations begin with costs a round, not a task.
    """
    pending = cut(paths.filter("length(path) > 0").select("path", F.expr(f"cast(octet_length(path) div {UNIT} as int)").alias("len")), "waiting")
    longest = pending.agg(F.max("len")).first()[0]
    nodes = None
    while nodes is None or not pending.isEmpty():
        if nodes is None:
            located = pending.select("path", "len", F.lit(None).cast("binary").alias("first"), F.lit(None).cast("int").alias("hi"), F.lit(0).alias("at"))
        else:
            located = cut(_locate(pending, nodes, longest.bit_length()), "located")
        new = located.filter("at < len").withColumn("next", F.expr(_unit("path", "at + 1")))
        batch = cut(new.groupBy("next").agg(F.max(F.struct("len", "path", "at")).alias("r"), F.count(F.lit(1)).alias("n")), "batch")
        leaves = batch.select(F.expr(_unit("r.path", "r.at")).alias("top"), F.col("r.at").alias("lo"), F.col("r.len").alias("hi"),
                              F.expr(f"substring(r.path, r.at * {UNIT} + 1)").alias("edge"))
        rest = batch.filter("n > 1").select("next", F.col("r.path").alias("taken"))
        left = cut(new.join(rest, "next").filter("path <> taken").select("path", "len"), "waiting")
        nodes = cut(leaves if nodes is None else _split(nodes, located).unionByName(leaves), "nodes")
        pending = left
    return nodes


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, group in groupby(zip(pdf["key"], pdf["id"].tolist()), itemgetter(0)):
            ids = [i for _, i in group]
            rows += [(bytes(key), ids[at], ",".join(map(str, ids[at:at + PACK]))) for at in range(0, len(ids), PACK)]
        yield pd.DataFrame(rows, columns=["key", "first", "ids"])


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, digest = None, None
    for pdf in batches:
        rows = []
        for key, ids in zip(map(bytes, pdf["key"]), pdf["ids"]):
            if key == now:
                digest.update(b",")
            else:
                if now is not None:
                    rows.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        yield pd.DataFrame(rows, columns=["key", "ends"])
    if now is not None:
        yield pd.DataFrame([(now, digest.hexdigest())], columns=["key", "ends"])


def _ends(members: DataFrame) -> DataFrame:
    """(key, ends): digest of the ids that end at each node, ascending, comma-joined.

    Ids are dealt by ranges of (node, id), packed there, and only then meet by node: the node where a third of all
    conversations end is one task's work as a few long texts, streamed through the digest.
    """
    dealt = members.select("key", "id").repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInPandas(_packed, "key binary, first long, ids string")
    return dealt.repartition("key").sortWithinPartitions("key", "first").mapInPandas(_digested, "key binary, ends string")


_SUMS = ("n", "sized", "edges", "leaves")


def _summed(nodes: DataFrame) -> DataFrame:
    """Sums of _SUMS and the least `conv` over every node's subtree, by doubling the reach along ancestors.

    After k rounds a row holds the sums of all nodes less than 2**k levels below it, and `up` is its ancestor 2**k levels
    above. Nodes whose ancestor is the root have no further one, so they are not joined to it.
    """
    now = nodes
    while not now.filter("up is not null").isEmpty():
        below = now.filter("up is not null").groupBy(F.col("up").alias("key")).agg(*[F.sum(c).alias(f"{c}_b") for c in _SUMS], F.min("conv").alias("conv_b"))
        above = now.select(F.col("key").alias("hop"), F.col("up").alias("further"))
        now = now.withColumn("hop", F.expr("if(length(up) > 0, up, key)")).join(below, "key", "left").join(above, "hop", "left")
        now = cut(now.select("key", F.expr("if(length(up) > 0, further, null)").alias("up"), *[(F.col(c) + F.coalesce(F.col(f"{c}_b"), F.lit(0))).alias(c) for c in _SUMS],
                             F.least("conv", "conv_b").alias("conv")), "subtrees")
    return now


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """All nodes of the prefix trie of `conversations` (id long, units as of `turn_units`; an empty list is a turnless one).

    A row per distinct prefix, the textless root included: conv_id (least member), depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves, saved_tokens (bytes that sharing this subtree's texts saves) and ends_sha256.
    The sums are taken on the compacted trie; its edges are expanded at the end, where inner nodes share their members.
    Repeated ids count as often as they come; null ids take no part; no conversation gives no row.
    """
    members = cut(conversations.filter("id is not null").select("id", _path_column(F.col("units")).alias("path")).withColumn("key", F.expr(f"if(length(path) > 0, substring(path, -{UNIT}, {UNIT}), X'')")), "members")
    ended = cut(members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("conv"), F.first("path").alias("path")), "sequences")
    inner = compact_nodes(ended.select("path"))
    root = ended.sparkSession.range(1).selectExpr("cast(null as binary) as top", "0 as lo", "0 as hi", "X'' as edge")
    nodes = inner.unionByName(root).withColumn("key", F.expr(f"if(hi > 0, substring(edge, -{UNIT}, {UNIT}), X'')"))
    kids = inner.groupBy(F.col("top").alias("key")).agg(F.count(F.lit(1)).alias("kids"))
    nodes = cut(nodes.join(ended.drop("path"), "key", "left").join(kids, "key", "left").join(_ends(members), "key", "left")
                .fillna(0, ["n", "kids"]).fillna(_EMPTY, ["ends"]).withColumn("own", F.expr(f"{_size('key')} - {_size('top')}")), "nodes")
    sums = _summed(nodes.select("key", F.col("top").alias("up"), "n", F.expr(f"n * {_size('key')}").alias("sized"), F.col("own").alias("edges"),
                                F.expr("if(kids = 0, 1L, 0L)").alias("leaves"), "conv"))
    top = sums.filter("length(key) = 0 and n > 0").select("conv").first()
    above = sums.filter("length(key) > 0").select(F.col("key").alias("hop"), F.col("conv").alias("above"))
    full = nodes.drop("n", "conv").join(sums.drop("up"), "key").withColumn("hop", F.expr("if(length(top) > 0, top, key)")).join(above, "hop", "left")
    depths = full.filter("n > 0").withColumn("depth", F.expr("explode(if(hi = 0, array(0), sequence(lo + 1, hi)))"))
    before = F.expr(_size(f"if(depth - 1 > lo, {_unit('edge', '(depth - 1 - lo)')}, top)"))
    least = F.lit(top[0] if top else None).cast("long")  # of the root, which is the parent of many
    parent = F.when(F.col("hi") == 0, None).when(F.col("depth") - 1 > F.col("lo"), F.col("conv")).when(F.length("top") > 0, F.col("above")).otherwise(least)
    return depths.withColumn("before", before).select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"),
        parent.alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.expr("if(depth < hi, 1L, kids)").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.expr(f"sized - n * before - (edges - own + {_size('key')} - before)").alias("saved_tokens"),
        F.expr(f"if(depth = hi, ends, '{_EMPTY}')").alias("ends_sha256"))


def branched(conversations: DataFrame) -> DataFrame:
    """Conversations as branches of others: c takes its first h turns from c - c % 5, h = crc32(c) % 9, the rest from itself."""
    own = cut(conversations, "turns")
    h = F.expr("cast(crc32(cast(id as string)) % 9 as int)")
    base = own.select(F.col("id").alias("base"), F.col("units").alias("first"))
    joined = own.withColumn("base", F.expr("id - id % 5")).withColumn("h", h).join(base, "base", "left")
    return joined.select("id", F.expr("concat(slice(coalesce(first, cast(array() as array<string>)), 1, h), slice(units, h + 1, size(units)))").alias("units"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(branched(turn_units(table(spark, sf_dir, "conversations"))))


SQL = """
WITH turns AS (
  SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1
), cut AS (
  SELECT c, own, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT) % 9 AS h
  FROM turns
), rebuilt AS (
  SELECT cut.c, list_concat(CASE WHEN cut.h = 0 OR b.own IS NULL THEN [] ELSE b.own[1:cut.h] END, cut.own[cut.h + 1:]) AS seq
  FROM cut LEFT JOIN turns b ON b.c = cut.c - cut.c % 5
), members AS (
  SELECT c, d, len(seq) AS n, sha256(CASE WHEN d = 0 THEN '' ELSE to_json(seq[1:d])::VARCHAR END) AS key,
    CASE WHEN d > 0 THEN sha256(CASE WHEN d = 1 THEN '' ELSE to_json(seq[1:d - 1])::VARCHAR END) END AS up,
    CASE WHEN d > 0 THEN strlen(seq[d].text) ELSE 0 END AS bytes
  FROM (SELECT c, seq, unnest(range(len(seq) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT key, any_value(up) AS up, min(c) AS conv, any_value(d) AS depth, count(*) AS n, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends
  FROM members GROUP BY key
), kids AS (SELECT up AS key, count(*) AS kids FROM nodes WHERE up IS NOT NULL GROUP BY 1
), below AS (
  SELECT m.key, sum((w.n - 1) * w.bytes) AS saved, count(*) FILTER (k.kids IS NULL) AS leaves
  FROM nodes w JOIN members m ON m.c = w.conv AND m.d <= w.depth LEFT JOIN kids k ON k.key = w.key GROUP BY 1
)
SELECT a.conv AS conv_id, a.depth::BIGINT AS depth, p.conv AS parent_conv_id, a.n AS n_convs, coalesce(k.kids, 0) AS n_children,
  b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, a.ends AS ends_sha256
FROM nodes a JOIN below b ON b.key = a.key LEFT JOIN nodes p ON p.key = a.up LEFT JOIN kids k ON k.key = a.key
"""
