import hashlib
import random
import zlib

from pyspark.sql.types import LongType, StringType, StructField, StructType

from tests.llm.helpers import clash
from tidemark.llm import trie

TURNS = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType())])


def frame(spark, rows):
    return spark.createDataFrame(rows, TURNS)


def sequences(rows, branch=True):
    own = {}
    for c, t, r, x in sorted((row for row in rows if row[0] is not None), key=lambda v: (v[0], v[1] is not None, v[1] or 0)):
        own.setdefault(c, []).append((r or "", x or ""))
    if not branch:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[:h[c]] + turns[h[c]:] for c, turns in own.items()}


def plain(seqs):
    """All prefixes in a dictionary."""
    members, kids = {}, {}
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(seqs[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rebuilt_conversations_against_a_dictionary_of_prefixes(spark):
    rng = random.Random(5)
    rows = []
    for c in range(160):
        for t in range(rng.choice([1, 2, 3, 5, 8, 20])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hello", "héllo wörld", "", "x" * 40])))
    rows += [(200 + c, t, "user", f"same {t}") for c in range(40) for t in range(7)]  # many copies
    rows += [(0, None, None, None), (300, 1, None, "a"), (301, 2, "", "a"), (None, 0, "user", "lost"), (1007, 0, "user", "base is absent")]
    found = trie.prefix_trie(trie.branched(trie.turn_units(clash(frame(spark, rows), "id", "units", "path", "key", "n", "up"))))
    assert rows_of(found) == plain(sequences(rows))


def test_nested_chains_and_deep_branches(spark):
    """Every prefix of one long conversation, and branches at every depth: edges split many times over."""
    long = [("user" if i % 2 else "assistant", f"turn {i}") for i in range(37)]
    seqs = {i: long[:i] for i in range(38)}
    seqs |= {100 + i: long[:i] + [("user", f"other {i}"), ("user", "tail")] for i in range(0, 37, 3)}
    seqs |= {200 + i: long[:i] + [("user", f"other {i}"), ("user", f"tail {i}")] for i in range(0, 37, 4)}
    rows = [(c, t, r, x) for c, seq in seqs.items() for t, (r, x) in enumerate(seq)]
    units = trie.turn_units(frame(spark, rows)).unionByName(spark.sql("select 0L as id, cast(array() as array<string>) as units"))
    assert rows_of(trie.prefix_trie(units)) == plain(seqs)


def test_turnless_one_and_none(spark):
    empty = trie.turn_units(frame(spark, []))
    assert trie.prefix_trie(trie.branched(empty)).collect() == []
    turnless = spark.sql("select 4L as id, cast(array() as array<string>) as units")
    assert rows_of(trie.prefix_trie(turnless)) == plain({4: []})
    assert rows_of(trie.prefix_trie(trie.turn_units(frame(spark, [(9, 0, "user", "hi")])))) == plain({9: [("user", "hi")]})


def test_fattest_number_and_packed_ends(spark, monkeypatch):
    pairs = spark.createDataFrame([(a, b) for a in range(40) for b in range(a + 1, 41)], "a int, b int").selectExpr("a", "b", trie._fattest("a", "b") + " as f").collect()
    for a, b, f in pairs:
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)
    monkeypatch.setattr(trie, "PACK", 7)
    members = spark.range(100).selectExpr("if(id % 3 = 0, X'', X'01') as key", "id")
    want = {b"": [i for i in range(100) if i % 3 == 0], b"\x01": [i for i in range(100) if i % 3]}
    found = {bytes(r.key): r.ends for r in trie._ends(members).collect()}
    assert found == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in want.items()}
