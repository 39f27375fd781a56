import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import clash, docs
from tidemark.llm import simhash as S
from tidemark.llm.components import connected_components


def slow_fingerprint(text):
    import re
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def test_fingerprint_follows_the_definition():
    rnd = random.Random(3)
    for text in [None, "", " \n\t", "One", "One two", "É É é", "A b c\x1fd", *(" ".join(rnd.choices("abCdE", k=rnd.randint(1, 30))) for _ in range(50))]:
        assert S.fingerprint(text) % (1 << 64) == slow_fingerprint(text)
    long = " ".join(rnd.choices(["x", "yy", "zzz"], k=200_000))
    whole, S._SLICE = S.fingerprint(long), 1000
    try:
        assert S.fingerprint(long) == whole
    finally:
        S._SLICE = 1 << 16


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(100, 140)] + [(7, j) for j in range(200, 260)] + [(5, 5)] + [(rnd.randint(300, 360), rnd.randint(300, 360)) for _ in range(50)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = roots({x for l in links for x in l}, links)
    assert got == {k: v for k, v in want.items() if k != v}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_close_links_connect_what_brute_force_connects(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(30)]
    values = set(base)
    for b in base:
        for _ in range(12):  # walks away from the base in steps of up to three bits
            b ^= sum(1 << k for k in rnd.sample(range(64), rnd.randint(1, 4)))
            values.add(b)
    values = sorted(int(np.uint64(v).view(np.int64)) for v in values)
    want = roots(values, [(a, b) for i, a in enumerate(values) for b in values[:i] if bin((a ^ b) % (1 << 64)).count("1") <= 3])
    for chunk in (20_000, 5):  # one chunk a bucket, and many
        links = [(r.u, r.v) for r in S.close_links(spark.createDataFrame([(v,) for v in values], "fp long"), chunk=chunk).collect()]
        got = roots(values, links)
        groups = lambda r: {frozenset(k for k in values if r[k] == x) for x in set(r.values())}
        assert groups(got) == groups(want)


def test_rows_nulls_ties_and_clashing_columns(spark):
    long = " ".join(f"word{i}" for i in range(400))
    rows = [(5, long), (3, long), (3, long), (9, long + " tail"), (None, long), (1, None), (2, ""), (None, "alone here now"), (None, "alone here now"), (7, "something else entirely")]
    got = S.near_duplicates(clash(docs(spark, rows), "fp", "id", "key", "fingerprint", "component_id", "root")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert {c for _, c in by[5]} == {c for _, c in by[3]} == {c for _, c in by[9]} == {3}
    assert by[1] == by[2] == {("0" * 16, 1)} and {c for _, c in by[None]} == {3, None}
    kept = S.keep_one(clash(docs(spark, rows), "fp", "key", "__x", "__n", "__id", "__fp"))
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect()) == [(False, 1), (False, 3), (False, 7), (True, None)]
    assert kept.columns[:2] == ["doc_id", "text"]
    empty = docs(spark, [])
    assert S.near_duplicates(empty).count() == 0 and S.keep_one(empty).count() == 0


def test_large_group_of_near_copies_makes_few_links(spark):
    rnd = random.Random(4)
    centre = rnd.getrandbits(64)
    values = {centre} | {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}
    fps = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    links = S.close_links(fps)
    assert links.count() < 10 * len(values)
    assert connected_components(links).select(F.count_distinct("root")).first()[0] == 1
