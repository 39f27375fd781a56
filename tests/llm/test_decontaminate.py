import random
from itertools import combinations

from tests.llm.helpers import PROSE, clash, docs
from tidemark.llm import decontaminate as D

BENCH = "item_id long, text string"


def words(rnd, n):
    return ["".join(rnd.choices("abcdefghij", k=7)) for _ in range(n)]


def test_masks_hit_every_pattern_of_substitutions():
    for n in (12, 13, 14, 15, 20):
        for gone in combinations(range(n), n // 5):
            assert any(all(p + i not in gone for i, b in enumerate(m) if b == "1") for m in D.MASKS for p in range(n - len(m) + 1)), (n, gone)


def slow(rows, bench):
    """Every window of every diagonal of every pair."""
    found = set()
    for d, t in rows:
        for i, b in bench:
            a, w = D.words(t), D.words(b)
            k = min(D.WINDOW, len(a), len(w))
            if k < D.SHORTEST:
                if a and a == w:
                    found.add((d, i))
                continue
            for x in range(len(a) - k + 1):
                if any(sum(p == q for p, q in zip(a[x:x + k], w[y:y + k])) >= D.SHARE * k - 1e-9 for y in range(len(w) - k + 1)):
                    found.add((d, i))
    return found


def test_overlaps_equal_brute_force(spark):
    rnd = random.Random(7)
    bench = [(i, " ".join(words(rnd, n))) for i, n in enumerate([3, 12, 14, 20, 40, 60])] + [(6, None), (None, "x y z"), (7, "")]
    bench += [(8, bench[3][1]), (8, bench[3][1]), (9, bench[4][1].upper() + "!")]
    rows = [(0, None), (1, ""), (2, bench[0][1]), (3, "a " + bench[0][1])]
    for i in range(1, 6):
        for gone in (0, 2, 4, 9):
            item = bench[i][1].split()
            for g in rnd.sample(range(len(item)), min(gone, len(item))):
                item[g] = "changed"
            rows.append((100 * i + gone, " ".join(words(rnd, 30) + item + words(rnd, 30))))
        rows.append((100 * i + 50, " ".join(bench[i][1].split()[:13])))
        rows.append((100 * i + 60, " ".join(words(rnd, 9) + bench[i][1].split()[:9] + words(rnd, 9))))
    rows += [(700, rows[4][1]), (700, rows[4][1]), (None, rows[4][1]), (800, " ".join(PROSE) + ".")]
    b = clash(spark.createDataFrame(bench, BENCH), "item", "hash", "doc_id")
    df = clash(docs(spark, rows), "id", "key", "hash", "item_id", "tokens", "n_items")
    got = {(r.id, r.item) for r in D.overlaps(df, b).collect()}
    assert got == slow(rows, [x for x in bench if x[0] is not None])
    bad = {i for i, _ in got}
    kept = D.drop_contaminated(df, b)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i not in bad)
    assert {100, 102, 700, None} <= bad


def test_empty_tables(spark):
    none, bench = docs(spark, []), spark.createDataFrame([], BENCH)
    some = docs(spark, [(1, " ".join(PROSE))])
    assert D.contaminated(none, bench).count() == 0 and D.contaminated(some, bench).count() == 0
    assert D.drop_contaminated(some, bench).count() == 1


def test_a_passage_that_many_documents_share(spark):
    passage = " ".join(PROSE)
    rows = [(i, f"w{i} v{i} u{i} {passage} z{i}") for i in range(300)] + [(1000 + i, " ".join(f"x{i}y{j}" for j in range(50))) for i in range(50)]
    found = D.contaminated(docs(spark, rows), spark.createDataFrame([(1, passage), (2, passage)], BENCH)).collect()
    assert sorted(r.id for r in found) == list(range(300)) and {r["items"] for r in found} == {"1,2"} and {r.word_start for r in found} == {3}
