import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import PROSE, clash, docs
from tidemark.llm import toxicity as T

LABELS = "doc_id long, toxic_prose int, toxic_junk int, toxic int"


def made(rnd, i):
    """Documents with an invented insult now and then; a third of them junk."""
    junk, bad = rnd.random() < 0.33, rnd.random() < 0.3
    words = [w + ("%%%" if junk else "") for w in rnd.choices(PROSE, k=rnd.randint(20, 300))]
    if bad:
        for _ in range(1 + len(words) // 20):
            words.insert(rnd.randrange(len(words)), rnd.choice(["grobnik", "grobnikal", "vastoxu", "vastoxe"]))
    return (i, " ".join(words)), (i, int(bad and not junk), int(bad and junk), int(bad))


def test_held_out_accuracy(spark):
    rnd = random.Random(1)
    both = [made(rnd, i) for i in range(900)]
    df = docs(spark, [d for d, _ in both])
    model = T.train(df, spark.createDataFrame([y for _, y in both[:500]], LABELS))
    assert any(f.startswith("grob") for f in model.features) and len(model.features) <= T.FEATURES
    got = {r.doc_id: r.toxicity.toxic >= T.THRESHOLD for r in T.score(df, model).collect()}
    want = {i: bool(y[3]) for (i, _), y in both[500:]}
    wrong = sum(got[i] != want[i] for i in want)
    assert wrong <= 0.01 * len(want)
    kept = T.drop_toxic(clash(df, "toxicity", "label", "__p"), model)
    assert {r.doc_id for r in kept.collect()} == {i for i, bad in got.items() if not bad} and kept.columns == ["doc_id", "text", "toxicity", "label", "__p"]


def test_chain_feeds_out_of_fold_probabilities(monkeypatch):
    """Every row has a feature of its own, so a model that has seen it knows it by heart; one that has not, can't."""
    rnd = np.random.default_rng(1)
    x, first = np.eye(60), rnd.integers(0, 2, 60).astype(float)
    seen = []
    fit = T.fit_logistic
    monkeypatch.setattr(T, "fit_logistic", lambda a, y: seen.append(a) or fit(a, y))
    w = T.fit_chain(x, np.column_stack([first, 1 - first]), np.arange(60) % 3)
    assert [len(v) for v in w] == [61, 62] and seen[-1].shape == (60, 61)
    assert np.abs(seen[-1][:, -1] - first).mean() > 0.4 and np.abs(T.predict(x, w[0]) - first).mean() < 0.2
    model = T.Chain(("a", "b"), ("=x",), (np.array([2.0, 0.0]), np.array([0.0, -3.0, 1.0])))
    p = model.probabilities(np.array([[2.0, 0.0]]))[0]
    assert np.isclose(p[0], 1 / (1 + np.exp(-2))) and np.isclose(p[1], 1 / (1 + np.exp(3 * p[0] - 1)))


def test_training_does_not_depend_on_partitions(spark):
    rnd = random.Random(2)
    both = [made(rnd, i) for i in range(200)]
    df, y = docs(spark, [d for d, _ in both]), spark.createDataFrame([y for _, y in both], LABELS)
    a, b = T.train(df.repartition(1), y), T.train(df.repartition(5), y)
    assert a.features == b.features and all(np.allclose(p, q) for p, q in zip(a.weights, b.weights))


def test_no_labels_one_class_and_null_rows(spark):
    df = docs(spark, [(1, "a b c"), (2, None), (None, "x"), (3, ""), (4, "word " * 50_000), (4, "again")])
    for labels in ([], [(1, None, None, None), (None, 1, 1, 1)], [(1, 0, 0, 0), (3, 0, 0, 0)], [(1, 1, 0, 1), (1, 0, 0, 0)]):
        model = T.train(df, spark.createDataFrame(labels, LABELS))
        assert T.score(df, model).filter(F.col("toxicity.toxic") >= T.THRESHOLD).count() == 0
        assert T.drop_toxic(df, model).count() == 6
    assert T.drop_toxic(docs(spark, []), model).count() == 0
