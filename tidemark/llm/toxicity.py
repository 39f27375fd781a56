"""Operator 4: toxicity by a classifier chain."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm.common import WORD, Memo, fresh, small_batches, table, tidy
from tidemark.session import cut

#: Order of the chain. Every label column is 0 or 1; later models see the probabilities of the earlier ones.
CHAIN = ("toxic_prose", "toxic_junk", "toxic")
SAMPLE = 8_000  # labelled documents at most that the models are fitted on, chosen by a hash of the id
FEATURES = 512  # words and word beginnings that tell a category best
FOLDS = 3
LEAST = 5  # documents of the sample that must hold a feature
LEAST_G2 = 15.0  # log-likelihood ratio below which a feature is noise
THRESHOLD = 0.5
RIDGE = 0.1


def features_of(word: str) -> list[str]:
    """The word itself and its beginnings of 3 to 5 letters, so that inflected forms share weight."""
    return ["=" + word, *(word[:k] for k in (3, 4, 5) if len(word) >= k)]


def _words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def _present(text: str | None) -> set[str]:
    return {f for w in _words(text) for f in features_of(w)}


def _count(chain: tuple[str, ...]):
    def run(batches):
        seen: Counter = Counter()
        positive = [Counter() for _ in chain]
        for pdf in batches:
            labels = pdf[list(chain)].to_numpy()
            for text, row in zip(pdf["text"], labels):
                found = _present(text)
                seen.update(found)
                for i in np.flatnonzero(row):
                    positive[i].update(found)
        if seen:
            yield pd.DataFrame({"feature": list(seen), "n": list(seen.values()), **{f"p{i}": [c[f] for f in seen] for i, c in enumerate(positive)}})

    return run


def _g2(n: Column, p: Column, docs: int, positives: int) -> Column:
    """Log-likelihood ratio of feature and category."""
    share = positives / max(docs, 1)

    def part(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    cells = [(p, n * share), (n - p, n * (1 - share)), (F.lit(positives) - p, (F.lit(docs) - n) * share), (F.lit(docs - positives) - (n - p), (F.lit(docs) - n) * (1 - share))]
    return 2 * sum((part(o.cast("double"), e) for o, e in cells), F.lit(0.0))


def _design(features: list[str], chain: tuple[str, ...]):
    place = {f: i for i, f in enumerate(features)}

    def run(batches):
        def held(word: str) -> list[int]:
            return [place[f] for f in features_of(word) if f in place]

        memo = Memo(held)
        for pdf in batches:
            yield pd.DataFrame({"fold": pdf["fold"], "labels": [r.tolist() for r in pdf[list(chain)].to_numpy().astype("int32")],
                                "at": [[i for w in _words(t) for i in memo[w]] for t in pdf["text"]]})

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept, which is not shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    prior = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = np.log(prior / (1 - prior))
    shrink = np.full(len(w), ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (p - y) + shrink * w)
        w -= step * min(1.0, 8 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, folds: int = FOLDS) -> list[np.ndarray]:
    """One weight vector per category: features, the earlier categories' probabilities, intercept.

    A later model is trained on out-of-fold probabilities of the earlier ones, which err as they will on new rows.
    """
    weights, earlier = [], np.zeros((len(x), 0))
    for k in range(y.shape[1]):
        seen = np.column_stack([x, earlier])
        out = np.full(len(x), y[:, k].mean() if len(y) else 0.0)
        for f in range(folds):
            test = fold == f
            if test.any() and not test.all():
                out[test] = predict(seen[test], fit_logistic(seen[~test], y[~test, k]))
        weights.append(fit_logistic(seen, y[:, k]))
        earlier = np.column_stack([earlier, out])
    return weights


@dataclass(frozen=True)
class Chain:
    names: tuple[str, ...]
    features: tuple[str, ...]
    weights: tuple[np.ndarray, ...]

    def word_weights(self):
        place = {f: i for i, f in enumerate(self.features)}
        own = np.array([w[:len(self.features)] for w in self.weights]).T.reshape(len(self.features), len(self.names))

        def weigh(word: str):
            found = [place[f] for f in features_of(word) if f in place]
            return own[found].sum(axis=0) if found else None

        return weigh

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        """Rows of summed word weights -> probabilities, one category after the other."""
        out = np.zeros((len(logits), 0))
        for k, w in enumerate(self.weights):
            z = logits[:, k] + out @ w[len(self.features):-1] + w[-1]
            out = np.column_stack([out, 1 / (1 + np.exp(-np.clip(z, -30, 30)))])
        return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: tuple[str, ...] = CHAIN, sample: int = SAMPLE) -> Chain:
    """Fit the chain on at most `sample` labelled documents; `labels` has the id and a 0/1 column per category.

    Rows with a null id or label don't take part; an id with several label rows counts once, with their largest values, and
    one with several texts by the first of them in order.
    Without labelled documents the model gives probability zero. The driver holds `sample` sparse rows of at most
    FEATURES places, and the weights.
    """
    small_batches(docs.sparkSession)
    usable = labels.select(F.col(id_col).alias("id"), *[F.col(c).cast("int").alias(c) for c in chain]).dropna()
    chosen = usable.groupBy("id").agg(*[F.max(c).alias(c) for c in chain]).withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "h", *chain).agg(F.min("text").alias("text"))
    rows = cut(texts.select("text", *chain, F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold")), "labelled")
    totals = rows.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(c), F.lit(0)) for c in chain]).first()
    counts = rows.mapInPandas(_count(chain), "feature string, n long, " + ", ".join(f"p{i} long" for i in range(len(chain))))
    counts = counts.groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(f"p{i}").alias(f"p{i}") for i in range(len(chain))]).filter(F.col("n") >= LEAST)
    score = F.greatest(F.lit(0.0), *[_g2(F.col("n"), F.col(f"p{i}"), totals[0], totals[i + 1]) for i in range(len(chain))])
    features = tuple(r["feature"] for r in counts.withColumn("g2", score).filter(F.col("g2") >= LEAST_G2).orderBy(F.desc("g2"), "feature").limit(FEATURES).collect())
    got = rows.mapInPandas(_design(list(features), chain), "fold int, labels array<int>, at array<int>").collect()
    if not got or not features:
        return Chain(chain, (), tuple(np.array([0.0] * k + [-30.0]) for k in range(len(chain))))
    x = np.zeros((len(got), len(features)))
    for i, r in enumerate(got):
        np.add.at(x[i], r["at"], 1.0)
    order = np.lexsort([*x.T[:8], [r["fold"] for r in got]])  # the same sums whatever order the tasks ended in
    y = np.array([r["labels"] for r in got], float)
    return Chain(chain, features, tuple(fit_chain(x[order], y[order], np.array([r["fold"] for r in got])[order])))


def scores_column(model: Chain, text_col: str) -> Column:
    """Struct of the category probabilities of a text; null texts count as empty."""

    @tidy
    def scored(batches):
        memo, zero = Memo(model.word_weights()), np.zeros(len(model.names))
        for texts in batches:
            logits = np.array([sum((v for w in _words(t) if (v := memo[w]) is not None), zero) for t in texts]).reshape(-1, len(zero))
            yield pd.DataFrame(model.probabilities(logits), columns=list(model.names))

    @F.pandas_udf(StructType([StructField(n, DoubleType()) for n in model.names]))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return scored(texts)

    return run(F.col(text_col))


def score(docs: DataFrame, model: Chain, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """`docs` with a struct column `out` of category probabilities (it replaces one of that name). No shuffle."""
    return docs.withColumn(out, scores_column(model, text_col))


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's labels: toxic, and toxic within good and within poor prose."""
    t, q = F.col("toxic"), F.col("quality")
    return table(spark, sf_dir, "labels").select("doc_id", (t * q).alias("toxic_prose"), (t * (1 - q)).alias("toxic_junk"), t.alias("toxic"))


def drop_toxic(docs: DataFrame, model: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` below the threshold in the chain's last category, columns unchanged, whatever their names.

    Null texts count as empty; null ids and repeated rows are judged like any other.
    """
    p = fresh(docs, "__p")
    return docs.withColumn(p, scores_column(model, text_col)[model.names[-1]]).filter(F.col(p) < threshold).drop(p)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents judged toxic, with the probabilities of every category."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train(docs, labels_of(spark, sf_dir))).filter(F.col("toxicity")[CHAIN[-1]] >= THRESHOLD)
    return found.select("doc_id", F.lit(True).alias("toxic"), *[F.col("toxicity")[c].alias(f"p_{c}") for c in CHAIN])
