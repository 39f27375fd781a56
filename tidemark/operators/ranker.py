"""Return ranker: training matrix, boosted trees, calibration, scoring, labelled text datasets."""

from __future__ import annotations

import hashlib
import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.maths import finite, is_finite, safe_div
from tidemark.functions.text import optional_text
from tidemark.operators.backtest import WalkForward, fold_dates, fold_spans, fold_summary, overall_summary, picks_with_returns, rank_scores
from tidemark.operators.labels import return_class
from tidemark.session import cut, held, release_shuffles, stored_bytes

# Label columns that must never be model inputs.
LABEL_COLUMNS = [f"forward_return_{h}d" for h in (1, 5, 20)] + [f"forward_log_return_{h}d" for h in (1, 5, 20)] + [f"survives_to_t{h}" for h in (1, 5, 20)]
NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")


def feature_columns(features: DataFrame) -> list[str]:
    """Numeric columns that are neither keys, labels nor the regime tag, by name."""
    skip = {"date", "ticker", "regime_label", *LABEL_COLUMNS}
    return sorted(n for n, t in features.dtypes if n not in skip and t in NUMERIC)


def training_matrix(features: DataFrame, labels: DataFrame, target: str = "forward_return_5d") -> DataFrame:
    """Features joined to finite targets, missing or non-finite inputs as zero."""
    y = labels.where(is_finite(target)).select("date", "ticker", F.col(target).cast("double").alias("target"))
    cols = [F.coalesce(finite(c), F.lit(0.0)).alias(c) for c in feature_columns(features)]
    return features.select("date", "ticker", *cols).join(y, ["date", "ticker"])


@dataclass
class RankerParams:
    trees: int = 200
    depth: int = 4
    rate: float = 0.05
    rows: float = 0.8
    columns: str = "0.8"
    min_rows: int = 10
    seed: int = 42


FOLDS_AT_ONCE = 4
TREE_ROWS = 200_000  # of a task
SCORES = "date date, ticker string, regime string, return_score double, pos_prob double, rank_score double, confidence double, model_version string"


@dataclass
class Ranker:
    """M2-M5: gradient-boosted 5-day return with a logistic probability of a positive outcome."""

    params: RankerParams = field(default_factory=RankerParams)
    columns: list[str] = field(default_factory=list)
    version: str = ""
    model: PipelineModel | None = None

    def fit(self, matrix: DataFrame, features: DataFrame | None = None, *, folder: str | None = None, where: Column | None = None) -> "Ranker":
        """Fit on the matrix; the version names the dates of `features`, labelled or not (else those of the matrix).

        Tree building reads the matrix several times, so it is stored until the fit ends. Where it is stored already, in
        files of at most TREE_ROWS rows, `folder` names the table and `where` the rows of it that are the matrix.
        """
        if folder is None:
            with held(matrix, "matrix", rows=TREE_ROWS) as (stored, path):
                return self.fit(stored, features, folder=path)
        matrix = matrix if where is None else matrix.where(where)
        p = self.params
        self.columns = [c for c in matrix.columns if c not in ("date", "ticker", "target")]
        assemble = VectorAssembler(inputCols=self.columns, outputCol="_x")
        trees = GBTRegressor(featuresCol="_x", labelCol="target", predictionCol="return_score", maxIter=p.trees, maxDepth=p.depth, stepSize=p.rate,
                             subsamplingRate=p.rows, featureSubsetStrategy=p.columns, minInstancesPerNode=p.min_rows, seed=p.seed)
        n = matrix.count()
        x = assemble.transform(matrix)
        gbt = trees.fit(assemble.transform(_in_parts(matrix.sparkSession, folder, where)) if n > TREE_ROWS else x)
        release_shuffles(matrix.sparkSession)
        raw = gbt.transform(x).select("return_score", (F.col("target") > 0).cast("double").alias("_up"))
        one = VectorAssembler(inputCols=["return_score"], outputCol="_r")
        logit = LogisticRegression(featuresCol="_r", labelCol="_up", probabilityCol="_p", predictionCol="_c", rawPredictionCol="_q").fit(one.transform(raw))
        self.model = PipelineModel([assemble, gbt, one, logit])
        span = (matrix if features is None else features).agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
        self.version = model_version(p, self.columns, str(span["a"]), str(span["b"]), n)
        return self

    def score(self, features: DataFrame) -> DataFrame:
        """M4: scores of all given dates at once; ranks are per date."""
        regime = F.trim("regime_label") if "regime_label" in features.columns else F.lit(None).cast("string")
        have = set(features.columns)
        x = features.select("date", "ticker", F.when(regime != "", regime).alias("regime"),
                            *[(F.coalesce(finite(c), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c) for c in self.columns])
        p = F.least(F.greatest(vector_to_array("_p").getItem(1), F.lit(0.0)), F.lit(1.0))
        s = self.model.transform(x).select("date", "ticker", "regime", "return_score", p.alias("pos_prob"))
        s = rank_scores(s, score="return_score")
        return s.withColumn("confidence", F.least(F.abs(F.col("pos_prob") - 0.5) * 2.0, F.lit(1.0))).withColumn("model_version", F.lit(self.version))

    def save(self, path: str) -> None:
        """M5: the fitted pipeline and its metadata side by side."""
        self.model.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.active()
        meta = json.dumps({"params": asdict(self.params), "columns": self.columns, "version": self.version})
        spark.range(1).select(F.lit(meta).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str) -> "Ranker":
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        return cls(RankerParams(**meta["params"]), meta["columns"], meta["version"], PipelineModel.load(f"{path}/pipeline"))


def model_version(params: RankerParams, columns: list[str], start: str, end: str, n: int) -> str:
    payload = json.dumps({"config": asdict(params), "features": columns, "train_start": start, "train_end": end, "n_samples": n}, sort_keys=True)
    return "v1-" + hashlib.sha256(payload.encode()).hexdigest()[:12]


def _in_parts(spark: SparkSession, folder: str, where: Column | None = None) -> DataFrame:
    """The stored matrix in tasks of about TREE_ROWS rows, as trees keep what a task reads; read so, not dealt out once more.

    The size of a reading task is a setting of the session, so the table is read in one of its own.
    """
    own = spark.newSession()
    table = own.read.parquet(folder)
    own.conf.set("spark.sql.files.openCostInBytes", "64k")
    own.conf.set("spark.sql.files.maxPartitionBytes", str(max(2**16, stored_bytes(spark, folder) * TREE_ROWS // max(table.count(), 1))))
    return table if where is None else table.where(where)


def walk_forward_scores(features: DataFrame, labels: DataFrame, dates: DataFrame, cfg: WalkForward, make_ranker=Ranker, target: str = "forward_return_5d") -> DataFrame:
    """Refit per fold on all earlier dates and score its test dates; no rows if no fold has enough.

    Only the fold list (a few rows) comes to the driver; fitting and scoring are
    distributed. Features and matrix are stored once, by date, so that each fold
    reads its own dates; the matrix goes when all are fitted. Several folds are fitted at a time, so that the small jobs
    at the end of one fold's trees leave no machine idle.
    """
    features = cut(features, "features", by="date")
    counts = features.groupBy("date").agg(F.count(F.lit(1)).alias("rows"))
    spans = fold_spans(fold_dates(dates, cfg), counts, cfg).orderBy("fold").collect()

    def scored(span, matrix: DataFrame, path: str) -> DataFrame:
        train, test = (F.col("date").between(span[f"{s}_start"], span[f"{s}_end"]) for s in ("train", "test"))
        return make_ranker().fit(matrix, features.where(train), folder=path, where=train).score(features.where(test))

    with held(training_matrix(features, labels, target), "matrix", by="date", rows=TREE_ROWS) as (matrix, path), ThreadPoolExecutor(FOLDS_AT_ONCE) as pool:
        parts = list(pool.map(lambda span: scored(span, matrix, path), spans))
    return reduce(lambda a, b: a.unionByName(b), parts, features.sparkSession.createDataFrame([], SCORES))


def model_backtest(features: DataFrame, labels: DataFrame, dates: DataFrame, cfg: WalkForward, make_ranker=Ranker, label: str = "forward_return_5d") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole run: fit and score per fold, pick the best, measure. Gives scores, metrics per fold and over all folds.

    Scores are stored once; every metric reads them or the stored picks.
    """
    scores = cut(walk_forward_scores(features, labels, dates, cfg, make_ranker, label), "scores")
    counts = features.groupBy("date").agg(F.count(F.lit(1)).alias("rows"))
    spans = fold_spans(fold_dates(dates, cfg), counts, cfg)
    picks = picks_with_returns(scores, labels, dates, cfg, label=label, scored_rows=features)
    return scores, fold_summary(picks, spans), overall_summary(picks, cfg)


# ---- labelled text -------------------------------------------------------------


def labelled_news(news: DataFrame, labels: DataFrame, *, band: float = 0.0025) -> DataFrame:
    """Every news row with its label class or the reason it is skipped."""
    y = labels.select("date", "ticker", F.lit(True).alias("_has"), "forward_return_1d")
    df = news.join(y, ["date", "ticker"], "left")
    text = F.coalesce(optional_text(F.col("text")), optional_text(F.col("headline")))
    label = return_class("forward_return_1d", band=band)
    skip = F.when(text.isNull(), "missing_text").when(F.col("_has").isNull(), "missing_label_record").when(label.isNull(), "missing_forward_return")
    return df.withColumn("skip_reason", skip).withColumn("label_name", F.when(skip.isNull(), label)).drop("_has")


def dataset_statistics(labelled: DataFrame) -> DataFrame:
    """Rows built, skips by reason, label counts, distinct tickers and dates."""
    built = F.col("skip_reason").isNull()
    skips = [F.count_if(F.coalesce(F.col("skip_reason") == r, F.lit(False))).alias(f"skipped_{r}") for r in ("missing_text", "missing_label_record", "missing_forward_return")]
    names = [F.count_if(F.coalesce(F.col("label_name") == n, F.lit(False))).alias(f"{n}_rows") for n in ("negative", "neutral", "positive")]
    return labelled.agg(F.count_if(built).alias("rows_built"), *skips, *names,
                        F.count_distinct(F.when(built, F.col("ticker"))).alias("ticker_count"), F.count_distinct(F.when(built, F.col("date"))).alias("date_count"))


def predicted_class(negative: str = "negative", neutral: str = "neutral", positive: str = "positive") -> Column:
    """The largest probability, earlier class on a tie."""
    n, u, p = F.col(negative), F.col(neutral), F.col(positive)
    return F.when((n >= u) & (n >= p), "negative").when(u >= p, "neutral").otherwise("positive")


def confusion(pairs: DataFrame, classes: list[str], truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Full confusion grid; absent cells are zero."""
    counts = pairs.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias(truth), F.lit(b).alias(predicted)) for a in classes for b in classes]))
    grid = pairs.sparkSession.range(1).select(cells.alias("c")).select("c.*")
    return grid.join(counts, [truth, predicted], "left").na.fill(0, ["n"])


def classification_metrics(pairs: DataFrame, classes: list[str], truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Accuracy and macro precision, recall and F1; empty classes count as zero."""
    t, p = F.col(truth), F.col(predicted)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(t == p).alias("hit")]
    for i, c in enumerate(classes):
        aggs += [F.count_if((t == c) & (p == c)).alias(f"tp{i}"), F.count_if(t == c).alias(f"s{i}"), F.count_if(p == c).alias(f"q{i}")]
    one = pairs.agg(*aggs)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    pr = [zero(safe_div(f"tp{i}", f"q{i}")) for i in range(len(classes))]
    rc = [zero(safe_div(f"tp{i}", f"s{i}")) for i in range(len(classes))]
    f1 = [zero(safe_div(2.0 * a * b, a + b)) for a, b in zip(pr, rc)]
    mean = lambda xs: sum(xs[1:], xs[0]) / len(xs)
    return one.select(zero(safe_div("hit", "n")).alias("accuracy"), mean(pr).alias("macro_precision"), mean(rc).alias("macro_recall"), mean(f1).alias("macro_f1"),
                      *[F.col(f"s{i}").alias(f"support_{c}") for i, c in enumerate(classes)])
