"""Density topics: dense groups of vectors, and outliers that belong to none."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.graph import link_groups
from tidemark.functions.ranking import with_ranks
from tidemark.session import cut


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column])


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, summed coordinate by coordinate: exact where the vectors hold whole numbers."""
    out = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        out += np.square(x[:, i][:, None] - y[:, i][None, :])
    return out


@dataclass(frozen=True)
class DensityLabeller:
    """Topics as groups of dense vectors.

    A vector is a core point when at least `min_points` rows lie within `radius` of it, itself included. Core points within
    the radius of each other share a topic; another row takes the topic of its nearest core point within the radius (of
    equally near ones the smallest id), and else is an outlier, topic -1.

    Vectors are dealt to the nearest of at most `pivots` of them. A row is also sent to every other pivot whose bisecting
    hyperplane lies within the radius of it: whatever is near a row is then in the row's own bucket, so counts are exact.
    Equal vectors count once with their number; buckets larger than `chunk` are dealt into pairs of chunks, and a pair
    gives counts and a tree of links, never its pairs of rows.
    """

    radius: float
    min_points: int
    pivots: int = 64
    chunk: int = 1500

    def label(self, vectors: DataFrame, *, keys: list[str], vector: str = "embedding") -> DataFrame:
        """`vectors` with topic_id and topic_probability: the share of 2 x min_points rows within the radius, at most 1; 0 for outliers.

        Topics are numbered from 0 by their smallest id. Rows whose vector is null are outliers; all vectors have one length.
        """
        points = vectors.filter(F.col(vector).isNotNull()).groupBy(F.col(vector).cast("array<double>").alias("v")).agg(
            F.min(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys])).alias("id"), F.count(F.lit(1)).alias("n"))
        points = cut(points, "points")
        tiles = cut(self._tiles(points), "tiles")
        counted = tiles.groupBy("bucket", "i", "j").applyInPandas(lambda tile: self._count(tile), "id string, near long").groupBy("id").agg(F.sum("near").alias("near"))
        counted = cut(counted.withColumn("core", F.col("near") >= self.min_points), "counts")
        found = cut(tiles.join(counted.select("id", "core"), "id").groupBy("bucket", "i", "j").applyInPandas(lambda tile: self._links(tile), "a string, b string, gap double"), "found")
        groups = link_groups(found.filter("gap is null"))
        cores = counted.filter("core").join(groups, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"))
        edge = found.filter("gap is not null").groupBy("a").agg(F.min_by("b", F.struct("gap", "b")).alias("b"))
        border = edge.join(cores.select(F.col("id").alias("b"), "root"), "b").select(F.col("a").alias("id"), "root")
        rooted = cores.unionByName(border)
        numbers = with_ranks(rooted.select("root").distinct().withColumn("_all", F.lit(0)), ["_all"], "root", topic_id="ordinal").select("root", "topic_id")
        share = F.least(F.col("near") / (2.0 * self.min_points), F.lit(1.0))
        topics = points.join(rooted.join(numbers, "root"), "id", "left").join(counted, "id").select(
            "v", F.coalesce("topic_id", F.lit(-1)).cast("int").alias("topic_id"), F.when(F.col("topic_id").isNotNull(), share).otherwise(0.0).alias("topic_probability"))
        rows = vectors.withColumn("_v", F.col(vector).cast("array<double>")).join(topics, F.col("_v") == F.col("v"), "left").drop("_v", "v")
        return rows.fillna(-1, ["topic_id"]).fillna(0.0, ["topic_probability"])

    def _tiles(self, points: DataFrame) -> DataFrame:
        """(bucket, i, j, home, other, id, v, n): rows of each pair of chunks; `home` counts, `other` is counted."""
        order = F.xxhash64("v")
        chosen = points.orderBy(order, "id").limit(self.pivots).select("v").collect()  # bounded by the parameter
        pivots = np.array([r["v"] for r in chosen], dtype=float)
        radius = self.radius

        @F.pandas_udf("struct<home:int,guest:array<int>>")
        def deal(v: pd.Series) -> pd.DataFrame:
            x = _matrix(v)
            d = _squares(x, pivots)
            home = d.argmin(1)
            apart = np.sqrt(_squares(pivots, pivots))[home]
            with np.errstate(divide="ignore", invalid="ignore"):
                beyond = (d - d[np.arange(len(x)), home][:, None]) / (2 * apart)
            # a little more than the radius, so that rounding never parts near rows
            guest = (beyond <= radius * (1 + 1e-9)) & (apart > 0)
            return pd.DataFrame({"home": home.astype("int32"), "guest": [np.flatnonzero(g).astype("int32") for g in guest]})

        dealt = cut(points.withColumn("d", deal("v")).select("id", "v", "n", F.explode(F.concat(
            F.array(F.struct(F.col("d.home").alias("bucket"), F.lit(True).alias("own"))), F.transform("d.guest", lambda g: F.struct(g.alias("bucket"), F.lit(False).alias("own"))))).alias("p")).select("id", "v", "n", "p.*"), "dealt")
        sizes = dealt.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / self.chunk).cast("int").alias("chunks"))
        part = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
        parted = dealt.join(sizes, "bucket").withColumn("part", part)
        seat = lambda i, j, home, other: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(home).alias("home"), F.lit(other).alias("other"))
        every = F.sequence(F.lit(0), F.col("chunks") - 1)
        others = F.filter(every, lambda c: c != F.col("part"))
        seats = F.concat(F.array(F.struct(F.col("part").alias("i"), F.col("part").alias("j"), F.col("own").alias("home"), F.lit(True).alias("other"))),
                         F.transform(F.when(F.col("own"), others).otherwise(F.array().cast("array<int>")), lambda c: seat(F.col("part"), c, True, False)),
                         F.transform(others, lambda c: seat(c, F.col("part"), False, True)))
        return parted.select("bucket", "id", "v", "n", F.explode(seats).alias("s")).select("bucket", "s.*", "id", "v", "n")

    def _near(self, tile: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
        home, other = tile[tile["home"]], tile[tile["other"]]
        if home.empty or other.empty:
            return home, other, np.zeros((len(home), len(other)))
        return home, other, _squares(_matrix(home["v"]), _matrix(other["v"]))

    def _count(self, tile: pd.DataFrame) -> pd.DataFrame:
        home, other, gap = self._near(tile)
        return pd.DataFrame({"id": home["id"], "near": (gap <= self.radius ** 2) @ other["n"].to_numpy()}).astype({"near": "int64"})

    def _links(self, tile: pd.DataFrame) -> pd.DataFrame:
        """Rows (a, b, null): links of core points that hold a tile's groups together; (a, b, gap): nearest core points of others."""
        home, other, gap = self._near(tile)
        other, gap = other[other["core"]], gap[:, other["core"].to_numpy(bool)]
        near = gap <= self.radius ** 2
        core = home["core"].to_numpy(bool)
        ids, out = other["id"].to_numpy(), []
        if len(ids):
            inner = near[core]
            label = np.arange(len(ids))
            while inner.any():
                least = np.where(inner, label[None, :], len(ids)).min(1)  # of each home point's neighbours
                spread = np.minimum(label, np.where(inner, least[:, None], len(ids)).min(0))
                if (spread == label).all():
                    out += [(a, ids[k], None) for a, k in zip(home["id"].to_numpy()[core], least) if k < len(ids)]
                    out += [(a, ids[k], None) for a, k in zip(ids, label) if a != ids[k]]
                    break
                label = spread
            for a, row, ok in zip(home["id"].to_numpy()[~core], gap[~core], near[~core]):
                if ok.any():
                    best = row[ok].min()
                    out.append((a, min(ids[ok & (row == best)]), float(best)))
        return pd.DataFrame(out, columns=["a", "b", "gap"])
