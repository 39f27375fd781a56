"""Operator 5: URL filters over a sorted digest array."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEFAULT = "allow"  # the verdict where no rule fits
INDEX_BYTES = 256 << 20  # the index goes to every executor: a larger rule list is refused, split it by host first
VERDICTS = ("allow", "block")


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or end; A-Z lower-cased. Empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ? # or end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Index:
    """Names of the two files that hold the rules: sorted digests with offsets, and the rule strings."""

    digests: str
    strings: str
    path_lengths: tuple[int, ...]
    labels: int  # most dot-separated parts in a rule's host


def _digest(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))


def build_index(spark: SparkSession, rules=RULES) -> Index:
    """Write the rules as a sorted digest array and hand the files to every executor.

    Row i of the array is (digest, start, end, verdict) of one rule string, host + path, in UTF-8. The files come to
    new executors as well, so a lost one costs nothing. Repeated rules are one; the same rule with two verdicts blocks.
    """
    seen: dict[bytes, int] = {}
    for verdict, host, path in rules:
        key = (host.lower() + path).encode()
        seen[key] = max(seen.get(key, 0), VERDICTS.index(verdict))
    keys = sorted(seen)
    if sum(map(len, keys)) + 32 * len(keys) > INDEX_BYTES:
        raise ValueError(f"the rule index is larger than {INDEX_BYTES} bytes")
    ends = np.cumsum([len(k) for k in keys], dtype=np.uint64) if keys else np.zeros(0, np.uint64)
    starts = ends - np.array([len(k) for k in keys], np.uint64)
    digests = _digest(keys)
    rows = np.column_stack([digests, starts, ends, np.array([seen[k] for k in keys], np.uint64)]).reshape(-1, 4).astype(np.uint64)
    rows = rows[np.argsort(digests, kind="stable")]
    folder, tag = tempfile.mkdtemp(prefix="url-rules-"), uuid.uuid4().hex
    names = (f"url-digests-{tag}.npy", f"url-strings-{tag}.npy")
    np.save(os.path.join(folder, names[0]), rows)
    np.save(os.path.join(folder, names[1]), np.frombuffer(b"".join(keys) or b"\0", np.uint8))
    for name in names:
        spark.sparkContext.addFile(os.path.join(folder, name))
    return Index(*names, tuple(sorted({len(path.encode()) for _, _, path in rules})), max((host.count(".") + 1 for _, host, _ in rules), default=0))


class Probe:
    """The memory-mapped index: pages are shared by all workers of a machine and read as they are touched."""

    def __init__(self, index: Index):
        self.rows = np.load(SparkFiles.get(index.digests), mmap_mode="r")
        self.strings = np.load(SparkFiles.get(index.strings), mmap_mode="r")
        self.path_lengths, self.labels = index.path_lengths, index.labels

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Row of every key, or -1. Equal digests lie side by side; the stored string decides."""
        wanted = _digest(keys)
        at = np.searchsorted(self.rows[:, 0], wanted)
        found = np.full(len(keys), -1)
        open_ = np.flatnonzero(at < len(self.rows))
        while len(open_):
            open_ = open_[self.rows[at[open_], 0] == wanted[open_]]
            for i in open_:
                _, a, b, _ = self.rows[at[i]].tolist()
                if self.strings[a:b].tobytes() == keys[i]:
                    found[i] = at[i]
            open_ = open_[found[open_] < 0]
            at[open_] += 1
            open_ = open_[at[open_] < len(self.rows)]
        return found

    def candidates(self, host: str, path: str) -> list[bytes]:
        """Rule strings that would fit: suffixes of the host at a dot, path beginnings of a rule's length."""
        h, p = host.encode(), path.encode()
        labels = h.rsplit(b".", self.labels)[-self.labels:] if self.labels else []
        starts = [p[:n] for n in self.path_lengths if n <= len(p)]
        return [b".".join(labels[i:]) + s for i in range(len(labels)) for s in starts] if h else []

    def judge(self, hosts, paths) -> tuple[list[str | None], list[str | None]]:
        """The longest fitting rule of every URL, and its verdict; None without a rule."""
        keys, owner = [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            new = self.candidates(host, path)
            keys += new
            owner += [i] * len(new)
        rules: list[str | None] = [None] * len(hosts)
        verdicts: list[str | None] = [None] * len(hosts)
        best = [-1] * len(hosts)
        found = self.find(keys) if keys else np.zeros(0, int)
        for k in np.flatnonzero(found >= 0):
            i = owner[k]
            if len(keys[k]) > best[i]:
                best[i], rules[i], verdicts[i] = len(keys[k]), keys[k].decode(), VERDICTS[int(self.rows[found[k], 3])]
        return rules, verdicts


def _judge(index: Index):
    def run(batches):
        probe = Probe(index)
        for pdf in batches:
            rules, verdicts = probe.judge(pdf["host"], pdf["path"])
            yield pdf.assign(rule=pd.Series(rules, pdf.index, dtype=object), verdict=pd.Series(verdicts, pdf.index, dtype=object))

    return run


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per row of `pages`: id, host, path, rule, verdict. No shuffle.

    Null URLs, and those without ://, have an empty host and path, which no rule fits. Of several fitting rules the
    longest wins. Where none fits, rule is null and the verdict is `default`. Null ids and repeated rows are kept;
    other columns are ignored, whatever their names.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    cut_up = pages.select(F.col(id_col).cast("string").alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    judged = cut_up.mapInPandas(_judge(build_index(pages.sparkSession, rules)), "id string, host string, path string, rule string, verdict string")
    return judged.select(F.col("id").cast(kind).alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return filter_urls(table(spark, sf_dir, "pages"))


SQL = r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), rules(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), numbered AS (SELECT row_number() OVER () AS n, * FROM parts)
, fitting AS (
  SELECT n, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM numbered p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM numbered LEFT JOIN fitting USING (n)
"""
