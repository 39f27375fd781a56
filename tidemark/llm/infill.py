"""Operator 11: fill-in-the-middle by content-defined chunks whose boundary summaries are remembered."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, small_batches, table, tidy

SPACE = "\x20\x09-\x0d"
MARKS = ("<P>", "<S>", "<M>")
WINDOW, LEAST, MEAN, MOST = 16, 128, 512, 4096  # characters: of the rolling hash, and of a chunk
SLICE = 1 << 18  # characters that are hashed at once
CACHED = 20_000  # chunks whose summaries a worker remembers

_STOP = re.compile(rf"[^{SPACE}](?=[{SPACE}])")
_SPACES = frozenset("\x20\x09\x0a\x0b\x0c\x0d")
_MARK = re.compile("<[PSM]>")
_BASE = np.uint64(0x9E3779B97F4A7C15)  # any odd number


def _rolled(points: np.ndarray) -> np.ndarray:
    """Polynomial hash of the WINDOW characters that end at every place (fewer at the beginning), by doubling its length."""
    hashes, power, have = points.astype(np.uint64) * _BASE + np.uint64(1), _BASE, 1
    while have < WINDOW:
        longer = hashes.copy()
        longer[have:] += hashes[:-have] * power
        hashes, power, have = longer, power * power, 2 * have
    return hashes ^ (hashes >> np.uint64(29))


def chunk_ends(text: str) -> list[int]:
    """Where the chunks of a text end: after places whose rolling hash says so, LEAST to MOST characters apart.

    What decides lies within WINDOW characters, less than a chunk's least length, so copies of a passage are cut alike.
    """
    out, low = [], 0
    top = 64 - (MEAN.bit_length() - 1)
    with np.errstate(over="ignore"):
        for at in range(0, len(text), SLICE):
            head = min(at, WINDOW - 1)
            points = np.frombuffer(text[at - head:at + SLICE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            for place in np.flatnonzero(_rolled(points)[head:] >> np.uint64(top) == 0).tolist():
                end = at + place + 1
                while end - low > MOST:
                    low += MOST
                    out.append(low)
                if end - low >= LEAST:
                    low = end
                    out.append(low)
    while len(text) - low > MOST:
        low += MOST
        out.append(low)
    if low < len(text):
        out.append(len(text))
    return out


@dataclass(frozen=True, slots=True)
class Summary:
    """What a chunk tells about its units: where those end that end inside it, and whether its borders are spaces."""

    stops: tuple[int, ...]
    opens_with_space: bool
    closes_with_space: bool


def summary(chunk: str) -> Summary:
    return Summary(tuple(m.end() for m in _STOP.finditer(chunk)), chunk[0] in _SPACES, chunk[-1] in _SPACES)


class Cutter:
    """Counts and finds the units of texts from the summaries of their chunks, remembered by the chunks' content.

    The cache is looked up by a chunk's hash and verified by its text, and forgets all when it is full.
    """

    def __init__(self) -> None:
        self.cache = Memo(summary, CACHED)

    def read(self, text: str) -> "Units":
        ends = chunk_ends(text)
        starts = [0, *ends[:-1]] if ends else []
        return Units(len(text), starts, [self.cache[text[a:b]] for a, b in zip(starts, ends)])


class Units:
    """Units of a text: a run of other characters with the spaces before it, and what spaces are left at the end."""

    def __init__(self, length: int, starts: list[int], chunks: list[Summary]):
        self.length, self.starts, self.chunks = length, starts, chunks
        after = [c.opens_with_space for c in chunks[1:]] + [True]  # the end of a text ends a run as a space does
        self.closed = [not c.closes_with_space and space for c, space in zip(chunks, after)]
        self.counts = list(accumulate(len(c.stops) + last for c, last in zip(chunks, self.closed)))
        self.runs = self.counts[-1] if chunks else 0
        self.n = self.runs + bool(chunks and chunks[-1].closes_with_space)

    def end(self, k: int) -> int:
        """Characters of the first k units."""
        if k > self.runs:
            return self.length
        if not k:
            return 0
        at = bisect_left(self.counts, k)
        k -= self.counts[at - 1] if at else 0
        stops = self.chunks[at].stops
        if k <= len(stops):
            return self.starts[at] + stops[k - 1]
        return self.starts[at + 1] if at + 1 < len(self.starts) else self.length


def _draws(key: str | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


@dataclass(frozen=True)
class Rates:
    seed: int = 42
    fim: int = 50  # of a hundred texts, those that are transformed
    spm: int = 80  # of a hundred of them, those whose suffix comes first


def transformed(key: str | None, text: str, cutter: Cutter, rates: Rates = Rates()) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, characters of prefix and middle, output."""
    units = cutter.read(text)
    h1, h2, h3, h4 = _draws(key, rates.seed)
    if not text or h3 % 100 >= rates.fim or _MARK.search(text):
        return units.n, "plain", None, None, text
    a, b = (units.end(k) for k in sorted((h1 % (units.n + 1), h2 % (units.n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = MARKS
    spm = h4 % 100 < rates.spm
    out = f"{s}{suffix}{p}{prefix}{m}{middle}" if spm else f"{p}{prefix}{s}{suffix}{m}{middle}"
    return units.n, "spm" if spm else "psm", a, b - a, out


def infilled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rates: Rates = Rates()) -> DataFrame:
    """One row per row of `docs`: id, n, form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    Null texts count as empty, which stay plain; a null id draws as an empty one; repeated rows are kept and get the same
    output; other columns are ignored. No shuffle; a text and its chunk summaries are held whole, one text at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter = Cutter()
        for pdf in batches:
            rows = [(key, *transformed(key, text or "", cutter, rates)) for key, text in zip(pdf["id"], pdf["text"])]
            out = pd.DataFrame(rows, columns=["id", "n", "form", "prefix_chars", "middle_chars", "output"])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    ids = F.col(id_col).cast("string")
    out = docs.select(ids.alias("id"), F.col(text_col).alias("text")).mapInPandas(
        tidy(run), "id string, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text of an output: its parts, found by their marks, which no part holds, in the order of the text."""
    parts = F.split(output, "|".join(MARKS), -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts, digests of output and of the text rebuilt from it, for every document."""
    out = infilled(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), draws AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM units
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM draws
), parts AS (
  SELECT *, CASE WHEN a = 0 THEN '' ELSE array_to_string(u[1:a], '') END AS p, CASE WHEN b = a THEN '' ELSE array_to_string(u[a + 1:b], '') END AS m,
    CASE WHEN b = n THEN '' ELSE array_to_string(u[b + 1:], '') END AS s
  FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
