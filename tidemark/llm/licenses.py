"""Operator 9: licence scans by the Dice coefficient over word bigrams, in DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.license_texts import TEMPLATES

LEAST_DICE = 0.8


def _template_words(text: str) -> list[str]:
    return re.sub(r"[^\w]+|_", " ", text.lower()).split()


def _bigrams(words: list[str]) -> list[str]:
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def key_words(templates: dict[str, str], least: float = LEAST_DICE) -> list[str]:
    """Words of which every matching text holds one.

    Dice >= d needs d / (2 - d) of a template's bigrams, so one of any larger rest is there: the rest with the longest
    words is taken, and of each bigram the longer word.
    """
    out = set()
    for text in templates.values():
        pairs = _bigrams(_template_words(text))
        rest = len(pairs) - math.ceil(least / (2 - least) * len(pairs) - 1e-9) + 1
        ranked = sorted(pairs, key=lambda p: (-max(map(len, p.split())), p))
        out |= {max(p.split(), key=lambda w: (len(w), w)) for p in ranked[:rest]}
    return sorted(out)


def normalised(text: Column) -> Column:
    """Lower case, every run of anything but letters, digits and line ends is one space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \n]+"), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def _literal(templates: dict[str, str]) -> Column:
    rows = []
    for name, text in templates.items():
        pairs = _bigrams(_template_words(text))
        rows.append(F.struct(F.lit(name).alias("license"), F.lit(len(pairs)).alias("size"), F.array(*map(F.lit, pairs)).alias("bigrams")))
    return F.array(*rows)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, least: float = LEAST_DICE) -> DataFrame:
    """(id, license, dice, n_units): the licences that a document's text matches, and in how many of its units.

    Units are the lines, the paragraphs (between blank lines) and the whole text, normalised and distinct. Texts and then units
    without any key word are left out; key words are chosen so that this loses no match. For a unit of a distinct bigrams
    only templates with a * least / (2 - least) <= b <= a * (2 - least) / least are compared. Templates of fewer than two
    words match nothing. Null and empty texts match nothing; a null id is a key like any other; rows that repeat an id are
    scanned as one document. Other columns are ignored, whatever their names.
    """
    templates = {k: v for k, v in templates.items() if len(_template_words(v)) > 1}
    schema = docs.schema[id_col].dataType.simpleString()
    if not templates:
        return docs.sparkSession.createDataFrame([], f"{id_col} {schema}, license string, dice double, n_units long")
    keys = F.array(*map(F.lit, key_words(templates, least)))
    texts = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")).filter(F.arrays_overlap(F.split("norm", r"[ \n]+"), keys))
    paragraphs = F.transform(F.split("norm", r"\n *\n"), lambda p: F.translate(p, "\n", " "))
    units = F.concat(F.split("norm", "\n"), paragraphs, F.array(F.translate("norm", "\n", " ")))
    unit = F.explode(F.array_distinct(F.transform(units, lambda u: F.trim(F.regexp_replace(u, " +", " ")))))
    held = texts.select("id", unit.alias("unit")).select("id", words_of(F.col("unit")).alias("words")).filter(F.arrays_overlap("words", keys))
    paired = held.select("id", bigrams_of(F.col("words")).alias("bigrams"))
    low, high = least / (2 - least), (2 - least) / least
    close = F.filter(_literal(templates), lambda t: (t["size"] >= F.size("bigrams") * F.lit(low) - 1e-9) & (t["size"] <= F.size("bigrams") * F.lit(high) + 1e-9))
    compared = paired.select("id", "bigrams", F.explode(close).alias("t"))
    shared = F.size(F.array_intersect("bigrams", "t.bigrams"))
    dice = (F.lit(2.0) * shared) / (F.size("bigrams") + F.col("t.size"))
    found = compared.select("id", F.col("t.license").alias("license"), dice.alias("dice")).filter(F.col("dice") >= least)
    return found.groupBy("id", "license").agg(F.max("dice").alias("dice"), F.count(F.lit(1)).alias("n_units")).withColumnRenamed("id", id_col)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of every document that matches one."""
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ",\n  ".join("('{}', [{}])".format(n, ", ".join("'" + b.replace("'", "''") + "'" for b in _bigrams(_template_words(t)))) for n, t in TEMPLATES.items())
    return rf"""
WITH templates(license, grams) AS (VALUES
  {rows}
), texts AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS norm FROM documents WHERE text IS NOT NULL
), raw AS (
  SELECT doc_id, unnest(list_concat(string_split(norm, chr(10)), string_split_regex(norm, '\n *\n'), [norm])) AS u FROM texts
), units AS (
  SELECT DISTINCT doc_id, trim(regexp_replace(replace(u, chr(10), ' '), ' +', ' ', 'g')) AS unit FROM raw
), words AS (SELECT doc_id, unit, list_filter(string_split(unit, ' '), lambda w: w <> '') AS w FROM units
), grams AS (
  SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1
), scored AS (
  SELECT doc_id, license, CAST(2.0 AS DOUBLE) * len(list_intersect(g, grams.grams)) / (len(g) + len(grams.grams)) AS dice
  FROM (SELECT doc_id, g, license, t.grams FROM grams JOIN templates t
        ON len(t.grams) >= len(g) * {LEAST_DICE} / (2 - {LEAST_DICE}) - 1e-9 AND len(t.grams) <= len(g) * (2 - {LEAST_DICE}) / {LEAST_DICE} + 1e-9) grams
)
SELECT doc_id, license, max(dice) AS dice, count(*) AS n_units FROM scored WHERE dice >= {LEAST_DICE} GROUP BY ALL
"""


SQL = _sql()
