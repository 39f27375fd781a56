"""Text expressions on whole strings, all built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns (Unicode-aware classes, as in the contract's own patterns).
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+(?=[\"'A-Z0-9])"
PLAIN_SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+"
TICKER_TOKEN = r"(?U)\b[A-Z][A-Z0-9.-]{0,6}\b"
ENTITY_PHRASE = r"(?U)\b(?:[A-Z][a-z0-9&]+(?:\s+[A-Z][a-z0-9&]+){0,3}|[A-Z]{2,}(?:\s+[A-Z]{2,})*)\b"
WORD_TOKEN = r"(?U)\b[a-z0-9][a-z0-9&.\-]*\b"


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def optional_text(text: Column) -> Column:
    """Trimmed text, null when blank."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(t != "", t)


def sentences(text: Column, min_chars: int = 2) -> Column:
    """Whitespace collapsed, cut after . ! ? before a quote, capital or digit; short pieces dropped."""
    pieces = F.split(squeeze(text), SENTENCE_BREAK)
    return F.coalesce(F.filter(F.transform(pieces, lambda s: F.trim(s)), lambda s: F.length(s) >= min_chars), F.array().cast("array<string>"))


def article_chunks(fields: list[str], min_chars: int = 2) -> Column:
    """One array of (field, order in field, text) over the fields in order."""
    def of_field(f: str) -> Column:
        return F.transform(sentences(F.col(f), min_chars), lambda s, i: F.struct(
            F.lit(f).alias("source_text_field"), i.alias("source_text_order"), s.alias("text")))

    return F.concat(*[of_field(f) for f in fields])


def normalize_headline(text: Column) -> Column:
    """T5: lower case, other characters to single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), r"\s+", " "))


def article_identity(*, ident: str = "id", url: str = "url", fields: tuple[str, ...] = ("headline", "summary", "content")) -> Column:
    """Id, url, else news- and 16 hex digits of the field digest."""
    joined = F.concat_ws("|", *[F.coalesce(optional_text(F.col(f)), F.lit("")) for f in fields])
    return F.coalesce(optional_text(F.col(ident)), optional_text(F.col(url)), F.concat(F.lit("news-"), F.substring(F.sha2(joined, 256), 1, 16)))


def contains_term(lowered: Column, term: str) -> Column:
    """A phrase anywhere, or a single word at word boundaries."""
    term = term.lower()
    if " " in term:
        return F.contains(lowered, F.lit(term))
    # the plain search is much cheaper than the pattern, and most texts end there
    return F.contains(lowered, F.lit(term)) & lowered.rlike(r"(?U)\b" + re.escape(term) + r"\b")


def evidence_snippets(text: Column, terms: list[str]) -> Column:
    """Sentences that hold any of the terms."""
    def hit(s: Column) -> Column:
        low = F.lower(s)
        cond = contains_term(low, terms[0])
        for t in terms[1:]:
            cond = cond | contains_term(low, t)
        return cond
    return F.transform(F.filter(F.split(text, PLAIN_SENTENCE_BREAK), hit), lambda s: F.trim(s))


def digest(*parts: Column) -> Column:
    """Hex sha-256 of the parts joined by |, nulls as blanks."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
