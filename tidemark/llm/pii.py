"""Operator 7: personal data, found through an offset-preserving deobfuscation."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.llm.common import small_batches, table, tidy

KINDS = ("email", "ip", "card", "phone")
_AT = re.compile("@")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where its run of digits begins, which keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]  # start, index in KINDS, end


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches of local@domain, found from the @ so that long words cost nothing.

    The local part is the whole run before the @ (no run holds an @), cut at the end of the match before.
    """
    low = 0
    for m in _AT.finditer(text):
        at = m.start()
        if at < low:
            continue
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (d := _DOMAIN.match(text, at + 1)):
            low = d.end()
            yield start, low


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[Span]:
    """Emails, addresses, cards and phone numbers of the text as it stands, by start and kind."""
    out: list[Span] = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m.group())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


# Letters of other scripts, and full-width or styled forms, that look like ASCII.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
    "․": ".", "。": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@", "﹢": "+",
}
_FOLD = {ord(k): v for k, v in _LOOKALIKES.items()}
_FOLD |= {0xFF01 + i: chr(0x21 + i) for i in range(94)}  # full-width ASCII
_FOLD |= {0x660 + i: str(i) for i in range(10)} | {0x6F0 + i: str(i) for i in range(10)} | {0x966 + i: str(i) for i in range(10)}
_FOLD |= {0x1D7CE + i: str(i % 10) for i in range(50)} | {0x2460 + i: str(i + 1) for i in range(9)}
_FOLDED = re.compile("[" + "".join(re.escape(chr(c)) for c in _FOLD) + "​-‍⁠﻿­]")
_INVISIBLE = re.compile("[​-‍⁠﻿­]")

# Digit names and the spoken forms of @ and the dot.
_NAMES = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_NAME = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_UNIT = rf"(?:{_NAME}|[0-9]++)(?![A-Za-z])"
_NUMBER = re.compile(rf"(?i)(?<![A-Za-z0-9])(?:plus[\s.-]+)?{_UNIT}(?:[\s.,-]{{1,3}}{_UNIT})++")
_NAME_TOKEN = re.compile(rf"(?i)plus|{_NAME}|[0-9]+|[\s.,-]+")
_PLUS = re.compile(r"plus[\s.-]++[0-9]")
# a plain @ counts only with a disguised dot behind it
_DISGUISE = re.compile(
    r"(?i)(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9._%+-]++)(?P<at>\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\s(?:at)\s|"
    r"@(?=[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?:\s?[\[({<]\s?(?:dot|\.|punkt|punto|point)\s?[\])}>]\s?|\sdot\s)[A-Za-z0-9-]))(?P<host>[A-Za-z0-9-]+)"
    r"(?P<rest>(?:(?:\s?[\[({<]\s?(?:dot|\.|punkt|punto|point)\s?[\])}>]\s?|\sdot\s|\.)[A-Za-z0-9-]+)+)")
_DOT = re.compile(r"(?i)\s?[\[({<]\s?(?:dot|\.|punkt|punto|point)\s?[\])}>]\s?|\sdot\s|\.")
_FAR = re.compile("[^\x00-\u024f]")  # every folded character but two lies beyond
_BRACKET = re.compile(r"(?i)[\[({<]\s?(?:at|@|dot|\.|punkt|punto|point)\s?[\])}>]|\sdot\s")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")


class Tape:
    """A text with, for every character, where it came from: source start and end."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, None, None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans, given in order; every new character keeps the whole source span it stands for."""
        if not edits:
            return
        if self.start is None:
            self.start, self.end = array("q", range(len(self.text))), array("q", range(1, len(self.text) + 1))
        text, start, end, low = [], array("q"), array("q"), 0
        for a, b, new in edits:
            text += self.text[low:a], new
            start += self.start[low:a] + array("q", [self.start[a]]) * len(new)
            end += self.end[low:a] + array("q", [self.end[b - 1]]) * len(new)
            low = b
        self.text = "".join([*text, self.text[low:]])
        self.start, self.end = start + self.start[low:], end + self.end[low:]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (self.start[a], self.end[b - 1])


def _lower(text: str) -> str:
    """Lower case, with the other letters that patterns without case take for i and s."""
    return text.lower() if text.isascii() else text.replace("İ", "i").lower().replace("ı", "i").replace("ſ", "s")


def _spoken(m: re.Match) -> str:
    """Digits of a run of digit names; separators go, a leading "plus" stays as +."""
    return "".join(_NAMES.get(t, "+" if t == "plus" else t if t.isdigit() else "") for t in map(_lower, _NAME_TOKEN.findall(m.group())))


def may_number(low: str) -> bool:
    """Whether a digit name stands in the lower-case text between other than letters, or "plus" before a digit: all that _NUMBER needs."""
    for name in _NAMES:
        at = low.find(name)
        while at >= 0:
            end = at + len(name)
            if (not at or low[at - 1] not in _LETTERS) and (end == len(low) or low[end] not in _LETTERS):
                return True
            at = low.find(name, end)
    return "plus" in low and _PLUS.search(low) is not None


def may_disguise(text: str, low: str) -> bool:
    """Whether a bracketed at or a bracketed or spoken dot stands in the text: what every disguise that counts holds."""
    return ("dot" in low or any(b in low for b in "[({<")) and _BRACKET.search(text) is not None


def deobfuscate(text: str) -> Tape | None:
    """The text after the three transducers, or None if none of them changes it."""
    tape = Tape(text)
    if not text.isascii() and ("\xb7" in text or "\xad" in text or _FAR.search(text)):
        tape.rewrite([(m.start(), m.end(), "" if _INVISIBLE.match(m.group()) else _FOLD[ord(m.group())]) for m in _FOLDED.finditer(text)])
    low = _lower(tape.text)
    if may_number(low):
        tape.rewrite([(m.start(), m.end(), _spoken(m)) for m in _NUMBER.finditer(tape.text) if any(c.isalpha() for c in m.group())])
    if may_disguise(tape.text, low):
        edits = []
        for m in _DISGUISE.finditer(tape.text):
            a, b = m.span("at")
            dots = [(m.start("rest") + d.start(), m.start("rest") + d.end(), ".") for d in _DOT.finditer(m.group("rest"))]
            # a bare " at " counts only with a spoken dot, "look at example.com" is prose
            if m.group("at").strip().lower() != "at" or any(tape.text[x:y] != "." for x, y, _ in dots):
                edits += [(a, b, "@"), *dots]
        tape.rewrite(edits)
    return None if tape.start is None else tape


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and base plus those that only the deobfuscated text shows, in source positions.

    An added span is dropped only if base spans cover it; one that reaches beyond them stays beside them.
    """
    base = base_spans(text)
    tape = deobfuscate(text)
    if tape is None:
        return base, base
    covered = merged(base)
    starts = [a for a, _, _ in covered]
    added = []
    for a, kind, b in base_spans(tape.text):
        s, e = tape.source(a, b)
        at = bisect_right(starts, s) - 1
        if at < 0 or covered[at][2] < e:
            added.append((s, kind, e))
    return base, sorted([*base, *added])


def merged(spans: list[Span]) -> list[Span]:
    """Spans in order, those that overlap as one of the first one's kind."""
    out: list[Span] = []
    for a, k, b in spans:
        if out and a < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(out[-1][2], b))
        else:
            out.append((a, k, b))
    return out


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _find(batches):
    for pdf in batches:
        rows = []
        for text in pdf["text"]:
            base, every = all_spans(text) if text else ([], [])
            rows.append((*(sum(k == i for _, k, _ in base) for i in range(4)), _written(base), _written(every), len(every) - len(base)))
        out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_added"])
        out.insert(0, "id", pdf["id"].to_numpy())
        yield out


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, counts of the base kinds, `base` and `spans` as kind:start:end lists, `n_added`.

    Spans are code point positions in the source text, end exclusive, by start and then kind. No shuffle; every text
    is read whole. Null texts count as empty; null ids and repeated rows are kept; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    ids = F.col(id_col).cast("string")  # as text, so that null ids of a batch stay exact
    out = docs.select(ids.alias("id"), F.col(text_col).alias("text")).mapInPandas(
        tidy(_find), "id string, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    if not text:
        return text
    out, low = [], 0
    for a, k, b in merged(all_spans(text)[1]):
        out += text[low:a], f"[{KINDS[k].upper()}]"
        low = b
    return "".join([*out, text[low:]])


def redacted_column(text_col: str):
    @tidy
    def redacted(batches):
        for texts in batches:
            yield pd.Series([redact(t) for t in texts], dtype=object)

    @F.pandas_udf(StringType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return redacted(texts)

    return run(F.col(text_col))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest of the base spans and all spans, for every document."""
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")
