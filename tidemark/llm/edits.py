"""Operator 8: token counts that follow edits, by a segment tree over a document's pre-tokens."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import pii
from tidemark.llm.bpe import VOCABULARY, Tokenizer, tokenizer
from tidemark.llm.common import small_batches, table, tidy

#: Pre-tokens before an edit that are read again: a run of white space is cut by what follows it, and gives at most
#: two pre-tokens and the space of the next.
CONTEXT = 3
AHEAD = 4  # slots read beyond an edit at first; doubled until the new cuts meet the old ones
PIECES = 200_000  # pre-tokens whose trees are held at once

Edit = tuple[int, int, str]


class CountTree:
    """Sums of characters and tokens over the slots of a document, in an implicit binary tree.

    A slot starts as one pre-token. An edit deals the new pre-tokens of its region over the region's slots (all into
    the first, if there are too few), so the tree keeps its shape and only sums above touched slots change. Token sums
    wait for settle(), so that the new pre-tokens of many documents can be encoded together.
    """

    def __init__(self, text: str, pieces: list[str], tok: Tokenizer):
        self.text, self.tok = text, tok
        self.starts = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)), out=self.starts[1:])
        self.width = 1 << max(0, (len(pieces) - 1).bit_length())
        self.chars = self._tree(np.diff(self.starts))
        self.tokens = self._tree(np.fromiter(map(len, tok.encode_each(pieces)), np.int64, len(pieces)) // 4)
        self.parts: dict[int, list[str]] = {}  # pre-tokens of the slots that were touched
        self.open: set[int] = set()
        self.read = 0

    def _tree(self, leaves: np.ndarray) -> np.ndarray:
        sums = np.zeros(2 * self.width, np.int64)
        sums[self.width:self.width + len(leaves)] = leaves
        level = self.width
        while level > 1:
            sums[level // 2:level] = sums[level:2 * level].reshape(-1, 2).sum(axis=1)
            level //= 2
        return sums

    @staticmethod
    def _set(sums: np.ndarray, node: int, value: int) -> None:
        by = value - int(sums[node])
        while node and by:
            sums[node] += by
            node //= 2

    def _slot(self, at: int) -> tuple[int, int]:
        """(slot, its start) of the character at `at`."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at - start >= self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node - self.width, start

    def pieces_of(self, slot: int) -> list[str]:
        held = self.parts.get(slot)
        if held is not None:
            return held
        return [self.text[self.starts[slot]:self.starts[slot + 1]]] if slot + 1 < len(self.starts) else []

    @property
    def length(self) -> int:
        return int(self.chars[1])

    @property
    def count(self) -> int:
        return int(self.tokens[1])

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from `start` to `end` by `new`.

        Pre-tokens are cut again from CONTEXT before the edit until a cut falls on an old one: what follows is cut
        from the same place in the same text, so it stays.
        """
        total = self.length
        if not total:
            self._write([0], self.tok.pattern.findall(new))
            return
        first, low = self._slot(min(start, total - 1))
        seen = sum(low + c <= start for c in accumulate(map(len, self.pieces_of(first))))
        while seen < CONTEXT and low:
            first, low = self._slot(low - 1)
            seen += len(self.pieces_of(first))
        slots, stops, stop, ahead = [], [], low, AHEAD
        beyond = 0
        while True:
            while stop < total and beyond < ahead:
                slot, begin = self._slot(stop)
                stop = begin + int(self.chars[self.width + slot])
                slots.append(slot)
                stops.append(stop)
                beyond += stop > end
            region = "".join(p for s in slots for p in self.pieces_of(s))
            region = region[:start - low] + new + region[end - low:]
            shift = len(new) - (end - start)
            cuts = {s + shift - low: i for i, s in enumerate(stops) if s >= end}
            pieces: list[str] = []
            for m in self.tok.pattern.finditer(region):
                pieces.append(m.group())
                # two characters on, the end of the region can't have been taken for the end of the text
                if m.end() in cuts and m.end() <= len(region) - 2 and m.end() >= start - low + len(new):
                    self._write(slots[:cuts[m.end()] + 1], pieces)
                    return
            if stop == total:
                self._write(slots, pieces)
                return
            ahead *= 2

    def _write(self, slots: list[int], pieces: list[str]) -> None:
        self.read += len(pieces)
        spread = len(slots) >= len(pieces)
        for i, slot in enumerate(slots):
            own = pieces[i:i + 1] if spread else pieces if i == 0 else []
            self.parts[slot] = own
            self.open.add(slot)
            self._set(self.chars, self.width + slot, sum(map(len, own)))

    def open_pieces(self) -> list[str]:
        return [p for s in self.open for p in self.parts[s]]

    def settle(self) -> None:
        """Bring the token sums of the touched slots up to date."""
        for slot in self.open:
            self._set(self.tokens, self.width + slot, sum(len(b) // 4 for b in self.tok.encode_each(self.parts[slot])))
        self.open.clear()

    def current(self) -> str:
        return "".join(p for s in range(max(1, len(self.starts) - 1)) for p in self.pieces_of(s))


def in_order(edits: list[Edit], length: int) -> list[Edit]:
    """Edits by position, cut to the text; one that overlaps an earlier one is left out."""
    low, out = 0, []
    for a, b, new in sorted(edits):
        a, b = max(0, a), min(length, b)
        if low <= a <= b:
            out.append((a, b, new))
            low = b
    return out


def _edited(jobs: list[tuple[str, list[str], list[Edit]]], tok: Tokenizer) -> list[tuple[int, int, int, int, int]]:
    """(edits, tokens before, tokens after, pre-tokens, pre-tokens read again) of every text."""
    tok.learn_all(p for _, p, _ in jobs)
    rows, changed = [], []
    for i, (text, pieces, edits) in enumerate(jobs):
        if not edits:  # a tree serves edits only
            count = sum(map(len, tok.encode_each(pieces))) // 4
            rows.append((0, count, count, len(pieces), 0))
            continue
        tree = CountTree(text, pieces, tok)
        before = tree.count
        for a, b, new in reversed(edits):  # from the end, so that positions stay true
            tree.edit(a, b, new)
        rows.append((len(edits), before, before, len(pieces), tree.read))
        changed.append((i, tree))
    tok.learn_all(t.open_pieces() for _, t in changed)
    for i, tree in changed:
        tree.settle()
        rows[i] = (*rows[i][:2], tree.count, *rows[i][3:])
    return rows


def _mapper(vocabulary: str, edits_of: Callable[[str], list[Edit]]):
    def run(batches):
        tok = tokenizer(vocabulary)
        for pdf in batches:
            rows, jobs, size = [], [], 0
            for text in pdf["text"]:
                text = text or ""
                parts = list(tok.slices(text))
                pieces = parts[0] if len(parts) == 1 else [p for part in parts for p in part]
                jobs.append((text, pieces, in_order(edits_of(text), len(text))))
                size += len(pieces)
                if size >= PIECES:
                    rows += _edited(jobs, tok)
                    jobs, size = [], 0
            rows += _edited(jobs, tok)
            out = pd.DataFrame(rows, columns=["n_edits", "n_tokens", "n_tokens_edited", "n_pieces", "n_pieces_read"])
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out

    return run


_BLANKS = re.compile(r"[ \t]{2,}")


def cleaning_edits(text: str) -> list[Edit]:
    """Personal data becomes its kind in brackets (overlapping spans as one, as in pii.redact), a run of blanks one space."""
    found = [(a, b, f"[{pii.KINDS[k].upper()}]") for a, k, b in pii.merged(pii.all_spans(text)[1])]
    if "  " in text or "\t" in text:
        found += [(m.start(), m.end(), " ") for m in _BLANKS.finditer(text)]
    return found


def count_edited(docs: DataFrame, edits_of: Callable[[str], list[Edit]] = cleaning_edits, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of `docs`: id, n_edits, n_tokens, n_tokens_edited, n_pieces, n_pieces_read.

    `edits_of` gives (start, end, replacement) in positions of the text; edits are put in order, and one that overlaps
    an earlier one is left out. n_pieces_read tells how many pre-tokens were cut and encoded again. No shuffle. Null
    texts count as empty; null ids and repeated rows are kept; other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(
        tidy(_mapper(vocabulary, edits_of)), "id string, n_edits long, n_tokens long, n_tokens_edited long, n_pieces long, n_pieces_read long")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after cleaning."""
    return count_edited(table(spark, sf_dir, "documents"))
