"""Operator 6: byte-level BPE with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, table, tidy

VOCABULARY = "byte_bpe_50k.tiktoken"
PIECES = 200_000  # pre-tokens that are encoded at once
CACHED = 200_000  # pre-tokens a worker remembers, the recent ones
_LONG = 4_000_000  # characters of a text above which its pre-tokens are drawn in slices


class RankQueue:
    """Buckets of list positions by merge rank; three levels of 64-bit words tell which buckets hold something."""

    def __init__(self, ranks: int):
        self.words = [[0] * (ranks // 64 + 1)]
        while len(self.words[-1]) > 1:
            self.words.append([0] * ((len(self.words[-1]) - 1) // 64 + 1))
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.words:
            rank, bit = divmod(rank, 64)
            before = level[rank]
            level[rank] = before | (1 << bit)
            if before:
                break

    def push_by_rank(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for rank, a, b in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)]):
            self.push(rank, positions[a:b])

    def pop(self) -> tuple[int, list[np.ndarray]] | None:
        """The lowest rank that has positions, by find-first-set from the top word down."""
        if not self.words[-1][0]:
            return None
        at = 0
        for level in reversed(self.words):
            word = level[at]
            at = at * 64 + (word & -word).bit_length() - 1
        rank = at
        for level in self.words:
            at, bit = divmod(at, 64)
            level[at] &= ~(1 << bit)
            if level[at]:
                break
        return rank, self.buckets.pop(rank)


class Tokenizer:
    """Encodes and decodes by merge ranks; `pattern` cuts a text into pre-tokens that are encoded separately."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self._base = self.size + 1  # one more for the end of a list
        keys, merged, self.early = [], [], np.zeros(self.size, bool)
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left * self._base + right)
                    merged.append(rank)
                # a part that ranks after the whole: merging it may open a merge of lower rank
                for part in (left, right):
                    if part is not None and part > rank:
                        self.early[part] = True
        order = np.argsort(keys)
        self._keys, self._merged = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self._base + right
        at = np.searchsorted(self._keys, key)
        at[at == len(self._keys)] = 0
        return np.where(self._keys[at] == key, self._merged[at], self.size)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of every piece, as little-endian unsigned 32-bit integers.

        All pieces share one queue: their bytes form linked lists in one array, a list ends at the sentinel. The
        positions of the lowest rank are merged together, left to right where they overlap; entries whose pair has
        changed since are stale and skipped. A rank that could open a lower one goes one position a piece at a time.
        """
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        sizes = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        piece = np.repeat(np.arange(len(pieces)), sizes)
        token = np.append(self.bytes[data], self.size)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends[sizes > 0] - 1] = n
        before[(ends - sizes)[sizes > 0]] = n
        before = np.append(before[:n], n)
        alive = np.ones(n, bool)
        pair = np.append(self._pair_ranks(token[:n], token[after[:n]]), self.size)
        queue = RankQueue(self.size)
        some = np.flatnonzero(pair < self.size)
        if len(some):
            queue.push_by_rank(pair[some], some)
        while (got := queue.pop()) is not None:
            rank, held = got
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[pair[at] == rank]
            if self.early[rank] and len(at) > 1:
                first = np.append(True, piece[at[1:]] != piece[at[:-1]])
                if not first.all():
                    queue.push(rank, at[~first])
                    at = at[first]
            if not len(at):
                continue
            if len(at) > 1:
                linked = np.append(False, at[1:] == after[at[:-1]])
                if linked.any():  # of overlapping pairs every second one, from the left
                    index = np.arange(len(at))
                    at = at[(index - np.maximum.accumulate(np.where(linked, 0, index))) % 2 == 0]
            right = after[at]
            following = after[right]
            token[at] = rank
            after[at] = following
            before[following] = at
            alive[right] = False
            pair[right] = self.size
            earlier = before[at]
            changed = np.concatenate([at, earlier[earlier < n]])
            new = self._pair_ranks(token[changed], token[after[changed]])
            pair[changed] = new
            open_ = new < self.size
            if open_.any():
                queue.push_by_rank(new[open_], changed[open_])
        ids = token[:n][alive].astype("<u4").tobytes()
        stops = (4 * np.cumsum(np.bincount(piece[alive], minlength=len(pieces)))).tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of `pieces` into the cache."""
        known, other = self.ranks, []
        for p in pieces:
            rank = known.get(p.encode())
            if rank is None:
                other.append(p)
            else:
                self.cache[p] = rank.to_bytes(4, "little")
        if other:
            self.cache.update(zip(other, self.merge([p.encode() for p in other])))

    def learn_all(self, lists) -> None:
        """Put all pre-tokens of some lists into the cache.

        When it holds half of CACHED it becomes the older half, from which what is met again moves over.
        """
        wanted = set().union(*lists)
        new = wanted - self.cache.keys()
        if len(self.cache) + len(new) > CACHED // 2:
            self.older, self.cache, new = self.cache, {}, wanted
        again = new & self.older.keys()
        self.cache.update((p, self.older[p]) for p in again)
        self.learn(new - again)

    def encode_each(self, pieces: list[str]) -> list[bytes]:
        """Ids of every pre-token of a list."""
        try:
            return list(map(self.cache.__getitem__, pieces))
        except KeyError:
            self.learn_all([pieces])
            return list(map(self.cache.__getitem__, pieces))

    def encode_many(self, lists: list[list[str]]) -> list[bytes]:
        """Ids of every list of pre-tokens."""
        self.learn_all(lists)
        get = self.cache.__getitem__
        return [b"".join(map(get, pieces)) for pieces in lists]

    def slices(self, text: str):
        """The pre-tokens of a text, in lists of bounded length."""
        if len(text) <= _LONG:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while part := list(islice(found, PIECES)):
            yield part

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str = VOCABULARY) -> Tokenizer:
    """Built once per worker. `vocabulary` is a name the installed tokenizer package knows, or a path with a slash."""
    import public_tokenizers

    return Tokenizer(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)


def encode_texts(texts: list[str | None], tok: Tokenizer):
    """Yields (index, ids) in order; pre-tokens of about PIECES are encoded together."""
    held: list[tuple[int, list[str]]] = []
    count, done, parts = 0, 0, []

    def flush(last: bool):
        nonlocal held, count, done, parts
        for (i, _), ids in zip(held, tok.encode_many([p for _, p in held])):
            while done < i:
                yield done, b"".join(parts)
                done, parts = done + 1, []
            parts.append(ids)
        held, count = [], 0
        if last:
            while done < len(texts):
                yield done, b"".join(parts)
                done, parts = done + 1, []

    for i, text in enumerate(texts):
        for pieces in tok.slices(text or ""):
            held.append((i, pieces))
            count += len(pieces)
            if count >= PIECES:
                yield from flush(False)
    yield from flush(True)


def _mapper(vocabulary: str):
    def run(batches):
        tok = tokenizer(vocabulary)
        for batch in batches:
            kept, start, ids_out, decoded, size = batch.columns[:-1], 0, [], [], 0
            for i, ids in encode_texts(batch.columns[-1].to_pylist(), tok):
                ids_out.append(ids)
                decoded.append(tok.decode(ids))
                size += len(ids)
                if size > 1 << 22 or i + 1 == batch.num_rows:
                    columns = [*(c.slice(start, len(ids_out)) for c in kept), pa.array(ids_out, pa.binary()), pa.array(decoded, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "token_ids", "decoded"])
                    start, ids_out, decoded, size = i + 1, [], [], 0

    return run


def encode_decode(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of `docs`: the `keep` columns, `token_ids` (little-endian unsigned 32-bit integers), `decoded` (bytes).

    No shuffle: every text is encoded where it is read, whole. Null texts count as empty and give no ids; null ids and
    repeated rows are kept; columns outside `keep` are ignored, whatever their names. Special tokens are ordinary text.
    """
    small_batches(docs.sparkSession)
    placed = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    kinds = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    out = placed.mapInArrow(tidy(_mapper(vocabulary)), ", ".join([*kinds, "token_ids binary", "decoded binary"]))
    return out.toDF(*keep, "token_ids", "decoded")


def digests(encoded: DataFrame) -> DataFrame:
    """`encoded` with n_tokens, ids_sha256 and decoded_sha256 in place of `decoded`."""
    return encoded.select("*", F.floor(F.octet_length("token_ids") / F.lit(4)).cast("long").alias("n_tokens"),
                          F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")).drop("decoded")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes, for every document."""
    return digests(encode_decode(table(spark, sf_dir, "documents"))).drop("token_ids")
