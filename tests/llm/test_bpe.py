import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.llm.helpers import clash, docs
from tidemark.llm import bpe

PIECES = ["a", "b", "aa", "th", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "é", "😀", "1", "23", "'s", "'ll", "!", "..", "ß", "​", "中", "<|endoftext|>", "\r", "\x0b"]


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(1)
    mixed = ["".join(rnd.choices(PIECES, k=rnd.randint(0, 60))) for _ in range(3000)]
    long = ["a" * 20_000, "ab" * 10_000, "\n" * 5000, " " * 5000, "".join(rnd.choices("abcdefgh", k=30_000)), "th" * 7 + "e" * 9]
    return [*mixed, *long, "".join(rnd.choices("etaoinsrhl", k=40))]


def test_ids_equal_the_library_and_decode_to_the_text(reference):
    tok = bpe.tokenizer()
    for text, (_, ids) in zip(texts(), bpe.encode_texts(texts(), tok)):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert tok.decode(ids) == text.encode()


def test_slices_and_small_chunks_give_the_same(reference, monkeypatch):
    some = texts()[:200] + ["word " * 500, "", None]
    want = [ids for _, ids in bpe.encode_texts(some, bpe.tokenizer())]
    monkeypatch.setattr(bpe, "PIECES", 7)
    monkeypatch.setattr(bpe, "_LONG", 20)
    monkeypatch.setattr(bpe, "CACHED", 50)
    got = list(bpe.encode_texts(some, bpe.tokenizer()))
    assert [i for i, _ in got] == list(range(len(some))) and [ids for _, ids in got] == want


def test_ranks_that_open_lower_ranks(tmp_path):
    """A vocabulary whose merges go back: after bc (rank 258) comes abc (rank 257)."""
    ranks = {bytes([b]): b for b in range(256)} | {b"xx": 256, b"abc": 257, b"bc": 258, b"bcbc": 259, b"abcx": 260}
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()))
    tok = bpe.Tokenizer(str(path), public_tokenizers.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcx", k=rnd.randint(1, 30))) for _ in range(500)]
    assert [np.frombuffer(i, "<u4").tolist() for i in tok.merge([w.encode() for w in words])] == [ref.encode_ordinary(w) for w in words]


def test_rank_queue_pops_in_order():
    queue, rnd = bpe.RankQueue(300_000), random.Random(2)
    ranks = [rnd.randrange(300_000) for _ in range(500)]
    for r in ranks:
        queue.push(r, np.array([r]))
    popped = []
    while (got := queue.pop()) is not None:
        popped += [got[0]] * len(got[1])
    assert popped == sorted(ranks)


def test_rows_nulls_and_clashing_columns(spark, reference):
    rows = [(1, "Hello  world\n"), (1, "Hello  world\n"), (None, "x"), (2, None), (3, ""), (4, "long " * 5000)]
    df = clash(docs(spark, rows), "id", "c0", "token_ids", "decoded", "n_tokens")
    got = bpe.digests(bpe.encode_decode(df)).drop("token_ids").collect()
    want = []
    for i, t in rows:
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.encode_decode(docs(spark, [])).count() == 0
