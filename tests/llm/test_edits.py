import random

from tests.llm.helpers import clash, docs
from tidemark.llm import edits as E
from tidemark.llm.bpe import tokenizer

PARTS = ["a", "bc", "the", "th", " ", " ", "  ", "\n", "\t", " ", "1", "23", "'s", "'ll", "'", "!", "..", "é", "re", "x"]


def whole(tok, text):
    return sum(len(i) // 4 for i in tok.encode_each(tok.pattern.findall(text)))


def test_trees_equal_a_full_count_after_every_edit():
    tok, rnd = tokenizer(), random.Random(5)
    make = lambda n: "".join(rnd.choices(PARTS, k=rnd.randint(0, n)))
    for _ in range(2500):
        now = make(40)
        tree = E.CountTree(now, tok.pattern.findall(now), tok)
        for _ in range(rnd.randint(1, 6)):
            a = rnd.randint(0, len(now))
            b = rnd.randint(a, min(len(now), a + rnd.choice([0, 1, 3, 10])))
            new = make(4)
            tree.edit(a, b, new)
            now = now[:a] + new + now[b:]
            assert tree.current() == now and tree.length == len(now)
            assert [p for s in range(max(1, len(tree.starts) - 1)) for p in tree.pieces_of(s)] == tok.pattern.findall(now)
        tree.settle()
        assert tree.count == whole(tok, now)


def test_only_touched_regions_are_read_again():
    tok, text = tokenizer(), "the quick brown fox " * 20_000
    tree = E.CountTree(text, tok.pattern.findall(text), tok)
    for at in range(len(text) - 10, 0, -5000):
        tree.edit(at, at + 3, "XY z")
    tree.settle()
    assert tree.read < 20 * (len(text) // 5000 + 1) and tree.count == whole(tok, tree.current())


def test_order_of_edits():
    assert E.in_order([(5, 9, "x"), (0, 3, "y"), (2, 4, "z"), (20, 30, "w"), (-5, 0, "v")], 8) == [(0, 0, "v"), (0, 3, "y"), (5, 8, "x")]


def test_overlapping_personal_data_is_one_edit():
    from tidemark.llm import pii
    for text in ("at 10.0.0.1@host.com  now", "john@mail.example dot com", "jоhn@example.com"):
        now = text
        for a, b, new in reversed(E.in_order(E.cleaning_edits(text), len(text))):
            now = now[:a] + new + now[b:]
        assert now == pii.redact(text).replace("  ", " ")
    assert E.cleaning_edits("10.0.0.1@host.com") == [(0, 17, "[EMAIL]")]


def test_rows_nulls_and_clashing_columns(spark):
    tok = tokenizer()
    rows = [(1, "mail a@b.c  now"), (1, "mail a@b.c  now"), (None, "x   y"), (2, None), (3, ""), (4, "plain text"), (5, "a@b.c " * 3000)]
    got = E.count_edited(clash(docs(spark, rows), "id", "n_edits", "n_tokens")).collect()
    clean = lambda t: "".join(("[EMAIL]" if p == "a@b.c" else p) for p in __import__("re").split(r"(a@b\.c)", t)).replace("   ", " ").replace("  ", " ")
    assert sorted((str(r.doc_id), r.n_tokens, r.n_tokens_edited) for r in got) == sorted((str(i), whole(tok, t or ""), whole(tok, clean(t or ""))) for i, t in rows)
    assert all(r.n_pieces_read == 0 for r in got if r.n_edits == 0)
    assert E.count_edited(docs(spark, [])).count() == 0
