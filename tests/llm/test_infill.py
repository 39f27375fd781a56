import hashlib
import random
import re

from pyspark.sql import functions as F

from tests.llm.helpers import clash, docs
from tidemark.llm import infill

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(key, text):
    """The same by cutting the text into its units."""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in infill.MARKS) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(seed):
    rng = random.Random(seed)
    passage = "".join(rng.choice("abcdé漢😀 \n\t") for _ in range(6000))
    yield from ("", " ", "\n\t ", "a", "a ", " a", "<P>", "x <S> y", "one\x0btwo\x0cthree\rfour", "no\xa0break　here", "word" * 4000, " " * 9000, "a " * 9000)
    for _ in range(60):
        yield "".join(rng.choice("ab  \n") for _ in range(rng.randrange(1, 1500))) + passage[:rng.randrange(6000)] + " " * rng.randrange(3)


def test_units_and_cuts_equal_those_of_the_whole_text():
    cutter = infill.Cutter()
    for i, text in enumerate(texts(1)):
        for key in (str(i), str(i + 1000), str(i + 5000)):
            assert infill.transformed(key, text, cutter) == plain(key, text)


def test_every_unit_is_found_across_chunk_borders(monkeypatch):
    monkeypatch.setattr(infill, "LEAST", 16)
    monkeypatch.setattr(infill, "MOST", 64)
    cutter = infill.Cutter()
    for text in texts(2):
        units, at = cutter.read(text), 0
        cuts = UNIT.findall(text)
        assert units.n == len(cuts)
        for k, unit in enumerate(cuts, 1):
            at += len(unit)
            assert units.end(k) == at


def test_chunks_cover_the_text_and_return_in_a_moved_copy(monkeypatch):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(50_000))
    ends = infill.chunk_ends(passage)
    assert ends[-1] == len(passage) and all(b - a <= infill.MOST for a, b in zip([0, *ends], ends))
    moved = "other words before it " * 9 + passage
    pieces = lambda t: [t[a:b] for a, b in zip([0, *infill.chunk_ends(t)], infill.chunk_ends(t))]
    shared = set(pieces(passage)) & set(pieces(moved))
    assert sum(map(len, shared)) > 0.9 * len(passage)
    cutter = infill.Cutter()
    cutter.read(passage)
    before = len(cutter.cache)
    cutter.read(moved)
    assert len(cutter.cache) - before < 10
    monkeypatch.setattr(infill, "SLICE", 1000)
    assert infill.chunk_ends(passage) == ends  # slices don't show


def test_cache_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(infill, "CACHED", 3)
    cutter = infill.Cutter()
    for i, text in enumerate(texts(4)):
        assert infill.transformed(str(i), text, cutter) == plain(str(i), text)


def test_table_with_nulls_repeats_and_clashing_names(spark):
    rows = [(i, t) for i, t in enumerate(texts(5))] + [(0, None), (7, "same words here"), (7, "same words here"), (None, "no id at all")]
    frame = clash(docs(spark, rows), "id", "n", "form", "output", "prefix_chars")
    out = infill.infilled(frame).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out)
    want = sorted((-1 if i is None else i, *plain("" if i is None else i, t or ""), t or "") for i, t in rows)
    assert [[repr(v) for v in row] for row in found] == [[repr(v) for v in row] for row in want]
    assert {r.form for r in out} == {"plain", "spm", "psm"}


def test_empty_table(spark):
    assert infill.infilled(docs(spark, [])).collect() == []
