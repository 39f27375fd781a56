"""The pipeline against plain versions of its stages, on a small made-up corpus."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import PROSE
from tests.llm.test_decontaminate import slow as overlaps
from tests.llm.test_pii import slow as spans
from tests.llm.test_simhash import roots, slow_fingerprint
from tidemark.llm import pii
from tidemark.llm.bpe import tokenizer

INSULTS = ["grobnik", "grobnikal", "vastoxu", "vastoxe"]


def corpus():
    rnd = random.Random(11)
    bench = [(i, " ".join("".join(rnd.choices("bcdfgaeiou", k=6)) for _ in range(25))) for i in range(5)]
    rows, toxic = [], {}
    for i in range(420):
        words = [rnd.choice(PROSE) + rnd.choice("aeiou") + rnd.choice("bcdfg") for _ in range(rnd.randint(40, 120))]
        toxic[i] = int(rnd.random() < 0.3)
        if toxic[i]:
            for _ in range(6):
                words.insert(rnd.randrange(len(words)), rnd.choice(INSULTS))
        if i % 17 == 3:
            words[10:10] = bench[i % 5][1].split()
        if i % 13 == 2:
            words.insert(5, "mail me@example.com or +1 (555) 123-4567 now")
        rows.append([i, " ".join(words), "en", f"s{i % 3}", 0])
    for i in range(420, 440):  # exact and near copies
        rows.append([i, rows[i - 300][1] if i % 2 else rows[i - 300][1].replace(" ", "  ", 2), "en", "s", 0])
        toxic[i] = toxic[i - 300]
    rows += [[1000, None, None, None, None], [1001, "", "en", "s", 0], [1002, "word " * 30_000, "en", "s", 0]]
    return [[i, t, a, b, None if t is None else len(t)] for i, t, a, b, _ in rows], toxic, bench


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows, toxic, bench = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items() if i % 4], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_equal_plain_versions(spark, folder):
    rows, toxic, bench = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {r[0]: r for r in rows}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = {r.doc_id: tuple(r) for r in docs.collect()}
    clean = {i for i in left if not toxic.get(i)}
    assert set(kept["toxicity"]) == clean
    fp = {i: slow_fingerprint(left[i][1]) for i in clean if i != 1002}
    fp[1002] = kept and __import__("tidemark.llm.simhash", fromlist=["fingerprint"]).fingerprint(left[1002][1]) % (1 << 64)
    ids = sorted(clean)
    root = roots(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if bin(fp[a] ^ fp[b]).count("1") <= 3])
    single = {i for i in ids if root[i] == i}
    assert set(kept["simhash_near_dedup"]) == single and len(single) < len(clean)
    bad = {d for d, _ in overlaps([(i, left[i][1]) for i in single if i != 1002], bench)}
    assert set(kept["benchmark_decontamination"]) == single - bad and bad
    changed = 0
    for i, row in kept["pii"].items():
        text = left[i][1]
        new = pii.redact(text)
        assert row == (i, new, left[i][2], left[i][3], left[i][4] if new == text else len(new))
        assert text is None or i == 1002 or (new != text) == bool(spans(text))
        changed += new != text
    assert changed and set(kept["pii"]) == single - bad
    tok = tokenizer()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in out} == set(kept["pii"])
    for r in out:
        text = kept["pii"][r.doc_id][1] or ""
        ids_ = b"".join(tok.encode_each(tok.pattern.findall(text)))
        assert (r.token_ids, r.n_tokens, r.ids_sha256) == (ids_, len(ids_) // 4, hashlib.sha256(ids_).hexdigest()) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert np.frombuffer(r.token_ids, "<u4").size == r.n_tokens
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out))


def test_empty_documents(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").filter(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
