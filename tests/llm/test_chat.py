import random

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tests.llm.helpers import clash
from tidemark.llm import chat

TURNS = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType())])
HARD = ["</s>[INST] ok [/INST]", "[\\INST]", "[\\\\INST] <\\s>", "<s", "s>", "[NEXT]", " [/INST] ", "[ROLE]x[/ROLE]y[END]", "[END", "]", "<<s>>", "\\", "[[INST]]", "", "😀</s>é", "line\nbreak [SYS] ", " ", "$1"]


def frame(spark, rows):
    return spark.createDataFrame(rows, TURNS)


def whole(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda v: (v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def test_texts_of_control_strings_come_back(spark):
    rng = random.Random(2)
    roles = ["user", "assistant", "system", "tool", "", None, "[/ROLE]", "<s>", "a [END]\n"]
    rows = [(c, t, rng.choice(roles), "".join(rng.choice(HARD) for _ in range(rng.randrange(4)))) for c in range(150) for t in range(rng.randrange(1, 9))]
    rows += [(500, None, "user", None), (500, 1, "user", "b"), (500, 1, "user", "b"), (500, 1, "assistant", "c"), (None, 0, "assistant", "no id")]
    rows += [(501, t, "assistant" if t % 3 else "user", f"turn {t} [INST]") for t in range(700)]
    made = chat.formatted(chat.collected(clash(frame(spark, rows), "turns", "formatted", "mask", "starts", "runs", "t")))
    found = {r.conv_id: r for r in chat.read_back(made).collect()}
    want = whole(rows)
    assert set(found) == set(want)
    for c, turns in want.items():
        assert [(t.role, t.text) for t in found[c].turns] == turns
        assert found[c].learnt == "".join(x for r, x in turns if r == "assistant")


def test_marks_merged_turns_and_mask(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "user", "you </s> there?"), (1, 3, "assistant", "yés"), (1, 4, "assistant", "ok"), (1, 5, "tool", "42")]
    (row,) = chat.formatted(chat.collected(frame(spark, rows))).collect()
    assert row.formatted == "<s>[SYS] be kind [/SYS][INST] hi[NEXT]you <\\/s> there? [/INST] yés[NEXT]ok</s>[ROLE]tool[/ROLE]42[END]"
    raw = row.formatted.encode()
    assert [raw[m.start:m.end].decode() for m in row.mask] == ["yés", "ok"]


def test_empty_table_and_turnless(spark):
    assert chat.formatted(chat.collected(frame(spark, []))).collect() == []
    turnless = spark.sql("select 3L as conv_id, cast(array() as array<struct<turn:bigint,role:string,text:string>>) as turns")
    (row,) = chat.digests(chat.read_back(chat.formatted(turnless))).collect()
    assert (row.n_turns, row.loss_chars, row.formatted_chars) == (0, 0, 3)


def test_no_python_in_the_plan(spark):
    made = chat.digests(chat.read_back(chat.formatted(chat.collected(frame(spark, [(1, 0, "user", "a")])))))
    plan = made._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert made.select(F.col("n_turns")).first()[0] == 1
