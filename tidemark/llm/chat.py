"""Operator 13: relational chat formatting, in Spark expressions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table


@dataclass(frozen=True)
class Template:
    """What marks the turns: role -> (open, close), the marks of other roles, and the one between merged turns.

    Every mark holds a control string, but for the opening ones that are a space: a block begins where the one before ends.
    """

    begin: str = "<s>"
    roles: tuple[tuple[str, str, str], ...] = (("user", "[INST] ", " [/INST]"), ("assistant", " ", "</s>"), ("system", "[SYS] ", " [/SYS]"))
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[END]")
    between: str = "[NEXT]"
    learnt: str = "assistant"

    @property
    def controls(self) -> tuple[str, ...]:
        marks = [self.begin, self.between, *self.other, *[m for _, a, b in self.roles for m in (a, b)]]
        return tuple(m.strip() for m in marks if m.strip())

    def _pattern(self, least: str) -> str:
        """A control string with backslashes behind its first character, the first one of them apart if `least` says so."""
        heads = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        return f"([{heads}]){least}(\\\\*)({'|'.join(re.escape(c[1:]) for c in self.controls)})"

    def escaped(self, text: Column) -> Column:
        """One backslash more behind the first character of every control string, so that none is left as it was."""
        return F.regexp_replace(text, self._pattern(""), r"$1\\$2$3")

    def plain(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(r"\\"), "$1$2$3")

    def open(self, role: Column) -> Column:
        out = F.concat(F.lit(self.other[0]), self.escaped(role), F.lit(self.other[1]))
        return F.coalesce(*[F.when(role == r, F.lit(a)) for r, a, _ in self.roles], out)

    def close(self, role: Column) -> Column:
        return F.coalesce(*[F.when(role == r, F.lit(b)) for r, _, b in self.roles], F.lit(self.other[2]))

    @property
    def blocks(self) -> str:
        """A block, whichever role it has; texts hold no control string, so the first closing mark is its end."""
        known = [f"{re.escape(a)}.*?{re.escape(b)}" for _, a, b in sorted(self.roles, key=lambda r: -len(r[1].strip()))]
        return "(?s)" + "|".join([f"{re.escape(self.other[0])}.*?{re.escape(self.other[2])}", *known])


def collected(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): every conversation's turns as sorted structs (turn, role, text).

    Null roles and texts are empty; null turn numbers come first; equal ones stand by role, then text; repeated rows are
    turns of their own; rows without an id are one conversation of id null. Other columns are ignored.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return turns.select(F.col(id_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def formatted(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, formatted, mask) of `conversations` (conv_id, turns as of `collected`).

    Adjacent turns of one role become one block, with a mark between their texts. `mask` lists what the loss is taken on:
    (start, end) in UTF-8 bytes of `formatted`, one span a turn of the learnt role, around its escaped text alone.
    A conversation is one row, so one task holds it whole; conversations without turns give the begin mark.
    """
    starts = F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 or turns[i].role <> turns[greatest(i - 1, 0)].role)")
    runs = F.expr("transform(starts, (s, j) -> struct(turns[s].role as role, slice(turns, s + 1, coalesce(get(starts, j + 1), size(turns)) - s).text as texts))")

    def piece(text: Column, learnt: Column) -> Column:
        return F.struct(text.alias("text"), learnt.alias("learnt"))

    off = F.lit(False)

    def block(run: Column) -> Column:
        mine = run["role"] == template.learnt
        texts = F.transform(run["texts"], lambda t, i: F.array(
            piece(F.when(i == 0, template.open(run["role"])).otherwise(F.lit(template.between)), off), piece(template.escaped(t), mine)))
        return F.concat(F.flatten(texts), F.array(piece(template.close(run["role"]), off)))

    spans = F.aggregate(
        "pieces", F.struct(F.lit(len(template.begin.encode())).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans")),
        lambda acc, p: F.struct((acc["at"] + F.octet_length(p["text"])).alias("at"), F.when(p["learnt"], F.array_append(acc["spans"], F.struct(
            acc["at"].alias("start"), (acc["at"] + F.octet_length(p["text"])).alias("end")))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    filled = conversations.withColumn("starts", F.when(F.size("turns") > 0, starts).otherwise(F.expr("cast(array() as array<int>)"))).withColumn("runs", runs)
    pieces = filled.select("conv_id", F.flatten(F.transform("runs", block)).alias("pieces"))
    return pieces.select("conv_id", F.concat(F.lit(template.begin), F.array_join(F.col("pieces.text"), "")).alias("formatted"), spans.alias("mask"))


def read_back(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, turns as (role, text), learnt text) of (conv_id, formatted, mask): what `formatted` was made from."""
    first, middle, last = template.other

    def turns(block: Column) -> Column:
        head = [(r, block.startswith(a) & block.endswith(b), a, b) for r, a, b in template.roles]
        inner = F.expr(f"length('{last}')")
        named = F.instr(block, middle)  # other roles only
        role = F.coalesce(*[F.when(fits, F.lit(r)) for r, fits, _, _ in head], template.plain(F.substr(block, F.lit(len(first) + 1), named - len(first) - 1)))
        body = F.coalesce(*[F.when(fits, F.substr(block, F.lit(len(a) + 1), F.length(block) - len(a) - len(b))) for _, fits, a, b in head],
                          F.substr(block, named + len(middle), F.length(block) - named - len(middle) + 1 - inner))
        return F.transform(F.split(body, re.escape(template.between), -1), lambda t: F.struct(role.alias("role"), template.plain(t).alias("text")))

    found = F.flatten(F.transform(F.regexp_extract_all("formatted", F.lit(template.blocks), F.lit(0)), turns))
    learnt = F.transform("mask", lambda m: template.plain(F.substring(F.col("raw"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")).cast("string")))
    return chats.withColumn("raw", F.col("formatted").cast("binary")).select("conv_id", found.alias("turns"), F.array_join(learnt, "").alias("learnt"), F.length("formatted").alias("formatted_chars"))


def digests(back: DataFrame) -> DataFrame:
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
                       F.sha2("learnt", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))


PLANTED = -7  # a conversation whose texts are control strings


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that says the template's own control strings, formatted and read back."""
    planted = spark.range(2).selectExpr(f"{PLANTED}L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", "'</s>[INST] ok [/INST]' as text")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return digests(read_back(formatted(collected(turns))))


_SQL_ESCAPED = r"""regexp_replace({}, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|SYS\]|/SYS\]|ROLE\]|/ROLE\]|END\]|NEXT\])', '\1\\\2\3', 'g')"""
SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PLANTED}, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(i, r)
), placed AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before, lead(role) OVER w AS after FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
  SELECT *, length({_SQL_ESCAPED.format('text')})
    + CASE WHEN before = role THEN 6 WHEN role = 'user' THEN 7 WHEN role = 'assistant' THEN 1 WHEN role = 'system' THEN 6 ELSE 13 + length({_SQL_ESCAPED.format('role')}) END
    + CASE WHEN after = role THEN 0 WHEN role = 'user' THEN 8 WHEN role = 'assistant' THEN 4 WHEN role = 'system' THEN 7 ELSE 5 END AS chars
  FROM placed
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256, (3 + sum(chars))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
