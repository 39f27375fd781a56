"""Runs of bits in rows of 64-bit words, in built-in expressions that code generation takes whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64
_HALVES = (32, 16, 8, 4, 2, 1)


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _right(word: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", word, by.cast("int"))


def bit(place: Column) -> Column:
    """The word with one bit set, at place 0 to 63."""
    return F.call_function("shiftleft", _long(1), place.cast("int"))


def low_bits(count: Column) -> Column:
    """The word whose `count` lowest bits are set; none below 1, all from 64 on."""
    return F.when(count >= WORD, _long(-1)).when(count <= 0, _long(0)).otherwise(_right(_long(-1), WORD - count))


def longest_run(df: DataFrame, words: list[str], out: str) -> DataFrame:
    """`df` without the columns `words` and with `out`: the longest run of set bits of their row, lowest bit of the first word first.

    Inside a word, runs of 2, 4, ... 32 come from and-ing the word with itself shifted; the longest is put together from
    these lengths, largest first. Between words, the run that ends one and the run that begins the next are joined. Every
    step is a projection of its own, so that no expression is repeated.
    """
    names = [f"__run{i}" for i in range(len(words))]
    others = df.columns
    kept = [F.col(f"`{c}`") for c in others]
    state = {f"{n}x1": F.col(w) for w, n in zip(words, names)}

    def step(**changed: Column) -> None:
        nonlocal df
        df = df.select(*kept, *[changed.get(c, F.col(c)).alias(c) for c in [*state, *[c for c in changed if c not in state]]])
        state.update(dict.fromkeys(changed))

    df = df.select(*kept, *[c.alias(name) for name, c in state.items()])
    for k in reversed(_HALVES[1:]):
        step(**{f"{n}x{2 * k}": F.col(f"{n}x{k}").bitwiseAND(F.shiftrightunsigned(f"{n}x{k}", k)) for n in names})
    step(**{f"{n}now": _long(-1) for n in names}, **{f"{n}len": F.lit(0) for n in names},
         **{f"{n}{side}": F.bitwise_not(F.col(w)) for w, n in zip(words, names) for side in ("low", "high")})
    for k in _HALVES:
        step(**{f"{n}try": F.col(f"{n}now").bitwiseAND(_right(F.col(f"{n}x{k}"), F.col(f"{n}len"))) for n in names})
        fits = {n: F.col(f"{n}try") != 0 for n in names}
        step(**{f"{n}now": F.when(fits[n], F.col(f"{n}try")).otherwise(F.col(f"{n}now")) for n in names},
             **{f"{n}len": F.col(f"{n}len") + F.when(fits[n], k).otherwise(0) for n in names},
             # the gaps fill all bits above the lowest and below the highest of them
             **{f"{n}low": F.col(f"{n}low").bitwiseOR(F.shiftleft(f"{n}low", k)) for n in names},
             **{f"{n}high": F.col(f"{n}high").bitwiseOR(F.shiftrightunsigned(f"{n}high", k)) for n in names})
    ended, best = F.lit(0), F.lit(0)
    for w, n in zip(words, names):
        full = F.col(w) == -1
        step(**{f"{n}join": ended + WORD - F.bit_count(f"{n}low")})
        ended = F.when(full, F.col(f"{n}join")).otherwise(WORD - F.bit_count(f"{n}high"))
        best = F.greatest(best, F.col(f"{n}join"), F.col(f"{n}len"))
    return df.select(*[c for c, name in zip(kept, others) if name not in words], best.cast("int").alias(out))
