"""Deterministic draws: a number in [0, 1) from an id and a seed, the same on every retry of a task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the mixing function
MOD = 2147483647
MUL_A, MUL_B, STEP = 1103515245, 1597334677, 7919


def hash01(id_col: Column | str, seed: int | Column = 0) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    s = seed if isinstance(seed, Column) else F.lit(seed)
    u = (F.pmod(c.cast("bigint"), F.lit(MOD)) * F.lit(MUL_A) + (s.cast("bigint") + 1) * F.lit(STEP)) % F.lit(MOD)
    u = u.bitwiseXOR(F.shiftright(u, 15))
    v = (u * F.lit(MUL_B)) % F.lit(MOD)
    v = v.bitwiseXOR(F.shiftright(v, 13))
    return (v % F.lit(MOD)).cast("double") / F.lit(float(MOD))


def hash01_sql(expr: str, seed: int | str = 0, spark: bool = False) -> str:
    """The same draw as SQL text; only the spelling of xor and shift differs between engines."""

    def mix(e: str, k: int) -> str:
        return f"(({e}) ^ shiftright(({e}), {k}))" if spark else f"xor(({e}), ({e}) >> {k})"

    u = f"((({expr}) % {MOD}) * {MUL_A} + (CAST({seed} AS BIGINT) + 1) * {STEP}) % {MOD}"
    v = f"({mix(u, 15)} * {MUL_B}) % {MOD}"
    return f"(CAST(({mix(v, 13)}) % {MOD} AS DOUBLE) / {float(MOD)!r})".replace("2147483647.0", "CAST(2147483647 AS DOUBLE)")
