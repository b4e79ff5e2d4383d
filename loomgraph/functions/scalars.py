"""Scalar column functions of the domain. All are built-in expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the model.
ALPHA_BOX, KAPPA_BOX = (0.30, 0.95), (0.30, 0.90)
SATURATED = 1e6
PAIR_SEED = 0x1234D00DCAFEBEEF
PAIR_FACTOR, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SUPPORT_FLOOR, SIZE_FLOOR = 1e-15, 1e-15


def label(c: Column) -> Column:
    """Any value as a trimmed label."""
    return F.trim(c.cast("string"))


def code(c: Column) -> Column:
    """A sector code: outer quotes go, and a point that only zeros follow."""
    bare = F.regexp_replace(F.trim(c.cast("string")), r'^"(.*)"$', "$1")
    return F.regexp_replace(F.trim(bare), r"^([^.]*)\.0*$", "$1")


def digits(c: Column) -> Column:
    """The first run of digits as a bigint; null if there is none."""
    return F.regexp_substr(c.cast("string"), F.lit("[0-9]+")).try_cast("bigint")


def lenient_number(c: Column) -> Column:
    """A non-negative double; what can't be read, is negative or not finite becomes 0."""
    x = F.trim(c.cast("string")).try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")), x).otherwise(F.lit(0.0))


def clipped(c: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        c = F.greatest(c, F.lit(low))
    return c if high is None else F.least(c, F.lit(high))


def custom_round(c: Column) -> Column:
    """Half-even rounding: to an integer if the first decimal is 0, else to one decimal."""
    return F.when(F.floor((c - F.floor(c)) * 10) == 0, F.rint(c)).otherwise(F.bround(c, 1))


def max_normalised(df: DataFrame, size: str, out: str, mode: str = "floor_one") -> DataFrame:
    """df with size divided by its maximum.

    mode: "floor_one" divides by max(max, 1), "positive" by the maximum if it is positive, "off" copies.
    The maximum is one row, so it may go to every task.
    """
    if mode == "off":
        return df.withColumn(out, F.col(size))
    top = F.greatest(F.max(size), F.lit(1.0)) if mode == "floor_one" else F.when(F.max(size) > 0, F.max(size)).otherwise(F.lit(1.0))
    return df.crossJoin(F.broadcast(df.agg(top.alias("_top")))).withColumn(out, F.col(size) / F.col("_top")).drop("_top")


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def inverse_sigmoid(c: Column) -> Column:
    return F.log(c / (1 - c))


def boxed(c: Column, box: tuple[float, float]) -> Column:
    """An unbounded parameter mapped into a box."""
    return F.lit(box[0]) + (box[1] - box[0]) * sigmoid(c)


def link_probability(x: Column) -> Column:
    """x / (1 + x), and 1 where x is saturated."""
    return F.when(x > SATURATED, F.lit(1.0)).otherwise(x / (1 + x))


def f_eta(n: Column, theta: float, eta: float) -> Column:
    return F.when(n <= 0, F.lit(0.0)).otherwise(theta * (1 - F.exp(-eta * n)))


def g_share(n: Column, gamma: float, n0: float, eta_g: float) -> Column:
    return F.when(n <= 0, F.lit(0.0)).otherwise(gamma * F.pow(n / (n0 + n), F.lit(eta_g)))


def ceil_count(c: Column) -> Column:
    return F.greatest(F.ceil(c), F.lit(0)).cast("bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _wrapping_product(x: Column, factor: int) -> Column:
    """x * factor modulo 2**64 on signed longs, without overflow: products of 32 by 16 bits, added by halves."""
    m = F.lit(0xFFFFFFFF)
    low, high = x.bitwiseAND(m), F.shiftrightunsigned(x, 32)
    b = [factor >> (16 * k) & 0xFFFF for k in range(4)]
    p = [low * F.lit(v).cast("bigint") for v in b]
    h = [high * F.lit(v).cast("bigint") for v in b[:2]]
    lo = p[0].bitwiseAND(m) + F.shiftleft(p[1].bitwiseAND(F.lit(0xFFFF)), 16)
    hi = F.shiftrightunsigned(p[0], 32) + F.shiftrightunsigned(p[1], 16) + F.shiftrightunsigned(lo, 32)
    hi = hi + p[2].bitwiseAND(m) + F.shiftleft(p[3].bitwiseAND(F.lit(0xFFFF)), 16)
    hi = hi + h[0].bitwiseAND(m) + F.shiftleft(h[1].bitwiseAND(F.lit(0xFFFF)), 16)
    return F.shiftleft(hi.bitwiseAND(m), 32).bitwiseOR(lo.bitwiseAND(m))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once for each row, however often and in whatever filter they are used: they come from a generator, which the optimiser neither repeats nor moves."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def with_pair_uniform(df: DataFrame, i: str, j: str, out: str, seed: int = PAIR_SEED) -> DataFrame:
    """df with a uniform number in [0, 1] that depends on the pair of 0-based positions and the seed only."""
    c, names = F.col, df.columns
    df = once(df, _h0=_wrapping_product(c(i).cast("bigint"), PAIR_FACTOR).bitwiseXOR(F.shiftleft(c(j).cast("bigint"), 1)).bitwiseXOR(F.lit(_signed(seed))))
    for k, (shift, factor) in enumerate(((30, MIX_1), (27, MIX_2))):
        df = once(df, **{f"_g{k}": c(f"_h{k}").bitwiseXOR(F.shiftrightunsigned(f"_h{k}", shift))})
        df = once(df, **{f"_h{k + 1}": _wrapping_product(c(f"_g{k}"), factor)})
    df = once(df, _h3=c("_h2").bitwiseXOR(F.shiftrightunsigned("_h2", 31)))
    value = (F.shiftrightunsigned("_h3", 32).cast("double") * 4294967296.0 + c("_h3").bitwiseAND(F.lit(0xFFFFFFFF)).cast("double")) / 18446744073709551616.0
    return df.select(*names, value.alias(out))


def mixed(h: np.ndarray) -> np.ndarray:
    """h, an array of 64 bits each, mixed in place."""
    other = np.empty_like(h)
    for shift, factor in ((30, MIX_1), (27, MIX_2), (31, 1)):
        np.right_shift(h, np.uint64(shift), out=other)
        h ^= other
        if factor != 1:
            h *= np.uint64(factor)
    return h


def pair_bits(i: np.ndarray, j: np.ndarray, seed: int = PAIR_SEED) -> tuple[np.ndarray, np.ndarray]:
    """What either position of a pair adds to its bits: mixed() of one xor the other is the pair's hash."""
    return i.astype(np.uint64) * np.uint64(PAIR_FACTOR) ^ np.uint64(seed), j.astype(np.uint64) << np.uint64(1)


def pair_hash(i: np.ndarray, j: np.ndarray, seed: int = PAIR_SEED) -> np.ndarray:
    """The 64 bits behind with_pair_uniform(), for arrays of positions that are spread against each other."""
    a, b = pair_bits(i, j, seed)
    return mixed(a ^ b)


def hash_uniform(h: np.ndarray) -> np.ndarray:
    """The uniform numbers of such bits: rounded once, as the sum of both halves in with_pair_uniform() is."""
    return h.astype(float) * 2.0**-64


def counted(df: DataFrame, n: Column, out: str, chunk: int = 10_000) -> DataFrame:
    """df with n rows for each row, numbered from 0; in two steps, so that no array is longer than the larger of chunk and n / chunk."""
    df = df.withColumn("_of", n.cast("bigint")).where("_of > 0")
    df = df.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_of - 1) div {chunk}"))))
    last = F.least(F.col("_of"), (F.col("_chunk") + 1) * chunk) - 1
    return df.withColumn(out, F.explode(F.sequence(F.col("_chunk") * chunk, last))).drop("_of", "_chunk")


def unboxed(value: float, box: tuple[float, float]) -> float:
    """The parameter that boxed() maps to value."""
    y = (value - box[0]) / (box[1] - box[0])
    return math.log(y / (1 - y))
