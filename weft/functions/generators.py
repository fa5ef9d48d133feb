"""Tensors from nothing: every cell is an expression of its running number, so a generator is one range scan."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from weft.errors import BadLogic, DimensionError
from weft.functions.scalars import DTYPES, arithmetic, is_complex
from weft.tensor import Tensor, index_columns, require, unravel


def _empty(spark: SparkSession, rank: int, dtype: str):
    return spark.createDataFrame([], ", ".join([*(f"{c} bigint" for c in index_columns(rank)), f"v {DTYPES[dtype][0]}"]))


def zeros(spark: SparkSession, dims: Sequence[int], dtype: str = "float64", name: str = "") -> Tensor:
    """No rows at all."""
    return Tensor(_empty(spark, len(dims), dtype), tuple(dims), dtype, name)


create = zeros


def like(t: Tensor, name: str = "") -> Tensor:
    return zeros(t.spark, t.dims, t.dtype, name)


def computed(spark: SparkSession, dims: Sequence[int], f: Callable[..., Column], dtype: str = "float64") -> Tensor:
    """A function tensor: f of the index columns, evaluated where it is read."""
    at = unravel(F.col("id"), dims)
    names = index_columns(len(dims))
    rows = spark.range(math.prod(dims)).select(*(c.alias(n) for c, n in zip(at, names, strict=True)))
    kind = arithmetic(dtype)
    return Tensor(rows.select(*names, kind.narrow(f(*map(F.col, names)), dtype).alias("v")), tuple(dims), dtype)


def shifted(t: Tensor, offsets: Sequence[int], dims: Sequence[int]) -> Tensor:
    """A window of a (function) tensor whose indices start at ``offsets``."""
    return t.view(*((o, o + n) for o, n in zip(offsets, dims, strict=True)))


def filled(spark: SparkSession, dims: Sequence[int], value, dtype: str = "float64") -> Tensor:
    kind = arithmetic(dtype)
    if not dims:
        return Tensor(spark.range(1).select(kind.narrow(kind.lit(value), dtype).alias("v")), (), dtype)
    return computed(spark, dims, lambda *_: kind.lit(value), dtype)


def identity(spark: SparkSession, n: int, rank: int = 2, dtype: str = "float64") -> Tensor:
    """One on the (hyper)diagonal. Also the Kronecker delta."""
    return set_diagonal(zeros(spark, (n,) * rank, dtype), 1)


kronecker = identity


def set_diagonal(t: Tensor, value) -> Tensor:
    """The tensor with one value on its hyperdiagonal, whose length is the least dimension."""
    kind, c = t.kind, t.columns
    rows = t.spark.range(min(t.dims)).select(*(F.col("id").alias(x) for x in c), kind.narrow(kind.lit(value), t.dtype).alias("v"))
    rest = t.df.where(F.lit(t.rank > 1) & ~_all_equal(c)) if t.rank > 1 else t.df.limit(0)
    return t.with_rows(rest.unionByName(rows))


def _all_equal(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns[1:]:
        out = out & (F.col(c) == F.col(columns[0]))
    return out


def incremented(spark: SparkSession, dims: Sequence[int], dtype: str = "float64", order: str = "C") -> Tensor:
    """Each cell holds its running number; complex ones hold it twice."""
    at = unravel(F.col("id"), dims, order)
    n = F.col("id").cast("double")
    v = F.struct(n.alias("re"), n.alias("im")) if is_complex(dtype) else n.cast(DTYPES[dtype][0])
    return Tensor(spark.range(math.prod(dims)).select(*(c.alias(x) for c, x in zip(at, index_columns(len(dims)), strict=True)), v.alias("v")), tuple(dims), dtype)


def arange(spark: SparkSession, start: float, stop: float | None = None, step: float = 1) -> Tensor:
    """start, start + step, ... below stop."""
    if stop is None:
        start, stop = 0, start
    if step == 0 or (stop < start) == (step > 0) and stop != start:
        raise BadLogic(f"no range from {start} to {stop} by {step}")
    n = max(0, math.ceil((stop - start) / step))
    return Tensor(spark.range(n).select(F.col("id").alias("i0"), (F.lit(float(start)) + F.col("id") * F.lit(float(step))).alias("v")), (n,))


def diagonal(vector: Tensor) -> Tensor:
    """A matrix with the vector on its diagonal."""
    require(vector, 1)
    return vector.with_rows(vector.df.select("i0", F.col("i0").alias("i1"), "v"), (vector.dims[0],) * 2)


def diagonal_like(vector: Tensor, other: Tensor) -> Tensor:
    require(vector, 1)
    if min(other.dims) < vector.dims[0]:
        raise DimensionError(f"{vector.dims[0]} values on the diagonal of {other.dims}")
    return vector.with_rows(vector.df.select(*(F.col("i0").alias(c) for c in other.columns), "v"), other.dims)


DISTRIBUTIONS = ("uniform", "normal", "circle", "unit_circle")
_seed = [0]


def seed_random(seed: int) -> None:
    """What random() starts from where no seed is given."""
    _seed[0] = seed


def random(spark: SparkSession, dims: Sequence[int], seed: int | None = None, dtype: str = "float64", normalize: bool = False, low: float = -1.0, high: float = 1.0, distribution: str | None = None) -> Tensor:
    """Random cells, drawn from the cell's number, so any partitioning draws the same. Real: uniform in [low, high), or normal.
    Complex: uniform on the disk of radius ``high`` (circle), on its edge (unit_circle), or normal in both parts.
    With ``normalize``, the columns of a matrix (or the vector) have 2-norm one."""
    kind = distribution or ("circle" if is_complex(dtype) else "uniform")
    if kind not in DISTRIBUTIONS or (kind == "uniform") == is_complex(dtype) and kind != "normal":
        raise BadLogic(f"no {kind!r} cells of {dtype}")
    seed = _seed[0] if seed is None else seed
    a, b = (_uniform(F.col("id"), seed, k) for k in (1, 2))
    size = {"uniform": a, "normal": F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - a)), "circle": F.sqrt(a) * F.lit(high), "unit_circle": F.lit(high)}[kind]
    phi = b * F.lit(2 * math.pi)
    if is_complex(dtype):
        v = F.struct((size * F.cos(phi)).alias("re"), (size * F.sin(phi)).alias("im"))
    else:
        v = (size * F.cos(phi) if kind == "normal" else F.lit(low) + a * F.lit(high - low)).cast(DTYPES[dtype][0])
    at = unravel(F.col("id"), dims)
    t = Tensor(spark.range(math.prod(dims)).select(*(c.alias(x) for c, x in zip(at, index_columns(len(dims)), strict=True)), v.alias("v")), tuple(dims), dtype)
    if not normalize or t.rank not in (1, 2):
        return t
    kind = t.kind
    last = t.columns[1:]
    sizes = t.df.groupBy(*last).agg(F.sqrt(F.sum(kind.square(F.col("v")))).alias("n"))
    joined = t.df.join(sizes, last) if last else t.df.crossJoin(F.broadcast(sizes))
    return t.with_rows(joined.select(*t.columns, kind.div(kind.lift(F.col("v"), dtype), kind.lift(F.col("n"), "float64")).alias("v")))


def _uniform(n: Column, seed: int, stream: int) -> Column:
    """53 bits of a hash of the number: in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(n, F.lit(seed), F.lit(stream)), 11).cast("double") * F.lit(2.0**-53)


def random_definite(spark: SparkSession, n: int, mean: float = 1.0, seed: int = 0, zero: int = 0) -> Tensor:
    """Q D Q^T with Q orthogonal and D from a Maxwell distribution of this mean (a negative one for negative definite);
    ``zero`` eigenvalues are zero. Made on the driver: n is that of a matrix that is factorised there as well."""
    draw = np.random.default_rng(seed)
    q, r = np.linalg.qr(draw.standard_normal((n, n)))
    q = q * np.sign(np.diag(r))
    scale = abs(mean) / (2 * math.sqrt(2 / math.pi))
    values = np.sqrt((draw.normal(0, scale, (3, n)) ** 2).sum(axis=0)) * (1 if mean >= 0 else -1)
    values[: min(zero, n)] = 0
    return Tensor.from_numpy(spark, (q * values) @ q.T)


def random_semidefinite(spark: SparkSession, n: int, mean: float = 1.0, zero: int = 1, seed: int = 0) -> Tensor:
    return random_definite(spark, n, mean, seed, zero)
