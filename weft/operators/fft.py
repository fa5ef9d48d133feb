"""Discrete Fourier transforms, unnormalised in both directions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.errors import BadLogic, DimensionError
from weft.functions.scalars import is_complex
from weft.tensor import Tensor, require


def fftfreq(spark, n: int, d: float = 1.0) -> Tensor:
    """0, 1, ... up to the middle, then the negative ones, by n d."""
    if n < 1 or not d:
        raise BadLogic("n and d must not be zero")
    half = (n - 1) // 2
    k = F.when(F.col("id") <= half, F.col("id")).otherwise(F.col("id") - n).cast("double")
    return Tensor(spark.range(n).select(F.col("id").alias("i0"), (k / F.lit(float(n * d))).alias("v")), (n,))


#: Length up to which a transform is a sum by definition, in generated code.
SHORT = 1024
#: Cells that a task transforms at a time, about.
AT_ONCE = 1 << 18


def _complex(t: Tensor) -> Tensor:
    v = F.col("v") if is_complex(t.dtype) else F.struct(F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"))
    return t.with_rows(t.df.select(*t.columns, v.alias("v")), dtype="complex128")


def _transform(t: Tensor, out: int, sign: int, n: int) -> Tensor:
    """The first ``out`` frequencies of a vector of length n: a short one by definition, a long one in two passes of rows, about
    the root of n long, with a turn between them. Lengths without such factors go through a convolution of a power of two."""
    if n <= SHORT:
        return _sum_of_turns(t, out, sign, n)
    n1 = next(d for d in range(math.isqrt(n), 0, -1) if n % d == 0)
    if n // n1 > 64 * n1:
        return _by_chirps(t, out, sign, n)
    n2, z = n // n1, _complex(t).df
    # x[j1 n2 + j2] as rows j2; then X[k1 + n1 k2] from rows k1
    columns = z.select((F.col("i0") % n2).alias("i0"), F.floor(F.col("i0") / n2).cast("bigint").alias("i1"), F.col("v.re").alias("re"), F.col("v.im").alias("im"))
    first = _rows(columns, n1, n1, sign)
    angle = F.lit(sign * 2 * math.pi / n) * (F.col("i0") * F.col("i1")).cast("double")
    c, s = F.cos(angle), F.sin(angle)
    turned = first.select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), (F.col("re") * c - F.col("im") * s).alias("re"), (F.col("re") * s + F.col("im") * c).alias("im"))
    last = _rows(turned, n2, n2, sign).select((F.col("i0") + F.col("i1") * n1).alias("i0"), F.struct("re", "im").alias("v"))
    return Tensor(last.where(F.col("i0") < out), (out,), "complex128")


def _chirp(i, n: int, sign: int) -> tuple:
    angle = F.lit(sign * math.pi / n) * F.pmod(i * i, F.lit(2 * n)).cast("double")
    return F.cos(angle), F.sin(angle)


def _times(re, im, c, s):
    return F.struct((re * c - im * s).alias("re"), (re * s + im * c).alias("im")).alias("v")


def _by_chirps(t: Tensor, out: int, sign: int, n: int) -> Tensor:
    m = 1 << (2 * n - 1).bit_length()
    i, spark = F.col("i0"), t.spark
    a = Tensor(_complex(t).df.select("i0", _times(F.col("v.re"), F.col("v.im"), *_chirp(i, n, sign))), (m,), "complex128")
    ids = spark.range(n).select(F.col("id").alias("i0")).unionAll(spark.range(1, n).select((F.lit(m) - F.col("id")).alias("i0")))
    c, s = _chirp(F.least(i, F.lit(m) - i), n, -sign)
    b = Tensor(ids.select("i0", F.struct(c.alias("re"), s.alias("im")).alias("v")), (m,), "complex128")
    both = _transform(a, m, -1, m).df.select("i0", F.col("v").alias("x")).join(_transform(b, m, -1, m).df.select("i0", F.col("v").alias("y")), "i0")
    mixed = _transform(Tensor(both.select("i0", _times(F.col("x.re"), F.col("x.im"), F.col("y.re"), F.col("y.im"))), (m,), "complex128"), out, 1, m)
    c, s = _chirp(i, n, sign)
    return Tensor(mixed.df.select("i0", _times(F.col("v.re") / m, F.col("v.im") / m, c, s)), (out,), "complex128")


def _rows(cells: DataFrame, n: int, out: int, sign: int, real: bool = False) -> DataFrame:
    """The first ``out`` frequencies of each row (i0) of cells i0, i1, re and im: whole rows meet in a task and are transformed many at a time."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def finish(table: pa.Table):
            own, row = np.unique(table.column("i0").to_numpy(), return_inverse=True)
            x = np.zeros((len(own), n), dtype=float if real else complex)
            x[row, table.column("i1").to_numpy()] = table.column("re").to_numpy() if real else table.column("re").to_numpy() + 1j * table.column("im").to_numpy()
            y = np.fft.rfft(x, axis=1) if real else np.fft.fft(x, axis=1) if sign < 0 else np.fft.ifft(x, axis=1) * n
            y = y[:, :out]
            at = pa.array(np.repeat(own, out)), pa.array(np.tile(np.arange(out), len(own)))
            return pa.RecordBatch.from_arrays([*at, pa.array(y.real.ravel()), pa.array(y.imag.ravel())], names=["i0", "i1", "re", "im"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= AT_ONCE:
                table = pa.Table.from_batches(held)
                keys = table.column("i0").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))  # the last row may go on
                if cut:
                    yield finish(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield finish(pa.Table.from_batches(held))

    return cells.repartition("i0").sortWithinPartitions("i0").mapInArrow(run, "i0 bigint, i1 bigint, re double, im double")


def _sum_of_turns(t: Tensor, out: int, sign: int, n: int) -> Tensor:
    """By definition: rows times turned factors, summed by frequency. n * out products; for short signals."""
    k = F.broadcast(t.spark.range(out).select(F.col("id").alias("k")))
    rows = _complex(t).df.crossJoin(k)
    angle = F.lit(sign * 2 * math.pi / n) * F.pmod(F.col("i0") * F.col("k"), F.lit(n)).cast("double")
    c, s = F.cos(angle), F.sin(angle)
    re, im = F.col("v.re"), F.col("v.im")
    found = rows.groupBy("k").agg(F.sum(re * c - im * s).alias("re"), F.sum(re * s + im * c).alias("im"))
    return Tensor(found.select(F.col("k").alias("i0"), F.struct("re", "im").alias("v")), (out,), "complex128")


def fft(t: Tensor, result: int | None = None, half: bool | None = None) -> Tensor:
    """Of a vector. Real input gives the n / 2 + 1 frequencies from zero up (all n with half=False), complex input all.
    ``result``: length of the result, if it is to be checked."""
    require(t, 1)
    n = t.dims[0]
    half = not is_complex(t.dtype) if half is None else half
    out = n // 2 + 1 if half else n
    if result is not None and result < out:
        raise DimensionError(f"{out} frequencies do not fit into {result}")
    return _transform(t, out, -1, n)


def ifft(t: Tensor, n: int | None = None, real: bool = False) -> Tensor:
    """Backward, without division by n. With ``real``, t holds the frequencies from zero up of a real signal of length n."""
    require(t, 1)
    if not real:
        return _transform(t, t.dims[0], 1, t.dims[0])
    n = n if n is not None else 2 * (t.dims[0] - 1)
    if t.dims[0] < n // 2 + 1:
        raise DimensionError(f"{t.dims[0]} frequencies for a signal of {n}")
    t = t.with_rows(t.df.where(F.col("i0") <= n // 2), (n // 2 + 1,))
    low = _complex(t).df
    mirror = low.where((F.col("i0") > 0) & (F.col("i0") * 2 != n)).select((F.lit(n) - F.col("i0")).alias("i0"), F.struct(F.col("v.re").alias("re"), (-F.col("v.im")).alias("im")).alias("v"))
    whole = Tensor(low.unionByName(mirror), (n,), "complex128")
    return _transform(whole, n, 1, n).map_values(lambda v: v.getField("re"), "float64")


def fft_rows(t: Tensor, inverse: bool = False, half: bool = True) -> Tensor:
    """Of each row of a matrix, by numpy in O(n log n). One row must fit a task."""
    require(t, 2)
    n = t.dims[1]
    wide = is_complex(t.dtype)
    half = half and not wide and not inverse
    out = n // 2 + 1 if half else n
    cells = _complex(t).df.select("i0", "i1", F.col("v.re").alias("re"), F.col("v.im").alias("im"))
    found = _rows(cells, n, out, 1 if inverse else -1, half)
    return Tensor(found.select("i0", "i1", F.struct("re", "im").alias("v")), (t.dims[0], out), "complex128")
