"""Tensors as relations: one row per index tuple and value; a tuple without a row is zero."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.errors import ArgumentCountError, BadLogic, CompatibilityError, DimensionError, RankError, TooLarge
from weft.functions.scalars import DTYPES, Real, arithmetic, is_complex, real_of, widest

#: Cells that an operation on one machine may gather: 64 million doubles are 512 MB.
LOCAL_CELLS = 1 << 26


def index_columns(rank: int) -> list[str]:
    return [f"i{k}" for k in range(rank)]


def strides(dims: Sequence[int], order: str = "C") -> list[int]:
    """Steps of the running number of a cell along each index: last index fastest for C, first for F."""
    if order not in ("C", "F"):
        raise BadLogic(f"order is C or F, not {order!r}")
    out, step = [], 1
    for n in reversed(dims) if order == "C" else dims:
        out.append(step)
        step *= n
    return out[::-1] if order == "C" else out


def ordinal(columns: Sequence[Column], dims: Sequence[int], order: str = "C") -> Column:
    n = F.lit(0).cast("bigint")
    for c, s in zip(columns, strides(dims, order), strict=True):
        n = n + c * F.lit(s)
    return n


def unravel(number: Column, dims: Sequence[int], order: str = "C") -> list[Column]:
    return [F.pmod(F.floor(number / F.lit(s)).cast("bigint") if s > 1 else number, F.lit(d).cast("bigint")).cast("bigint") for s, d in zip(strides(dims, order), dims, strict=True)] if prod(dims, start=1) < 1 << 52 else _unravel_exact(number, dims, order)


def _unravel_exact(number: Column, dims: Sequence[int], order: str) -> list[Column]:
    """Beyond 2 ** 52 a double quotient could round: integer division instead."""
    return [F.pmod(F.call_function("div", number, F.lit(s).cast("bigint")), F.lit(d).cast("bigint")) for s, d in zip(strides(dims, order), dims, strict=True)]


@dataclass(frozen=True)
class Tensor:
    """``df``: i0 .. i{r-1} bigint and v; at most one row per tuple. ``dims`` are authoritative, rows are not counted."""

    df: DataFrame
    dims: tuple[int, ...]
    dtype: str = "float64"
    name: str = ""

    # what it is

    @property
    def rank(self) -> int:
        return len(self.dims)

    @property
    def size(self) -> int:
        return prod(self.dims, start=1)

    @property
    def columns(self) -> list[str]:
        return index_columns(self.rank)

    @property
    def indices(self) -> list[Column]:
        return [F.col(c) for c in self.columns]

    @property
    def kind(self) -> Real:
        return arithmetic(self.dtype)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def T(self) -> Tensor:
        from weft.operators.shape import transpose

        return transpose(self)

    def dim(self, k: int) -> int:
        return self.dims[k]

    def strides(self, order: str = "C") -> list[int]:
        return strides(self.dims, order)

    # how it is made

    @staticmethod
    def of(df: DataFrame, indices: Sequence[str | Column], value: str | Column, dims: Sequence[int], dtype: str = "float64", name: str = "", summed: bool = False) -> Tensor:
        """From any table. With ``summed``, rows of equal indices are added up, as they must be where they repeat; null values count as zero."""
        if len(indices) != len(dims):
            raise RankError(f"{len(indices)} index columns for {len(dims)} dimensions")
        kind = arithmetic(dtype)
        value = F.col(value) if isinstance(value, str) else value
        names = index_columns(len(dims))
        found = df.select(*((F.col(c) if isinstance(c, str) else c).cast("bigint").alias(n) for c, n in zip(indices, names, strict=True)), kind.lift(value, dtype).alias("v"))
        if summed:
            found = found.groupBy(*names).agg(kind.sum(F.col("v")).alias("v"))
        return Tensor(found.select(*names, kind.narrow(kind.or_zero(F.col("v")), dtype).alias("v")), tuple(int(n) for n in dims), dtype, name)

    @staticmethod
    def from_numpy(spark: SparkSession, array: np.ndarray, name: str = "") -> Tensor:
        """Nonzero cells of an array that the driver holds."""
        array = np.asarray(array)
        dtype = {"b": "int64", "i": "int64", "u": "int64", "f": "float64", "c": "complex128"}[array.dtype.kind]
        if str(array.dtype) in DTYPES:
            dtype = str(array.dtype)
        at = np.nonzero(array)
        values = array[at]
        names = index_columns(array.ndim)
        import pyarrow as pa

        columns = {n: pa.array(x.astype(np.int64)) for n, x in zip(names, at, strict=True)}
        if is_complex(dtype):
            columns |= {"re": pa.array(np.atleast_1d(values.real).astype(float)), "im": pa.array(np.atleast_1d(values.imag).astype(float))}
        else:
            columns["v"] = pa.array(np.atleast_1d(values))
        df = spark.createDataFrame(pa.table(columns))
        if is_complex(dtype):
            df = df.select(*names, F.struct("re", "im").alias("v"))
        return Tensor(df.select(*names, F.col("v").cast(DTYPES[dtype][0])), array.shape, dtype, name)

    def to_numpy(self) -> np.ndarray:
        """All cells on the driver, if they are few enough."""
        if self.size > LOCAL_CELLS:
            raise TooLarge(f"{self.size} cells do not go to one machine (limit {LOCAL_CELLS})")
        flat = self.df.select(*self.columns, *((F.col("v.re").alias("re"), F.col("v.im").alias("im")) if is_complex(self.dtype) else ("v",))).toArrow()
        out = np.zeros(self.dims, dtype=self.dtype)
        values = flat.column("re").to_numpy() + 1j * flat.column("im").to_numpy() if is_complex(self.dtype) else flat.column("v").to_numpy()
        if not self.rank:
            return out + (values.sum() if len(values) else 0)
        out[tuple(flat.column(c).to_numpy() for c in self.columns)] = values
        return out

    def with_rows(self, df: DataFrame, dims: Sequence[int] | None = None, dtype: str | None = None) -> Tensor:
        return replace(self, df=df, dims=tuple(self.dims if dims is None else dims), dtype=dtype or self.dtype, name="")

    def renamed(self, name: str) -> Tensor:
        return replace(self, name=name)

    def cast(self, dtype: str) -> Tensor:
        if is_complex(self.dtype) and not is_complex(dtype):
            raise CompatibilityError("take the real or imaginary part of a complex tensor")
        return self.with_rows(self.df.select(*self.columns, arithmetic(dtype).narrow(arithmetic(dtype).lift(F.col("v"), self.dtype), dtype).alias("v")), dtype=dtype)

    def map_values(self, f: Callable[[Column], Column], dtype: str | None = None) -> Tensor:
        """f on the cells that have rows: right where f(0) = 0."""
        return self.with_rows(self.df.select(*self.columns, f(F.col("v")).alias("v")), dtype=dtype)

    def cache(self) -> Tensor:
        return replace(self, df=self.df.cache())

    def grid(self) -> DataFrame:
        """One row per cell."""
        return self.spark.range(self.size).select(*(c.alias(n) for c, n in zip(unravel(F.col("id"), self.dims), self.columns, strict=True)))

    def densify(self) -> Tensor:
        """A row for every cell, zero where there was none."""
        if not self.rank:
            return self.with_rows(self.spark.range(1).select().join(self.df.agg(F.first("v").alias("v")), how="left").select(self.kind.narrow(self.kind.or_zero(F.col("v")), self.dtype).alias("v")))
        joined = self.grid().join(self.df, self.columns, "left")
        return self.with_rows(joined.select(*self.columns, self.kind.narrow(self.kind.or_zero(self.kind.lift(F.col("v"), self.dtype)), self.dtype).alias("v")))

    def sparsify(self) -> Tensor:
        return self.with_rows(self.df.where(self.kind.nonzero(F.col("v"))))

    def values(self) -> DataFrame:
        return self.df

    # reading cells

    def _wrap(self, k: int, at: int) -> int:
        n = self.dims[k]
        if not -n <= at < n:
            raise IndexError(f"index {at} of dimension {n}")
        return at + n if at < 0 else at

    def _range(self, k: int, part: slice) -> tuple[int, int]:
        if part.step not in (None, 1):
            raise BadLogic("slices have a step of one")
        n = self.dims[k]
        low, high = 0 if part.start is None else part.start, n if part.stop is None else part.stop
        low, high = low + n if low < 0 else low, high + n if high < 0 else high
        if not 0 <= low <= high <= n:
            raise IndexError(f"range {part.start}:{part.stop} of dimension {n}")
        return low, high

    def view(self, *parts: int | slice | tuple[int, int]) -> Tensor:
        """Numbers drop an index, slices and (low, high) pairs keep it, renumbered from zero. Conditions reach the scan as filters."""
        if len(parts) > self.rank:
            raise TooMany(f"{len(parts)} parts for rank {self.rank}")
        parts = (*parts, *(slice(None),) * (self.rank - len(parts)))
        where, kept, dims = [], [], []
        for k, p in enumerate(parts):
            c = F.col(f"i{k}")
            if isinstance(p, (int, np.integer)):
                where.append(c == self._wrap(k, int(p)))
                continue
            low, high = self._range(k, slice(*p) if isinstance(p, tuple) else p)
            if (low, high) != (0, self.dims[k]):
                where += [c >= low, c < high]
            kept.append((c - low).cast("bigint") if low else c)
            dims.append(high - low)
        df = self.df
        for w in where:
            df = df.where(w)
        return self.with_rows(df.select(*(c.alias(n) for c, n in zip(kept, index_columns(len(kept)), strict=True)), "v"), dims)

    def __getitem__(self, parts) -> Tensor:
        return self.view(*(parts if isinstance(parts, tuple) else (parts,)))

    def item(self, *at: int):
        """The value of one cell, zero without a row."""
        if len(at) != self.rank:
            raise ArgumentCountError(f"{len(at)} indices for rank {self.rank}")
        return self.item_of(self.view(*at).df.first())

    def item_of(self, row):
        """A row's value as a plain number."""
        if row is None or row["v"] is None:
            return 0j if is_complex(self.dtype) else (0 if self.dtype.startswith("int") else 0.0)
        return complex(row["v"]["re"], row["v"]["im"]) if is_complex(self.dtype) else row["v"]

    def window(self, parts: Sequence[int | slice]) -> list[tuple[int, int]]:
        """Lowest index and one more than the highest, of every dimension."""
        full = (*parts, *(slice(None),) * (self.rank - len(parts)))
        return [(self._wrap(k, int(p)), self._wrap(k, int(p)) + 1) if isinstance(p, (int, np.integer)) else self._range(k, p) for k, p in enumerate(full)]

    def assign(self, parts: Sequence[int | slice], other: Tensor | float) -> Tensor:
        """This tensor with the window replaced: rows of the window go, the other's rows come."""
        seen = self.view(*parts)
        if not isinstance(other, Tensor):
            from weft.functions.generators import filled

            other = filled(self.spark, seen.dims, other, self.dtype)
        if other.dims != seen.dims:
            raise DimensionError(f"window {seen.dims}, value {other.dims}")
        inside, columns, k = F.lit(True), [], 0
        for at, (low, high) in enumerate(self.window(parts)):
            inside = inside & (F.col(f"i{at}") >= low) & (F.col(f"i{at}") < high)
            if at < len(parts) and isinstance(parts[at], (int, np.integer)):
                columns.append(F.lit(low).cast("bigint").alias(f"i{at}"))
            else:
                columns.append((F.col(f"i{k}") + low).cast("bigint").alias(f"i{at}"))
                k += 1
        moved = other.cast(self.dtype).df.select(*columns, "v")
        return self.with_rows(self.df.where(~inside).unionByName(moved))

    def add_to(self, parts: Sequence[int | slice], other: Tensor | float) -> Tensor:
        """This tensor with ``other`` added in the window."""
        return self.assign(parts, self.view(*parts) + other)

    def __iter__(self):
        """The slices along the first index, or the cells of a vector: these are read once, in order."""
        if self.rank == 1:
            at, zero = 0, self.item_of(None)
            for row in self.df.orderBy("i0").toLocalIterator():
                yield from [zero] * (row["i0"] - at)
                yield self.item_of(row)
                at = row["i0"] + 1
            yield from [zero] * (self.dims[0] - at)
        else:
            yield from (self.view(k) for k in range(self.dims[0]))

    def __len__(self) -> int:
        return self.dims[0]

    # arithmetic

    def _other(self, other) -> Tensor | complex | float:
        if isinstance(other, np.ndarray):
            return Tensor.from_numpy(self.spark, other)
        return other

    def __add__(self, other) -> Tensor:
        from weft.operators import elementwise as e

        return e.add(self, self._other(other))

    __radd__ = __add__

    def __sub__(self, other) -> Tensor:
        from weft.operators import elementwise as e

        return e.subtract(self, self._other(other))

    def __rsub__(self, other) -> Tensor:
        return (-self) + other

    def __mul__(self, other) -> Tensor:
        from weft.operators import elementwise as e

        return e.multiply(self, self._other(other))

    __rmul__ = __mul__

    def __truediv__(self, other) -> Tensor:
        from weft.operators import elementwise as e

        return e.divide(self, self._other(other))

    def __rtruediv__(self, other) -> Tensor:
        from weft.operators import elementwise as e

        return e.divide(self._other(other), self)

    def __neg__(self) -> Tensor:
        return self.map_values(self.kind.neg)

    def __matmul__(self, other: Tensor) -> Tensor:
        from weft.operators.blas import gemm

        return gemm(1.0, self, other)


class TooMany(ArgumentCountError, IndexError):
    pass


def common(*tensors: Tensor) -> str:
    return widest(*(t.dtype for t in tensors))


def same_dims(*tensors: Tensor) -> None:
    if len({t.dims for t in tensors}) > 1:
        raise DimensionError(" and ".join(str(t.dims) for t in tensors))


def require(tensor: Tensor, *ranks: int) -> None:
    if tensor.rank not in ranks:
        raise RankError(f"rank {tensor.rank}, not {' or '.join(map(str, ranks))}")


def square(tensor: Tensor) -> int:
    require(tensor, 2)
    if tensor.dims[0] != tensor.dims[1]:
        raise DimensionError(f"{tensor.dims} is not square")
    return tensor.dims[0]


def scalar(spark: SparkSession, df: DataFrame, dtype: str) -> Tensor:
    return Tensor(df, (), dtype)


__all__ = ["LOCAL_CELLS", "Tensor", "common", "index_columns", "ordinal", "real_of", "require", "same_dims", "scalar", "square", "strides", "unravel", "Iterable"]
