"""Cell by cell. Where f(0) is not 0, absent cells are made first."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.errors import ComplexConversionError, NotEnoughArguments
from weft.functions.scalars import arithmetic, is_complex, real_of, widest
from weft.tensor import Tensor, common, same_dims


def _numbers(*xs) -> list[str]:
    """Types that plain numbers bring along."""
    return ["complex128" if isinstance(x, complex) else "int64" if isinstance(x, int) else "float64" for x in xs]


def zipped(tensors: Sequence[Tensor], how: str, kind) -> DataFrame:
    """Index columns and a0, a1, ...: cells of equal indices side by side, lifted to one arithmetic; absent ones are zero under outer joins."""
    same_dims(*tensors)
    out = None
    for k, t in enumerate(tensors):
        own = t.df.select(*t.columns, kind.lift(F.col("v"), t.dtype).alias(f"a{k}"))
        if out is None:
            out = own
        elif t.columns:
            out = out.join(own, t.columns, how)
        else:
            out = out.crossJoin(own)
    assert out is not None
    return out.select(*tensors[0].columns, *(kind.or_zero(F.col(f"a{k}")).alias(f"a{k}") for k in range(len(tensors))))


def _pair(a: Tensor, b: Tensor, how: str, f: Callable[..., Column]) -> Tensor:
    dtype = common(a, b)
    kind = arithmetic(dtype)
    df = zipped((a, b), how, kind)
    return a.with_rows(df.select(*a.columns, kind.narrow(f(kind, F.col("a0"), F.col("a1")), dtype).alias("v")), dtype=dtype)


def _with_number(a: Tensor, x, f: Callable[..., Column], dense: bool, divide: bool = False) -> Tensor:
    dtype = widest(a.dtype, *_numbers(x)) if not (isinstance(x, float) and a.dtype in ("float32", "complex64")) else a.dtype
    if divide and dtype.startswith("int"):
        dtype = "float64"
    kind = arithmetic(dtype)
    t = a.densify() if dense else a
    return t.with_rows(t.df.select(*t.columns, kind.narrow(f(kind, kind.lift(F.col("v"), a.dtype), kind.lit(x)), dtype).alias("v")), dtype=dtype)


def add(a: Tensor, b) -> Tensor:
    if isinstance(b, Tensor):
        return _pair(a, b, "full_outer", lambda k, x, y: k.add(x, y))
    return _with_number(a, b, lambda k, x, y: k.add(x, y), True)


def subtract(a: Tensor, b) -> Tensor:
    if isinstance(b, Tensor):
        return _pair(a, b, "full_outer", lambda k, x, y: k.sub(x, y))
    return _with_number(a, b, lambda k, x, y: k.sub(x, y), True)


def multiply(a: Tensor, b) -> Tensor:
    """Absent times anything is absent: an inner join."""
    if isinstance(b, Tensor):
        return _pair(a, b, "inner", lambda k, x, y: k.mul(x, y))
    return _with_number(a, b, lambda k, x, y: k.mul(x, y), False)


def divide(a, b) -> Tensor:
    """A zero divisor gives an infinity or NaN, in cells without rows as well, so the divisor is made dense."""
    if isinstance(a, Tensor) and isinstance(b, Tensor):
        whole = b.densify()
        out = _pair(whole.cast("float64") if b.dtype.startswith("int") else whole, a.cast("float64") if a.dtype.startswith("int") else a, "left", lambda k, y, x: k.div(x, y))
        return out
    if isinstance(a, Tensor):
        if b == 0:
            return _with_number(a, b, lambda k, x, y: k.div(x, y), True, True)
        return _with_number(a, b, lambda k, x, y: k.div(x, y), False, True)
    return _with_number(b, a, lambda k, x, y: k.div(y, x), True, True)


def real(a: Tensor) -> Tensor:
    return a if not is_complex(a.dtype) else a.map_values(lambda v: v.getField("re"), real_of(a.dtype))


def imag(a: Tensor) -> Tensor:
    if not is_complex(a.dtype):
        return a.with_rows(a.df.limit(0))
    return a.map_values(lambda v: v.getField("im"), real_of(a.dtype))


def absolute(a: Tensor) -> Tensor:
    return a.map_values(a.kind.abs, real_of(a.dtype))


def conjugate(a: Tensor) -> Tensor:
    return a.map_values(a.kind.conj)


def to_complex(re: Tensor, im: Tensor) -> Tensor:
    if is_complex(re.dtype) or is_complex(im.dtype):
        raise ComplexConversionError("two real tensors are needed")
    df = zipped((re, im), "full_outer", arithmetic("float64"))
    return re.with_rows(df.select(*re.columns, F.struct(F.col("a0").alias("re"), F.col("a1").alias("im")).alias("v")), dtype="complex128")


def element_transform(t: Tensor, f: Callable[[Column], Column], keeps_zero: bool = False, dtype: str | None = None) -> Tensor:
    """f on each cell. f is a Column function, or a pandas/Arrow UDF. Unless f(0) = 0 is promised, absent cells are made first."""
    return (t if keeps_zero else t.densify()).map_values(f, dtype)


def element(f: Callable[..., Column], *tensors: Tensor, keeps_zero: bool = False, dtype: str | None = None) -> Tensor:
    """f on the cells of several tensors of equal dimensions."""
    if not tensors:
        raise NotEnoughArguments("no tensors")
    top = common(*tensors)
    kind = arithmetic(top)
    first = tensors[0] if keeps_zero else tensors[0].densify()
    df = zipped((first, *tensors[1:]), "full_outer" if keeps_zero else "left", kind)
    return first.with_rows(df.select(*first.columns, f(*(F.col(f"a{k}") for k in range(len(tensors)))).alias("v")), dtype=dtype or top)


def rmsd(a: Tensor, b: Tensor) -> Tensor:
    """Root of the mean square of a - b over all cells, those without rows as well. A scalar."""
    kind = arithmetic(common(a, b))
    df = zipped((a, b), "full_outer", kind)
    return Tensor(df.agg(F.sqrt(F.coalesce(F.sum(kind.square(kind.sub(F.col("a0"), F.col("a1")))), F.lit(0.0)) / F.lit(float(a.size))).alias("v")), ())


def assign_copy(a: Tensor, dtype: str) -> Tensor:
    """Copy across types."""
    return a.cast(dtype)
