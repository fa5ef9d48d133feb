"""Vector and matrix operations, each as the contraction or projection that it is."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.errors import DimensionError, RankError
from weft.functions.scalars import arithmetic, real_of, widest
from weft.operators.elementwise import multiply, zipped
from weft.plans.contraction import Plan, combine, sum_all
from weft.tensor import Tensor, common, require, same_dims, square

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _labels(t: Tensor) -> str:
    return LETTERS[: t.rank]


def dot(a: Tensor, b: Tensor, c: Tensor | None = None) -> Tensor:
    """Sum of products of all cells of two or three tensors; nothing is conjugated."""
    if c is not None:
        same_dims(a, b, c)
        a, b = multiply(a, b), c
    same_dims(a, b)
    return Plan((), _labels(a), _labels(b)).execute(a, b)


def precise_dot(a: Tensor, b: Tensor) -> Tensor:
    """Sum of products of two real tensors, rounded nearly once. Each product is split into two doubles without error; a task
    sums them exactly and hands on two doubles, and so does the last step."""
    same_dims(a, b)
    if a.kind.complex or b.kind.complex:
        raise RankError("precise sums are of real tensors")
    x, y = F.col("a0"), F.col("a1")

    def split(v):
        c = v * F.lit(134217729.0)
        high = c - (c - v)
        return high, v - high

    (xh, xl), (yh, yl) = split(x), split(y)
    p = x * y
    rest = ((xh * yh - p) + xh * yl + xl * yh) + xl * yl

    def add(batches):
        import math

        import pyarrow as pa

        held: list[float] = []
        for batch in batches:
            values = [v for c in batch.columns for v in c.to_pylist()] + held
            high = math.fsum(values)
            low = math.fsum([*values, -high])
            held = [high, low, math.fsum([*values, -high, -low])]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in held], names=["p", "e", "f"])

    schema = "p double, e double, f double"
    pairs = zipped((a.cast("float64"), b.cast("float64")), "inner", arithmetic("float64")).select(p.alias("p"), rest.alias("e"), F.lit(0.0).alias("f"))
    total = pairs.mapInArrow(add, schema).coalesce(1).mapInArrow(add, schema)
    return Tensor(total.agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("v")), ())


def true_dot(a: Tensor, b: Tensor) -> Tensor:
    same_dims(a, b)
    return Plan((), _labels(a), _labels(b)).execute(a, b, conj_a=True)


def _scalar(t: Tensor, v, dtype: str = "float64") -> Tensor:
    return Tensor(t.df.agg(v.alias("v")), (), dtype)


def sum_square(t: Tensor) -> tuple[Tensor, Tensor]:
    """scale and sumsq, with scale ** 2 * sumsq the sum of squares; the scale keeps squares from overflow."""
    size = t.kind.abs(F.col("v")).cast("double")
    scale = _scalar(t, F.coalesce(F.max(size), F.lit(0.0)))
    joined = t.df.crossJoin(F.broadcast(scale.df.withColumnRenamed("v", "s")))
    part = F.when(F.col("s") > 0, size / F.col("s")).otherwise(F.lit(0.0))
    return scale, Tensor(joined.agg(F.coalesce(F.sum(part * part), F.lit(0.0)).alias("v")), ())


def asum(t: Tensor) -> Tensor:
    """Sum of |re| + |im|."""
    v = F.col("v")
    size = F.abs(v["re"]) + F.abs(v["im"]) if t.kind.complex else F.abs(v)
    return _scalar(t, F.coalesce(F.sum(size).cast("double"), F.lit(0.0)))


def sum1(t: Tensor) -> Tensor:
    """Sum of moduli."""
    return _scalar(t, F.coalesce(F.sum(t.kind.abs(F.col("v"))).cast("double"), F.lit(0.0)))


def nrm2(t: Tensor) -> Tensor:
    return _scalar(t, F.sqrt(F.coalesce(F.sum(t.kind.square(F.col("v"))), F.lit(0.0))))


def gemm(alpha, a: Tensor, b: Tensor, beta=0.0, c: Tensor | None = None, trans_a: str = "n", trans_b: str = "n", blocked: bool = False) -> Tensor:
    """beta c + alpha op(a) op(b); op is n, t or c (conjugate transpose)."""
    require(a, 2)
    require(b, 2)
    la, lb = ("ik" if trans_a.lower() == "n" else "ki"), ("kj" if trans_b.lower() == "n" else "jk")
    if blocked and not beta:
        from weft.plans.blocked import contract

        return contract(("i", "j"), tuple(la), a, tuple(lb), b, alpha)
    return Plan("ij", la, lb).execute(a, b, c, alpha, beta, trans_a.lower() == "c", trans_b.lower() == "c")


def symm_gemm(a: Tensor, b: Tensor, trans_b: str = "n") -> Tensor:
    """op(b)^T a op(b)."""
    square(a)
    first = Plan("kj", "kl", "lj" if trans_b == "n" else "jl").execute(a, b)
    return Plan("ij", "ki" if trans_b == "n" else "ik", "kj").execute(b, first)


def gemv(alpha, a: Tensor, x: Tensor, beta=0.0, y: Tensor | None = None, trans: str = "n") -> Tensor:
    require(a, 2)
    require(x, 1)
    return Plan("i", "ik" if trans.lower() == "n" else "ki", "k").execute(a, x, y, alpha, beta, trans.lower() == "c")


def ger(alpha, x: Tensor, y: Tensor, a: Tensor | None = None, conj: bool = False) -> Tensor:
    """a + alpha x y^T (gerc: y conjugated)."""
    require(x, 1)
    require(y, 1)
    return Plan("ij", "i", "j").execute(x, y, a, alpha, 1.0 if a is not None else 0.0, conj_b=conj)


def gerc(alpha, x: Tensor, y: Tensor, a: Tensor | None = None) -> Tensor:
    return ger(alpha, x, y, a, True)


def axpby(alpha, x: Tensor, beta, y: Tensor) -> Tensor:
    same_dims(x, y)
    dtype = widest(common(x, y), *("complex128" for s in (alpha, beta) if isinstance(s, complex)))
    if dtype.startswith("int") and any(s != int(s) for s in (alpha, beta)):
        dtype = "float64"
    kind = arithmetic(dtype)
    df = zipped((x, y), "full_outer", kind)
    v = kind.add(kind.mul(kind.lit(alpha), F.col("a0")), kind.mul(kind.lit(beta), F.col("a1")))
    return y.with_rows(df.select(*y.columns, kind.narrow(v, dtype).alias("v")), dtype=dtype)


def axpy(alpha, x: Tensor, y: Tensor) -> Tensor:
    return axpby(alpha, x, 1, y)


def scale(factor, t: Tensor) -> Tensor:
    return multiply(t, factor)


def rscl(divisor, t: Tensor) -> Tensor:
    return multiply(t, 1.0 / divisor)


def _scale_line(k: int, at: int, factor, t: Tensor) -> Tensor:
    require(t, 2)
    if not 0 <= at < t.dims[k]:
        raise IndexError(f"{at} of {t.dims[k]}")
    dtype = widest(t.dtype, "complex128") if isinstance(factor, complex) else ("float64" if t.dtype.startswith("int") and factor != int(factor) else t.dtype)
    kind = arithmetic(dtype)
    v = kind.lift(F.col("v"), t.dtype)
    return t.with_rows(t.df.select("i0", "i1", kind.narrow(F.when(F.col(f"i{k}") == at, kind.mul(v, kind.lit(factor))).otherwise(v), dtype).alias("v")), dtype=dtype)


def scale_row(row: int, factor, t: Tensor) -> Tensor:
    return _scale_line(0, row, factor, t)


def scale_column(column: int, factor, t: Tensor) -> Tensor:
    return _scale_line(1, column, factor, t)


def direct_product(alpha, a: Tensor, b: Tensor, beta=0.0, c: Tensor | None = None) -> Tensor:
    same_dims(a, b)
    return Plan(_labels(a), _labels(a), _labels(b)).execute(a, b, c, alpha, beta)


def copy(t: Tensor) -> Tensor:
    return t


def trace(t: Tensor) -> Tensor:
    square(t)
    return Tensor(t.df.where("i0 = i1").agg(sum_all(t).alias("v")), (), t.dtype)


def weight(t: Tensor, w: Tensor) -> Tensor:
    """Scale along the first index."""
    require(w, 1)
    if t.rank < 1:
        raise RankError("a scalar has no first index")
    if t.dims[0] != w.dims[0]:
        raise DimensionError(f"{w.dims[0]} weights for {t.dims[0]} rows")
    return Plan(_labels(t), _labels(t), LETTERS[0]).execute(t, w)


__all__ = ["asum", "axpby", "axpy", "combine", "copy", "direct_product", "dot", "gemm", "gemv", "ger", "gerc", "nrm2", "precise_dot", "real_of", "rscl", "scale", "scale_column", "scale_row", "sum1", "sum_square", "symm_gemm", "trace", "true_dot", "weight"]
