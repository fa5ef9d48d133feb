"""More queries on whole business tables: factorisations with closed forms in SQL, disk tensors, blocks and tiles, windows, surfaces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft import errors
from weft.config import Settings, memory, scratch
from weft.functions import generators as g
from weft.operators import blas, decomposition, elementwise, fft, norms, shape, solve, spectral, structured
from weft.plans.contraction import Plan, compile_plan, einsum
from weft.plans.labels import classify, labels_of
from weft.queries import DW, GRID, A, P, T, U, W, X, _a, _cube, _lines, _p, _parts, _rounded, _t, _w, _x, query
from weft.sources import tables as src
from weft.sources.disk import DiskTensor, create_disk_tensor_like
from weft.sources.text import read_tensor
from weft.tensor import Tensor

# a matrix of all suppliers by two columns, and by three; their Gram matrices, the latter divided by its trace
_PAIR = "(SELECT l_suppkey AS i, sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity / 100 ELSE 0 END) AS x, sum(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity / 100 ELSE 0 END) AS y FROM lineitem GROUP BY 1)"
_GRAM = f"(SELECT sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS d FROM {_PAIR})"
#: Eigenvalues h >= l and the unit vector (p, q) of h, whose components are positive as all entries are; (-q, p) belongs to l.
_EIGEN = f"(SELECT *, b / sqrt(b * b + (h - a) * (h - a)) AS p, (h - a) / sqrt(b * b + (h - a) * (h - a)) AS q FROM (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS h, (a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b) AS l FROM {_GRAM}))"
_SHARES = f"(SELECT a / (a + d) AS a, b / (a + d) AS b, d / (a + d) AS d FROM {_GRAM})"
_THREE = "(SELECT l_suppkey AS i, " + ", ".join(f"sum(CASE WHEN l_linenumber % 3 = {k} THEN l_quantity / 100 ELSE 0 END) AS {c}" for k, c in enumerate("xyz")) + " FROM lineitem GROUP BY 1)"
_G3 = f"(SELECT a / t AS a, b / t AS b, c / t AS c, d / t AS d, e / t AS e, f / t AS f FROM (SELECT *, a + d + f AS t FROM (SELECT sum(x * x) AS a, sum(x * y) AS b, sum(x * z) AS c, sum(y * y) AS d, sum(y * z) AS e, sum(z * z) AS f FROM {_THREE})))"
_D3 = f"(SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM {_G3})"
# a matrix of four sums that is not symmetric
_FOUR = "(SELECT " + ", ".join(f"sum(CASE WHEN l_orderkey % 2 = {i} AND l_linenumber % 2 = {j} THEN l_quantity * (1 + l_orderkey % 2 + l_linenumber % 2) END) / 100000.0 AS {c}" for c, i, j in (("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("d", 1, 1))) + " FROM lineitem)"


def _columns(s, d, n: int) -> Tensor:
    rows = src.table(s, d, "lineitem")
    return Tensor.of(rows, ["l_suppkey", F.col("l_linenumber") % n], F.col("l_quantity") / 100, [*src.bounds(s, d, "lineitem", "l_suppkey"), n], summed=True)


def _gram(s, d, n: int) -> Tensor:
    """Divided by its trace."""
    m = spectral.gram(_columns(s, d, n), "columns")
    return m * (1 / blas.trace(m).item())


def _four(s, d) -> Tensor:
    rows = src.table(s, d, "lineitem")
    weight = 1 + F.col("l_orderkey") % 2 + F.col("l_linenumber") % 2
    return Tensor.of(rows, [F.col("l_orderkey") % 2, F.col("l_linenumber") % 2], F.col("l_quantity") * weight / 100000.0, (2, 2), summed=True)


def _named(**tensors: Tensor) -> DataFrame:
    """name, i0, i1, v: of several matrices or vectors in one table."""
    out = None
    for name, t in tensors.items():
        own = t.df.select(F.lit(name).alias("name"), F.col("i0"), (F.col("i1") if t.rank > 1 else F.lit(0).cast("bigint")).alias("i1"), "v")
        out = own if out is None else out.unionByName(own)
    return out


def _rows(s, names: str, values: list[tuple]) -> DataFrame:
    return s.createDataFrame(values, names)


def _cells(first: str, n: int, digits: int, cells: dict[tuple, str], name: str | None = None) -> str:
    """SQL of a small matrix: a row per cell, from one row of numbers."""
    tag = f"'{name}' AS name, " if name else ""
    return " UNION ALL ".join(f"SELECT {tag}" + ", ".join(f"{i}::BIGINT AS i{k}" for k, i in enumerate(at)) + f", round({e}, {digits}) + 0.0 AS v FROM {first}" for at, e in cells.items())


# factorisations


@query(f"SELECT round(sqrt(h), 6) + 0.0 AS v FROM {_EIGEN}")
def norm_two(s, d):
    return _rounded(norms.norm(norms.Norm.TWO, _columns(s, d, 2)).df)


@query(f"SELECT round(det, 12) + 0.0 AS v FROM {_D3}")
def det(s, d):
    return _rounded(g.filled(s, (), float(solve.det(_gram(s, d, 3)))).df, 12)


@query(_cells(_D3, 3, 4, {(0, 0): "(d * f - e * e) / det", (0, 1): "(c * e - b * f) / det", (0, 2): "(b * e - c * d) / det", (1, 0): "(c * e - b * f) / det", (1, 1): "(a * f - c * c) / det", (1, 2): "(b * c - a * e) / det", (2, 0): "(b * e - c * d) / det", (2, 1): "(b * c - a * e) / det", (2, 2): "(a * d - b * b) / det"}))
def invert(s, d):
    return _rounded(solve.invert(_gram(s, d, 3)).df, 4)


@query(_cells(_D3, 3, 4, {(0,): "((d * f - e * e) + 2 * (c * e - b * f) + 3 * (b * e - c * d)) / det", (1,): "((c * e - b * f) + 2 * (a * f - c * c) + 3 * (b * c - a * e)) / det", (2,): "((b * e - c * d) + 2 * (b * c - a * e) + 3 * (a * d - b * b)) / det"}))
def gesv(s, d):
    return _rounded(solve.gesv(_gram(s, d, 3), g.arange(s, 1.0, 4.0))[0].df, 4)


_LU = f"(SELECT CASE WHEN s THEN c ELSE a END AS u, CASE WHEN s THEN d ELSE b END AS w, CASE WHEN s THEN a / c ELSE c / a END AS l, CASE WHEN s THEN b - a / c * d ELSE d - c / a * b END AS x, s FROM (SELECT *, abs(c) > abs(a) AS s FROM {_FOUR}))"


@query(_cells(_LU, 2, 9, {(0, 0): "u", (0, 1): "w", (1, 0): "l", (1, 1): "x"}))
def getrf(s, d):
    return _rounded(solve.getrf(_four(s, d))[0].df, 9)


@query(" UNION ALL ".join([_cells(_LU, 2, 9, {(0, 0): "1.0", (1, 0): "l", (1, 1): "1.0"}, "l"), _cells(_LU, 2, 9, {(0, 0): "u", (0, 1): "w", (1, 1): "x"}, "u"), f"SELECT 'p' AS name, CASE WHEN s THEN 1 - k ELSE k END AS i0, k AS i1, 1.0 AS v FROM {_LU}, range(2) r(k)"]))
def extract_plu(s, d):
    f, swaps, _ = solve.getrf(_four(s, d))
    p, low, up = solve.extract_plu(f, swaps)
    return _rounded(_named(p=p, l=low, u=up), 9)


@query(_cells(_FOUR, 2, 6, {(0, 0): "d / (a * d - b * c)", (0, 1): "-b / (a * d - b * c)", (1, 0): "-c / (a * d - b * c)", (1, 1): "a / (a * d - b * c)"}))
def getri(s, d):
    f, swaps, _ = solve.getrf(_four(s, d))
    return _rounded(solve.getri(f, swaps).df, 6)


_ROOTS = f"(SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * c) AS h, (a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * c) AS l FROM {_FOUR})"


def _unit(p: str, q: str) -> tuple[str, str]:
    """A vector's components, of length one, the larger one positive."""
    turn = f"(CASE WHEN abs({p}) >= abs({q}) THEN sign({p}) ELSE sign({q}) END / sqrt(({p}) * ({p}) + ({q}) * ({q})))"
    return f"({p}) * {turn}", f"({q}) * {turn}"


@query(" UNION ALL ".join([
    _cells(_ROOTS, 2, 9, {(0, 0): "l", (1, 0): "h"}, "w"),
    _cells(_ROOTS, 2, 6, {(k, j): _unit("b", f"{x} - a")[k] for j, x in enumerate("lh") for k in (0, 1)}, "right"),
    _cells(_ROOTS, 2, 6, {(k, j): _unit("c", f"{x} - a")[k] for j, x in enumerate("lh") for k in (0, 1)}, "left"),
]))
def geev(s, d):
    """All values are real here: b c is positive."""
    w, left, right = spectral.geev(_four(s, d))
    w, left, right = (elementwise.real(t) for t in (w, left, right))
    return _named(w=w).withColumn("v", F.round("v", 9) + F.lit(0.0)).unionByName(_rounded(_named(left=left, right=right)))


@query(_cells(f"(SELECT (a + d) / 2 AS m, sqrt((a - d) * (a - d) / 4 + (b + c) * (b + c) / 4 + (b - c) * (b - c) / 4) AS r FROM {_FOUR})", 2, 9, {(0,): "m - r", (1,): "m + r"}))
def heev(s, d):
    """Of the Hermitian matrix whose real part is symmetric and whose imaginary part is not."""
    b = _four(s, d)
    z = elementwise.to_complex((b + b.T) * 0.5, (b - b.T) * 0.5)
    return _rounded(spectral.heev(z)[0].df, 9)


@query(" UNION ALL ".join([_cells(_EIGEN, 2, 4, {(0, 0): "l", (1, 0): "h"}, "w"), _cells(_EIGEN, 2, 6, {(k, j): _unit("b", f"{x} - a")[k] for j, x in enumerate("lh") for k in (0, 1)}, "v")]))
def syev_pairs(s, d):
    w, v = spectral.syev(spectral.gram(_columns(s, d, 2), "columns"))
    return _rounded(_named(w=w), 4).unionByName(_rounded(_named(v=v)))


_LEFT = f"(SELECT i, (x * p + y * q) / sqrt(h) AS m, (y * p - x * q) / sqrt(l) AS n FROM {_PAIR}, {_EIGEN})"
_TURN = f"(SELECT sign(arg_max(m, abs(m))) AS tm, sign(arg_max(n, abs(n))) AS tn FROM {_LEFT})"


@query(f"SELECT 'u' AS name, i AS i0, 0::BIGINT AS i1, round(m * tm, 6) + 0.0 AS v FROM {_LEFT}, {_TURN} UNION ALL SELECT 'u', i, 1, round(n * tn, 6) + 0.0 FROM {_LEFT}, {_TURN} UNION ALL {_cells(_EIGEN, 2, 6, {(0, 0): 'sqrt(h)', (1, 0): 'sqrt(l)'}, 's')} UNION ALL {_cells(f'(SELECT * FROM {_EIGEN}, {_TURN})', 2, 6, {(0, 0): 'p * tm', (0, 1): 'q * tm', (1, 0): '-q * tn', (1, 1): 'p * tn'}, 'vh')}")
def svd(s, d):
    """Every supplier's components."""
    u, w, vh = spectral.svd(_columns(s, d, 2), spectral.Vectors.SOME, spectral.Vectors.SOME)
    return _rounded(_named(u=u, s=w, vh=vh))


@query(_cells(_EIGEN, 2, 6, {(0,): "sqrt(h)", (1,): "sqrt(l)"}))
def svd_dd(s, d):
    return _rounded(spectral.svd_dd(_columns(s, d, 2), spectral.Vectors.NONE, spectral.Vectors.NONE)[1].df)


@query(f"SELECT 'u' AS name, i AS i0, 0::BIGINT AS i1, round(m * tm, 6) + 0.0 AS v FROM {_LEFT}, {_TURN} UNION ALL SELECT 'u', i, 1, round(n * tn, 6) + 0.0 FROM {_LEFT}, {_TURN} UNION ALL {_cells(_EIGEN, 2, 6, {(0, 0): 'sqrt(h)', (1, 0): 'sqrt(l)'}, 's')}")
def truncated_svd(s, d):
    u, w, _ = spectral.truncated_svd(_columns(s, d, 2), 2)
    return _rounded(_named(u=u, s=w))


@query(f"{_cells(_EIGEN, 1, 4, {(0, 0): 'h'}, 'w')} UNION ALL {_cells(_EIGEN, 1, 6, {(0, 0): 'p', (1, 0): 'q'}, 'v')}")
def truncated_syev(s, d):
    w, v = spectral.truncated_syev(spectral.gram(_columns(s, d, 2), "columns"), 1)
    return _rounded(_named(w=w), 4).unionByName(_rounded(_named(v=v)))


@query(_cells(f"(SELECT sum(x) AS a, sum(y) AS b FROM {_PAIR})", 2, 9, {(0, 0): "b * b / (a * a + b * b)", (0, 1): "-a * b / (a * a + b * b)", (1, 0): "-a * b / (a * a + b * b)", (1, 1): "a * a / (a * a + b * b)"}))
def svd_nullspace(s, d):
    """The projector on what the row of column sums maps to zero."""
    m = einsum("ij->j", _columns(s, d, 2))
    v = spectral.svd_nullspace(m.with_rows(m.df.select(F.lit(0).cast("bigint").alias("i0"), F.col("i0").alias("i1"), "v"), (1, 2)))
    return _rounded((v @ v.T).df, 9)


@query(f"SELECT 0::BIGINT AS i0, i AS i1, round((d * x - b * y) / (a * d - b * b), 9) + 0.0 AS v FROM {_PAIR}, {_GRAM} UNION ALL SELECT 1, i, round((a * y - b * x) / (a * d - b * b), 9) + 0.0 FROM {_PAIR}, {_GRAM}")
def pseudoinverse(s, d):
    return _rounded(solve.pseudoinverse(_columns(s, d, 2)).df, 9)


@query(f"SELECT 'q' AS name, i AS i0, 0::BIGINT AS i1, round(x / sqrt(a), 6) + 0.0 AS v FROM {_PAIR}, {_GRAM} UNION ALL SELECT 'q', i, 1, round((y - x * b / a) / sqrt(d - b * b / a), 6) + 0.0 FROM {_PAIR}, {_GRAM} UNION ALL {_cells(_GRAM, 2, 6, {(0, 0): 'sqrt(a)', (0, 1): 'b / sqrt(a)', (1, 1): 'sqrt(d - b * b / a)'}, 'r')}")
def qr(s, d):
    q, r = spectral.qr(_columns(s, d, 2), full=False)
    return _rounded(_named(q=q, r=r)).where("name = 'q' or i0 <= i1")


_INVERSE_ROOT = f"(SELECT (d + k) / m / k AS a, -b / m / k AS b, (a + k) / m / k AS d FROM (SELECT *, sqrt(a * d - b * b) AS k, sqrt(1 + 2 * sqrt(a * d - b * b)) AS m FROM {_SHARES}))"


@query(_cells(_INVERSE_ROOT, 2, 6, {(0, 0): "a", (0, 1): "b", (1, 0): "b", (1, 1): "d"}))
def power(s, d):
    """To the power of minus a half."""
    return _rounded(solve.power(_gram(s, d, 2), -0.5).df)


@query(_cells(_SHARES, 2, 6, {(0, 0): "d / (a * d - b * b) / 2", (0, 1): "-b / (a * d - b * b) / 2", (1, 0): "-b / (a * d - b * b) / 2", (1, 1): "a / (a * d - b * b) / 2"}))
def lyapunov(s, d):
    """With the identity on the right, half the inverse."""
    return _rounded(solve.solve_continuous_lyapunov(_gram(s, d, 2), g.identity(s, 2)).df)


@query(f"SELECT b, k AS i0, round(CASE WHEN t * t / 4 >= q THEN t / 2 + (2 * k - 1) * sqrt(t * t / 4 - q) ELSE t / 2 END, 6) + 0.0 AS re, round(CASE WHEN t * t / 4 >= q THEN 0 ELSE (2 * k - 1) * sqrt(q - t * t / 4) END, 6) + 0.0 AS im FROM (SELECT b, p00 + p11 AS t, p00 * p11 - p01 * p10 AS q FROM (SELECT i // 2 AS b, " + ", ".join(f"max(CASE WHEN i % 2 = {x} AND j % 2 = {y} THEN v END) AS p{x}{y}" for x in (0, 1) for y in (0, 1)) + f" FROM {DW} WHERE i // 2 = j // 2 GROUP BY 1)), range(2) r(k)")
def block_geev(s, d):
    w, _ = structured.BlockTensor.of(_w(s, d), (2, 2, 2, 2)).geev()
    return _parts(w, 6).select(F.floor(F.col("i0") / 2).cast("bigint").alias("b"), (F.col("i0") % 2).alias("i0"), "re", "im")


@query(f"SELECT 'first' AS name, i AS i0, 0::BIGINT AS i1, round(m * tm * sqrt(h), 6) + 0.0 AS v FROM {_LEFT}, {_TURN}, {_EIGEN} UNION ALL {_cells(_EIGEN, 1, 6, {(0, 0): 'p', (1, 0): 'q'}, 'second')}")
def initialize_cp(s, d):
    first, second = decomposition.initialize_cp(_columns(s, d, 2), 1, gathered=False)
    return _rounded(_named(first=first, second=second))


@query(f"SELECT 'first' AS name, i AS i0, 0::BIGINT AS i1, round(m * tm, 6) + 0.0 AS v FROM {_LEFT}, {_TURN} UNION ALL {_cells(_EIGEN, 1, 6, {(0, 0): 'p', (1, 0): 'q'}, 'second')}")
def initialize_tucker(s, d):
    first, second = decomposition.initialize_tucker(_columns(s, d, 2), (1, 1), gathered=False)
    return _rounded(_named(first=first, second=second))


_OUTER = f"SELECT a.i AS i0, b.j AS i1, CAST(r_regionkey AS BIGINT) AS i2, round(a.v * b.v * (r_regionkey + 1) / 1000, 3) + 0.0 AS v FROM (SELECT i, sum(v) / 1000 AS v FROM {A} GROUP BY 1) a, (SELECT j, sum(v) / 1000 AS v FROM {W} GROUP BY 1) b, region"


def _outer(s, d) -> Tensor:
    """One product of three vectors: suppliers, lines and regions."""
    return einsum("i,j,k->ijk", einsum("ik->i", _a(s, d)) * 1e-3, einsum("ij->j", _w(s, d)) * 1e-3, (src.keys(s, d, "region", "r_regionkey") + 1.0) * 1e-3)


def _close(t: Tensor) -> DataFrame:
    return _rounded(t.df, 3).where("abs(v) > 1e-9")


@query(f"SELECT * FROM ({_OUTER}) WHERE v <> 0")
def parafac(s, d):
    """Rank one, so that the fit is the tensor."""
    return _close(decomposition.parafac_reconstruct(decomposition.parafac(_outer(s, d), 1, 3)))


@query(f"SELECT * FROM ({_OUTER}) WHERE v <> 0")
def weighted_parafac(s, d):
    """Weights of 1.0 and up by the supplier's number."""
    t = _outer(s, d)
    if t.dims[0] <= decomposition.FACTOR_CELLS:
        weights = g.arange(s, 1.0, 1.0 + t.dims[0])
    else:
        # the same ones, of the suppliers that occur: numbers can be much fewer than the largest of them
        rows = src.table(s, d, "lineitem").select(F.col("l_suppkey").cast("bigint").alias("i0")).distinct()
        weights = Tensor(rows.select("i0", (F.col("i0") + 1.0).alias("v")), t.dims[:1])
    return _close(decomposition.parafac_reconstruct(decomposition.weighted_parafac(t, weights, 1, 3)))


_CUBE = "SELECT l_orderkey % 8 AS i0, CAST(l_linenumber AS BIGINT) AS i1, l_suppkey % 4 AS i2, round(sum(l_quantity), 3) + 0.0 AS v FROM lineitem GROUP BY 1, 2, 3"


@query(f"SELECT * FROM ({_CUBE}) WHERE v <> 0")
def tucker_ho_svd(s, d):
    """Full ranks, so that the fit is the tensor."""
    return _close(decomposition.tucker_reconstruct(*decomposition.tucker_ho_svd(_cube(s, d), (8, 8, 4))))


@query(f"SELECT * FROM ({_CUBE}) WHERE v <> 0")
def tucker_ho_oi(s, d):
    return _close(decomposition.tucker_reconstruct(*decomposition.tucker_ho_oi(_cube(s, d), (8, 8, 4), 1)))


_VECTOR = "(SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS v, count(*) OVER () AS rows FROM part)"
_N = "(SELECT greatest((SELECT max(p_partkey) FROM part), (SELECT max(l_partkey) FROM lineitem)) + 1)"


@query(f"SELECT f AS i0, round(sum(v * cos(2 * pi() * (f * k % {_N}) / {_N})), 4) + 0.0 AS re, round(-sum(v * sin(2 * pi() * (f * k % {_N}) / {_N})), 4) + 0.0 AS im FROM {_VECTOR}, range({_N} // 2 + 1) r(f) GROUP BY 1")
def fft_long(s, d):
    """One frequency per two parts: two passes of rows, or chirps."""
    return _parts(fft.fft(_x(s, d)), 4)


@query(f"SELECT k AS i0, round(v * {_N}, 4) + 0.0 AS v FROM {_VECTOR}")
def ifft_long(s, d):
    x = _x(s, d)
    return _rounded(fft.ifft(fft.fft(x), x.dims[0], real=True).df, 4).where("v <> 0")


# vectors and matrices

_ORDERS = "(SELECT l_orderkey AS i, CAST(l_linenumber AS BIGINT) AS j, sum(l_extendedprice) AS x, sum(l_discount) AS y FROM lineitem GROUP BY 1, 2)"


@query(f"SELECT round(sum(x * y), 2) + 0.0 AS v FROM {_ORDERS}")
def precise_dot(s, d):
    rows = src.table(s, d, "lineitem")
    dims = src.bounds(s, d, "lineitem", "l_orderkey", "l_linenumber")
    x, y = (Tensor.of(rows, ["l_orderkey", "l_linenumber"], c, dims, summed=True) for c in ("l_extendedprice", "l_discount"))
    return _rounded(blas.precise_dot(x, y).df, 2)


def _wave(s, d) -> Tensor:
    """Suppliers: quantity and line numbers as the parts of a complex number."""
    rows = src.table(s, d, "lineitem")
    n = src.bounds(s, d, "lineitem", "l_suppkey")
    return elementwise.to_complex(*(Tensor.of(rows, ["l_suppkey"], F.col(c).cast("double"), n, summed=True) for c in ("l_quantity", "l_linenumber")))


@query("SELECT i AS i0, j AS i1, 0.5 * (x * p + y * p) AS re, 0.5 * (y * p - x * p) AS im FROM (SELECT l_suppkey AS i, sum(l_quantity) AS x, CAST(sum(l_linenumber) AS DOUBLE) AS y FROM lineitem GROUP BY 1), (SELECT CAST(n_nationkey AS BIGINT) AS j, CAST(n_nationkey AS DOUBLE) AS p FROM nation)")
def gerc(s, d):
    """The second vector is k + k i: conjugated, k - k i."""
    k = src.keys(s, d, "nation", "n_nationkey")
    return _parts(blas.gerc(0.5, _wave(s, d), elementwise.to_complex(k, k)))


@query(f"SELECT i AS i0, CAST(v AS BIGINT) AS v FROM (SELECT i, sum(v) AS v FROM {A} GROUP BY 1)")
def cast_to_integers(s, d):
    return einsum("ik->i", _a(s, d)).cast("int64").df


@query(f"SELECT i AS i0, j AS i1, CAST(v AS BIGINT) + 3 AS v FROM {DW}")
def add_integer(s, d):
    return (_w(s, d).cast("int64") + 3).df


@query(f"SELECT i AS i0, k AS i1, v FROM {A}")
def copy(s, d):
    return blas.copy(_a(s, d)).df


@query(f"SELECT a.i AS i0, sum(a.v / (a.k + 1)) AS v FROM (SELECT i, k, v FROM {A}) a GROUP BY 1".replace("sum(a.v / (a.k + 1))", "round(sum(a.v / (a.k + 1)), 6) + 0.0"))
def einsum_function(s, d):
    """The second tensor is a function of its index."""
    a = _a(s, d)
    return _rounded(einsum("ik,k->i", a, g.computed(s, (a.dims[1],), lambda k: F.lit(1.0) / (k + 1))).df)


@query(f"SELECT 0::BIGINT AS pair, a.i AS i0, sum(a.v * x.v) AS v FROM {A} a JOIN {X} x USING (k) GROUP BY 2 UNION ALL SELECT 1, a.i, sum(a.v * 2 * x.v) FROM {A} a JOIN {X} x USING (k) GROUP BY 2")
def einsum_list(s, d):
    """One plan, two pairs of tensors."""
    a, x = _a(s, d), _x(s, d)
    first, second = compile_plan("i", "ik", "k").execute([a, a * 2.0], [x, x])
    return first.df.withColumn("pair", F.lit(0).cast("bigint")).unionByName(second.df.withColumn("pair", F.lit(1).cast("bigint")))


_SPECS = {",ij,ij": "dot", "ij,ij,ij": "direct", "ij,i,j": "ger", "i,ij,j": "gemv", "ij,ik,kj": "gemm", "ij,kij,kij": "generic", "ii,ij,ji": "generic"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _SPECS.items()) + ") t(spec, kind)")
def algorithm_report(s, d):
    """What a contraction amounts to, from its labels alone; nothing is run."""
    return _rows(s, "spec string, kind string", [(x, classify(*(labels_of(p) if p else () for p in x.split(","))).value) for x in _SPECS])


@query("SELECT * FROM (VALUES ('add', 'DimensionError'), ('contract', 'DimensionError'), ('det', 'DimensionError'), ('item', 'ArgumentCountError'), ('norm', 'RankError'), ('norm kind', 'EnumError'), ('permute', 'BadLogic'), ('slice', 'IndexError'), ('svd', 'EnumError')) t(call, error)")
def error_report(s, d):
    """What is found to be wrong before any job runs."""
    a, w, x, t = _a(s, d), _w(s, d), _x(s, d), _t(s, d)
    calls = {
        "add": lambda: a + w, "contract": lambda: einsum("ik,k->i", w, x), "det": lambda: solve.det(a), "item": lambda: w.item(1), "norm": lambda: norms.norm(norms.Norm.ONE, t),
        "norm kind": lambda: norms.norm("two", a), "permute": lambda: shape.permute("ii", "ij", w), "slice": lambda: w[8], "svd": lambda: spectral.svd(w, "all"),
    }
    found = []
    for name, call in calls.items():
        try:
            call()
        except (errors.TensorError, IndexError) as e:
            found.append((name, type(e).__name__))
    return _rows(s, "call string, error string", found)


@query("SELECT * FROM (VALUES ('4MB', 4194304::BIGINT), ('1.5 k', 1536), ('2gb', 2147483648), ('17', 17)) t(text, bytes)")
def memory_sizes(s, d):
    return _rows(s, "text string, bytes bigint", [(x, memory(x)) for x in ("4MB", "1.5 k", "2gb", "17")])


@query("SELECT * FROM (VALUES ('int', '3'), ('str', 'three'), ('float', '0.0'), ('bool', 'True')) t(kind, held)")
def config_map(s, d):
    held = Settings()
    held.set("x", 3)
    held.set("x", "three")
    return _rows(s, "kind string, held string", [(k.__name__, str(held.get("x", k, True if k is bool else None))) for k in (int, str, float, bool)])


# generators


@query("SELECT 0::BIGINT AS i0, 0::BIGINT AS i1, 0.0::DOUBLE AS v WHERE FALSE")
def create_zero(s, d):
    return g.zeros(s, (10, 20)).df


@query("SELECT i AS i0, j AS i1, 3.5::DOUBLE AS v FROM range(10) a(i), range(20) b(j)")
def set_all(s, d):
    return g.filled(s, (10, 20), 3.5).df


@query("SELECT i AS i0, j AS i1, 1.0::DOUBLE AS v FROM range(8) a(i), range(8) b(j)")
def create_like(s, d):
    return (g.like(_w(s, d)) + 1.0).df


@query(f"SELECT k AS i0, k AS i1, v FROM {X}")
def diagonal_like(s, d):
    x = _x(s, d)
    return g.diagonal_like(x, g.zeros(s, (x.dims[0], x.dims[0] + 5))).df


# views


@query(f"SELECT coalesce((SELECT v FROM {A} WHERE i = 7 AND k = (SELECT min(l_partkey) FROM lineitem WHERE l_suppkey = 7)), 0.0) AS v")
def element_read(s, d):
    part = src.table(s, d, "lineitem").where("l_suppkey = 7").agg(F.min("l_partkey")).first()[0]
    return g.filled(s, (), _a(s, d).item(7, part or 0)).df


@query(f"SELECT i AS i0, j AS i1, CASE WHEN i >= 2 AND i < 4 AND j < 5 THEN v + 7.0 ELSE v END AS v FROM (SELECT * FROM {DW}) WHERE v <> 0 OR (i >= 2 AND i < 4 AND j < 5)")
def view_add(s, d):
    return _w(s, d).add_to((slice(2, 4), slice(0, 5)), 7.0).df


@query(f"SELECT (i * {_N} + k) * 8 + l AS i0, v FROM {T}")
def rank_1_view(s, d):
    return shape.flatten(_lines(s, d)).df


@query(f"SELECT i AS i0, k AS i1, v FROM {A} WHERE i < 50")
def resize(s, d):
    a = _a(s, d)
    return shape.resize(a, 50, a.dims[1] + 3).df


@query(f"SELECT l AS i0, i AS i1, k AS i2, v FROM {T}")
def compiled_permute(s, d):
    return shape.compile_permute("kij", "ijk").execute(_t(s, d)).df


def _halves(n: int) -> tuple[int, int, int]:
    """Three parts, the second one empty."""
    return n // 2, 0, n - n // 2


_NI = "(SELECT max(l_suppkey) + 1 FROM lineitem)"


@query(f"SELECT i AS i0, k - {_N} // 2 AS i1, v FROM {A} WHERE i < {_NI} // 2 AND k >= {_N} // 2")
def apply_view(s, d):
    a = _a(s, d)
    return structured.apply_view(a, *map(_halves, a.dims)).tile(0, 2).df


@query(f"SELECT i - 4 AS i0, j - 4 AS i1, v FROM {W} WHERE i >= 4 AND j >= 4")
def block_view(s, d):
    return structured.BlockTensor.of(_w(s, d), (4, 4), ("low", "high")).block("high").df


@query(f"SELECT 2::BIGINT AS rank, {_NI} * {_N} AS size, {_N} AS stride, 'float64' AS dtype, 'gemm' AS kind")
def introspection(s, d):
    a = _a(s, d)
    return _rows(s, "rank bigint, size bigint, stride bigint, dtype string, kind string", [(a.rank, a.size, a.strides()[0], a.dtype, Plan("ij", "ik", "jk").algorithm.value)])


@query(f"SELECT k AS i0, coalesce(x.v, 0.0) AS v0, coalesce(y.v, 0.0) AS v1 FROM range({_N}) r(k) LEFT JOIN {X} x USING (k) LEFT JOIN (SELECT k, sum(v) AS v FROM {A} GROUP BY 1) y USING (k)")
def enumerate_many(s, d):
    return shape.enumerate_many(_x(s, d), einsum("ik->k", _a(s, d)))


# blocks and tiles; the tiled ones are as large as the table


def _tiled(s, d) -> structured.TiledTensor:
    a = _a(s, d)
    return structured.apply_view(a, *map(_halves, a.dims))


def _blocks(s, d, column: str = "l_quantity") -> structured.BlockTensor:
    return structured.BlockTensor.of(_w(s, d, column), (3, 0, 5))


_IN = "((i < 3 AND j < 3) OR (i >= 3 AND j >= 3))"
_BW, _BU = (f"(SELECT * FROM {x} WHERE {_IN})" for x in (W, U))


@query(f"SELECT sum(v * v) AS v FROM {A}")
def tiled_dot(s, d):
    t = _tiled(s, d)
    return structured.contract("ij,ij->", t, t).df


@query(f"SELECT a.i AS i0, p.s AS i1, sum(a.v * p.v) AS v FROM {A} a JOIN {P} p USING (k) GROUP BY 1, 2")
def tiled_gemm_whole(s, d):
    t, p = _tiled(s, d), _p(s, d)
    return structured.contract("ik,ks->is", t, structured.apply_view(p, t.parts[1], _halves(p.dims[1]))).to_dense().df


@query(f"SELECT a.i AS i0, sum(a.v * x.v) AS v FROM {A} a JOIN {X} x USING (k) GROUP BY 1")
def tiled_gemv(s, d):
    return structured.gemv(1.0, _tiled(s, d), _x(s, d)).to_dense().df


@query(f"SELECT k AS i0, i AS i1, v FROM {A}")
def tiled_permute(s, d):
    return structured.permute("ji", "ij", _tiled(s, d)).to_dense().df


@query(f"SELECT i AS i0, k AS i1, v * 3 AS v FROM {A}")
def tiled_scale(s, d):
    return structured.scale(3.0, _tiled(s, d)).to_dense().df


@query(f"SELECT i AS i0, k AS i1, 2 * v + v * v AS v FROM {A}")
def tiled_axpy(s, d):
    t = _tiled(s, d)
    return structured.axpy(2.0, t, t * t).to_dense().df


@query(f"SELECT i AS i0, k AS i1, (v + v * v - v * 3) / 2 AS v FROM {A}")
def tiled_arithmetic(s, d):
    t = _tiled(s, d)
    return ((t + t * t - t * 3.0) / 2.0).to_dense().df


@query(f"SELECT i AS i0, j AS i1, coalesce(w.v, 0.0) + 0.5 * p.x * q.x AS v FROM {GRID} LEFT JOIN {W} w USING (i, j) JOIN (SELECT i, sum(v) AS x FROM {W} GROUP BY 1) p USING (i) JOIN (SELECT i AS j, sum(v) AS x FROM {W} GROUP BY 1) q USING (j)")
def tiled_ger(s, d):
    w = _w(s, d)
    v = einsum("ij->i", w)
    return structured.ger(0.5, v, v, structured.apply_view(w, (3, 0, 5), (3, 0, 5))).to_dense().df


@query(f"SELECT CAST(CASE WHEN i < {_NI} // 2 THEN 0 ELSE 2 END AS INTEGER) AS t0, CAST(CASE WHEN k < {_N} // 2 THEN 0 ELSE 2 END AS INTEGER) AS t1, max(v * 0) AS most FROM {A} GROUP BY 1, 2")
def tiled_zero(s, d):
    """Emptied tiles are gone, zeroed ones stay."""
    t = _tiled(s, d)
    kept = t.zero_no_clear()
    return kept.filled().join(t.zero().filled(), ["t0", "t1"], "left_anti").crossJoin(kept.tensor.df.agg(F.max("v").alias("most")))


@query(f"SELECT w.i AS i0, u.j AS i1, sum(w.v * u.v) AS v FROM {_BW} w JOIN {U} u ON u.i = w.j GROUP BY 1, 2")
def block_times_tiled(s, d):
    return structured.contract("ik,kj->ij", _blocks(s, d), structured.apply_view(_w(s, d, "l_linenumber"), (4, 4), (2, 6))).df


@query(f"SELECT j AS i0, i AS i1, v FROM {_BW}")
def block_permute(s, d):
    return structured.permute("ji", "ij", _blocks(s, d)).to_dense().df


@query(f"SELECT i AS i0, sum(b.v * x.v) AS v FROM {_BW} b JOIN (SELECT j, sum(v) AS v FROM {W} GROUP BY 1) x USING (j) GROUP BY 1")
def block_gemv(s, d):
    return structured.gemv(1.0, _blocks(s, d), einsum("ij->j", _w(s, d))).df


@query(f"SELECT i AS i0, j AS i1, 2.0 * coalesce(w.v, 0.0) + coalesce(u.v, 0.0) AS v FROM {_BW} w FULL JOIN {_BU} u USING (i, j)")
def block_axpy(s, d):
    return structured.axpy(2.0, _blocks(s, d), _blocks(s, d, "l_linenumber")).to_dense().df


@query(f"SELECT i AS i0, j AS i1, coalesce(w.v, 0.0) + p.x * q.x AS v FROM (SELECT i, j FROM {GRID} WHERE {_IN}) LEFT JOIN {_BW} w USING (i, j) JOIN (SELECT i, sum(v) AS x FROM {W} GROUP BY 1) p USING (i) JOIN (SELECT i AS j, sum(v) AS x FROM {W} GROUP BY 1) q USING (j)")
def block_ger(s, d):
    v = einsum("ij->i", _w(s, d))
    return structured.ger(1.0, v, v, _blocks(s, d)).to_dense().df


@query(f"SELECT sum(w.v * u.v) AS v FROM {_BW} w JOIN {_BU} u USING (i, j)")
def block_true_dot(s, d):
    return structured.true_dot(_blocks(s, d), _blocks(s, d, "l_linenumber")).df


@query(f"SELECT max(abs(v)) AS scale, round(sum(v * v) / max(abs(v)) ** 2, 6) + 0.0 AS sumsq FROM {_BW}")
def block_sum_square(s, d):
    scale, total = structured.sum_square(_blocks(s, d))
    return scale.df.select(F.col("v").alias("scale")).crossJoin(_rounded(total.df).select(F.col("v").alias("sumsq")))


@query(f"SELECT b.j AS i0, c.j AS i1, sum(b.v * a.v * c.v) AS v FROM {_BU} b JOIN {_BW} a ON a.i = b.i JOIN {_BU} c ON c.i = a.j GROUP BY 1, 2")
def block_symm_gemm(s, d):
    return structured.symm_gemm(_blocks(s, d), _blocks(s, d, "l_linenumber")).to_dense().df


@query(f"SELECT i AS i0, j AS i1, (coalesce(w.v, 0.0) - coalesce(u.v, 0.0) + 1.0) / 2 AS v FROM (SELECT i, j FROM {GRID} WHERE {_IN}) LEFT JOIN {_BW} w USING (i, j) LEFT JOIN {_BU} u USING (i, j)")
def block_arithmetic(s, d):
    return (_blocks(s, d) - _blocks(s, d, "l_linenumber")).add_number(1.0).divide(2.0).to_dense().df


# tensors on disk


def _stored(s, t: Tensor) -> DiskTensor:
    disk = create_disk_tensor_like(t, scratch(s, "disk"), "t")
    disk.write(t)
    return disk


@query(f"SELECT i AS i0, k AS i1, v FROM {A}")
def disk_round_trip(s, d):
    held = _stored(s, _a(s, d))
    return DiskTensor(s, held.root.rsplit("/", 1)[0], "t").tensor().df


@query(f"SELECT i - 2 AS i0, k AS i1, v FROM {A} WHERE i >= 2 AND i < 9")
def disk_window(s, d):
    return _stored(s, _a(s, d))[2:9].df


@query(f"SELECT i AS i0, k AS i1, v FROM {A} WHERE NOT (i >= 2 AND i < 9 AND k < 100) UNION ALL SELECT i, k, 7.0 FROM range(2, 9) a(i), range(100) b(k)")
def disk_write_window(s, d):
    disk = _stored(s, _a(s, d))
    disk.write_view((slice(2, 9), slice(0, 100)), 7.0)
    return disk.tensor().df


@query(f"SELECT i AS i0, k AS i1, CASE WHEN i >= 2 AND i < 9 THEN 2 * v ELSE v END AS v FROM {A}")
def disk_add_window(s, d):
    a = _a(s, d)
    disk = _stored(s, a)
    disk.add_view((slice(2, 9),), a[2:9])
    return disk.tensor().df


@query(f"SELECT i AS i0, k AS i1, v FROM {A} WHERE i < 50")
def disk_resize(s, d):
    """Made smaller, then larger again: what was cut off is gone."""
    a = _a(s, d)
    disk = _stored(s, a)
    disk.resize(50, a.dims[1])
    disk.resize(*a.dims)
    return disk.tensor().df


@query(f"SELECT i AS i0, k AS i1, v * 2 AS v FROM {A}")
def disk_get_put(s, d):
    disk = _stored(s, _a(s, d))
    disk.put(disk.get_update() * 2.0)
    return disk.tensor().df


@query(f"SELECT i AS i0, s AS i1, 0.5 * sum(a.v * p.v) + 2 * sum(a.v * p.v) AS v FROM {A} a JOIN {P} p USING (k) GROUP BY 1, 2")
def disk_contract(s, d):
    """What is stored, twice, plus half of what is contracted, stored again."""
    a, p = _a(s, d), _p(s, d)
    disk = _stored(s, einsum("ik,ks->is", a, p))
    disk.contract("ik,ks->is", a, p, alpha=0.5, beta=2.0)
    return disk.tensor().df


@query("SELECT FALSE AS first, TRUE AS again, 'AccessDenied' AS closed, 'Uninitialized' AS gone")
def disk_life(s, d):
    """Made, opened again, closed to writers, unlinked."""
    w = _w(s, d)
    disk = _stored(s, w)
    again = DiskTensor(s, disk.root.rsplit("/", 1)[0], "t")
    said = []
    again.set_read_only()
    for call in (lambda: again.write(w), lambda: (disk.unlink(), DiskTensor(s, disk.root.rsplit("/", 1)[0], "t"))):
        try:
            call()
        except errors.TensorError as e:
            said.append(type(e).__name__)
    return _rows(s, "first boolean, again boolean, closed string, gone string", [(disk.existed(), again.existed(), *said)])


@query(f"SELECT i AS i0, j AS i1, v FROM {W}")
def text_round_trip(s, d):
    """Cells as lines of text, indices from one."""
    folder = scratch(s, "text")
    w = _w(s, d)
    w.df.select(F.concat_ws(" ", *((c + 1).cast("string") for c in w.indices), F.col("v").cast("string"))).write.text(folder)
    return read_tensor(s, folder, w.dims, symmetric=False).df


@query(f"SELECT k AS i0, v FROM {X}")
def buffer_round_trip(s, d):
    return Tensor.from_numpy(s, np.asarray(_x(s, d).to_numpy())).df


@query(f"SELECT k AS i0, v FROM {X}")
def iterate(s, d):
    """A vector read cell by cell, in order."""
    return Tensor.from_numpy(s, np.array(list(_x(s, d)))).df
