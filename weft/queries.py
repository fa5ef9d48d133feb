"""Queries that apply the tensor operators to whole business tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import generators as g
from weft.operators import blas, elementwise, fft, norms, shape, solve, spectral, structured
from weft.operators.decomposition import parafac, parafac_reconstruct, tucker_ho_svd, tucker_reconstruct
from weft.plans.contraction import Plan, einsum
from weft.sources import tables as src
from weft.config import scratch
from weft.streaming.contraction import contract_stream, keep, latest
from weft.tensor import Tensor

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# the tensors, as SQL
A = "(SELECT l_suppkey AS i, l_partkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
T = "(SELECT l_suppkey AS i, l_partkey AS k, CAST(l_linenumber AS BIGINT) AS l, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)"
P = "(SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS s, CAST(sum(p_size) AS DOUBLE) AS v FROM part GROUP BY 1, 2)"
X = "(SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS v FROM part)"
W = "(SELECT l_orderkey % 8 AS i, CAST(l_linenumber AS BIGINT) AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
U = "(SELECT l_orderkey % 8 AS i, CAST(l_linenumber AS BIGINT) AS j, CAST(sum(l_linenumber) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2)"
E = "(SELECT vec_id AS i, unnest(range(len(embedding))) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
EL = "(SELECT CAST(label AS BIGINT) AS b, vec_id AS i, unnest(range(len(embedding))) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE label IS NOT NULL)"
GRID = "(SELECT i, j FROM range(8) a(i), range(8) b(j))"
DW = f"(SELECT i, j, coalesce(v, 0.0) AS v FROM {GRID} LEFT JOIN {W} w USING (i, j))"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


def _w(s: SparkSession, d: str, column: str = "l_quantity") -> Tensor:
    """8 x 8: order key modulo 8, line number."""
    rows = src.table(s, d, "lineitem")
    return Tensor.of(rows, [F.col("l_orderkey") % 8, "l_linenumber"], F.col(column).cast("double"), (8, 8), summed=True)


def _p(s: SparkSession, d: str) -> Tensor:
    """(part, size): the size again."""
    rows = src.table(s, d, "part")
    (parts, sizes), (used,) = src.bounds(s, d, "part", "p_partkey", "p_size"), src.bounds(s, d, "lineitem", "l_partkey")
    return Tensor.of(rows, ["p_partkey", "p_size"], F.col("p_size").cast("double"), (max(parts, used), sizes), summed=True)


def _a(s: SparkSession, d: str) -> Tensor:
    t = src.quantities(s, d)
    n = max(t.dims[1], src.bounds(s, d, "part", "p_partkey")[0])
    return t.with_rows(t.df, (t.dims[0], n))


def _t(s: SparkSession, d: str) -> Tensor:
    t = src.quantities_by_line(s, d)
    n = max(t.dims[1], src.bounds(s, d, "part", "p_partkey")[0])
    return t.with_rows(t.df, (t.dims[0], n, t.dims[2]))


def _x(s: SparkSession, d: str) -> Tensor:
    return src.part_sizes(s, d)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    # adding 0.0 makes the negative zero that rounding can leave a plain one
    return df.withColumn("v", F.round("v", digits) + F.lit(0.0))


def _parts(t: Tensor, digits: int | None = None) -> DataFrame:
    re, im = F.col("v.re"), F.col("v.im")
    if digits is not None:
        re, im = F.round(re, digits) + F.lit(0.0), F.round(im, digits) + F.lit(0.0)
    return t.df.select(*t.columns, re.alias("re"), im.alias("im"))


# contraction


@query(f"SELECT a.i AS i0, b.i AS i1, sum(a.v * b.v) AS v FROM {A} a JOIN {A} b USING (k) GROUP BY 1, 2")
def einsum_gemm(s, d):
    a = _a(s, d)
    return einsum("ik,jk->ij", a, a).df


@query(f"SELECT a.i AS i0, p.s AS i1, sum(a.v * p.v) AS v FROM {A} a JOIN {P} p USING (k) GROUP BY 1, 2")
def einsum_gemm_trans_a(s, d):
    return einsum("ki,ks->is", _a(s, d).T, _p(s, d)).df


@query(f"SELECT a.i AS i0, p.s AS i1, sum(a.v * p.v) AS v FROM {A} a JOIN {P} p USING (k) GROUP BY 1, 2")
def einsum_gemm_trans_b(s, d):
    return einsum("ik,sk->is", _a(s, d), _p(s, d).T).df


@query(f"SELECT p.s AS i0, a.i AS i1, sum(a.v * p.v) AS v FROM {A} a JOIN {P} p USING (k) GROUP BY 1, 2")
def einsum_gemm_trans_c(s, d):
    return einsum("ik,ks->si", _a(s, d), _p(s, d)).df


@query(f"SELECT a.i AS i0, p.s AS i1, sum(a.v * p.v) AS v FROM {A} a JOIN {P} p USING (k) GROUP BY 1, 2")
def einsum_gemm_blocked(s, d):
    return einsum("ik,ks->is", _a(s, d), _p(s, d), blocked=True).df


@query(f"SELECT a.i AS i0, sum(a.v * x.v) AS v FROM {A} a JOIN {X} x USING (k) GROUP BY 1")
def einsum_gemv(s, d):
    return einsum("ik,k->i", _a(s, d), _x(s, d)).df


@query(f"SELECT a.i AS i0, sum(a.v * x.v) AS v FROM {A} a JOIN {X} x USING (k) GROUP BY 1")
def einsum_gemv_swap(s, d):
    return einsum("k,ik->i", _x(s, d), _a(s, d)).df


@query(f"SELECT a.i AS i0, sum(a.v * x.v) AS v FROM {A} a JOIN {X} x USING (k) GROUP BY 1")
def einsum_gemv_transpose(s, d):
    return einsum("ki,k->i", _a(s, d).T, _x(s, d)).df


@query(f"SELECT sum(v * v) AS v FROM {A}")
def einsum_dot(s, d):
    a = _a(s, d)
    return einsum("ik,ik->", a, a).df


@query(f"SELECT i AS i0, k AS i1, v * v AS v FROM {A}")
def einsum_direct(s, d):
    a = _a(s, d)
    return einsum("ik,ik->ik", a, a).df


@query("SELECT CAST(r_regionkey AS BIGINT) AS i0, CAST(n_nationkey AS BIGINT) AS i1, CAST(r_regionkey * n_nationkey AS DOUBLE) AS v FROM region, nation")
def einsum_ger(s, d):
    return einsum("i,j->ij", src.keys(s, d, "region", "r_regionkey"), src.keys(s, d, "nation", "n_nationkey")).df


@query(f"SELECT w.i AS i0, CAST(r_regionkey AS BIGINT) AS i1, w.j AS i2, v * r_regionkey AS v FROM {W} w, region")
def einsum_ger_matrix(s, d):
    return einsum("ij,k->ikj", _w(s, d), src.keys(s, d, "region", "r_regionkey")).df


@query(f"SELECT t.i AS i0, sum(t.v * u.v) AS v FROM {T} t JOIN {U} u ON u.j = t.l JOIN {P} p ON p.k = t.k AND p.s = u.i GROUP BY 1")
def einsum_three_operands(s, d):
    ones = _p(s, d).map_values(lambda v: F.lit(1.0))
    u = _w(s, d, "l_linenumber")
    n = max(8, ones.dims[1])
    return einsum("ikl,sl,ks->i", _t(s, d), u.with_rows(u.df, (n, 8)), ones.with_rows(ones.df, (ones.dims[0], n))).df


@query(f"SELECT t.i AS i0, sum(t.v * q.v) AS v FROM {T} t JOIN (SELECT k, l, v FROM {T}) q ON q.k = t.k AND q.l = t.l GROUP BY 1")
def einsum_generic_multi_link(s, d):
    t = _t(s, d)
    other = einsum("ikl->kl", t)
    return einsum("ikl,kl->i", t, other).df


@query(f"SELECT a.i AS i0, b.j AS i1, a.v * b.v AS v FROM (SELECT i, v FROM {W} WHERE i = j) a, (SELECT j, v FROM {U} WHERE i = j) b")
def einsum_hadamard_in(s, d):
    return einsum("ii,jj->ij", _w(s, d), _w(s, d, "l_linenumber")).df


@query(f"SELECT a.i AS i0, a.i AS i1, sum(a.v * b.v) AS v FROM {W} a JOIN {U} b ON b.i = a.j AND b.j = a.i GROUP BY 1, 2")
def einsum_hadamard_out(s, d):
    return einsum("ij,ji->ii", _w(s, d), _w(s, d, "l_linenumber")).df


@query(f"SELECT a.b AS i0, a.i AS i1, c.i AS i2, round(sum(a.v * c.v), 6) + 0.0 AS v FROM {EL} a JOIN {EL} c USING (b, k) GROUP BY 1, 2, 3")
def einsum_batch(s, d):
    e = src.features_by_label(s, d)
    return _rounded(einsum("bik,bjk->bij", e, e, blocked=True).df)


@query(f"SELECT i0, i1, coalesce(2.0 * w.v, 0.0) + coalesce(0.5 * n.v, 0.0) AS v FROM (SELECT i AS i0, j AS i1, v FROM {W}) w FULL JOIN (SELECT a.i AS i0, b.j AS i1, sum(a.v * b.v) AS v FROM {W} a JOIN {U} b ON b.i = a.j GROUP BY 1, 2) n USING (i0, i1)")
def einsum_beta(s, d):
    w = _w(s, d)
    return Plan("ij", "ik", "kj").execute(w, _w(s, d, "l_linenumber"), previous=w, alpha=0.5, beta=2.0).df


@query(f"SELECT k AS i0, sum(t.v) * any_value(x.v) AS v FROM {T} t JOIN {X} x USING (k) GROUP BY 1")
def einsum_private_labels(s, d):
    return einsum("ikl,k->k", _t(s, d), _x(s, d)).df


@query(f"SELECT i0, j AS i1, v FROM (SELECT a.i AS i0, sum(a.v * x.v) AS v FROM {A} a JOIN {X} x USING (k) GROUP BY 1), range(3) r(j)")
def einsum_broadcast_output(s, d):
    a = _a(s, d)
    return einsum("ik,k->ij", a, _x(s, d), dims=(a.dims[0], 3)).df


@query(f"SELECT sum(w.v * w.v - u.v * u.v) AS re, sum(2 * w.v * u.v) AS im FROM {W} w JOIN {U} u USING (i, j)")
def einsum_dot_complex(s, d):
    z = elementwise.to_complex(_w(s, d), _w(s, d, "l_linenumber"))
    return _parts(einsum("ij,ij->", z, z))


@query(f"SELECT sum(w.v * w.v + u.v * u.v) AS re, 0.0::DOUBLE AS im FROM {W} w JOIN {U} u USING (i, j)")
def true_dot_complex(s, d):
    z = elementwise.to_complex(_w(s, d), _w(s, d, "l_linenumber"))
    return _parts(blas.true_dot(z, z))


@query(f"SELECT a.i AS i0, b.j AS i1, sum(a.v * b.v - c.v * e.v) AS re, sum(a.v * e.v + c.v * b.v) AS im FROM {W} a JOIN {U} c USING (i, j) JOIN {W} b ON b.i = a.j JOIN {U} e ON e.i = b.i AND e.j = b.j GROUP BY 1, 2")
def einsum_gemm_complex(s, d):
    z = elementwise.to_complex(_w(s, d), _w(s, d, "l_linenumber"))
    return _parts(einsum("ik,kj->ij", z, z))


@query(f"SELECT a.b AS i0, round(sum(a.v * a.v), 6) + 0.0 AS v FROM {EL} a GROUP BY 1")
def einsum_batched_dot(s, d):
    from weft.plans.contraction import batched

    e = src.features_by_label(s, d)
    return _rounded(batched(Plan("", "ik", "ik"), e, e).df)


@query(f"SELECT a.i AS i0, sum(a.v * x.v) AS v FROM {A} a JOIN {X} x USING (k) GROUP BY 1")
def stream_gemv(s, d):
    """The rows arrive as a stream; sums that change go to files, and the last one of each counts."""

    static = src.table(s, d, "lineitem")
    rows = s.readStream.schema(static.schema).parquet(f"{d}/lineitem.parq*")
    changes = rows.select(F.col("l_suppkey").alias("i0"), F.col("l_partkey").alias("i1"), F.col("l_quantity").alias("v"))
    folder = scratch(s, "stream")
    keep(contract_stream(changes, "ik", _x(s, d), "k", "i"), f"{folder}/sums", f"{folder}/check").awaitTermination()
    return latest(f"{folder}/sums", s, ["i0"])


# blocks and tiles


@query(f"SELECT a.i AS i0, b.j AS i1, sum(a.v * b.v) AS v FROM {W} a JOIN {U} b ON b.i = a.j AND a.i // 4 = a.j // 4 AND b.i // 4 = b.j // 4 GROUP BY 1, 2")
def block_gemm(s, d):
    a, b = (structured.BlockTensor.of(_w(s, d, c), (4, 4)) for c in ("l_quantity", "l_linenumber"))
    return structured.contract("ik,kj->ij", a, b).to_dense().df


@query(f"SELECT sum(a.v * b.v) AS v FROM {W} a JOIN {U} b USING (i, j) WHERE i // 4 = j // 4")
def block_dot(s, d):
    a, b = (structured.BlockTensor.of(_w(s, d, c), (4, 4)) for c in ("l_quantity", "l_linenumber"))
    return structured.contract("ij,ij->", a, b).df


@query(f"SELECT a.i AS i0, b.j AS i1, sum(a.v * b.v) AS v FROM {W} a JOIN {U} b ON b.i = a.j WHERE a.i // 4 = a.j // 4 GROUP BY 1, 2")
def block_times_dense(s, d):
    return structured.contract("ik,kj->ij", structured.BlockTensor.of(_w(s, d), (4, 4)), _w(s, d, "l_linenumber")).df


@query(f"SELECT a.i AS i0, b.j AS i1, sum(a.v * b.v) AS v FROM {W} a JOIN {U} b ON b.i = a.j GROUP BY 1, 2")
def tiled_gemm(s, d):
    a, b = (structured.TiledTensor.of(_w(s, d, c), ((3, 0, 5), (3, 0, 5))) for c in ("l_quantity", "l_linenumber"))
    return structured.contract("ik,kj->ij", a, b).to_dense().df


@query(f"SELECT DISTINCT CAST(CASE WHEN i < 3 THEN 0 ELSE 2 END AS INTEGER) AS t0, CAST(CASE WHEN j < 3 THEN 0 ELSE 2 END AS INTEGER) AS t1 FROM {W}")
def tiled_filled(s, d):
    return structured.TiledTensor.of(_w(s, d), ((3, 0, 5), (3, 0, 5))).filled()


@query(f"SELECT b AS blk, round(max(CASE WHEN i % 2 = 0 AND j % 2 = 0 THEN v END) * max(CASE WHEN i % 2 = 1 AND j % 2 = 1 THEN v END) - max(CASE WHEN i % 2 = 0 AND j % 2 = 1 THEN v END) * max(CASE WHEN i % 2 = 1 AND j % 2 = 0 THEN v END), 2) + 0.0 AS v FROM (SELECT i // 2 AS b, * FROM {DW} WHERE i // 2 = j // 2) GROUP BY 1")
def block_det(s, d):
    return _rounded(structured.BlockTensor.of(_w(s, d), (2, 2, 2, 2)).det(), 2)


# shapes and views


@query(f"SELECT l AS i0, i AS i1, k AS i2, v FROM {T}")
def permute(s, d):
    return shape.permute("kij", "ijk", _t(s, d)).df


@query(f"SELECT i AS i0, j AS i1, coalesce(2.0 * u.v, 0.0) + coalesce(0.5 * w.v, 0.0) AS v FROM {U} u FULL JOIN (SELECT j AS i, i AS j, v FROM {W}) w USING (i, j)")
def permute_beta(s, d):
    return shape.permute("ji", "ij", _w(s, d), _w(s, d, "l_linenumber"), alpha=0.5, beta=2.0).df


@query(f"SELECT k AS i0, i AS i1, v FROM {A}")
def transpose(s, d):
    return _a(s, d).T.df


@query(f"SELECT i AS i0, k * 8 + l AS i1, v FROM {T}")
def unfold_0(s, d):
    return shape.unfold(_lines(s, d), 0).df


@query(f"SELECT k AS i0, i * 8 + l AS i1, v FROM {T}")
def unfold_1(s, d):
    return shape.unfold(_lines(s, d), 1).df


@query(f"SELECT l AS i0, i + k * (SELECT max(l_suppkey) + 1 FROM lineitem) AS i1, v FROM {T}")
def unfold_2_column_order(s, d):
    return shape.unfold(_lines(s, d), 2, "F").df


def _lines(s, d) -> Tensor:
    t = _t(s, d)
    return t.with_rows(t.df, (*t.dims[:2], 8))


@query(f"SELECT (i * 8 + j) // 16 AS i0, (i * 8 + j) % 16 // 4 AS i1, (i * 8 + j) % 4 AS i2, v FROM {W}")
def reshape(s, d):
    return shape.reshape(_w(s, d), 4, -1, 4).df


@query(f"SELECT i AS i0, v FROM {W} WHERE i = j")
def tie_indices(s, d):
    return shape.tie_indices(_w(s, d), 0, 1).df


@query(f"SELECT a.i * 8 + b.i AS i0, a.j AS i1, a.v * b.v AS v FROM {W} a JOIN {U} b USING (j)")
def khatri_rao(s, d):
    return shape.khatri_rao("ir", _w(s, d), "mr", _w(s, d, "l_linenumber")).df


@query(f"SELECT i - 2 AS i0, k AS i1, v FROM {A} WHERE i >= 2 AND i < 9")
def slice_range(s, d):
    return _a(s, d)[2:9].df


@query(f"SELECT i AS i0, k AS i1, v FROM {T} WHERE l = 3")
def slice_index(s, d):
    return _t(s, d)[:, :, 3].df


@query(f"SELECT i AS i0, j AS i1, v FROM {W} WHERE NOT (i >= 2 AND i < 4 AND j < 5) UNION ALL SELECT i, j, 7.0 FROM {GRID} WHERE i >= 2 AND i < 4 AND j < 5")
def view_assign(s, d):
    return _w(s, d).assign((slice(2, 4), slice(0, 5)), 7.0).df


# element by element


@query(f"SELECT i AS i0, j AS i1, coalesce(w.v, 0.0) + coalesce(u.v, 0.0) AS v FROM {W} w FULL JOIN {U} u USING (i, j)")
def add(s, d):
    return (_w(s, d) + _w(s, d, "l_linenumber")).df


@query(f"SELECT i AS i0, j AS i1, coalesce(w.v, 0.0) - coalesce(u.v, 0.0) AS v FROM {W} w FULL JOIN (SELECT j AS i, i AS j, v FROM {U}) u USING (i, j)")
def subtract(s, d):
    return (_w(s, d) - _w(s, d, "l_linenumber").T).df


@query(f"SELECT i AS i0, j AS i1, w.v * u.v AS v FROM {W} w JOIN (SELECT j AS i, i AS j, v FROM {U}) u USING (i, j)")
def multiply(s, d):
    return (_w(s, d) * _w(s, d, "l_linenumber").T).df


@query(f"SELECT i AS i0, j AS i1, round(w.v / u.v, 6) + 0.0 AS v FROM {DW} w JOIN (SELECT i, j, 1.0 + coalesce(v, 0.0) AS v FROM {GRID} LEFT JOIN {U} x USING (i, j)) u USING (i, j)")
def divide(s, d):
    return _rounded((_w(s, d).densify() / (_w(s, d, "l_linenumber") + 1.0)).df)


@query(f"SELECT i AS i0, j AS i1, v + 3.0 AS v FROM {DW}")
def add_number(s, d):
    return (_w(s, d) + 3.0).df


@query(f"SELECT i AS i0, k AS i1, v * 2.5 AS v FROM {A}")
def multiply_number(s, d):
    return (_a(s, d) * 2.5).df


@query(f"SELECT i AS i0, j AS i1, round(1.0 / (v + 1.0), 6) + 0.0 AS v FROM {DW}")
def divide_number_by_tensor(s, d):
    return _rounded((1.0 / (_w(s, d) + 1.0)).df)


@query(f"SELECT i AS i0, j AS i1, round(exp(-v / 10000), 6) + 0.0 AS v FROM {DW}")
def element_transform(s, d):
    return _rounded(elementwise.element_transform(_w(s, d), lambda v: F.exp(-v / 10000)).df)


@query(f"SELECT i AS i0, j AS i1, w.v + 2 * coalesce(u.v, 0.0) + 1 AS v FROM {DW} w LEFT JOIN {U} u USING (i, j)")
def element(s, d):
    return elementwise.element(lambda a, b: a + 2 * b + 1, _w(s, d), _w(s, d, "l_linenumber")).df


@query(f"SELECT i AS i0, j AS i1, w.v AS re, -u.v AS im FROM {W} w JOIN {U} u USING (i, j)")
def conjugate(s, d):
    return _parts(elementwise.conjugate(elementwise.to_complex(_w(s, d), _w(s, d, "l_linenumber"))))


@query(f"SELECT i AS i0, j AS i1, round(sqrt(w.v * w.v + u.v * u.v), 6) + 0.0 AS v FROM {W} w JOIN {U} u USING (i, j)")
def absolute_complex(s, d):
    return _rounded(elementwise.absolute(elementwise.to_complex(_w(s, d), _w(s, d, "l_linenumber"))).df)


@query(f"SELECT i AS i0, j AS i1, v FROM {U}")
def imaginary_part(s, d):
    return elementwise.imag(elementwise.to_complex(_w(s, d), _w(s, d, "l_linenumber"))).df


@query(f"SELECT round(sqrt(sum((coalesce(w.v, 0.0) - coalesce(u.v, 0.0)) ** 2) / 64), 6) + 0.0 AS v FROM {W} w FULL JOIN {U} u USING (i, j)")
def rmsd(s, d):
    return _rounded(elementwise.rmsd(_w(s, d), _w(s, d, "l_linenumber")).df)


# vectors and matrices


@query(f"SELECT i AS i0, j AS i1, CASE WHEN i = 2 THEN v * 3 ELSE v END AS v FROM {W}")
def scale_row(s, d):
    return blas.scale_row(2, 3.0, _w(s, d)).df


@query(f"SELECT i AS i0, j AS i1, CASE WHEN j = 2 THEN v * 3 ELSE v END AS v FROM {W}")
def scale_column(s, d):
    return blas.scale_column(2, 3.0, _w(s, d)).df


@query(f"SELECT i AS i0, j AS i1, 2.0 * coalesce(w.v, 0.0) + 3.0 * coalesce(u.v, 0.0) AS v FROM {W} w FULL JOIN (SELECT j AS i, i AS j, v FROM {U}) u USING (i, j)")
def axpby(s, d):
    return blas.axpby(2.0, _w(s, d), 3.0, _w(s, d, "l_linenumber").T).df


@query(f"SELECT i AS i0, j AS i1, 2.0 * coalesce(w.v, 0.0) + coalesce(u.v, 0.0) AS v FROM {W} w FULL JOIN {U} u USING (i, j)")
def axpy(s, d):
    return blas.axpy(2.0, _w(s, d), _w(s, d, "l_linenumber")).df


@query(f"SELECT b.j AS i0, c.j AS i1, sum(b.v * a.v * c.v) AS v FROM {U} b JOIN {W} a ON a.i = b.i JOIN {U} c ON c.i = a.j GROUP BY 1, 2")
def symm_gemm(s, d):
    return blas.symm_gemm(_w(s, d), _w(s, d, "l_linenumber")).df


@query(f"SELECT sum(w.v * u.v * w.v) AS v FROM {W} w JOIN {U} u USING (i, j)")
def dot_of_three(s, d):
    w = _w(s, d)
    return blas.dot(w, _w(s, d, "l_linenumber"), w).df


@query(f"SELECT sum(v) AS v FROM {W} WHERE i = j")
def trace(s, d):
    return blas.trace(_w(s, d)).df


@query(f"SELECT i AS i0, k AS i1, v * x AS v FROM {A} JOIN (SELECT s_suppkey AS i, CAST(s_nationkey AS DOUBLE) AS x FROM supplier) USING (i)")
def weight_tensor(s, d):
    a = _a(s, d)
    w = Tensor.of(src.table(s, d, "supplier"), ["s_suppkey"], F.col("s_nationkey").cast("double"), [a.dims[0]])
    return blas.weight(a, w).df


@query(f"SELECT max(abs(v)) AS v FROM {A}")
def norm_maxabs(s, d):
    return norms.norm(norms.Norm.MAXABS, _a(s, d)).df


@query(f"SELECT max(x) AS v FROM (SELECT sum(abs(v)) AS x FROM {A} GROUP BY k)")
def norm_one(s, d):
    return norms.norm(norms.Norm.ONE, _a(s, d)).df


@query(f"SELECT max(x) AS v FROM (SELECT sum(abs(v)) AS x FROM {A} GROUP BY i)")
def norm_infinity(s, d):
    return norms.norm(norms.Norm.INFTY, _a(s, d)).df


@query(f"SELECT round(sqrt(sum(v * v)), 6) + 0.0 AS v FROM {A}")
def norm_frobenius(s, d):
    return _rounded(norms.norm(norms.Norm.FROBENIUS, _a(s, d)).df)


@query(f"SELECT round(sqrt(sum(v * v)), 6) + 0.0 AS v FROM {T}")
def vec_norm(s, d):
    return _rounded(norms.vec_norm(_t(s, d)).df)


@query(f"SELECT max(abs(v)) AS scale, round(sum(v * v) / max(abs(v)) ** 2, 6) + 0.0 AS sumsq FROM {A}")
def sum_square(s, d):
    scale, sumsq = blas.sum_square(_a(s, d))
    return scale.df.select(F.col("v").alias("scale")).crossJoin(sumsq.df.select((F.round("v", 6) + F.lit(0.0)).alias("sumsq")))


# generators


@query("SELECT i AS i0, i AS i1, 1.0::DOUBLE AS v FROM range(100) r(i)")
def identity(s, d):
    return g.identity(s, 100).df


@query("SELECT i AS i0, 2.0::DOUBLE + i * 0.5::DOUBLE AS v FROM range(16) r(i)")
def arange(s, d):
    return g.arange(s, 2.0, 10.0, 0.5).df


@query("SELECT i AS i0, j AS i1, CAST(i * 20 + j AS DOUBLE) AS v FROM range(10) a(i), range(20) b(j)")
def incremented(s, d):
    return g.incremented(s, (10, 20)).df


@query(f"SELECT k AS i0, k AS i1, v FROM {X}")
def diagonal(s, d):
    return g.diagonal(_x(s, d)).df


@query("SELECT i AS i0, CAST(CASE WHEN i <= 4 THEN i ELSE i - 10 END AS DOUBLE) / 5.0::DOUBLE AS v FROM range(10) r(i)")
def fftfreq(s, d):
    return fft.fftfreq(s, 10, 0.5).df


_SIGNAL = f"(SELECT k, sum(v) AS v FROM {E} GROUP BY k)"


@query(f"SELECT f AS i0, round(sum(v * cos(2 * pi() * (f * k % 64) / 64)), 6) + 0.0 AS re, round(-sum(v * sin(2 * pi() * (f * k % 64) / 64)), 6) + 0.0 AS im FROM {_SIGNAL}, range(33) r(f) GROUP BY 1")
def fft_real(s, d):
    return _parts(fft.fft(einsum("ik->k", src.features(s, d))), 6)


@query(f"SELECT k AS i0, round(64 * v, 6) + 0.0 AS v FROM {_SIGNAL}")
def ifft_of_fft(s, d):
    return _rounded(fft.ifft(fft.fft(einsum("ik->k", src.features(s, d))), 64, real=True).df)


@query(f"SELECT i AS i0, f AS i1, round(sum(v * cos(2 * pi() * (f * k % 64) / 64)), 6) + 0.0 AS re, round(-sum(v * sin(2 * pi() * (f * k % 64) / 64)), 6) + 0.0 AS im FROM {E}, range(33) r(f) GROUP BY 1, 2")
def fft_of_rows(s, d):
    return _parts(fft.fft_rows(src.features(s, d)), 6)


# factorisations: quantities that SQL can name


@query(f"SELECT round(sum(v * v), 4) + 0.0 AS trace FROM {E}")
def syev_trace(s, d):
    w, _ = spectral.syev(spectral.gram(src.features(s, d), "columns"))
    return w.df.agg((F.round(F.sum("v"), 4) + F.lit(0.0)).alias("trace"))


@query(f"SELECT round(sum(v * v), 4) + 0.0 AS squares FROM {E}")
def svd_squares(s, d):
    _, w, _ = spectral.svd(src.features(s, d), spectral.Vectors.NONE, spectral.Vectors.NONE)
    return w.df.agg((F.round(F.sum(F.col("v") * F.col("v")), 4) + F.lit(0.0)).alias("squares"))


def _error(t: Tensor, digits: int = 4) -> DataFrame:
    return norms.norm(norms.Norm.MAXABS, t).df.select((F.round("v", digits) + F.lit(0.0)).alias("error"))


@query("SELECT 0.0::DOUBLE AS error")
def qr_error(s, d):
    e = src.features(s, d)
    q, r = spectral.qr(e)
    return _error(q @ r - e)


def _shifted(s, d) -> Tensor:
    """A symmetric positive definite 8 x 8 matrix of shares."""
    w = _w(s, d)
    size = float(norms.norm(norms.Norm.FROBENIUS, w).item()) or 1.0
    return (w + w.T) * (1 / size) + g.identity(s, 8) * 4.0


@query("SELECT 0.0::DOUBLE AS error")
def gesv_error(s, d):
    a, b = _shifted(s, d), g.arange(s, 1.0, 9.0)
    x, *_ = solve.gesv(a, b)
    return _error(blas.gemv(1.0, a, x) - b)


@query("SELECT 0.0::DOUBLE AS error")
def invert_error(s, d):
    a = _shifted(s, d)
    return _error(a @ solve.invert(a) - g.identity(s, 8))


@query("SELECT 0.0::DOUBLE AS error")
def power_error(s, d):
    a = _shifted(s, d)
    r = solve.power(a, -0.5)
    return _error(r @ a @ r - g.identity(s, 8))


@query("SELECT 0.0::DOUBLE AS error")
def lyapunov_error(s, d):
    a, q = _shifted(s, d), g.identity(s, 8)
    x = solve.solve_continuous_lyapunov(a, q)
    return _error(a @ x + x @ a.T - q)


@query("SELECT 0.0::DOUBLE AS error")
def lu_error(s, d):
    a = _shifted(s, d)
    f, swaps, _ = solve.getrf(a)
    p, low, up = solve.extract_plu(f, swaps)
    return _error(p @ low @ up - a)


@query("SELECT TRUE AS close")
def truncated_svd_close(s, d):
    w = _w(s, d)
    _, some, _ = spectral.truncated_svd(w, 1)
    _, every, _ = spectral.svd(w, spectral.Vectors.NONE, spectral.Vectors.NONE)
    return (some - every[0:1]).df.select((F.abs("v") < 0.01 * F.lit(float(np.abs(every.to_numpy()).max()))).alias("close"))


@query()
def parafac_fit(s, d):
    """Rows of the fit: (order mod 8, line, supplier mod 4) in rank 2."""
    t = _cube(s, d)
    return _rounded(parafac_reconstruct(parafac(t, 2, 10)).df, 3)


@query()
def tucker_fit(s, d):
    t = _cube(s, d)
    return _rounded(tucker_reconstruct(*tucker_ho_svd(t, (2, 2, 2))).df, 3)


def _cube(s, d) -> Tensor:
    rows = src.table(s, d, "lineitem")
    return Tensor.of(rows, [F.col("l_orderkey") % 8, "l_linenumber", F.col("l_suppkey") % 4], "l_quantity", (8, 8, 4), summed=True)


def _load() -> None:
    from weft import queries_linear

    assert queries_linear


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
