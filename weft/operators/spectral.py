"""Eigenvalues, singular values, QR. Eigenvalues ascend (general ones by real, then imaginary part); the largest component of each vector is positive."""

from __future__ import annotations

from enum import Enum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.errors import DimensionError, EnumError, TooLarge
from weft.functions.generators import random
from weft.functions.scalars import is_complex
from weft.operators.local import canonical_columns, on_driver
from weft.plans.contraction import Plan
from weft.tensor import LOCAL_CELLS, Tensor, require, square


class Vectors(Enum):
    ALL = "A"
    SOME = "S"
    NONE = "N"


def gram(t: Tensor, side: str | None = None) -> Tensor:
    """t^H t or t t^H, the smaller one unless ``side`` says "columns" or "rows": one distributed contraction."""
    require(t, 2)
    columns = side == "columns" if side else t.dims[1] <= t.dims[0]
    return Plan("ij", "ki", "kj").execute(t, t, conj_a=True) if columns else Plan("ij", "ik", "jk").execute(t, t, conj_b=True)


def syev(a: Tensor, vectors: bool = True) -> tuple[Tensor, Tensor | None]:
    """Eigenvalues and eigenvectors (as columns) of a symmetric matrix."""
    square(a)

    def f(x):
        w, v = np.linalg.eigh((x + x.conj().T) / 2)
        return (w, *canonical_columns(v))

    w, v = on_driver(f, a)
    return w, v if vectors else None


heev = syev


def sterf(d: Tensor, e: Tensor) -> Tensor:
    """Eigenvalues of a symmetric tridiagonal matrix."""
    return on_driver(lambda x, y: np.linalg.eigvalsh(np.diag(x) + np.diag(y, -1) + np.diag(y, 1)), d, e)


def geev(a: Tensor, left: bool = True, right: bool = True) -> tuple[Tensor, Tensor | None, Tensor | None]:
    """Complex eigenvalues, left and right eigenvectors of unit length."""
    square(a)

    def f(x):
        w, r = np.linalg.eig(x)
        order = np.lexsort((w.imag.round(12), w.real.round(12)))
        w, r = w[order].astype(complex), r[:, order].astype(complex)
        if not len(w) or np.linalg.cond(r) < 1e12:
            l = np.linalg.inv(r).conj().T  # rows of the inverse are the left vectors
            return w, *canonical_columns(l / np.linalg.norm(l, axis=0)), *canonical_columns(r)
        wl, l = np.linalg.eig(x.conj().T)
        free, match = np.ones(len(wl), dtype=bool), []
        for z in w:
            match.append(int(np.where(free, np.abs(wl.conj() - z), np.inf).argmin()))
            free[match[-1]] = False
        return w, *canonical_columns(l[:, match].astype(complex)), *canonical_columns(r)

    w, l, r = on_driver(f, a)
    return w, l if left else None, r if right else None


def schur(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """t upper triangular and z unitary with z t z^H = x, by shifted QR steps; dependent eigenvectors do no harm."""
    t = np.array(x, dtype=complex)
    n = len(t)
    z = np.eye(n, dtype=complex)
    least = np.finfo(float).eps * (np.linalg.norm(t) or 1.0)
    high, steps = n - 1, 0
    while high > 0:
        if np.linalg.norm(t[high, :high]) <= least:
            t[high, :high] = 0
            high, steps = high - 1, 0
            continue
        steps += 1
        if steps > 30 * n:
            raise np.linalg.LinAlgError("the QR steps do not end")
        # the eigenvalue of the last 2 x 2 block that is nearer to its corner; a turn off the path now and then
        a, b, c, d = t[high - 1, high - 1], t[high - 1, high], t[high, high - 1], t[high, high]
        root = np.sqrt((a - d) ** 2 / 4 + b * c + 0j)
        shift = min(((a + d) / 2 + root, (a + d) / 2 - root), key=lambda e: abs(e - d))
        if steps % 11 == 10:
            shift = d + np.linalg.norm(t[high, :high])
        k = high + 1
        q, r = np.linalg.qr(t[:k, :k] - shift * np.eye(k))
        t[:k, :k] = r @ q + shift * np.eye(k)
        t[:k, k:] = q.conj().T @ t[:k, k:]
        z[:, :k] = z[:, :k] @ q
    return np.triu(t), z


def gees(a: Tensor) -> tuple[Tensor, Tensor]:
    """Complex Schur form: t upper triangular and z unitary with z t z^H = a."""
    square(a)
    return on_driver(schur, a)


def _fits(a: Tensor, k: int) -> None:
    if a.dims[k] ** 2 > LOCAL_CELLS:
        raise TooLarge(f"all {a.dims[k]} vectors of {a.dims}: ask for SOME")


def svd(a: Tensor, u: Vectors = Vectors.ALL, vh: Vectors = Vectors.ALL) -> tuple[Tensor | None, Tensor, Tensor | None]:
    """u, s, v^H. A matrix that does not fit one machine goes through a distributed QR of its long side, which keeps small
    singular values; ALL vectors of a side are refused where they alone would not fit one machine, at every size of the other side."""
    require(a, 2)
    for x in (u, vh):
        if not isinstance(x, Vectors):
            raise EnumError(f"{x!r} says nothing of vectors")
    m, n = a.dims
    if u is Vectors.ALL and m > n:
        _fits(a, 0)
    if vh is Vectors.ALL and n > m:
        _fits(a, 1)
    if a.size > LOCAL_CELLS:
        return _svd_of_long(a, u, vh)
    full = (u is Vectors.ALL and m > n) or (vh is Vectors.ALL and n > m)

    def f(x):
        p, s, q = np.linalg.svd(x, full_matrices=full)
        k = len(s)
        turned, rest = canonical_columns(p[:, :k], q[:k].conj().T)
        return np.hstack([turned, p[:, k:]]), s, np.vstack([rest.conj().T, q[k:]])

    p, s, q = on_driver(f, a)
    k = min(a.dims)
    return None if u is Vectors.NONE else p if u is Vectors.ALL else p.view(slice(None), (0, k)), s, None if vh is Vectors.NONE else q if vh is Vectors.ALL else q.view((0, k))


svd_dd = svd


def _adjoint(t: Tensor) -> Tensor:
    return t.T.map_values(t.kind.conj) if is_complex(t.dtype) else t.T


def _svd_of_long(a: Tensor, u: Vectors, vh: Vectors) -> tuple[Tensor | None, Tensor, Tensor | None]:
    if a.dims[0] < a.dims[1]:
        v, s, uh = _svd_of_long(_adjoint(a), vh, u)
        return None if uh is None else _adjoint(uh), s, None if v is None else _adjoint(v)
    q, r = tall_qr(a)
    p, s, w = np.linalg.svd(r.to_numpy())
    turned, p = canonical_columns(w.conj().T, p)
    make = Tensor.from_numpy
    return None if u is Vectors.NONE else q @ make(a.spark, p), make(a.spark, s), None if vh is Vectors.NONE else make(a.spark, turned.conj().T)


def tall_qr(a: Tensor) -> tuple[Tensor, Tensor]:
    """q (m x n, orthonormal columns) and r (n x n, with a diagonal that is not negative) of a tall matrix of any length and rank.

    Blocks of rows are factorised where they are; their factors r, one upon the other, are a shorter tall matrix, which is
    treated alike until it fits one machine. Each block's q is then made again and turned by its rows of the shorter matrix's q.
    """
    require(a, 2)
    m, n = a.dims
    if m < n:
        raise DimensionError(f"{a.dims} is not tall")
    if a.size <= LOCAL_CELLS:
        return on_driver(lambda x: _economy(x), a)
    rows = max(2 * n, min(LOCAL_CELLS // 16, 1 << 21) // n)
    blocks, wide = -(-m // rows), is_complex(a.dtype)
    values = ("v.re", "v.im") if wide else ("v",)
    parts = ("re", "im")[: len(values)]
    cells = a.df.select(F.floor(F.col("i0") / F.lit(rows)).cast("bigint").alias("b"), (F.col("i0") % F.lit(rows)).cast("bigint").alias("i"), F.col("i1").alias("j"), *(F.col(v).cast("double").alias(p) for v, p in zip(values, parts, strict=True)))
    schema = "b bigint, i bigint, j bigint, " + ", ".join(f"{p} double" for p in parts)

    def dense(t: pa.Table, height: int) -> np.ndarray:
        x = np.zeros((height, n), dtype=complex if wide else float)
        at = t.column("i").to_numpy(), t.column("j").to_numpy()
        x[at] = t.column("re").to_numpy() + 1j * t.column("im").to_numpy() if wide else t.column("re").to_numpy()
        return x

    def height(block: int) -> int:
        return min(rows, m - block * rows)

    def flat(block: int, x: np.ndarray) -> pa.Table:
        at = np.nonzero(x)
        found = [x[at].real, x[at].imag] if wide else [x[at]]
        return pa.table([pa.array(np.full(len(at[0]), block)), *map(pa.array, at), *map(pa.array, found)], names=["b", "i", "j", *parts])

    def factor(t: pa.Table) -> pa.Table:
        block = t.column("b")[0].as_py()
        r = _economy(dense(t, height(block)))[1]
        return flat(block, r)

    def back(df: DataFrame, dims: tuple[int, int], step: int) -> Tensor:
        v = F.struct("re", "im") if wide else F.col("re")
        return Tensor(df.select((F.col("b") * step + F.col("i")).alias("i0"), F.col("j").alias("i1"), v.alias("v")), dims, "complex128" if wide else "float64")

    # the last block may have fewer rows than columns: its r is short, and stands in n rows all the same
    upper = back(cells.groupBy("b").applyInArrow(factor, schema), (blocks * n, n), n)
    turn, r = tall_qr(upper)
    turned = turn.df.select(F.floor(F.col("i0") / F.lit(n)).cast("bigint").alias("b"), (F.col("i0") % F.lit(n)).cast("bigint").alias("i"), F.col("i1").alias("j"), *(F.col(v).cast("double").alias(p) for v, p in zip(values, parts, strict=True)))

    def apply(own: pa.Table, other: pa.Table) -> pa.Table:
        if not own.num_rows or not other.num_rows:
            return flat(0, np.zeros((0, n), dtype=complex if wide else float))
        block = own.column("b")[0].as_py()
        q = _economy(dense(own, height(block)))[0]
        return flat(block, q @ dense(other, n)[: q.shape[1]])

    return back(cells.groupBy("b").cogroup(turned.groupBy("b")).applyInArrow(apply, schema), (m, n), rows), r


def _economy(x: np.ndarray, mode: str = "reduced") -> tuple[np.ndarray, np.ndarray]:
    q, r = np.linalg.qr(x, mode=mode)
    d = np.diag(r)
    turn = np.ones(q.shape[1], dtype=q.dtype)
    turn[: len(d)] = np.where(np.abs(d) > 0, d / np.where(d == 0, 1, np.abs(d)), 1)
    return q * turn, r * turn.conj()[:, None]


def svd_nullspace(a: Tensor, tol: float | None = None) -> Tensor:
    """Unit vectors, as columns, that a maps to zero."""
    require(a, 2)

    def f(x):
        _, s, q = np.linalg.svd(x)
        least = tol if tol is not None else max(x.shape) * np.finfo(float).eps * (s[0] if len(s) else 0)
        return q[int((s > least).sum()) :].conj().T

    out = f(a.to_numpy())
    return Tensor.from_numpy(a.spark, out)


def _sketch(a: Tensor, k: int, extra: int, seed: int) -> np.ndarray:
    """Orthonormal columns that span nearly what the first k singular vectors do: one distributed product by a random matrix, one power step."""
    columns = min(k + extra, *a.dims)
    y = a @ random(a.spark, (a.dims[1], columns), seed)
    y = a @ Plan("ij", "ki", "kj").execute(a, Tensor.from_numpy(a.spark, np.linalg.qr(y.to_numpy())[0]), conj_a=True)
    return np.linalg.qr(y.to_numpy())[0]


def truncated_svd(a: Tensor, k: int, extra: int = 5, seed: int = 0) -> tuple[Tensor, Tensor, Tensor]:
    """The k largest singular values and vectors, by a random sketch. Rows times (k + extra) numbers reach the driver."""
    require(a, 2)
    q = _sketch(a, k, extra, seed)
    small = Plan("ij", "ki", "kj").execute(Tensor.from_numpy(a.spark, q), a, conj_a=True).to_numpy()
    p, s, vh = np.linalg.svd(small, full_matrices=False)
    u, v = canonical_columns(q @ p, vh.conj().T)
    return Tensor.from_numpy(a.spark, u[:, :k]), Tensor.from_numpy(a.spark, s[:k]), Tensor.from_numpy(a.spark, v[:, :k].conj().T)


def truncated_syev(a: Tensor, k: int, extra: int = 5, seed: int = 0) -> tuple[Tensor, Tensor]:
    """The k eigenvalues of largest modulus, descending by it, and their vectors."""
    square(a)
    q = _sketch(a, k, extra, seed)
    small = q.conj().T @ (a @ Tensor.from_numpy(a.spark, q)).to_numpy()
    w, v = np.linalg.eigh((small + small.conj().T) / 2)
    order = np.argsort(-np.abs(w))[:k]
    return Tensor.from_numpy(a.spark, w[order]), Tensor.from_numpy(a.spark, canonical_columns(q @ v[:, order])[0])


def qr(a: Tensor, full: bool | None = None) -> tuple[Tensor, Tensor]:
    """q and r; the diagonal of r is not negative. ``full``: q (m x m) and r (m x n) at every size, refused where they would not
    fit one machine. Not ``full``: q (m x k) and r (k x n) with k = min(m, n), at every size. By default full where q fits one machine."""
    require(a, 2)
    m, n = a.dims
    if full is None:
        full = max(m * m, a.size) <= LOCAL_CELLS
    if full and m > n:
        _fits(a, 0)
    if not full and m >= n:
        return tall_qr(a)
    return on_driver(lambda x: _economy(x, "complete" if full else "reduced"), a)


geqrf = qr


def gelqf(a: Tensor) -> tuple[Tensor, Tensor]:
    """l and q with l q the matrix."""
    q, r = qr(a.T if not is_complex(a.dtype) else a.T.map_values(a.kind.conj))
    if is_complex(a.dtype):
        q, r = q.map_values(q.kind.conj), r.map_values(r.kind.conj)
    return r.T, q.T
