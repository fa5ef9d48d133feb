"""CP and Tucker decompositions. What is as large as the tensor is contracted by Spark; what has the size of a factor is solved on
the driver, up to ``FACTOR_CELLS``. A longer factor stays in Spark: the driver sees matrices of rank by rank, whatever its keys are."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import functions as F

from weft.config import forget, scratch
from weft.errors import BadLogic, RankError
from weft.operators.blas import LETTERS, weight
from weft.operators.elementwise import rmsd
from weft.operators.local import canonical_columns
from weft.operators.shape import unfold
from weft.operators.spectral import gram
from weft.plans.contraction import einsum
from weft.tensor import Tensor, require

#: Cells of a factor up to which the driver holds it: 8 MB of doubles. They are counted by the dimension, as absent rows are zeros there.
FACTOR_CELLS = 1 << 20

#: A factor: on the driver, or a tensor in Spark.
Factor = np.ndarray | Tensor


def weight_tensor(t: Tensor, w: Tensor) -> Tensor:
    """Scale along the first index."""
    return weight(t, w)


def parafac_reconstruct(factors: Sequence[Tensor]) -> Tensor:
    """Sum over r of the products of the factors' columns r."""
    if len(factors) < 2:
        raise RankError("two factors at least")
    modes = LETTERS[: len(factors)]
    return einsum(",".join(f"{m}z" for m in modes) + f"->{modes}", *factors)


def _tensor(t: Tensor, f: Factor) -> Tensor:
    return f if isinstance(f, Tensor) else Tensor.from_numpy(t.spark, f)


def _kept(t: Tensor) -> tuple[Tensor, str]:
    """Written once and read again, so that no reader makes it anew; and where it is."""
    path = scratch(t.spark, "factor")
    t.df.write.parquet(path)
    return t.with_rows(t.spark.read.parquet(path)), path


def _leading(folded: Tensor, rank: int) -> tuple[np.ndarray, Factor]:
    """Largest eigenvalues of x x^H, descending, and their eigenvectors, from the Gram matrix of x's shorter side.

    Where the columns are fewer, x maps the eigenvectors of x^H x to these: rows times rank numbers, which reach the driver only
    if they are few. What x maps to nothing, and what goes beyond the columns, is filled up to an orthonormal set.
    """
    m, n = folded.dims
    rank = min(rank, m)
    w, v = np.linalg.eigh(gram(folded, "rows" if m <= n else "columns").to_numpy())
    w, v = np.maximum(w[::-1][:rank], 0), v[:, ::-1][:, :rank]
    if m > n:
        found = einsum("ik,kj->ij", folded, Tensor.from_numpy(folded.spark, v))
        missing = rank - found.dims[1]
        w = np.pad(w, (0, missing))
        if m * rank > FACTOR_CELLS and rank**2 <= m:
            return w, _orthonormal(found, rank)
        v = np.linalg.qr(np.pad(found.to_numpy(), ((0, 0), (0, missing))))[0]
    return w, canonical_columns(v)[0]


def _orthonormal(x: Tensor, rank: int) -> Tensor:
    """Orthonormal columns that span those of x in their order, filled up to ``rank`` (its square is at most the rows). Signs as of
    ``canonical_columns``. x has nearly orthogonal columns of descending length; from the first of nearly no length on they are filled up.

    Columns are combined by the inverse Cholesky factor of their Gram matrix, twice, as the first time leaves small errors.
    """
    x, path = _kept(x)
    g = gram(x, "columns").to_numpy()
    lengths = np.diag(g).real
    short = np.flatnonzero(~(lengths > 1e3 * np.finfo(float).eps * len(g) * lengths.max(initial=0.0)))
    k = int(short[0]) if len(short) else len(g)
    scale = 1 / np.sqrt(lengths[:k])
    turn = np.zeros((len(g), k), dtype=g.dtype)
    turn[:k] = scale[:, None] * _inverse_root(g[:k, :k] * scale[:, None] * scale)
    q, again = _kept(einsum("ij,jk->ik", x, Tensor.from_numpy(x.spark, turn)))
    forget(x.spark, path)
    turn = _inverse_root(gram(q, "columns").to_numpy())
    added = None
    if rank > k:
        # unit vectors of rows in which the others have least, less their parts along the others: of so many rows, those that are
        # taken have squares that add up to half at most
        head = q.view((0, (rank - k) * (2 * k + 1))).to_numpy() @ turn
        rows = np.argsort((np.abs(head) ** 2).sum(axis=1), kind="stable")[: rank - k]
        along = head[rows]
        w, v = np.linalg.eigh(np.eye(len(rows)) - along @ along.conj().T)
        root = v / np.sqrt(w) @ v.conj().T
        turn = np.hstack([turn, -turn @ along.conj().T @ root])
        unit = Tensor.from_numpy(x.spark, np.hstack([np.zeros((len(rows), k)), root]))
        number = F.element_at(F.array(*(F.lit(int(r)).cast("bigint") for r in rows)), (F.col("i0") + 1).cast("int"))
        added = unit.with_rows(unit.df.select(number.alias("i0"), "i1", "v"), (q.dims[0], rank))
    out = einsum("ij,jk->ik", q, Tensor.from_numpy(x.spark, turn))
    if added is not None:
        out, path = _kept(out + added)
        forget(x.spark, again)
    top = out.df.groupBy("i1").agg(F.max_by("v", F.struct(out.kind.abs(F.col("v")).alias("size"), -F.col("i0"))).alias("v"))
    top = Tensor(top.select(F.col("i1").alias("i0"), "v"), (rank,), out.dtype).to_numpy()
    return _columns_times(out, np.where(np.abs(top) > 0, np.abs(top) / np.where(top == 0, 1, top), 1))


def _inverse_root(g: np.ndarray) -> np.ndarray:
    """r with r^H g r the identity, upper triangular."""
    return np.linalg.inv(np.linalg.cholesky(g)).conj().T


def _columns_times(f: Factor, x: np.ndarray) -> Factor:
    return einsum("ij,j->ij", f, Tensor.from_numpy(f.spark, x)) if isinstance(f, Tensor) else f * x


def _initial(t: Tensor, rank: int, seed: int) -> list[Factor]:
    draw = np.random.default_rng(seed)
    out = []
    for k in range(t.rank):
        values, v = _leading(unfold(t, k), rank)
        if k == 0:
            v = _columns_times(v, np.sqrt(values))
        if not isinstance(v, Tensor) and v.shape[1] < rank:
            v = np.hstack([v, draw.uniform(-1, 1, (v.shape[0], rank - v.shape[1]))])
        out.append(v)
    return out


def _handed(t: Tensor, factors: Sequence[Factor], gathered: bool) -> list[Factor]:
    return [(f.to_numpy() if isinstance(f, Tensor) else f) if gathered else _tensor(t, f) for f in factors]


def initialize_cp(t: Tensor, rank: int, seed: int = 0, gathered: bool = True) -> list[Factor]:
    """Leading eigenvectors of each unfolding; the first mode's are scaled by the roots of their eigenvalues; missing columns are drawn.
    Arrays, or, not ``gathered``, tensors: then long ones never reach the driver."""
    return _handed(t, _initial(t, rank, seed), gathered)


def _times_others(t: Tensor, factors: list[Factor], mode: int) -> Tensor:
    """The unfolding of one mode times the Khatri-Rao product of the other factors: a chain of joins, short factors first and broadcast."""
    left = LETTERS[: t.rank]
    now = t
    for n, k in enumerate(sorted((k for k in range(t.rank) if k != mode), key=lambda k: isinstance(factors[k], Tensor))):
        rest = left.replace(LETTERS[k], "")
        now = einsum(f"{left}{'z' if n else ''},{LETTERS[k]}z->{rest}z", now, _tensor(t, factors[k]))
        left = rest
    return now


def _own(f: Factor) -> np.ndarray:
    return einsum("az,ay->zy", f, f).to_numpy() if isinstance(f, Tensor) else f.T @ f


def _als(t: Tensor, rank: int, n_iter: int, tol: float, seed: int) -> list[Factor]:
    if rank < 1 or t.rank < 2:
        raise BadLogic("a rank of one at least, a tensor of two indices at least")
    t = t.cache()
    size = float(np.sqrt(einsum(f"{LETTERS[: t.rank]},{LETTERS[: t.rank]}->", t, t).item()))
    factors = _initial(t, rank, seed)
    squares, paths = [_own(f) for f in factors], {}
    error, before = 0.0, np.inf
    for step in range(n_iter):
        for mode in range(t.rank):
            m = _times_others(t, factors, mode)
            v = np.prod([x for k, x in enumerate(squares) if k != mode], axis=0)
            if isinstance(factors[mode], Tensor):
                inverse = np.linalg.pinv(v, rcond=rank * np.finfo(float).eps)
                factors[mode], path = _kept(einsum("az,zy->ay", m, Tensor.from_numpy(t.spark, inverse)))
                if mode in paths:
                    forget(t.spark, paths[mode])
                paths[mode] = path
            else:
                m = m.to_numpy()
                factors[mode] = np.linalg.lstsq(v, m.T, rcond=None)[0].T
            squares[mode] = _own(factors[mode])
        # |t - x|^2 = |t|^2 - 2 <t, x> + |x|^2, the inner product from the last mode's matrix, which is its factor times v
        inner = float((squares[-1] * v).sum() if isinstance(m, Tensor) else (m * factors[-1]).sum())
        own = np.prod(squares, axis=0)
        error = float(np.sqrt(max(size**2 - 2 * inner + own.sum(), 0.0))) / (size or 1.0)
        if step >= 1 and abs(before - error) < tol:
            break
        before = error
    t.df.unpersist()
    return factors


def parafac(t: Tensor, rank: int, n_iter: int = 100, tol: float = 1e-8, seed: int = 0) -> list[Tensor]:
    """Factors, one matrix per index, by alternating least squares; they are not normalised."""
    return [_tensor(t, f) for f in _als(t, rank, n_iter, tol, seed)]


def weighted_parafac(t: Tensor, w: Tensor, rank: int, n_iter: int = 100, tol: float = 1e-8, seed: int = 0) -> list[Tensor]:
    """Least squares with weights along the first index: the weighted tensor is decomposed and its first factor unscaled.

    Weights are positive. Where there are too many for the driver, an index at which the tensor has no rows may go without one.
    """
    require(w, 1)
    if w.size * rank <= FACTOR_CELLS:
        weights = w.to_numpy()
        if (weights <= 0).any():
            raise BadLogic("weights are positive")
        root = Tensor.from_numpy(t.spark, np.sqrt(weights))
    else:
        bad = w.df.where((F.col("v") <= 0) | F.col("v").isNull())
        if not bad.isEmpty() or not t.df.select("i0").distinct().join(w.df.select("i0"), "i0", "left_anti").isEmpty():
            raise BadLogic("weights are positive")
        root = w.cast("float64").map_values(F.sqrt)
    first, *rest = _als(weight(t, root), rank, n_iter, tol, seed)
    if isinstance(first, Tensor):
        first = einsum("az,a->az", first, root.map_values(lambda v: 1 / v))
    else:
        scale = root.to_numpy()
        first = first / np.where(scale == 0, 1, scale)[:, None]
    return [_tensor(t, f) for f in (first, *rest)]


def tucker_reconstruct(core: Tensor, factors: Sequence[Tensor]) -> Tensor:
    """The core times each factor along its index."""
    now = core
    for k, f in enumerate(factors):
        letters = LETTERS[: core.rank]
        now = einsum(f"{letters},z{letters[k]}->{letters.replace(letters[k], 'z')}", now, f)
    return now


def _initial_tucker(t: Tensor, ranks: Sequence[int]) -> list[Factor]:
    if len(ranks) != t.rank:
        raise RankError(f"{len(ranks)} ranks for rank {t.rank}")
    return [_leading(unfold(t, k), r)[1] for k, r in enumerate(ranks)]


def initialize_tucker(t: Tensor, ranks: Sequence[int], gathered: bool = True) -> list[Factor]:
    """Leading left singular vectors of each unfolding. Arrays, or, not ``gathered``, tensors: then long ones never reach the driver."""
    return _handed(t, _initial_tucker(t, ranks), gathered)


def _project(t: Tensor, factors: Sequence[Factor], skip: int = -1) -> Tensor:
    now = t
    for k, f in enumerate(factors):
        if k != skip:
            letters = LETTERS[: t.rank]
            now = einsum(f"{letters},{letters[k]}z->{letters.replace(letters[k], 'z')}", now, _tensor(t, f))
    return now


def tucker_ho_svd(t: Tensor, ranks: Sequence[int]) -> tuple[Tensor, list[Tensor]]:
    """Core and factors by singular vectors of the unfoldings."""
    factors = _initial_tucker(t, ranks)
    return _project(t, factors), [_tensor(t, f) for f in factors]


def tucker_ho_oi(t: Tensor, ranks: Sequence[int], n_iter: int = 100, tol: float = 1e-8) -> tuple[Tensor, list[Tensor]]:
    """Core and factors by orthogonal iteration, until neither changes by more than tol."""
    t = t.cache()
    factors = _initial_tucker(t, ranks)
    core = _project(t, factors).to_numpy()
    for _ in range(n_iter):
        new = list(factors)
        for mode in range(t.rank):
            new[mode] = _leading(unfold(_project(t, new, mode), mode), ranks[mode])[1]
        after = _project(t, new).to_numpy()
        change = max(rmsd(a, b).item() if isinstance(a, Tensor) else float(np.sqrt(((a - b) ** 2).mean())) for a, b in zip([after, *new], [core, *factors], strict=True))
        factors, core = new, after
        if change < tol:
            break
    t.df.unpersist()
    return Tensor.from_numpy(t.spark, core), [_tensor(t, f) for f in factors]


__all__ = ["initialize_cp", "initialize_tucker", "parafac", "parafac_reconstruct", "rmsd", "tucker_ho_oi", "tucker_ho_svd", "tucker_reconstruct", "weight_tensor", "weighted_parafac"]
