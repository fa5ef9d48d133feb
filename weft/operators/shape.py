"""Indices renamed, split, joined and tied: projections and filters, no shuffle but to add a previous output."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import functions as F

from weft.errors import BadLogic, DimensionError, RankError
from weft.functions.scalars import arithmetic, widest
from weft.plans.contraction import combine
from weft.plans.labels import column, difference, intersect, labels_of, unique
from weft.tensor import Tensor, index_columns, ordinal, require, unravel


def permute(out: str, labels: str, t: Tensor, previous: Tensor | None = None, alpha=1.0, beta=0.0, conj: bool = False) -> Tensor:
    """beta * previous + alpha * t, with t's indices in the order of ``out``. A previous output may be larger than t in any index."""
    to, own = labels_of(out), labels_of(labels)
    if len(own) != t.rank or len(to) != t.rank:
        raise RankError(f"labels {out!r}, {labels!r} for rank {t.rank}")
    if set(to) != set(own) or len(set(own)) < len(own):
        raise BadLogic(f"{labels!r} cannot be permuted to {out!r}")
    sizes = dict(zip(own, t.dims, strict=True))
    dims = tuple(sizes[x] for x in to)
    dtype = t.dtype
    if previous is not None and beta:
        if previous.rank != t.rank or any(n < m for n, m in zip(previous.dims, dims, strict=True)):
            raise DimensionError(f"{dims} does not fit into {previous.dims}")
        dims, dtype = previous.dims, widest(t.dtype, previous.dtype)
    kind = arithmetic(dtype)
    v = kind.lift(F.col("v"), t.dtype)
    found = t.df.select(*(F.col(f"i{k}").alias(column(x)) for k, x in enumerate(own)), (kind.conj(v) if conj else v).alias("p"))
    return Tensor(combine(to, found, dims, kind, dtype, alpha, beta, previous), dims, dtype)


class Permutation:
    """A permutation whose labels are analysed once."""

    def __init__(self, out: str, labels: str):
        self.out, self.labels = out, labels

    def execute(self, t: Tensor, previous: Tensor | None = None, alpha=1.0, beta=0.0) -> Tensor:
        return permute(self.out, self.labels, t, previous, alpha, beta)


compile_permute = Permutation


def transpose(t: Tensor) -> Tensor:
    require(t, 2)
    return t.with_rows(t.df.select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), "v"), t.dims[::-1])


def reshape(t: Tensor, *dims: int, order: str = "C") -> Tensor:
    """Same cells in the same running order under other dimensions; one of them may be -1."""
    open_ = [k for k, n in enumerate(dims) if n == -1]
    if len(open_) > 1:
        raise BadLogic("more than one dimension is open")
    known = prod((n for n in dims if n != -1), start=1)
    if open_:
        if not known or t.size % known:
            raise DimensionError(f"{t.size} cells do not fill {dims}")
        dims = tuple(t.size // known if n == -1 else n for n in dims)
    if prod(dims, start=1) != t.size:
        raise DimensionError(f"{t.size} cells do not fill {dims}")
    n = t.df.select(ordinal(t.indices, t.dims, order).alias("n_"), "v")
    return t.with_rows(n.select(*(c.alias(x) for c, x in zip(unravel(F.col("n_"), dims, order), index_columns(len(dims)), strict=True)), "v"), dims)


def flatten(t: Tensor, order: str = "C") -> Tensor:
    return reshape(t, t.size, order=order)


def unfold(t: Tensor, mode: int, order: str = "C") -> Tensor:
    """Matrix of dim(mode) rows; the other indices are run together in ``order``."""
    if not 0 <= mode < t.rank:
        raise RankError(f"mode {mode} of rank {t.rank}")
    rest = [k for k in range(t.rank) if k != mode]
    number = ordinal([F.col(f"i{k}") for k in rest], [t.dims[k] for k in rest], order)
    return t.with_rows(t.df.select(F.col(f"i{mode}").alias("i0"), number.cast("bigint").alias("i1"), "v"), (t.dims[mode], prod((t.dims[k] for k in rest), start=1)))


def khatri_rao(labels_a: str, a: Tensor, labels_b: str, b: Tensor, order: str = "C") -> Tensor:
    """Column-wise Kronecker product over the common labels, which come last: [(own of a, own of b), common]."""
    from weft.plans.contraction import Plan

    la, lb = labels_of(labels_a), labels_of(labels_b)
    both, own_a, own_b = intersect(la, lb), difference(la, lb), difference(lb, la)
    t = Plan((*own_a, *own_b, *both), la, lb).execute(a, b)
    n = len(own_a) + len(own_b)
    rows, cols = t.dims[:n], t.dims[n:]
    number = ordinal(t.indices[:n], rows, order), ordinal(t.indices[n:], cols, order)
    return t.with_rows(t.df.select(number[0].cast("bigint").alias("i0"), number[1].cast("bigint").alias("i1"), "v"), (prod(rows, start=1), prod(cols, start=1)))


def tie_indices(t: Tensor, *tied: int) -> Tensor:
    """The cells where these indices are equal, under one index in the first one's place."""
    if len(set(tied)) < 2 or not all(0 <= k < t.rank for k in tied):
        raise RankError(f"indices {tied} of rank {t.rank}")
    first, rest = min(tied), sorted(set(tied) - {min(tied)})
    df = t.df
    for k in rest:
        df = df.where(F.col(f"i{k}") == F.col(f"i{first}"))
    kept = [k for k in range(t.rank) if k not in rest]
    dims = [min(t.dims[j] for j in tied) if k == first else t.dims[k] for k in kept]
    return t.with_rows(df.select(*(F.col(f"i{k}").alias(n) for k, n in zip(kept, index_columns(len(kept)), strict=True)), "v"), dims)


def resize(t: Tensor, *dims: int) -> Tensor:
    """Other dimensions; cells beyond them go."""
    if len(dims) != t.rank:
        raise RankError(f"{dims} for rank {t.rank}")
    df = t.df
    for k, n in enumerate(dims):
        if n < t.dims[k]:
            df = df.where(F.col(f"i{k}") < n)
    return t.with_rows(df, dims)


def enumerate_many(*vectors: Tensor):
    """i0 and one column per vector: cells of equal index side by side, up to the shortest one's end."""
    n = min(v.dims[0] for v in vectors)
    out = vectors[0].spark.range(n).select(F.col("id").alias("i0"))
    for k, v in enumerate(vectors):
        require(v, 1)
        out = out.join(v.df.select("i0", F.col("v").alias(f"v{k}")), "i0", "left")
    return out.select("i0", *(v.kind.or_zero(v.kind.lift(F.col(f"v{k}"), v.dtype)).alias(f"v{k}") for k, v in enumerate(vectors)))


__all__ = ["Permutation", "Sequence", "compile_permute", "enumerate_many", "flatten", "khatri_rao", "permute", "reshape", "resize", "tie_indices", "transpose", "unfold", "unique"]
