"""Block-diagonal and tiled tensors: COO rows that know where their blocks lie. What is absent is zero and is skipped by the joins."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import accumulate
from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.errors import BadLogic, DimensionError, RankError
from weft.operators import blas, shape
from weft.operators.local import canonical_columns, per_block
from weft.plans.contraction import BROADCAST_CELLS, Plan, einsum
from weft.plans.labels import labels_of
from weft.tensor import Tensor, index_columns


def offsets(sizes: Sequence[int]) -> tuple[int, ...]:
    return (0, *accumulate(sizes))


def part_of(c: Column, sizes: Sequence[int]) -> Column:
    """Number of the part that an index lies in: a sum of comparisons for few parts, arithmetic where they are equal."""
    if len(set(sizes)) == 1:
        return F.floor(c / F.lit(sizes[0])).cast("int")
    starts = F.array(*(F.lit(x).cast("bigint") for x in offsets(sizes)[1:-1]))
    return F.size(F.filter(starts, lambda x: x <= c)).cast("int") if len(sizes) > 1 else F.lit(0)


#: Parts up to which their bounds stand in an expression; beyond, they are a table that is joined.
FEW = 64


def number_parts(df: DataFrame, index: str, sizes: Sequence[int], name: str) -> DataFrame:
    """``df`` with the part that ``index`` lies in, as ``name``, and that part's first index, as ``name``_low."""
    low = offsets(sizes)
    if len(sizes) <= FEW or len(set(sizes)) == 1:
        k = part_of(F.col(index), sizes).cast("bigint")
        first = k * sizes[0] if len(set(sizes)) == 1 else F.element_at(F.array(*(F.lit(x).cast("bigint") for x in low[:-1])), (k + 1).cast("int"))
        return df.withColumn(name, k).withColumn(f"{name}_low", first.cast("bigint"))
    rows = df.sparkSession.createDataFrame([(k, low[k], low[k + 1]) for k, n in enumerate(sizes) if n], f"{name} bigint, {name}_low bigint, high bigint")
    members = rows.select(name, f"{name}_low", F.explode(F.sequence(f"{name}_low", F.col("high") - 1)).alias(index))
    return df.join(F.broadcast(members) if low[-1] <= BROADCAST_CELLS else members, index)


@dataclass(frozen=True)
class BlockTensor:
    """Equal dimensions, cut alike; only blocks on the diagonal hold anything. ``tensor`` is the whole one."""

    tensor: Tensor
    sizes: tuple[int, ...]
    names: tuple[str, ...] = ()

    @staticmethod
    def of(tensor: Tensor, sizes: Sequence[int], names: Sequence[str] = ()) -> BlockTensor:
        """Cells off the diagonal blocks are dropped."""
        n = sum(sizes)
        if tensor.rank < 1 or any(d != n for d in tensor.dims):
            raise DimensionError(f"blocks of {n} for {tensor.dims}")
        df = tensor.df
        if len(sizes) <= FEW or len(set(sizes)) == 1:
            for c in tensor.columns[1:]:
                df = df.where(part_of(F.col(c), sizes) == part_of(F.col("i0"), sizes))
        else:
            df = number_parts(df, "i0", sizes, "blk")
            for c in tensor.columns[1:]:
                df = number_parts(df, c, sizes, "own").where("own = blk").drop("own", "own_low")
            df = df.select(*tensor.columns, "v")
        return BlockTensor(tensor.with_rows(df), tuple(sizes), tuple(names))

    @property
    def ranges(self) -> list[tuple[int, int]]:
        at = offsets(self.sizes)
        return list(zip(at, at[1:], strict=False))

    @property
    def num_blocks(self) -> int:
        return len(self.sizes)

    def block_of(self, index: int) -> int:
        n = sum(self.sizes)
        index = index + n if index < 0 else index
        if not 0 <= index < n:
            raise IndexError(index)
        return bisect_right(offsets(self.sizes), index) - 1

    def block(self, at: int | str) -> Tensor:
        k = self.names.index(at) if isinstance(at, str) else at
        low, high = self.ranges[k]
        return self.tensor.view(*((low, high),) * self.tensor.rank)

    def push_block(self, block: Tensor, name: str = "") -> BlockTensor:
        return self.insert_block(len(self.sizes), block, name)

    def insert_block(self, at: int, block: Tensor, name: str = "") -> BlockTensor:
        n = block.dims[0]
        if block.rank != self.tensor.rank or any(d != n for d in block.dims):
            raise DimensionError(f"block {block.dims}")
        start = offsets(self.sizes)[at]
        moved = self.tensor.df.select(*(F.when(F.col(c) >= start, F.col(c) + n).otherwise(F.col(c)).alias(c) for c in self.tensor.columns), "v")
        new = block.cast(self.tensor.dtype).df.select(*((F.col(c) + start).alias(c) for c in block.columns), "v")
        sizes = (*self.sizes[:at], n, *self.sizes[at:])
        names = (*self.names[:at], name, *self.names[at:]) if self.names or name else ()
        return BlockTensor(self.tensor.with_rows(moved.unionByName(new), (sum(sizes),) * self.tensor.rank), sizes, names)

    def to_dense(self) -> Tensor:
        return self.tensor

    def with_key(self) -> DataFrame:
        return number_parts(self.tensor.df, "i0", self.sizes, "blk")

    def map_blocks(self, f: Callable[[Tensor], Tensor]) -> BlockTensor:
        """f on the whole tensor, for operations that keep to blocks."""
        return BlockTensor.of(f(self.tensor), self.sizes, self.names)

    def _same(self, other: BlockTensor) -> None:
        if self.sizes != other.sizes:
            raise BadLogic(f"blocks {self.sizes} and {other.sizes}")

    def __add__(self, other: BlockTensor) -> BlockTensor:
        self._same(other)
        return BlockTensor(self.tensor + other.tensor, self.sizes, self.names)

    def __sub__(self, other: BlockTensor) -> BlockTensor:
        self._same(other)
        return BlockTensor(self.tensor - other.tensor, self.sizes, self.names)

    def __mul__(self, other) -> BlockTensor:
        return BlockTensor(self.tensor * (other.tensor if isinstance(other, BlockTensor) else other), self.sizes, self.names)

    def add_number(self, x) -> BlockTensor:
        """To the cells of blocks only."""
        return self._grid(lambda t: t + x)

    def divide(self, other) -> BlockTensor:
        return self._grid(lambda t: t / (other.tensor if isinstance(other, BlockTensor) else other))

    def _grid(self, f: Callable[[Tensor], Tensor]) -> BlockTensor:
        """Dense inside the blocks: each block's cells are made, not the grid of the whole."""
        spark, rank = self.tensor.spark, self.tensor.rank
        kind = self.tensor.kind
        cells = spark.createDataFrame([(k, low, high) for k, (low, high) in enumerate(self.ranges) if high > low], "blk bigint, low bigint, high bigint")
        names = index_columns(rank)
        for c in names:
            cells = cells.withColumn(c, F.explode(F.sequence("low", F.col("high") - 1)))
        full = cells.select(*names).join(self.tensor.df, names, "left").select(*names, kind.narrow(kind.or_zero(kind.lift(F.col("v"), self.tensor.dtype)), self.tensor.dtype).alias("v"))
        held = _Full(full, self.tensor.dims, self.tensor.dtype, self.tensor.name)
        return BlockTensor.of(f(held), self.sizes, self.names)

    # per-block linear algebra: blocks are factorised in the tasks that hold them

    def _blocks(self, f: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
        if self.tensor.rank != 2:
            raise RankError("blocks of matrices")
        low = offsets(self.sizes)
        sizes = dict(enumerate(self.sizes))
        local = self.with_key().select("blk", (F.col("i0") - F.col("blk_low")).alias("i0"), (F.col("i1") - F.col("blk_low")).alias("i1"), "v")
        return per_block(local, "blk", ["i0", "i1"], ["v"], lambda k, x: f(x["v"], low[k]), f"blk bigint, {schema}", sizes)

    def syev(self) -> tuple[Tensor, BlockTensor]:
        """Eigenvalues and vectors of each block, ascending within it. A block without rows is zero: its values are not stored."""

        def f(x, low):
            w, v = np.linalg.eigh((x + x.T) / 2)
            v = canonical_columns(v)[0]
            n = len(w)
            return {"i0": low + np.repeat(np.arange(n), n), "i1": low + np.tile(np.arange(n), n), "w": np.repeat(w, n), "v": v.ravel()}

        found = self._blocks(f, "i0 bigint, i1 bigint, w double, v double").cache()
        n = self.tensor.dims[0]
        # w repeats along i0: of row i it is the eigenvalue number i of the block
        values = found.where("i0 = i1").select("i0", F.col("w").alias("v"))
        return Tensor(values, (n,)), BlockTensor(Tensor(found.select("i0", "i1", "v"), (n, n)), self.sizes, self.names)

    heev = syev

    def geev(self) -> tuple[Tensor, BlockTensor]:
        """Complex eigenvalues (by real, then imaginary part within a block) and right vectors of each block."""

        def f(x, low):
            w, v = np.linalg.eig(x)
            order = np.lexsort((w.imag.round(12), w.real.round(12)))
            w, v = w[order].astype(complex), canonical_columns(v[:, order].astype(complex))[0]
            n = len(w)
            w, v = np.repeat(w, n), v.ravel()
            return {"i0": low + np.repeat(np.arange(n), n), "i1": low + np.tile(np.arange(n), n), "wr": w.real, "wi": w.imag, "vr": v.real, "vi": v.imag}

        found = self._blocks(f, "i0 bigint, i1 bigint, wr double, wi double, vr double, vi double").cache()
        n = self.tensor.dims[0]
        values = found.where("i0 = i1").select("i0", F.struct(F.col("wr").alias("re"), F.col("wi").alias("im")).alias("v"))
        vectors = found.select("i0", "i1", F.struct(F.col("vr").alias("re"), F.col("vi").alias("im")).alias("v"))
        return Tensor(values, (n,), "complex128"), BlockTensor(Tensor(vectors, (n, n), "complex128"), self.sizes, self.names)

    def invert(self) -> BlockTensor:
        def f(x, low):
            y = np.linalg.inv(x)
            at = np.nonzero(y)
            return {"i0": low + at[0], "i1": low + at[1], "v": y[at]}

        return BlockTensor(self.tensor.with_rows(self._blocks(f, "i0 bigint, i1 bigint, v double").drop("blk")), self.sizes, self.names)

    def power(self, exponent: float) -> BlockTensor:
        def f(x, low):
            w, v = np.linalg.eigh((x + x.T) / 2)
            with np.errstate(all="ignore"):
                p = np.power(w, exponent)
            if exponent < 0 and len(w):
                p[np.abs(w) < np.finfo(float).eps * np.abs(w).max()] = 0
            p[~np.isfinite(p)] = 0
            y = (v * p) @ v.T
            at = np.nonzero(y)
            return {"i0": low + at[0], "i1": low + at[1], "v": y[at]}

        return BlockTensor(self.tensor.with_rows(self._blocks(f, "i0 bigint, i1 bigint, v double").drop("blk")), self.sizes, self.names)

    def det(self) -> DataFrame:
        """blk, v."""
        return self._blocks(lambda x, low: {"v": np.array([np.linalg.det(x)])}, "v double")


class _Full(Tensor):
    """Rows that are dense where they need to be."""

    def densify(self) -> Tensor:
        return self


@dataclass(frozen=True)
class TiledTensor:
    """Each index is cut into parts; tiles may be missing."""

    tensor: Tensor
    parts: tuple[tuple[int, ...], ...]

    @staticmethod
    def of(tensor: Tensor, parts: Sequence[Sequence[int]]) -> TiledTensor:
        if len(parts) != tensor.rank or any(sum(p) != n for p, n in zip(parts, tensor.dims, strict=False)):
            raise DimensionError(f"{parts} do not cut {tensor.dims}")
        return TiledTensor(tensor, tuple(map(tuple, parts)))

    @property
    def grid_size(self) -> int:
        return prod(map(len, self.parts))

    def tile_offsets(self, index: int) -> tuple[int, ...]:
        return offsets(self.parts[index])[:-1]

    def tile_of(self, *at: int) -> tuple[int, ...]:
        return tuple(bisect_right(offsets(p), x) - 1 for p, x in zip(self.parts, at, strict=True))

    def has_zero_size(self, *tile: int) -> bool:
        return any(p[k] == 0 for p, k in zip(self.parts, tile, strict=True))

    def tile(self, *tile: int) -> Tensor:
        return self.tensor.view(*((o[k], o[k + 1]) for o, k in zip(map(offsets, self.parts), tile, strict=True)))

    def tile_columns(self) -> list[Column]:
        return [part_of(F.col(f"i{k}"), p) for k, p in enumerate(self.parts)]

    def filled(self) -> DataFrame:
        """t0, t1, ...: tiles that hold a row."""
        df = self.tensor.df
        for k, p in enumerate(self.parts):
            df = number_parts(df, f"i{k}", p, f"t{k}")
        return df.select(*(F.col(f"t{k}").cast("int").alias(f"t{k}") for k in range(len(self.parts)))).distinct()

    def zero(self) -> TiledTensor:
        """No tiles any more."""
        return TiledTensor(self.tensor.with_rows(self.tensor.df.limit(0)), self.parts)

    def zero_no_clear(self) -> TiledTensor:
        """The same tiles, holding zeros."""
        kind = self.tensor.kind
        return TiledTensor(self.tensor.map_values(lambda v: kind.narrow(kind.lit(0), self.tensor.dtype)), self.parts)

    def has_tile(self, *tile: int) -> bool:
        return not self.tile(*tile).df.isEmpty()

    def num_filled(self) -> int:
        return self.filled().count()

    def to_dense(self) -> Tensor:
        return self.tensor

    def __add__(self, other: TiledTensor) -> TiledTensor:
        return TiledTensor(self.tensor + other.tensor, self._alike(other))

    def __sub__(self, other: TiledTensor) -> TiledTensor:
        return TiledTensor(self.tensor - other.tensor, self._alike(other))

    def __mul__(self, other) -> TiledTensor:
        return TiledTensor(self.tensor * (other.tensor if isinstance(other, TiledTensor) else other), self.parts)

    def __truediv__(self, other) -> TiledTensor:
        return TiledTensor(self.tensor / (other.tensor if isinstance(other, TiledTensor) else other), self.parts)

    def _alike(self, other: TiledTensor):
        if self.parts != other.parts:
            raise BadLogic(f"tiles {self.parts} and {other.parts}")
        return self.parts


def _plain(x):
    return x.tensor if isinstance(x, (BlockTensor, TiledTensor)) else x


def _like(t: Tensor, *givers):
    """t cut as the first block or tiled one of the givers is."""
    for x in givers:
        if isinstance(x, BlockTensor):
            return BlockTensor.of(t, x.sizes, x.names)
        if isinstance(x, TiledTensor):
            return TiledTensor.of(t, x.parts)
    return t


def scale(factor, a):
    return _like(blas.scale(factor, _plain(a)), a)


def axpby(alpha, x, beta, y):
    """alpha x + beta y of block or tiled tensors that are cut alike."""
    if isinstance(x, BlockTensor) and isinstance(y, BlockTensor):
        x._same(y)
    if isinstance(x, TiledTensor) and isinstance(y, TiledTensor):
        x._alike(y)
    return _like(blas.axpby(alpha, _plain(x), beta, _plain(y)), y, x)


def axpy(alpha, x, y):
    return axpby(alpha, x, 1, y)


def true_dot(a, b) -> Tensor:
    return blas.true_dot(_plain(a), _plain(b))


def sum_square(a) -> tuple[Tensor, Tensor]:
    return blas.sum_square(_plain(a))


def gemv(alpha, a, x, beta=0.0, y=None, trans: str = "n"):
    """A tiled matrix gives a tiled vector, a block one a plain vector."""
    out = blas.gemv(alpha, _plain(a), _plain(x), beta, _plain(y) if y is not None else None, trans)
    return TiledTensor.of(out, (a.parts[0 if trans.lower() == "n" else 1],)) if isinstance(a, TiledTensor) else out


def ger(alpha, x, y, a, conj: bool = False):
    """a + alpha x y^T, cut as a is; of a block tensor, inside its blocks."""
    return _like(blas.ger(alpha, _plain(x), _plain(y), _plain(a), conj), a)


def gerc(alpha, x, y, a):
    return ger(alpha, x, y, a, True)


def symm_gemm(a, b, trans_b: str = "n"):
    """op(b)^T a op(b)."""
    out = blas.symm_gemm(_plain(a), _plain(b), trans_b)
    if isinstance(b, TiledTensor):
        return TiledTensor.of(out, (b.parts[1 if trans_b == "n" else 0],) * 2)
    return _like(out, b)


def permute(out: str, labels: str, t):
    """Indices of a block or tiled tensor in another order; tiles move along."""
    turned = shape.permute(out, labels, _plain(t))
    if isinstance(t, TiledTensor):
        cuts = dict(zip(labels_of(labels), t.parts, strict=True))
        return TiledTensor.of(turned, tuple(cuts[x] for x in labels_of(out)))
    return BlockTensor(turned, t.sizes, t.names) if isinstance(t, BlockTensor) else turned


def apply_view(tensor: Tensor, *parts: Sequence[int]) -> TiledTensor:
    """A dense, block or tiled tensor seen as tiles."""
    held = tensor.tensor if isinstance(tensor, (BlockTensor, TiledTensor)) else tensor
    return TiledTensor.of(held, parts)


def contract(spec: str, a, b, **more):
    """einsum on any mix of dense, block and tiled tensors. Two block tensors give a block tensor, tiled ones a tiled one."""
    ta, tb = (x.tensor if isinstance(x, (BlockTensor, TiledTensor)) else x for x in (a, b))
    out = einsum(spec, ta, tb, **more)
    inputs, to = spec.split("->")
    la, lb = inputs.split(",")
    if isinstance(a, BlockTensor) and isinstance(b, BlockTensor):
        a._same(b)
        return BlockTensor.of(out, a.sizes, a.names) if to else out
    if isinstance(a, TiledTensor) and isinstance(b, TiledTensor) and to:
        cuts: dict[str, tuple[int, ...]] = {}
        for labels, t in ((la, a), (lb, b)):
            for x, p in zip(labels, t.parts, strict=True):
                if cuts.setdefault(x, p) != p:
                    raise BadLogic(f"label {x} is cut in two ways")
        return TiledTensor(out, tuple(cuts[x] for x in to))
    return out


__all__ = ["BlockTensor", "Plan", "TiledTensor", "apply_view", "contract", "offsets", "part_of"]
