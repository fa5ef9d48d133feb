"""Dense contractions on blocks: tiles of numbers joined on tile indices, multiplied by numpy, summed in the task first.

A COO product of two n x n matrices makes n ** 3 rows; with tiles of B it makes (n / B) ** 3
of them, each a B x B product in one call. Absent tiles are zero and are never made.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.errors import CompatibilityError
from weft.functions.scalars import is_complex
from weft.plans.labels import Contraction, Labels, column, difference, intersect
from weft.tensor import Tensor, ordinal

#: Cells of a tile: 2 MB of doubles.
TILE_CELLS = 1 << 18
#: Bytes of sums that a task holds before it passes them on.
HELD_BYTES = 128 << 20
#: Cells of the shared labels up to which the rows of a batch are dense vectors of them.
LINK_CELLS = 1 << 14
#: Cells that a block of such rows may have, and rows.
BLOCK_CELLS, BLOCK_ROWS = 1 << 21, 1 << 12
#: Products that a task passes on at a time.
EMIT_ROWS = 1 << 16


def edge(rank: int) -> int:
    """Length of a tile's side at this rank."""
    return max(2, int(TILE_CELLS ** (1 / max(rank, 1))))


def tile_shapes(dims: Sequence[int], sides: Sequence[int], at: Sequence[int]) -> tuple[int, ...]:
    return tuple(min(s, n - t * s) for n, s, t in zip(dims, sides, at, strict=True))


def to_blocks(t: Tensor, sides: Sequence[int]) -> DataFrame:
    """t0.. (tile numbers) and payload (little-endian doubles, last index fastest). Rows meet by tile once and are scattered into it."""
    if is_complex(t.dtype):
        raise CompatibilityError("tiles hold real numbers")
    tiles = [f"t{k}" for k in range(t.rank)]
    sides, dims, rank = tuple(sides), t.dims, t.rank
    inner = F.lit(0).cast("bigint")
    for k, s in enumerate(sides):
        inner = inner * F.lit(s) + F.pmod(F.col(f"i{k}"), F.lit(s))
    rows = t.df.select(*(F.floor(F.col(f"i{k}") / F.lit(s)).cast("int").alias(c) for k, (s, c) in enumerate(zip(sides, tiles, strict=True))), inner.alias("at"), F.col("v").cast("double").alias("v"))

    def fill(batches):
        held: np.ndarray | None = None
        key: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(i).to_numpy() for i in range(rank)], axis=1)
            at, v = batch.column(rank).to_numpy(), batch.column(rank + 1).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, [len(k)]])
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                here = tuple(int(x) for x in k[s])
                if here != key:
                    if held is not None and key is not None:
                        yield _row(key, held, sides, dims)
                    key, held = here, np.zeros(int(np.prod(sides)))
                held[at[s:e]] = v[s:e]
        if held is not None and key is not None:
            yield _row(key, held, sides, dims)

    return rows.repartition(*tiles).sortWithinPartitions(*tiles).mapInArrow(fill, ", ".join(f"{c} int" for c in tiles) + ", payload binary")


def _row(key, held, sides, dims) -> pa.RecordBatch:
    shape = tile_shapes(dims, sides, key)
    cut = held.reshape(sides)[tuple(slice(0, n) for n in shape)]
    return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in key), pa.array([np.ascontiguousarray(cut).tobytes()], pa.binary())], names=[*(f"t{k}" for k in range(len(key))), "payload"])


def from_blocks(df: DataFrame, dims: Sequence[int], sides: Sequence[int], dtype: str = "float64") -> Tensor:
    dims, sides, rank = tuple(dims), tuple(sides), len(dims)

    def explode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                key = [row[f"t{k}"] for k in range(rank)]
                block = np.frombuffer(row["payload"]).reshape(tile_shapes(dims, sides, key))
                at = np.nonzero(block)
                yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64) + t * s) for x, t, s in zip(at, key, sides, strict=True)), pa.array(block[at])], names=[*(f"i{k}" for k in range(rank)), "v"])

    out = df.mapInArrow(explode, ", ".join([*(f"i{k} bigint" for k in range(rank)), "v double"]))
    return Tensor(out, dims, "float64").cast(dtype) if dtype != "float64" else Tensor(out, dims, dtype)


def contract(out: Labels, la: Labels, a: Tensor, lb: Labels, b: Tensor, alpha: float = 1.0, side: int | None = None) -> Tensor:
    """The product of two dense tensors without repeated labels. Tiles of both sides are joined on the shared labels' tile numbers;
    a task adds up what it can of each output tile before the rest is shuffled. With batch labels, see ``contract_batches``."""
    plan = Contraction(out, la, lb)
    if any(len(set(x)) < len(x) for x in (out, la, lb)) or plan.only_out or plan.private_a or plan.private_b or not out:
        raise CompatibilityError("the blocked plan takes tensors without repeated or private labels")
    sizes = plan.dims(a.dims, b.dims)
    if plan.links and set(plan.shared) & set(out) and prod(sizes[x] for x in plan.links) <= LINK_CELLS and side is None:
        return contract_batches(plan, a, b, sizes, alpha)
    rank = max(len(la), len(lb), len(out))
    s = side or edge(rank)
    sides = {x: min(s, sizes[x]) for x in sizes}
    left = to_blocks(a, [sides[x] for x in la]).toDF(*(f"{x}_" for x in map(_safe, la)), "pa")
    right = to_blocks(b, [sides[x] for x in lb]).toDF(*(f"{x}_" for x in map(_safe, lb)), "pb")
    joined = left.join(right, [f"{_safe(x)}_" for x in plan.shared]) if plan.shared else left.crossJoin(right)
    names = [f"{_safe(x)}_" for x in (*plan.a, *(y for y in plan.b if y not in plan.a))]
    order = (*plan.a, *(y for y in plan.b if y not in plan.a))
    letters = {x: chr(97 + k) for k, x in enumerate(order)}
    spec = f"{''.join(letters[x] for x in la)},{''.join(letters[x] for x in lb)}->{''.join(letters[x] for x in out)}"
    schema = ", ".join([*(f"t{k} int" for k in range(len(out))), "payload binary"])

    def emit(held):
        for key, block in held.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in key), pa.array([block.tobytes()], pa.binary())], names=[*(f"t{k}" for k in range(len(out))), "payload"])

    def multiply(batches):
        held: dict[tuple, np.ndarray] = {}
        size = 0
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                tile = {x: row[f"{_safe(x)}_"] for x in order}
                x = np.frombuffer(row["pa"]).reshape([min(sides[l], sizes[l] - tile[l] * sides[l]) for l in la])
                y = np.frombuffer(row["pb"]).reshape([min(sides[l], sizes[l] - tile[l] * sides[l]) for l in lb])
                z = alpha * np.einsum(spec, x, y, optimize=True)
                key = tuple(tile[l] for l in out)
                if key in held:
                    held[key] += z
                else:
                    held[key] = np.ascontiguousarray(z)
                    size += z.nbytes
                if size > HELD_BYTES:
                    yield from emit(held)
                    held, size = {}, 0
        yield from emit(held)

    def total(batches):
        key, held = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                here = tuple(row[f"t{k}"] for k in range(len(out)))
                block = np.frombuffer(row["payload"])
                if here == key:
                    held = held + block
                else:
                    if key is not None:
                        yield from emit({key: held})
                    key, held = here, block
        if key is not None:
            yield from emit({key: held})

    partial = joined.select(*names, "pa", "pb").mapInArrow(multiply, schema)
    tiles = [f"t{k}" for k in range(len(out))]
    full = partial.repartition(*tiles).sortWithinPartitions(*tiles).mapInArrow(total, schema)
    return from_blocks(full, [sizes[x] for x in out], [sides[x] for x in out])


def contract_batches(plan: Contraction, a: Tensor, b: Tensor, sizes: dict[str, int], alpha: float = 1.0) -> Tensor:
    """Products within batches that may be as sparse as labels of rows are: no cell of two batches is made, no product shuffled.

    The rows of either side are packed into vectors over the links. Those of a meet in blocks, in one task each, past which
    all rows of b of the same batch run. As in the relational plan, a cell comes of at least one link that both rows have.
    """
    if is_complex(a.dtype) or is_complex(b.dtype):
        raise CompatibilityError("tiles hold real numbers")
    batch, links = intersect(plan.shared, plan.out), plan.links
    own_a, own_b = difference(plan.a, plan.b), difference(plan.b, plan.a)
    width = prod(sizes[x] for x in links)
    rows = max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(width, 1)))
    groups = max(1, -(-prod(sizes[x] for x in own_a) // rows))

    def packed(t: Tensor, labels: Labels, own: Labels) -> DataFrame:
        at = {x: F.col(f"i{k}") for k, x in enumerate(labels)}
        df = t.df
        for x in (*batch, *links):
            df = df.where(at[x].isNotNull())
        cell = F.struct(ordinal([at[x] for x in links], [sizes[x] for x in links]).cast("int").alias("at"), F.col("v").cast("double").alias("v"))
        return df.groupBy(*(at[x].alias(column(x)) for x in (*batch, *own))).agg(F.collect_list(cell).alias("cells"))

    def side_of(df: DataFrame, tag: int, own: Labels, group) -> DataFrame:
        mine = [F.col(column(x)) if x in own else F.lit(None).cast("bigint").alias(column(x)) for x in (*own_a, *own_b)]
        return df.select(*map(column, batch), group.alias("group_"), F.lit(tag).cast("bigint").alias("side_"), *mine, F.col("cells.at").alias("at_"), F.col("cells.v").alias("v_"))

    number = ordinal([F.col(column(x)) for x in own_a], [sizes[x] for x in own_a])
    left = side_of(packed(a, plan.a, own_a), 0, own_a, F.coalesce(F.pmod(number, F.lit(groups)), F.lit(0)).cast("bigint"))
    right = side_of(packed(b, plan.b, own_b), 1, own_b, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    keys = [*map(column, batch), "group_", "side_"]
    spread = min(groups * prod(sizes[x] for x in batch), 4096)
    both = left.unionByName(right).repartition(max(spread, int(a.spark.conf.get("spark.sql.shuffle.partitions"))), *keys[:-1]).sortWithinPartitions(*keys)
    nb, na = len(batch), len(own_a)
    names = [column(x) for x in (*batch, *own_a, *own_b)]
    high, emitted = max(1, (BLOCK_CELLS // 2) // max(width, 1)), EMIT_ROWS

    def dense(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Values, and how many rows each cell has; values of rows that repeat a cell are added up."""
        at, v = part.column(part.num_columns - 2), part.column(part.num_columns - 1)
        cells = np.repeat(np.arange(part.num_rows) * width, at.value_lengths().to_numpy(zero_copy_only=False)) + at.flatten().to_numpy()
        shape = part.num_rows, width
        return np.bincount(cells, v.flatten().to_numpy(zero_copy_only=False), part.num_rows * width).reshape(shape), (np.bincount(cells, minlength=part.num_rows * width) > 0).reshape(shape)

    def products(x, has_x, y, has_y) -> tuple[np.ndarray, np.ndarray | None]:
        """All products of rows, and which of them have a link in common (None: all)."""
        if has_x.all() and has_y.all():
            return x @ y.T, None
        met = has_x.astype(np.float32) @ has_y.T.astype(np.float32) > 0
        if np.isfinite(x).all() and np.isfinite(y).all():
            return x @ y.T, met
        z = np.zeros((len(x), len(y)))  # zero times what is not finite would count where a row has no cell
        for k in range(width):
            z += np.where(has_x[:, k, None] & has_y[None, :, k], x[:, k, None] * y[None, :, k], 0.0)
        return z, met

    def multiply(batches):
        key, held = None, []
        for got in batches:
            if not got.num_rows:
                continue
            k = np.stack([got.column(i).to_numpy() for i in range(nb + 2)], axis=1)
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(k)], strict=True):
                here, tag = tuple(k[s, :-1]), k[s, -1]
                if here != key:
                    key, held = here, []
                for low in range(s, e, high):
                    part = got.slice(low, min(high, e - low))
                    if not tag:
                        held.append((part, *dense(part)))
                        continue
                    y, has_y = dense(part) if held else (None, None)
                    step = max(1, emitted // part.num_rows)
                    for block, x, has_x in held:
                        for first in range(0, len(x), step):
                            z, met = products(x[first : first + step], has_x[first : first + step], y, has_y)
                            i, j = (q.ravel() for q in np.indices(z.shape)) if met is None else np.nonzero(met)
                            v = z.ravel() if met is None else z[met]
                            if not len(v):
                                continue
                            columns = [pa.array(np.full(len(v), n)) for n in here[:nb]]
                            columns += [block.column(nb + 2 + n).take(pa.array(i + first)) for n in range(na)]
                            columns += [part.column(nb + 2 + n).take(pa.array(j)) for n in range(na, na + len(own_b))]
                            yield pa.RecordBatch.from_arrays([*columns, pa.array(alpha * v)], names=[*names, "v"])

    found = both.mapInArrow(multiply, ", ".join(f"{n} bigint" for n in names) + ", v double")
    return Tensor(found.select(*(F.col(column(x)).alias(f"i{k}") for k, x in enumerate(plan.out)), "v"), tuple(sizes[x] for x in plan.out))


def _safe(label: str) -> str:
    from weft.plans.labels import column

    return column(label)
