"""Factorisations by numpy: of one matrix on the driver, or of very many small ones in the tasks.

A factorisation needs its whole matrix in one place. A single matrix is gathered only below
``LOCAL_CELLS`` cells; block-diagonal tensors are factorised block by block where the blocks are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.tensor import Tensor


def on_driver(f: Callable, *tensors: Tensor):
    """f on arrays; arrays and scalars it returns become tensors and plain numbers."""
    out = f(*(t.to_numpy() for t in tensors))
    spark = tensors[0].spark

    def back(x):
        return Tensor.from_numpy(spark, x) if isinstance(x, np.ndarray) and x.ndim else (x.item() if isinstance(x, (np.ndarray, np.generic)) else x)

    return tuple(back(x) for x in out) if isinstance(out, tuple) else back(out)


def canonical_columns(u: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """Signs (phases) fixed: the largest component of each column of u is positive. ``others`` have their columns turned alike."""
    if not u.size:
        return (u, *others)
    top = u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])]
    turn = np.where(np.abs(top) > 0, np.abs(top) / np.where(top == 0, 1, top), 1)
    return (u * turn, *(o * turn for o in others))


def per_block(df: DataFrame, key: str, dims: Sequence[str], columns: Sequence[str], f: Callable[[int, dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str, sizes: dict[int, int]) -> DataFrame:
    """f on each block as a dense array. ``df``: key, the index columns ``dims`` and value ``columns`` (doubles). f gives columns of equal length.
    ``sizes``: of the blocks, which are square. Rows of a block meet in one task, sorted, one block at a time."""
    names = [x.split()[0] for x in schema.split(", ")][1:]
    rank = len(dims)

    def run(batches):
        key_now, held = None, []

        def finish():
            n = sizes[key_now]
            at = [np.concatenate([h[k] for h in held]) for k in range(rank)]
            arrays = {}
            for c, name in enumerate(columns):
                x = np.zeros((n,) * rank)
                x[tuple(at)] = np.concatenate([h[rank + c] for h in held])
                arrays[name] = x
            out = f(key_now, arrays)
            count = len(next(iter(out.values())))
            return pa.RecordBatch.from_arrays([pa.array([key_now] * count, pa.int64()), *(pa.array(out[n]) for n in names)], names=[key, *names])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            rest = [batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(rank + len(columns))]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                here = int(keys[s])
                if key_now is not None and here != key_now:
                    yield finish()
                    held = []
                key_now = here
                held.append([x[s:e] for x in rest])
        if key_now is not None:
            yield finish()

    ordered = df.select(F.col(key).cast("bigint"), *dims, *(F.col(c).cast("double") for c in columns)).repartition(key).sortWithinPartitions(key)
    return ordered.mapInArrow(run, schema)
