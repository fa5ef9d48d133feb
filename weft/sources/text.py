"""Text files of cells: indices from one, then the value, between white space."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weft.tensor import Tensor, index_columns

#: Orders of the indices under which a matrix, or an array of two-electron integrals, is the same.
SYMMETRIC = {2: ((0, 1), (1, 0)), 4: ((0, 1, 2, 3), (0, 1, 3, 2), (1, 0, 2, 3), (1, 0, 3, 2), (2, 3, 0, 1), (3, 2, 0, 1), (2, 3, 1, 0), (3, 2, 1, 0))}


def read_tensor(spark: SparkSession, path: str, dims: Sequence[int], symmetric: bool = True) -> Tensor:
    """Each line also stands for the cells that symmetry makes equal to it."""
    rank = len(dims)
    words = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("w")).where(F.size("w") == rank + 1)
    rows = words.select(*((F.col("w")[k].cast("bigint") - 1).alias(f"i{k}") for k in range(rank)), F.col("w")[rank].cast("double").alias("v"))
    names = index_columns(rank)
    if symmetric and rank in SYMMETRIC:
        turned = F.array(*(F.struct(*(F.col(f"i{k}").alias(n) for k, n in zip(order, names, strict=True))) for order in SYMMETRIC[rank]))
        rows = rows.select(F.explode(F.array_distinct(turned)).alias("x"), "v").select("x.*", "v").dropDuplicates(names)
    return Tensor(rows.select(*names, "v"), tuple(dims))


def show(t: Tensor, n: int = 20) -> None:
    """Print the first cells."""
    print(f"{t.name or 'tensor'} {t.dims} {t.dtype}")
    t.df.orderBy(*t.columns).show(n, truncate=False)
