"""Tensors from business tables: keys are indices, repeated ones are added up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.tensor import Tensor


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounds(spark: SparkSession, folder: str, name: str, *columns: str) -> list[int]:
    """One more than the largest value of each column, from the statistics in the files' footers: no data pages are read."""
    row = maxima(spark, folder, name, *columns).first()
    return [0 if x is None else int(x) + 1 for x in row]


def maxima(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Analysed and optimised with the reader that pushes aggregates to Parquet; the session's settings are as before afterwards."""
    wanted = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        out = table(spark, folder, name).agg(*(F.max(c).alias(f"m{k}") for k, c in enumerate(columns)))
        out._jdf.queryExecution().executedPlan()
        return out
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _widest(spark: SparkSession, folder: str) -> int:
    return table(spark, folder, "embeddings").agg(F.max(F.size("embedding"))).first()[0] or 0


def quantities(spark: SparkSession, folder: str) -> Tensor:
    """Matrix (supplier, part): quantity supplied."""
    rows = table(spark, folder, "lineitem")
    return Tensor.of(rows, ["l_suppkey", "l_partkey"], "l_quantity", bounds(spark, folder, "lineitem", "l_suppkey", "l_partkey"), summed=True)


def quantities_by_line(spark: SparkSession, folder: str) -> Tensor:
    """(supplier, part, line number): quantity supplied."""
    rows = table(spark, folder, "lineitem")
    return Tensor.of(rows, ["l_suppkey", "l_partkey", "l_linenumber"], "l_quantity", bounds(spark, folder, "lineitem", "l_suppkey", "l_partkey", "l_linenumber"), summed=True)


def part_sizes(spark: SparkSession, folder: str) -> Tensor:
    """Vector (part): size."""
    parts = table(spark, folder, "part")
    return Tensor.of(parts, ["p_partkey"], F.col("p_size").cast("double"), [max(bounds(spark, folder, "part", "p_partkey")[0], bounds(spark, folder, "lineitem", "l_partkey")[0])])


def keys(spark: SparkSession, folder: str, name: str, column: str) -> Tensor:
    """Vector of a key column, at its own key."""
    rows = table(spark, folder, name)
    return Tensor.of(rows, [column], F.col(column).cast("double"), bounds(spark, folder, name, column))


def features(spark: SparkSession, folder: str) -> Tensor:
    """Matrix (vector, component) of the embeddings."""
    rows = table(spark, folder, "embeddings")
    cells = rows.select("vec_id", F.posexplode("embedding").alias("k", "x"))
    return Tensor.of(cells, ["vec_id", "k"], F.col("x").cast("double"), [*bounds(spark, folder, "embeddings", "vec_id"), _widest(spark, folder)])


def features_by_label(spark: SparkSession, folder: str) -> Tensor:
    """(label, vector, component) of the embeddings."""
    rows = table(spark, folder, "embeddings")
    cells = rows.select("label", "vec_id", F.posexplode("embedding").alias("k", "x"))
    return Tensor.of(cells, ["label", "vec_id", "k"], F.col("x").cast("double"), [*bounds(spark, folder, "embeddings", "label", "vec_id"), _widest(spark, folder)])
