"""A tensor whose rows arrive: each micro-batch is contracted with a static one, and sums are kept.

Rows of a stream are additive changes of cells. A contraction is linear in them, so the sum over
what arrived so far is the contraction of the sum; Structured Streaming keeps it as state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.plans.labels import column, labels_of
from weft.tensor import Tensor, index_columns


def contract_stream(changes: DataFrame, labels: str, static: Tensor, static_labels: str, out: str, time: str | None = None, window: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``changes``: a streaming DataFrame with i0 .. and v. The result has the output's indices and v (and a window's bounds, if
    ``time`` and ``window`` are given; then events later than ``late`` are dropped and state is let go)."""
    a, b, c = labels_of(labels), labels_of(static_labels), labels_of(out) if out else ()
    left = changes.withWatermark(time, late) if time and window else changes
    left = left.select(*(F.col(f"i{k}").alias(column(x)) for k, x in enumerate(a)), F.col("v").alias("va"), *([F.window(time, window).alias("span")] if time and window else []))
    right = static.df.select(*(F.col(f"i{k}").alias(column(x)) for k, x in enumerate(b)), F.col("v").alias("vb"))
    shared = [column(x) for x in a if x in b]
    joined = left.join(right, shared) if shared else left.crossJoin(right)
    keys = (["span"] if time and window else []) + [column(x) for x in c]
    found = joined.groupBy(*keys).agg(F.sum(F.col("va") * F.col("vb")).alias("v"))
    names = index_columns(len(c))
    return found.select(*([F.col("span.start").alias("start"), F.col("span.end").alias("end")] if time and window else []), *(F.col(column(x)).alias(n) for x, n in zip(c, names, strict=True)), "v")


def keep(found: DataFrame, folder: str, checkpoint: str, **trigger):
    """Start a query that writes the changed sums of each micro-batch to its own folder of Parquet files; a batch that is run
    again replaces what it wrote. Nothing is held outside of the stream's state."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/run={batch}")

    return found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(folder: str, spark, keys: Sequence[str]) -> DataFrame:
    """Of a folder that a stream in update mode appends to: the last value of each key."""
    rows = spark.read.parquet(folder)
    return rows.groupBy(*keys).agg(F.max_by("v", "batch").alias("v"))
