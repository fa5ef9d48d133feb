"""Best-fit packing of token sequences, planned on the length histogram.

Documents longer than a sequence are cut into pieces of full length and a rest. Pieces of one
length are alike to a plan, so best-fit decreasing runs over the counts of each length, of
which there are at most ``length``: the plan is made on the driver from that many numbers and
holds runs of equal slots. Pieces are then ranked within their length, and a piece takes the
slot of its rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.arrow import as_bytes, key_and_text, map_batches, sized
from weft.llm.storage import materialize
from weft.llm.tokenize import encoder, read_vocabulary

#: Text that a worker encodes at a time, about.
SLICE_BYTES = 1 << 21
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Run:
    """``count`` pieces of ``length`` with ranks from ``first``: rank r goes to sequence ``sequence + (r - first) // each``, at ``offset + (r - first) % each * length``."""

    length: int
    first: int
    count: int
    sequence: int
    each: int
    offset: int


def plan(histogram: dict[int, int], length: int) -> tuple[list[Run], int]:
    """Runs of slots for all pieces, and the number of sequences.

    Best fit, longest pieces first: a piece goes where the least room is left that it fits in.
    Open sequences of equal room are held as ranges of numbers, so the work follows the number of lengths.
    """
    runs: list[Run] = []
    open_at: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, start: int, count: int) -> None:
        if room > 0 and count > 0:
            if room not in open_at:
                insort(rooms, room)
            open_at[room].append((start, count))

    sequences = 0
    for size in sorted((n for n in histogram if n > 0 and histogram[n] > 0), reverse=True):
        left, rank = histogram[size], 0
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                fill = length // size
                new = -(-left // fill)
                start, count, room = sequences, new, length
                sequences += new
            else:
                room = rooms[at]
                start, count = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room]
                    rooms.pop(at)
                fill = room // size
            full = min(count, left // fill)
            if full:
                runs.append(Run(size, rank, full * fill, start, fill, length - room))
                put(room - fill * size, start, full)
                rank, left = rank + full * fill, left - full * fill
            if full < count:
                if left and left < fill:
                    runs.append(Run(size, rank, left, start + full, left, length - room))
                    put(room - left * size, start + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                if full < count and room < length:
                    put(room, start + full, count - full)
    return runs, sequences


def pieces(documents: DataFrame, vocabulary: str, length: int = 4096, end: int | None = 1, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ids of the tokenizers library (no special tokens), then ``end``, cut where they exceed ``length``. A null text is empty."""
    spark = documents.sparkSession
    shipped = spark.sparkContext.broadcast(vocabulary)
    tail = b"" if end is None else int(end).to_bytes(4, "little")
    step = 4 * length
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids

    def run(batches):
        coder = encoder(shipped.value)
        for part in sized(batches, 1, SLICE_BYTES):
            rows: list[tuple] = []
            found, ends = coder.arrays(as_bytes(part.column(1)))
            begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            for doc, b, e in zip(part.column(0).to_pylist(), begins.tolist(), ends.tolist(), strict=True):
                ids = found[b:e].tobytes() + tail
                for at in range(0, len(ids), step):
                    own = ids[at : at + step]
                    rows.append((doc, at // step, at // 4, len(own) // 4, zlib.crc32(own), own if with_ids else None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: len(names)], strict=False)], names=names)

    return map_batches(key_and_text(documents, key, text), run, PIECES + ", ids binary" * with_ids)


def pack(cut: DataFrame, length: int = 4096) -> DataFrame:
    """``cut`` (from pieces(), already written: it is read twice) with sequence_id and offset; columns of these names are replaced,
    others are kept. Rows that are equal get places of their own, null ids are ids like others, no rows give none.

    Ranks: rows are dealt to ``deals`` parts of each length by a hash, numbered there, and
    shifted by the sizes of the parts before; so a length that a third of all pieces has is
    ranked in many tasks. What the driver gets is one count per length.
    """
    spark = cut.sparkSession
    own_names = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    deal, shift, rank = (c + "_" * max(map(len, own_names)) for c in ("deal", "shift", "rank"))  # no column has these names
    deals = max(16, spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan(histogram, length)
    runs.sort(key=lambda r: (r.length, r.first))
    table = np.array([(r.length, r.first, r.count, r.sequence, r.each, r.offset) for r in runs], dtype=np.int64).reshape(-1, 6)
    slots = spark.sparkContext.broadcast(table)
    dealt = cut.select(*own_names, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(deals)).alias(deal))
    before = Window.partitionBy("length").orderBy(deal).rowsBetween(Window.unboundedPreceding, -1)
    shifts = dealt.groupBy("length", deal).agg(F.count("*").alias(rank)).select("length", deal, F.coalesce(F.sum(rank).over(before), F.lit(0)).alias(shift))
    own = Window.partitionBy("length", deal).orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn(rank, F.row_number().over(own) - 1).join(shifts, ["length", deal]).withColumn(rank, F.col(rank) + F.col(shift)).drop(deal, shift)
    at, rank_at = ranked.columns.index("length"), ranked.columns.index(rank)
    names = [c for c in ranked.columns if c != rank]

    def place(batches):
        runs = slots.value
        for part in batches:
            if not part.num_rows:
                continue
            size, place_of = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (at, rank_at))
            # the last run whose (length, first) is not above (length, rank)
            first_of = np.searchsorted(runs[:, 0], size, side="left")
            last_of = np.searchsorted(runs[:, 0], size, side="right")
            low, high = first_of, last_of
            while (high - low > 1).any():
                middle = (low + high) // 2
                up = (high - low > 1) & (runs[middle, 1] <= place_of)
                low, high = np.where(up, middle, low), np.where(up | (high - low <= 1), high, middle)
            r = runs[low]
            q = place_of - r[:, 1]
            sequence, offset = r[:, 3] + q // r[:, 4], r[:, 5] + q % r[:, 4] * size
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kinds = dict(ranked.dtypes)
    out = map_batches(ranked, place, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", sequence_id long, offset long")
    return out.select(*own_names, "sequence_id", "offset")


def best_fit(documents: DataFrame, vocabulary_path: str, length: int = 4096, end: int | None = 1, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for): one row per piece of each row.

    Null and empty texts are one piece that holds only ``end`` (none without ``end``); a null id
    stays null; repeated rows are pieces of their own; an empty table gives none; other columns are
    not read. Texts are encoded once: pieces are written to the shared folder, then planned and placed.
    """
    cut = materialize(pieces(documents, read_vocabulary(vocabulary_path), length, end, key, text, with_ids), "pieces")
    return pack(cut, length)
