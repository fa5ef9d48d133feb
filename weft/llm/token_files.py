"""Token-id files: a concatenated id array with Elias-Fano encoded document boundaries.

A file is a table of shards in ascending order of the key. A shard holds its ids at the width
that the vocabulary needs (2 or 4 bytes), the keys, and the ends of its documents in the id
array as an Elias-Fano sequence: n ends below u take about 2 + log2(u / n) bits each. The low
bits are packed; the high parts are a bit vector in which the i-th one stands at (high + i),
and select(i) finds it through a count kept for each block of 512 bits. Offsets are thus read
without a table of 64-bit numbers. A shard knows how many ids of its own part come before it.

The table is written by Spark, so that any file system that Spark writes to will do, and a
task that is lost or repeated leaves no half shard.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.arrow import as_bytes, key_and_text, map_batches, sized
from weft.llm.storage import new_path
from weft.llm.tokenize import encoder, read_vocabulary

BLOCK = 512
#: A shard is closed when it holds this many ids; a document is never split, so a longer one has a larger shard.
SHARD_IDS = 4_000_000
_POPCOUNT = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)
#: Place of the k-th one of a byte.
_SELECT = np.array([([b for b in range(8) if x >> b & 1] + [0] * 8)[:8] for x in range(256)], dtype=np.uint8)


@dataclass(frozen=True)
class EliasFano:
    """A non-decreasing sequence of ``n`` numbers up to ``top``."""

    n: int
    top: int
    low_bits: int
    low: bytes
    high: bytes
    #: Ones before each block of ``BLOCK`` bits of ``high``.
    ranks: bytes

    @staticmethod
    def encode(values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        l = max(0, (max(top, 1) // max(n, 1)).bit_length() - 1)
        lows = (v[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)
        ones = (v >> np.uint64(l)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-(int(ones[-1]) + 1 if n else 0) // BLOCK) * BLOCK, dtype=np.uint8)
        bits[ones] = 1
        counts = bits.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        ranks = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0)
        return EliasFano(n, top, l, np.packbits(lows.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes(), ranks.astype("<u4").tobytes())

    def select(self, i: int | np.ndarray) -> int | np.ndarray:
        """The i-th number, from 0; of an array of places, the numbers there. A block of ``high`` and ``low_bits`` bits are read for each."""
        at = np.atleast_1d(np.asarray(i, dtype=np.int64))
        if len(at) and not (0 <= at.min() and at.max() < self.n):
            raise IndexError(i)
        if not len(at):
            return np.zeros(0, dtype=np.int64)
        ranks = np.frombuffer(self.ranks, dtype="<u4")
        block = np.searchsorted(ranks, at, side="right") - 1
        bits = np.frombuffer(self.high, dtype=np.uint8).reshape(-1, BLOCK // 8)[block]
        left = at - ranks[block].astype(np.int64)
        counts = np.cumsum(_POPCOUNT[bits], axis=1, dtype=np.int32)
        byte = (counts <= left[:, None]).sum(axis=1)
        row = np.arange(len(at))
        left -= np.where(byte > 0, counts[row, byte - 1], 0)
        place = _SELECT[bits[row, byte], left].astype(np.int64)
        out = block * BLOCK + byte * 8 + place - at << self.low_bits
        if self.low_bits:
            low = np.frombuffer(self.low + b"\0", dtype=np.uint8)
            for k in range(self.low_bits):
                bit = at * self.low_bits + k
                out |= (low[bit >> 3].astype(np.int64) >> (bit & 7) & 1) << k
        return int(out[0]) if np.ndim(i) == 0 else out

    def decode(self) -> np.ndarray:
        """All numbers in order, in one sweep."""
        if not self.n:
            return np.zeros(0, dtype=np.int64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, dtype=np.uint8), bitorder="little"))
        out = (ones - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, dtype=np.uint8), bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            out |= bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out


SHARDS = "part int, shard int, ids_before long, documents long, ids long, id_bytes int, top long, low_bits int, low binary, high binary, ranks binary, keys binary, no_key long, payload binary"
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.int64(), pa.binary()]


def write(documents: DataFrame, vocabulary_path: str, path: str, end: int | None = 2, key: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode whole texts, append ``end`` to each, and write the shards under ``path`` in ascending order of the key.

    Rows are range-partitioned by key once, as texts; ids are made after that and go from the
    encoder to the shard. Null keys come first; null texts are empty; repeated rows are documents of
    their own, in the order of their texts; an empty table writes no shard.
    """
    spark = documents.sparkSession
    shipped = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder = encoder(shipped.value)
        width = 2 if max(coder.tokenizer.get_vocab_size(), (end or 0) + 1) <= 1 << 16 else 4
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        shard = size = none = before = 0

        def close():
            ends = EliasFano.encode(np.cumsum(np.concatenate(lengths)))
            row = (part, shard, before, ends.n, size, width, ends.top, ends.low_bits, ends.low, ends.high, ends.ranks, np.concatenate(keys).tobytes(), none, b"".join(x.tobytes() for x in held))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _KINDS, strict=True)], names=[c.split()[0] for c in SHARDS.split(", ")])

        for some in sized(batches, 1):
            ids, ends = coder.arrays(as_bytes(some.column(1)))
            if end is None:
                ids = ids.astype(f"<u{width}")
            else:
                ends = ends + 1 + np.arange(len(ends))
                ids, found = np.full(ends[-1], end, dtype=f"<u{width}"), ids
                own = np.ones(len(ids), dtype=bool)
                own[ends - 1] = False
                ids[own] = found
            nulls = some.column(0).is_null().to_numpy(zero_copy_only=False)
            numbers = some.column(0).fill_null(0).to_numpy().astype("<i8")
            at = taken = 0
            while at < len(ends):  # as many documents as the shard still holds: the one that fills it closes it
                stop = min(len(ends), int(np.searchsorted(ends, taken + shard_ids - size)) + 1)
                held.append(ids[taken : ends[stop - 1]])
                lengths.append(np.diff(ends[at:stop], prepend=taken))
                keys.append(numbers[at:stop])
                none += int(nulls[at:stop].sum())  # null keys sort first: the first ``no_key`` of the shard
                size += len(held[-1])
                at, taken = stop, int(ends[stop - 1])
                if size >= shard_ids:
                    yield close()
                    held, lengths, keys, size, none, shard, before = [], [], [], 0, 0, shard + 1, before + size
        if keys:
            yield close()

    plain = key_and_text(documents, key, text)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = plain.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    map_batches(ordered, run, SHARDS).write.parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids): one row per document, read from the shards.

    Documents without an id come first and have a null one; an empty text has what was written for it (the end id, if any);
    repeated rows are documents of their own; a folder without shards must have been written by write(), and gives no rows.
    """
    shards = spark.read.parquet(path)
    # one row per task that wrote: bounded by the number of partitions, and so broadcast; the payloads are not shuffled
    parts = shards.groupBy("part").agg(F.sum("ids").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = shards.join(F.broadcast(parts.select("part", "before")), "part").select((F.col("before") + F.col("ids_before")).alias("base"), "documents", "id_bytes", "top", "low_bits", "low", "high", "ranks", "keys", "no_key", "payload")

    def run(batches):
        for batch in batches:
            for row in (r for at in range(batch.num_rows) for r in batch.slice(at, 1).to_pylist()):
                offsets = EliasFano(row["documents"], row["top"], row["low_bits"], row["low"], row["high"], row["ranks"])
                ids = np.frombuffer(row["payload"], dtype="<u2" if row["id_bytes"] == 2 else "<u4")
                keys = np.frombuffer(row["keys"], dtype="<i8")
                for at in range(0, offsets.n, 4096):
                    span = slice(at, at + 4096)
                    ends = offsets.select(np.arange(at, min(at + 4096, offsets.n)))
                    begins = np.concatenate([[offsets.select(at - 1) if at else 0], ends[:-1]])
                    own = [ids[b:e].astype("<u4").tobytes() for b, e in zip(begins, ends, strict=True)]
                    out = [pa.array(keys[span], mask=np.arange(at, at + len(own)) < row["no_key"]), pa.array(row["base"] + begins), pa.array(ends - begins), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    yield pa.RecordBatch.from_arrays(out + ([pa.array(own, pa.binary())] if with_ids else []), names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return map_batches(placed, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def round_trip(documents: DataFrame, vocabulary_path: str, end: int | None = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write to a new place in the shared folder and read back."""
    path = new_path(documents.sparkSession, "tokens")
    write(documents, vocabulary_path, path, end, key, text)
    return read(documents.sparkSession, path)
