"""Quality rules: compression bands.

A text's zstandard ratio (compressed bytes by bytes) falls as it gets longer, since a longer
text repeats more of its own words; so each band of lengths has its own limits. Below the
lower limit a text, or one of its fixed chunks, repeats itself; above the upper one it has no
structure that a compressor finds. The limits follow the measured spread of clean texts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.arrow import as_bytes, key_and_text, map_batches, slices

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_ODD = tuple(np.uint64(0x9E3779B97F4A7C15 ** (k + 1) % 2**64) for k in range(8))


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio: (least bytes, below it repetitive, above it incompressible), in ascending order of bytes.

    They are the 0.001 and 0.999 quantiles of the whole texts and chunks labelled as good that pass the base rules, of the rows
    that the classifier learns from, less and plus 8 % (16 % in the first and last band, of fewer than 100 values).
    """

    limits: tuple[tuple[int, float, float], ...] = (
        (0, 0.536, 1.008),
        (256, 0.501, 0.801),
        (512, 0.473, 0.735),
        (1024, 0.440, 0.625),
        (2048, 0.416, 0.562),
        (4096, 0.396, 0.521),
        (8192, 0.382, 0.487),
        (16384, 0.339, 0.496),
    )
    chunk_bytes: int = 4096
    #: Where the last chunk is shorter than this, the last so many bytes of the text are judged in its place.
    least_chunk: int = 1024
    level: int = 3
    #: Words in a text below which nothing is judged, and share of repeated words, in percent, above which a text goes.
    least_words: int = 20
    most_repeated: int = 30

    def of(self, n: int) -> tuple[float, float]:
        low, high = self.limits[0][1:]
        for least, a, b in self.limits:
            if n >= least:
                low, high = a, b
        return low, high


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words that stand in a run of ``window`` words found twice or more, the first time included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.uint64, count=len(words))
    if len(ids) == len(words):
        return 0
    x = (x + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        h += x[k : k + n] * _ODD[k % 8]
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: bytes, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, least and most ratio of a chunk, kept."""
    words = text.split()
    solid = text.translate(None, WHITE)
    lines = Counter(line for line in text.split(b"\n") if line and not line.isspace())
    n, repeated = len(words), repeated_words(words)
    failed = n < bands.least_words or 100 * repeated > bands.most_repeated * n
    ratio = len(compressor.compress(text)) / len(text) if text else 0.0
    low, high = bands.of(len(text))
    fine = bool(text) and low <= ratio <= high
    least = most = ratio
    if len(text) > bands.chunk_bytes:
        for at in range(0, len(text), bands.chunk_bytes):
            chunk = text[min(at, len(text) - bands.least_chunk) : at + bands.chunk_bytes]
            r = len(compressor.compress(chunk)) / len(chunk)
            low, high = bands.of(len(chunk))
            fine &= low <= r <= high
            least, most = min(least, r), max(most, r)
    return n, len(solid.translate(None, _CONTINUATION)), len(solid) - len(solid.translate(None, SYMBOLS)), sum(lines.values()) - len(lines), repeated, failed, ratio, least, most, fine and not failed


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, zstd_ratio double, zstd_least double, zstd_most double, kept boolean"
_TYPES = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 3 + [pa.bool_()]
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def judge(documents: DataFrame, bands: Bands = Bands(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``documents``: key and the measures of its whole text.

    A null text counts as empty and fails; a null key stays null; repeated rows give repeated
    rows; an empty table gives none. Other columns are not read. No row meets another, so
    nothing is shuffled, and memory holds a slice of texts.
    """

    def run(batches):
        compressor = zstandard.ZstdCompressor(level=bands.level)
        for part in slices(batches):
            rows = [measure(x, bands, compressor) for x in as_bytes(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True))], names=["doc_id", *_NAMES])

    return map_batches(key_and_text(documents, key, text), run, f"doc_id long, {SCHEMA}")


def filter_rows(documents: DataFrame, bands: Bands = Bands(), text: str = "text") -> DataFrame:
    """The rows of ``documents``, all columns as they are (``text`` as a string), whose text is kept. Each is judged where it is read.

    A null or empty text goes; equal rows stay or go together; ids do not matter; an empty table gives none.
    """

    def run(batches):
        compressor = zstandard.ZstdCompressor(level=bands.level)
        at = None
        for part in slices(batches):
            at = part.schema.get_field_index(text) if at is None else at
            yield part.filter(pa.array([measure(x, bands, compressor)[-1] for x in as_bytes(part.column(at))], pa.bool_()))

    return map_batches(documents.withColumn(text, F.col(text).cast("string")), run, documents.withColumn(text, F.col(text).cast("string")).schema)
