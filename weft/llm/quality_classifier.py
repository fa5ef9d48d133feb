"""Quality classifier: regularised quadratic discriminant on document statistics.

Each class gets a mean and a covariance over transformed statistics of a text. A covariance
is shrunk towards the pooled one and then towards a multiple of the identity, so that it can
be inverted with few labelled rows. The score is the logistic of the difference of the two
log densities, whose Mahalanobis terms come from Cholesky factors that are inverted once, on
the driver, and sent to the workers with the model (a few KB).
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.arrow import as_bytes, key_and_text, map_batches, slices
from weft.llm.storage import materialize

WHITE = b" \t\n\r\x0b\x0c"
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(0x41, 0x5B))
_LETTERS = _UPPER + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_DIGITS = b"0123456789"
_MARKS = b".,;:!?"
_SYMBOLS = bytes(x for x in range(0x21, 0x7F) if x not in _LETTERS and x not in _DIGITS and x not in _MARKS and x not in b"'-\"()")
FEATURES = ("words", "word_length", "word_length_spread", "unique_words", "repeated_next", "top_word", "upper", "digits", "marks", "loud_marks", "symbols", "bare_symbols", "line_words", "repeated_lines", "sentence_words", "repeated_triples")


def _share(part: float, whole: float) -> float:
    """Square root of a share: near zero, where most shares lie, it spreads them out."""
    return math.sqrt(part / whole) if whole else 0.0


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of one whole text; an empty text has zeros."""
    words = text.split()
    n = len(words)
    solid = text.translate(None, WHITE)
    size = len(solid)
    points = len(solid.translate(None, _CONTINUATION))
    counted = Counter(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    marks = size - len(solid.translate(None, _MARKS))
    letters = size - len(solid.translate(None, _LETTERS))
    stops = text.count(b".") + text.count(b"?")
    bare = sum(c for w, c in counted.items() if not w.translate(None, _SYMBOLS))
    return [
        math.log1p(n),
        math.log1p(points / n) if n else 0.0,
        math.log1p(float(lengths.std())) if n else 0.0,
        # distinct words fall with length in any text: taken against n ** 0.8
        math.log((len(counted) + 1) / (n**0.8 + 1)),
        _share(sum(map(bytes.__eq__, words, words[1:])), n),
        _share(max(counted.values(), default=0), n),
        _share(size - len(solid.translate(None, _UPPER)), letters),
        _share(size - len(solid.translate(None, _DIGITS)), size),
        _share(marks, size),
        _share(text.count(b"!"), size),
        _share(size - len(solid.translate(None, _SYMBOLS)), size),
        _share(bare, n),
        math.log1p(n / len(lines)) if lines else 0.0,
        _share(len(lines) - len(set(lines)), len(lines)),
        math.log1p(n / (stops + 1)),
        _share(max(0, n - 2 - triples), n),
    ]


@dataclass(frozen=True)
class Discriminant:
    """What scoring needs. ``factors`` are the inverses of the Cholesky factors, ``offsets`` log prior minus half the log determinant."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray] | None
    factors: tuple[np.ndarray, np.ndarray] | None
    offsets: tuple[float, float]
    constant: float = 0.5
    temperature: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None or self.factors is None:
            return np.full(len(x), self.constant)
        z = (x - self.centre) / self.scale
        logs = [o - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1.0 / (1.0 + np.exp(-np.clip((logs[1] - logs[0]) / self.temperature, -60, 60)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], towards_pooled: float = 0.3, towards_identity: float = 0.02, temperature: float = 4.0) -> Discriminant:
    """From each class's count, sum and sum of outer products. With a class missing, the score is a constant: 0.5 without labels, else the class there is."""
    d = len(FEATURES)
    zero = np.zeros(d)
    n = {c: moments[c][0] if c in moments else 0.0 for c in (0, 1)}
    if not n[0] or not n[1]:
        return Discriminant(zero, zero + 1, None, None, (0.0, 0.0), 0.5 if n[0] == n[1] else float(n[1] > 0))
    total = n[0] + n[1]
    centre = (moments[0][1] + moments[1][1]) / total
    scale = np.sqrt(np.maximum(np.diag(moments[0][2] + moments[1][2]) / total - centre**2, 1e-9))
    means, spreads = [], []
    for c in (0, 1):
        mean = moments[c][1] / n[c]
        spread = moments[c][2] / n[c] - np.outer(mean, mean)
        means.append((mean - centre) / scale)
        spreads.append(spread / np.outer(scale, scale))
    pooled = (n[0] * spreads[0] + n[1] * spreads[1]) / total
    factors, offsets = [], []
    for c in (0, 1):
        shrunk = (1 - towards_pooled) * spreads[c] + towards_pooled * pooled
        shrunk = (1 - towards_identity) * shrunk + towards_identity * max(np.trace(shrunk) / d, 1e-6) * np.eye(d)
        lower = np.linalg.cholesky((shrunk + shrunk.T) / 2)
        factors.append(np.linalg.inv(lower))
        offsets.append(math.log(n[c] / total) - float(np.log(np.diag(lower)).sum()))
    return Discriminant(centre, scale, (means[0], means[1]), (factors[0], factors[1]), (offsets[0], offsets[1]), temperature=temperature)


def features(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``x``: the statistics of each whole text, null as empty. Rows do not meet."""

    def run(batches):
        for part in slices(batches):
            x = np.array([statistics(t) for t in as_bytes(part.column(1))], dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))], names=["doc_id", "x"])

    return map_batches(key_and_text(documents, key, text), run, "doc_id long, x array<double>")


def class_moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Of columns ``x`` and ``quality``: sums per task first, so that 2 x (1 + d + d * d) numbers reach the driver, whatever the input."""
    d = len(FEATURES)

    def run(batches):
        total = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), dtype=np.float64).reshape(-1, d)
            y = np.array(batch.column(1).to_pylist())
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        for c in (0, 1):
            if total[c][0]:
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(total[c]), pa.int32()), pa.array(range(len(total[c])), pa.int32()), pa.array(total[c])], names=["c", "i", "v"])

    sums = map_batches(labelled.select("x", F.col("quality").cast("int")), run, "c int, i int, v double").groupBy("c", "i").agg(F.sum("v").alias("v")).collect()
    out = {}
    for c in {r["c"] for r in sums}:
        v = np.zeros(1 + d + d * d)
        for r in sums:
            if r["c"] == c:
                v[r["i"]] = r["v"]
        out[c] = (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d))
    return out


def held_out(key: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the id as text, mod 4, is 2. A row without an id is none."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(measured: DataFrame, labels: DataFrame, learn=None) -> Discriminant:
    """``measured``: from features(). ``labels``: doc_id, quality. Rows with ``learn`` true are used, all of them; a label
    that is null or neither 0 nor 1 is no label; an id labelled both ways is left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    if learn is not None:
        known = known.where(learn)
    return fit(class_moments(measured.join(known, "doc_id").select("x", "quality")))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted: one row per row of ``documents``.

    A null or empty text is scored from its zeros; repeated rows get equal rows; a null key
    stays null and is never learned from; without labelled rows every score is 0.5. Texts are
    read once: their statistics (16 numbers a text) are written to the shared folder, joined
    with the labels there, and scored from there. Ids, labels and other columns never enter a score.
    """
    measured = materialize(features(documents, key, text), "features")
    return score(measured, train(measured, labels, ~held_out()), threshold)


def score(measured: DataFrame, model: Discriminant, threshold: float = 0.7) -> DataFrame:
    def run(batches):
        for batch in batches:
            s = model.score(np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = map_batches(measured, run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def filter_rows(documents: DataFrame, model: Discriminant, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``documents``, all columns as they are (``text`` as a string), that the model does not reject.

    A null or empty text is scored from its zeros; equal rows stay or go together; ids do not matter; an empty table gives none.
    """
    plain = documents.withColumn(text, F.col(f"`{text}`").cast("string"))
    at = plain.columns.index(text)

    def run(batches):
        for part in slices(batches):
            x = np.array([statistics(t) for t in as_bytes(part.column(at))], dtype=np.float64).reshape(-1, len(FEATURES))
            yield part.filter(pa.array(model.score(x) >= threshold))

    return map_batches(plain, run, plain.schema)
