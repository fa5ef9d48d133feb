"""LM scoring by cross-entropy difference.

Two bigram models, one of a target corpus and one of the background (all documents), share one
vocabulary: all words of the documents. Words and pairs of neighbours are told apart by 64-bit
hashes. Both have the same order and smoothing, and the background's counts are scaled to the
target's size, so that the models are matched. A document's score is the mean over its words of the
background loss less the target loss, in nats: the higher, the more like the target.

A document is scored by what the others hold: its own counts are taken out of the models that
they went into. The models are sums over all documents, and grow with them: they stay distributed.
Documents are dealt to chunks of some ``CHUNK`` bytes. A chunk sends its distinct n-grams with their
counts to the buckets that own them, by ranges of the hash, and a bucket answers each chunk with the
sums over all chunks. A frequent n-gram is one number per chunk, however often it occurs. No task
holds more than a chunk, or what a bucket gets from all chunks, which is about three chunks' n-grams.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.arrow import as_bytes, key_and_text
from weft.llm.storage import materialize, ship

#: Bytes of text in a chunk, about; the larger, the fewer n-grams are sent, and the more a task holds.
CHUNK = 1 << 23
#: Words scored at a time, about.
BLOCK = 1 << 17


@dataclass(frozen=True)
class Bigrams:
    """With ``words`` and ``pairs`` hashes are taken modulo these, so that n-grams collide; without, they are 64-bit."""

    words: int | None = None
    pairs: int | None = None
    #: Added to each word's count; weight of the word model in a pair's probability.
    add: float = 0.1
    prior: float = 8.0

    @property
    def slots(self) -> int:
        """Word counts, then counts of words as the first of a pair (with the start of a text), then pairs."""
        return 2 * self.words + 1 + self.pairs


#: What stands before a text's first word, among 64-bit hashes.
START = np.uint64(0x5DEECE66D1CE4E5B)


def _mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(text: bytes, how: Bigrams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word, what stands before it, and the pair, as numbers of their own range. A-Z are lower-cased."""
    found = text.lower().split()
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    if how.words is not None:
        w %= np.uint64(how.words)
    before = np.concatenate([[START if how.words is None else np.uint64(how.words)], w[:-1]]) if len(w) else w
    if how.words is None:
        pair = _mix(_mix(before) + w)
    else:
        mixed = (before * np.uint64(how.words) + w + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        pair = mixed * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(17)
    return w, before, pair if how.pairs is None else pair % np.uint64(how.pairs)


def places(text: bytes, how: Bigrams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of each word, of what stands before it, and of the pair, where the slots are bounded."""
    w, before, pair = hashes(text, how)
    return w.astype(np.int64), how.words + before.astype(np.int64), 2 * how.words + 1 + pair.astype(np.int64)


def _pack(numbers: np.ndarray) -> bytes:
    """64-bit numbers by planes of equal bytes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(packed: bytes, kind=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8).reshape(8, -1).T).view(kind).ravel()


class Chunk:
    """The n-grams of some texts: distinct hashes in order, and of each word of each text its place among them."""

    def __init__(self, texts: list[bytes], how: Bigrams):
        found = [hashes(x, how)[::2] for x in texts]
        self.n = np.fromiter((len(x[0]) for x in found), dtype=np.int64, count=len(found))
        self.text = np.repeat(np.arange(len(texts)), self.n)
        ends = np.cumsum(self.n)
        #: Places of the texts' last words in the row of all words.
        self.last = ends[self.n > 0] - 1
        self.hashes, self.at = [], []
        for k in (0, 1):
            own, at = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *(x[k] for x in found)]), return_inverse=True)
            self.hashes.append(own)
            self.at.append(at)

    def counts(self, target: np.ndarray) -> list[list[np.ndarray]]:
        """Of the words: as a word in all texts, in the target's, before another in all, in the target's; of the pairs: in all, in the target's."""
        (w, p), (nw, np_) = self.at, map(len, self.hashes)
        mine = target[self.text]
        ends, ends_mine = w[self.last], w[self.last[mine[self.last]]]
        words, of_target = np.bincount(w, minlength=nw), np.bincount(w[mine], minlength=nw)
        before = [words - np.bincount(ends, minlength=nw), of_target - np.bincount(ends_mine, minlength=nw)]
        return [[words, of_target, *before], [np.bincount(p, minlength=np_), np.bincount(p[mine], minlength=np_)]]

    def losses(self, words: list[np.ndarray], pairs: list[np.ndarray], totals: dict[str, int], how: Bigrams) -> list[np.ndarray]:
        """By text: words, then mean losses (target, background) with its counts out of the background only, and out of both.

        ``words``, ``pairs``: as in ``counts``, over all documents.
        """
        ends, out, begin = np.cumsum(self.n), [], 0
        while begin < len(self.n):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + BLOCK)))
            out.append(self._losses(begin, end, ends, words, pairs, totals, how))
            begin = end
        return [self.n, *(np.concatenate(x) for x in zip(*out, strict=True))]

    def _losses(self, begin: int, end: int, ends: np.ndarray, words: list[np.ndarray], pairs: list[np.ndarray], totals: dict[str, int], how: Bigrams) -> list[np.ndarray]:
        """Of the texts from ``begin`` to before ``end``."""
        n = self.n[begin:end]
        cut = slice(ends[begin] - n[0], ends[end - 1])
        text, w, p = self.text[cut] - begin, self.at[0][cut], self.at[1][cut]
        some, stop = n > 0, ends[begin:end] - cut.start
        first, last = (stop - n)[some], np.zeros(len(n), dtype=np.int64)
        last[some] = w[stop[some] - 1]

        def held(at, kinds):
            """How often each n-gram is in its own text."""
            _, back, m = np.unique(text * max(1, kinds) + at, return_inverse=True, return_counts=True)
            return m[back]

        held_w, prev = held(w, len(words[0])), np.concatenate([w[:1], w[:-1]])
        held_b = np.concatenate([held_w[:1], held_w[:-1]]) - (prev == last[text])
        held_b[first] = 1
        own = [held_w, held_b, held(p, len(pairs[0]))]
        count_b, count_t = ([words[k][w], words[2 + k][prev], pairs[k][p]] for k in (0, 1))
        count_b[1][first], count_t[1][first] = totals["docs"], totals["target_docs"]

        def mean(counts, total, scale):
            total, scale = (np.broadcast_to(x, n.shape)[text] for x in (total, scale))
            c = [x * scale for x in counts]
            one = (c[0] + how.add) / (total * scale + how.add * totals["vocabulary"])
            return np.bincount(text, weights=-np.log((c[2] + how.prior * one) / (c[1] + how.prior)), minlength=len(n)) / np.maximum(n, 1)

        rest_b, less_b = totals["words"] - n, [x - y for x, y in zip(count_b, own, strict=True)]
        out = []
        # where the document is not in the target, taking it out means nothing: the floor keeps that unused loss a number
        for c, rest in ((count_t, np.full(len(n), totals["target_words"])), ([np.maximum(x - y, 0) for x, y in zip(count_t, own, strict=True)], np.maximum(totals["target_words"] - n, 0))):
            out += [mean(c, rest, 1.0), mean(less_b, rest_b, np.maximum(rest, 1) / np.maximum(rest_b, 1))]
        return out


def _bounds(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's hashes begin, and where the last one's end."""
    step = (1 << 64) // buckets + 1
    return np.append(np.searchsorted(sorted_hashes, np.array([step * i for i in range(buckets)], dtype=np.uint64)), len(sorted_hashes))


_TOTALS = ["words", "target_words", "docs", "target_docs"]
_ASKED = "bucket long, chunk long, word binary, pair binary, " + ", ".join(f"{x} long" for x in _TOTALS)
_TOLD = "chunk long, bucket long, word binary, pair binary, vocabulary long, " + ", ".join(f"{x} long" for x in _TOTALS)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def model(chunks: DataFrame, wanted: DataFrame, buckets: int, how: Bigrams) -> DataFrame:
    """Per chunk and bucket: counts over all documents of the chunk's n-grams, in the order of their hashes. Written once."""

    def ask(texts: pa.Table, ids: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _table([], _ASKED)
        wanted_here = set(ids.column("doc_id").to_pylist())
        target = np.array([x in wanted_here for x in texts.column("doc_id").to_pylist()], dtype=bool)
        own, chunk = Chunk(as_bytes(texts.column("text")), how), texts.column("chunk")[0].as_py()
        counts, bounds = own.counts(target), [_bounds(x, buckets) for x in own.hashes]
        totals = (int(own.n.sum()), int(own.n[target].sum()), int((own.n > 0).sum()), int((own.n[target] > 0).sum()))
        rows = []
        for b in range(buckets):
            cut = [slice(x[b], x[b + 1]) for x in bounds]
            if any(x.stop > x.start for x in cut):
                sent = [_pack(np.concatenate([np.diff(h[x], prepend=np.uint64(0)).view(np.int64), *(y[x] for y in c)])) for h, c, x in zip(own.hashes, counts, cut, strict=True)]
                rows.append((b, chunk, *sent, *(totals if not rows else (0,) * 4)))
        return _table(rows, _ASKED)

    def tell(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        told = [[row["chunk"], row["bucket"]] for row in rows]
        distinct = 0
        for kind, columns in (("word", 5), ("pair", 3)):
            parts = [_unpack(row.pop(kind)).reshape(columns, -1) for row in rows]
            own, back = np.unique(np.concatenate([np.cumsum(x[0].view(np.uint64), dtype=np.uint64) for x in parts]), return_inverse=True)
            sums = []
            for k in range(1, columns):
                total = np.zeros(len(own), dtype=np.int64)
                np.add.at(total, back, np.concatenate([x[k] for x in parts]))
                sums.append(total)
            ends = np.cumsum([x.shape[1] for x in parts])
            for out, part, end in zip(told, parts, ends, strict=True):
                at = back[end - part.shape[1] : end]
                out.append(_pack(np.concatenate([x[at] for x in sums])))
            if kind == "word":
                distinct = len(own)
        return _table([(*out, distinct if not i else 0, *(row[x] for x in _TOTALS)) for i, (out, row) in enumerate(zip(told, rows, strict=True))], _TOLD)

    asked = chunks.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(ask, _ASKED)
    return materialize(asked.groupBy("bucket").applyInArrow(tell, _TOLD), "ngrams")


def score(documents: DataFrame, target_ids: DataFrame, how: Bigrams = Bigrams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, target_loss, background_loss, score: one row per row of ``documents``.

    ``target_ids``: doc_id of the target's documents (nulls and repeats do not matter). A null or
    empty text has no words and zeros; a null id stays null and is background only; repeated rows
    are documents of their own; an empty table gives none, and without a target all scores are those
    against an empty model. The whole texts are read three times, to measure, to count and to score;
    they move twice, to meet the ids and to meet the counts.
    """
    plain = key_and_text(documents, key, text)
    ship(documents.sparkSession)
    n = (plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // CHUNK + 8
    buckets = n // 3 + 4
    # rows without an id are dealt by their texts; ids are dealt to the texts by a shuffle at every size
    chunks = plain.withColumn("chunk", F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(n)))
    wanted = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    told = model(chunks, wanted.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(n))), buckets, how)
    totals = {k: v or 0 for k, v in told.agg(*(F.sum(x).alias(x) for x in ["vocabulary", *_TOTALS])).first().asDict().items()}
    totals["vocabulary"] = how.words or totals["vocabulary"]
    schema = "doc_id long, n_words long, t double, b double, own_t double, own_b double"

    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _table([], schema)
        own, counts = Chunk(as_bytes(texts.column("text")), how), counts.sort_by("bucket")
        summed = []
        for kind, columns, there in (("word", 4, own.hashes[0]), ("pair", 2, own.hashes[1])):
            summed.append(np.concatenate([np.zeros((columns, 0), dtype=np.int64), *(_unpack(x).reshape(columns, -1) for x in counts.column(kind).to_pylist())], axis=1))
            if summed[-1].shape[1] != len(there):
                raise ValueError("a chunk's texts changed between counting and scoring")
        return pa.table([texts.column("doc_id"), *own.losses(*summed, totals, how)], names=["doc_id", "n_words", "t", "b", "own_t", "own_b"])

    # a document's membership is not needed to score it: both losses are kept until the ids meet the small result
    scored = chunks.groupBy("chunk").cogroup(told.select("chunk", "bucket", "word", "pair").groupBy("chunk")).applyInArrow(run, schema)
    losses = materialize(scored, "losses")
    # rows without an id are in no target, and would all go to one task
    both = losses.where("doc_id is not null").join(wanted.withColumn("target", F.lit(True)), "doc_id", "left").unionByName(losses.where("doc_id is null").withColumn("target", F.lit(None).cast("boolean")))
    t, b = F.when(F.col("target"), F.col("own_t")).otherwise(F.col("t")), F.when(F.col("target"), F.col("own_b")).otherwise(F.col("b"))
    return both.select("doc_id", "n_words", t.alias("target_loss"), b.alias("background_loss"), (b - t).alias("score"))
