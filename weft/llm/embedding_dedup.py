"""Embedding near-dedup: sign hashing with random hyperplanes in several tables, exact cosines, connected components.

Equal vectors of a label form a class that goes on as one. Each table gives a class a code of
``bits`` signs; classes of one label whose codes are equal in some table are compared by
cosine in double precision. Two vectors at the least cosine c get equal bits with a chance of
1 - acos(c) / pi each, and there are as many tables as bring the chance to miss them below
``miss``. Bits follow the size of the largest label, so that a bucket holds about
``per_bucket`` unrelated vectors at any size of input.

Buckets are compared in blocks of bounded size, first by a second sketch of ``SKETCH`` signs,
which is all that a posting carries: two vectors at the least cosine differ in more than
``SignHash.most`` of them with a chance of a thousandth of ``miss``. Where few pairs are left of a
block, they are sent to their vectors; where many are (copies of one another), the vectors are
sent to the block, which then emits the number of links of each vector and a spanning forest,
never the pairs. A pair counts in the first table where its codes are equal, so none counts twice.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from weft.llm.arrow import groups, map_batches, slices
from weft.llm.components import components, salted_join
from weft.llm.storage import materialize


SKETCH = 128
#: Pairs for each row of a block, up to which they are sent one by one.
FEW_PAIRS = 2


@dataclass(frozen=True)
class SignHash:
    cosine: float = 0.93
    miss: float = 1e-3
    per_bucket: int = 16
    block: int = 1024

    def bits(self, largest: int) -> int:
        return min(60, max(4, math.ceil(math.log2(max(1, largest) / self.per_bucket)))) if largest else 4

    def tables(self, bits: int) -> int:
        same = (1 - math.acos(self.cosine) / math.pi) ** bits
        return math.ceil(math.log(self.miss) / math.log1p(-same))


    @property
    def most(self) -> int:
        """Signs of the second sketch in which a linked pair may differ."""
        p, total = math.acos(self.cosine) / math.pi, 0.0
        for k in range(SKETCH + 1):
            total += math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
            if total >= 1 - self.miss / 1000:
                return k
        return SKETCH


def _hyperplanes(bits: int, tables: int, dims: int) -> np.ndarray:
    """Of the tables' codes, then of the second sketch."""
    draw = np.random.default_rng(dims)
    return np.hstack([draw.standard_normal((dims, tables * bits)), draw.standard_normal((dims, SKETCH))])


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, without overflow on the way."""
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def _narrow(bits: int) -> str:
    return "<u2" if bits <= 16 else "<u4" if bits <= 32 else "<u8"


def _sketch(vectors: DataFrame, how: SignHash, bits: int, tables: int, kind: str) -> DataFrame:
    """vec_id, label, digest, vector (bytes of ``kind``), codes (an integer for each table), sketch; the last four are null where a vector links with nothing."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.uint64)
        for part in slices(batches, 1024):
            ids, labels = part.column(0), part.column(1)
            columns: list[list] = [[], [], [], []]
            for vector, label in zip(part.column(2).to_pylist(), labels.to_pylist(), strict=True):
                x = np.array(vector, dtype=np.float64) if vector and label is not None and None not in vector else np.zeros(0)
                if not (len(x) and np.isfinite(x).all() and x.any()):
                    for c in columns:
                        c.append(None)
                    continue
                x = x + 0.0  # no negative zeros
                if len(x) not in planes:
                    planes[len(x)] = _hyperplanes(bits, tables, len(x))
                signs = (_unit(x) @ planes[len(x)]) >= 0
                codes = signs[: tables * bits].reshape(tables, bits).astype(np.uint64) @ weights
                for c, v in zip(columns, (xxhash.xxh3_128_digest(x.tobytes()), x.astype(kind).tobytes(), codes.astype(_narrow(bits)).tobytes(), np.packbits(signs[tables * bits :]).tobytes()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([ids, labels, *(pa.array(c, pa.binary()) for c in columns)], names=["vec_id", "label", "digest", "vector", "codes", "sketch"])

    return map_batches(vectors, run, "vec_id long, label long, digest binary, vector binary, codes binary, sketch binary")


def _spread(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node of each node's component in a small graph."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _bytes(column: pa.Array, kind: str, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(rows, -1)


def _first_equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first table in which codes are equal."""
    return (a == b).argmax(axis=1)


def _found(nodes: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    count = np.bincount(i, weights=copies[j], minlength=len(nodes)) + np.bincount(j, weights=copies[i], minlength=len(nodes))
    least = _spread(len(nodes), i, j)
    at = np.flatnonzero(count)
    return pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(count[at].astype(np.int64)), pa.array(nodes[least[at]])], names=["node", "links", "root"])


def _links(reps: DataFrame, how: SignHash, bits: int, tables: int, kind: str) -> DataFrame:
    """node, links (to vectors of other classes), root: counts of links by node, and edges (node, root) that span them."""
    code = _narrow(bits)
    width = np.dtype(kind).itemsize

    def buckets(batches):
        for part in slices(batches, 2048):
            codes = _bytes(part.column("codes"), code, part.num_rows)
            dims = [len(x) // width for x in part.column("vector").to_pylist()]
            labels = part.column("label").to_pylist()
            for t in range(tables):
                keys = [xxhash.xxh3_64_intdigest(b"%d,%d,%d,%d" % (t, label, d, c)) - (1 << 63) for label, d, c in zip(labels, dims, codes[:, t].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([t] * part.num_rows, pa.int32()), pa.array(keys, pa.int64()), part.column("sketch")], names=["node", "t", "bucket", "sketch"])

    posted = map_batches(reps.select("node", "label", "vector", "codes", "sketch"), buckets, "node long, t int, bucket long, sketch binary")
    sizes = posted.groupBy("t", "bucket").agg(F.count("*").alias("n")).where("n >= 2").withColumn("parts", F.ceil(F.col("n") / how.block).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), own.alias("own")))
    dealt = salted_join(posted, sizes, ["t", "bucket"], F.xxhash64("node"), reps.count() * tables).withColumn("block", F.explode(pairs))
    dealt = dealt.select("t", "bucket", F.col("block.i").cast("int").alias("bi"), F.col("block.j").cast("int").alias("bj"), F.col("block.own").cast("int").alias("own"), "node", "sketch")
    keys = ["t", "bucket", "bi", "bj"]
    most = how.most

    def meet(batches):
        """Pairs (node, other), or, of a block with many, its rows that have any (other is null)."""
        for (t, bucket, bi, bj), table in groups(batches, keys):
            n = table.num_rows
            if n < 2:
                continue
            part = table.column("own").to_numpy()
            left, right = np.flatnonzero(part == bi), np.flatnonzero(part == bj)
            s = _bytes(table.column("sketch"), "<u8", n)
            far = sum(np.bitwise_count(s[left, None, k] ^ s[None, right, k]).astype(np.int16) for k in range(s.shape[1])) if len(left) and len(right) else np.zeros((0, 0))
            i, j = np.nonzero(far <= most)
            i, j = left[i], right[j]
            if bi == bj:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            nodes = table.column("node").to_numpy()
            if len(i) <= FEW_PAIRS * n:
                a, b, who = nodes[i], pa.array(nodes[j]), np.zeros(len(i), dtype=np.int32)
            else:
                at = np.unique(np.concatenate([i, j]))
                a, b, who = nodes[at], pa.array([None] * len(at), pa.int64()), part[at].astype(np.int32)
            same = [pa.array(np.full(len(a), v), k) for v, k in ((t, pa.int32()), (bucket, pa.int64()), (bi, pa.int32()), (bj, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*same, pa.array(who), pa.array(a), b], names=[*keys, "own", "node", "other"])

    met = map_batches(dealt.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "own", "node", "sketch"), meet, "t int, bucket long, bi int, bj int, own int, node long, other long")
    met = materialize(met, "met")

    def compare(batches):
        for (t, _, bi, bj), table in groups(batches, keys):
            n = table.num_rows
            nodes, copies, labels, part = (table.column(c).to_numpy() for c in ("node", "copies", "label", "own"))
            x, codes = _unit(_bytes(table.column("vector"), kind, n).astype(np.float64)), _bytes(table.column("codes"), code, n)
            left, right = np.flatnonzero(part == bi), np.flatnonzero(part == bj)
            if not len(left) or not len(right):
                continue
            i, j = np.nonzero(x[left] @ x[right].T >= how.cosine)
            i, j = left[i], right[j]
            fine = (i < j if bi == bj else i >= 0) & (codes[i, t] == codes[j, t]) & (labels[i] == labels[j])
            i, j = i[fine], j[fine]
            for at in range(t):
                later = codes[i, at] != codes[j, at]
                i, j = i[later], j[later]
            if len(i):
                yield _found(nodes, copies, i, j)

    def verify(batches):
        for part in slices(batches, 4096):
            n = part.num_rows
            a, b, t = (part.column(c).to_numpy() for c in ("node", "other", "t"))
            lengths = np.array([len(v) for v in part.column("x").to_pylist()]), np.array([len(v) for v in part.column("y").to_pylist()])
            for size in np.unique(lengths[0]):  # vectors of one dimension at a time
                at = np.flatnonzero((lengths[0] == size) & (lengths[1] == size))
                rows = part.take(pa.array(at))
                x, y = (_unit(_bytes(rows.column(c), kind, len(at)).astype(np.float64)) for c in "xy")
                p, q = (_bytes(rows.column(c), code, len(at)) for c in "pq")
                fine = ((x * y).sum(axis=1) >= how.cosine) & (_first_equal(p, q) == t[at]) & (p[np.arange(len(at)), t[at]] == q[np.arange(len(at)), t[at]])
                fine &= rows.column("lx").to_numpy() == rows.column("ly").to_numpy()
                at, rows = at[fine], rows.take(pa.array(np.flatnonzero(fine)))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a[at], b[at]])), pa.array(np.concatenate([rows.column("cy").to_numpy(), rows.column("cx").to_numpy()])), pa.array(np.concatenate([b[at], b[at]]))], names=["node", "links", "root"])

    schema = "node long, links long, root long"
    columns = [*keys, "own", "node", "vector", "codes", "copies", "label"]
    dense = met.where("other is null").drop("other").join(reps.select("node", "vector", "codes", "copies", "label"), "node")
    dense = map_batches(dense.repartition(*keys).sortWithinPartitions(*keys).select(*columns), compare, schema)
    # the first table in which a pair was met; it counts if no earlier one has it in a block with many
    sparse = met.where("other is not null").select(F.least("node", "other").alias("node"), F.greatest("node", "other").alias("other"), "t").groupBy("node", "other").agg(F.min("t").alias("t"))
    for node, letters in (("node", ("x", "p", "cx", "lx")), ("other", ("y", "q", "cy", "ly"))):
        sparse = sparse.join(reps.select(F.col("node").alias(node), *(F.col(c).alias(n) for c, n in zip(("vector", "codes", "copies", "label"), letters, strict=True))), node)
    return dense.unionByName(map_batches(sparse.select("node", "other", "t", "x", "p", "cx", "lx", "y", "q", "cy", "ly"), verify, schema))


def near_duplicates(embeddings: DataFrame, how: SignHash = SignHash(), key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``embeddings``.

    Vectors are compared within a label and a dimension. A vector that is null, empty, zero or holds
    null or non-finite components, or has no label or no id, links with nothing; a row without an id
    has no component and is kept. Rows that repeat an id are one vector. Equal vectors link with
    each other, however many there are. Lengths do not matter, a vector's scale does not either.
    """
    kind = "<f4" if isinstance(embeddings.schema[vector].dataType, ArrayType) and isinstance(embeddings.schema[vector].dataType.elementType, FloatType) else "<f8"
    plain = embeddings.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("embedding"))
    largest = plain.where("label is not null").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits = how.bits(largest)
    tables = how.tables(bits)
    sketches = materialize(_sketch(plain, how, bits, tables, kind), "sketches")
    usable = sketches.where("vec_id is not null and digest is not null")
    distinct = usable.select("vec_id", "label", "digest").distinct()
    classes = materialize(distinct.groupBy("label", "digest").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "classes")
    reps = usable.join(classes.withColumn("vec_id", F.col("node")), ["label", "digest", "vec_id"]).select("node", "label", "digest", "vector", "codes", "sketch", "copies").dropDuplicates(["node", "label", "digest"])
    reps = materialize(reps.drop("digest"), "representatives")
    found = materialize(_links(reps, how, bits, tables, kind), "found")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    many = classes.where("copies >= 2").join(counts, "node", "left").select("label", "digest", "node", "copies", "links", F.col("copies").alias("n"))
    salted = salted_join(distinct, many, ["label", "digest"], F.xxhash64("vec_id"), sketches.count())
    copies = salted.where("vec_id <> node").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    edges = found.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b").unionAll(copies)
    joined = components(edges, "a", "b", "links").withColumnRenamed("node", "vec_id")
    degree = salted.select("vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n")).unionAll(counts.join(classes.where("copies = 1").select("node"), "node", "left_semi").select(F.col("node").alias("vec_id"), F.col("links").alias("n")))
    degree = degree.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    # rows without an id meet nothing, and would all go to one task
    named = sketches.where("vec_id is not null").select("vec_id").join(degree, "vec_id", "left").join(joined, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    out = named.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
    none = F.lit(None).cast("long")
    return out.unionByName(sketches.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), none.alias("component_id"), F.lit(True).alias("kept")))
