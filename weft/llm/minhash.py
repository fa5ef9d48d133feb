"""MinHash near-dedup by an inverted join on signature coordinates.

1.  A document's word shingles are hashed to a set; equal sets form a class, and one
    representative of each class goes on.
2.  Its signature has one value for each of K coordinates. Two sets of similarity s agree in
    Binomial(K, s) coordinates; the match threshold T is the largest that misses a pair of the
    sought similarity with a chance of at most ``miss``.
3.  Documents are posted under (coordinate, value). Values that only one document has are
    skipped. A pair with T matches shares at least one of each side's K - T + 1 rarest
    coordinates (prefix), so only those are posted; the long lists are skipped in the merge and
    serve only to count matches between documents that met in a short one.
4.  In each list, in blocks of bounded size, collisions are counted over whole signatures and
    pairs with T or more are kept, as a spanning forest of them: their components, the
    candidate clusters, contain every link that the pairs could show.
5.  In each cluster, again in blocks, links are confirmed on the full shingle sets. A search
    from document to document reaches each component without listing all pairs.
    A list or cluster of several blocks sends its first document to all of them; what a block
    ties to that one is done, and only the rest goes to the other blocks.
6.  Distributed connected components join what the blocks found.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.arrow import as_bytes, groups, key_and_text, map_batches, slices
from weft.llm.components import components, salted_join
from weft.llm.storage import materialize


@dataclass(frozen=True)
class MinHash:
    words: int = 5
    #: Least similarity as a fraction, 85 / 100 and the like: the comparison is exact in integers.
    numerator: int = 80
    denominator: int = 100
    coordinates: int = 64
    miss: float = 1e-4
    #: Documents of a block of a posting list, and documents and shingles of a block of a cluster.
    list_block: int = 1024
    cluster_block: int = 1024
    block_shingles: int = 1_500_000

    @property
    def matches(self) -> int:
        k, s, total = self.coordinates, self.numerator / self.denominator, 0.0
        for t in range(k + 1):
            total += math.comb(k, t) * s**t * (1 - s) ** (k - t)
            if total > self.miss:
                return t
        return k


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles. A-Z are lower-cased; with fewer words the whole sequence is one shingle; without words, none."""
    found = text.lower().split()
    n = len(found)
    if not n:
        return np.empty(0, dtype=np.uint64)
    if n < words:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(found), seed=n)], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=n)
    mixed = np.zeros(n - words + 1, dtype=np.uint64)
    for k in range(words):
        mixed = (mixed ^ h[k : n - words + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.random.default_rng(20_240_607).integers(0, 2**63, size=(2, k), dtype=np.uint64)
    return x[0] * np.uint64(2) + np.uint64(1), x[1]


def signature(members: np.ndarray, factors: np.ndarray, flips: np.ndarray) -> np.ndarray:
    out = np.empty(len(factors), dtype=np.uint32)
    for k in range(len(factors)):
        out[k] = (((members ^ flips[k]) * factors[k]) >> np.uint64(32)).min()
    return out


def _sketch(documents: DataFrame, how: MinHash) -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature; both null for an empty set."""
    words, k = how.words, how.coordinates

    def run(batches):
        factors, flips = _coefficients(k)
        for part in slices(batches):
            n, digests, signatures = [], [], []
            for text in as_bytes(part.column(1)):
                s = shingles(text, words)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signatures.append(signature(s, factors, flips).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "n_shingles", "digest", "signature"])

    return map_batches(documents, run, "doc_id long, n_shingles long, digest binary, signature binary")


def _reach(n: int, near) -> list[tuple[int, int]]:
    """Spanning forest of n nodes; near(i, rest) tells which of ``rest`` are linked with i. Each node is compared only with those not reached yet."""
    rest = np.arange(n)
    out = []
    while len(rest):
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            if hit.any():
                found = rest[hit]
                out += [(int(root), int(j)) for j in found]
                queue += found.tolist()
                rest = rest[~hit]
    return out


def _emit(found, key: str, at_once: int = 20_000):
    """Rows (key, a, b) in batches."""

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[key, "a", "b"])

    held: list[tuple] = []
    for rows in found:
        held += rows
        if len(held) >= at_once:
            yield batch(held)
            held = []
    if held:
        yield batch(held)


def _dealt(rows: DataFrame, key: str, sizes: DataFrame, total: int) -> DataFrame:
    """``rows`` (key, node) of groups of two or more, with parts, first and part. ``sizes``: key, n (rows), parts, first (a node)."""
    found = salted_join(rows, sizes.where("n >= 2").select(key, "n", "parts", "first"), [key], F.xxhash64("node"), total)
    return found.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))


def _spanned(dealt: DataFrame, key: str, sizes: DataFrame, total: int, payload: list[str], linker) -> DataFrame:
    """Edges (a, b) that span the components of the links within each group.

    ``dealt``: from _dealt, with ``payload``. ``linker`` makes the test for _reach from a table. A group of several parts is
    dealt to as many tasks, and its first node's row to all of them. What a part ties to the first node is done: it meets
    other parts only through rows that are not tied to it, which are sent to every part, in blocks as large as a part. So a
    group of copies of one text moves about once, whatever its size, and no task holds more than two parts' rows.
    """
    columns = ["node", *payload]

    def grouped(df: DataFrame) -> DataFrame:
        return df.repartition(key, "part").sortWithinPartitions(key, "part").select(key, "part", "first", "own", *columns)

    def forest(batches, rest: bool):
        def each():
            for (k, _), table in groups(batches, [key, "part"]):
                nodes = table.column("node").to_pylist()
                pairs = _reach(len(nodes), linker(table)) if len(nodes) > 1 else []
                yield [(k, nodes[i], nodes[j]) for i, j in pairs if nodes[i] != nodes[j]]
                if rest:
                    first = table.column("first")[0].as_py()
                    root = {j: i for i, j in pairs}  # all edges of a tree start at its root
                    done = {root.get(i, i) for i, x in enumerate(nodes) if x == first}
                    own = table.column("own").to_pylist()
                    yield [(k, x, None) for i, x in enumerate(nodes) if own[i] and root.get(i, i) not in done]

        yield from _emit(each(), key)

    schema = f"{key} long, a long, b long"
    edges = map_batches(grouped(dealt.where("parts = 1").withColumn("own", F.lit(True))), lambda batches: forest(batches, False), schema)
    if not sizes.where("parts > 1").take(1):
        return edges.select("a", "b").distinct()
    many = materialize(dealt.where("parts > 1"), "parted")
    mine = many.withColumn("own", F.lit(True))

    def elsewhere(df: DataFrame) -> DataFrame:
        """A row for each part but the one that has it."""
        moved = df.withColumn("home", F.col("part")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return moved.where("part <> home").drop("home").withColumn("own", F.lit(False))

    first = materialize(map_batches(grouped(mine.unionByName(elsewhere(many.where("node = first")))), lambda batches: forest(batches, True), schema), "first")
    left = first.where("b is null").select(key, F.col("a").alias("node")).distinct()
    # the rest of a group meets its parts in blocks as large as a part; groups that are done are not read again
    rest = left.groupBy(key).agg(F.count("*").alias("m")).join(sizes.select(key, "n", F.col("parts").alias("p")), key)
    rest = rest.select(key, "n", F.ceil(F.col("m") * F.col("p") / F.col("n")).cast("int").alias("blocks"))
    block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    still = salted_join(mine, rest, [key], F.xxhash64("node"), total).withColumn("block", block)
    moved = elsewhere(salted_join(many.join(left, [key, "node"]), rest, [key], F.xxhash64("node"), total)).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    open_ = still.unionByName(moved).withColumn("part", F.col("part").cast("long") * F.col("blocks") + F.col("block"))
    last = map_batches(grouped(open_), lambda batches: forest(batches, False), schema)
    return edges.unionByName(first.where("b is not null")).unionByName(last).select("a", "b").distinct()


def _signatures(table: pa.Table, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype=np.uint32).reshape(-1, k)


def _candidates(reps: DataFrame, how: MinHash) -> DataFrame:
    """Edges (a, b) that span the components of pairs with ``how.matches`` matches or more. ``reps``: node, signature."""
    k, t = how.coordinates, how.matches
    total = reps.count() * k

    def explode(batches):
        for part in slices(batches, 4096):
            s = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint32).reshape(-1, k).astype(np.uint64)
            tokens = (np.arange(k, dtype=np.uint64) << np.uint64(32)) + s
            nodes = np.repeat(np.array(part.column(0).to_pylist(), dtype=np.int64), k)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(tokens.astype(np.int64).ravel())], names=["node", "token"])

    posted = map_batches(reps, explode, "node long, token long")
    frequent = posted.groupBy("token").agg(F.count("*").alias("n")).where("n >= 2").withColumn("held", F.col("n"))
    # values with one holder are not posted: a document with fewer than t others cannot reach t matches
    common = salted_join(posted, frequent, ["token"], F.xxhash64("node"), total).withColumnRenamed("held", "n")
    shared = common.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("lists")).where(F.size("lists") >= t)
    prefix = shared.select("node", F.explode(F.slice("lists", F.lit(1), F.size("lists") - (t - 1))).alias("x")).select("node", F.col("x.token").alias("token"))
    prefix = materialize(prefix, "postings")
    sizes = materialize(prefix.groupBy("token").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n >= 2").withColumn("parts", F.ceil(F.col("n") / how.list_block).cast("int")), "lists")
    listed = _dealt(prefix, "token", sizes, total).join(reps, "node")

    def linker(table: pa.Table):
        s = _signatures(table, k)
        return lambda i, rest: (s[rest] == s[i]).sum(axis=1) >= t

    return _spanned(listed, "token", sizes, total, ["signature"], linker)


def _confirmed(documents: DataFrame, clusters: DataFrame, reps: DataFrame, how: MinHash) -> DataFrame:
    """Edges (a, b) that span the components of confirmed links. ``clusters``: node, component."""
    words, k, t, num, den = how.words, how.coordinates, how.matches, how.numerator, how.denominator
    wanted = reps.join(clusters, "node")
    sizes = wanted.groupBy("component").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.greatest(F.ceil(F.count("*") / how.cluster_block), F.ceil(F.sum("n_shingles") / how.block_shingles)).cast("int").alias("parts"))
    sizes = materialize(sizes, "clusters")
    placed = _dealt(wanted.select("node", "component", "signature"), "component", sizes, sizes.agg(F.sum("n")).first()[0] or 0)
    texts = documents.withColumnRenamed("doc_id", "node").join(placed, "node")
    plain = ["node", "component", "parts", "first", "part", "signature"]

    def run(batches):
        for part in slices(batches):
            sets = [shingles(x, words).tobytes() for x in as_bytes(part.column("text"))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in plain), pa.array(sets, pa.binary())], names=[*plain, "members"])

    full = materialize(map_batches(texts.select(*plain, "text"), run, "node long, component long, parts int, first long, part int, signature binary, members binary"), "members")

    def linker(table: pa.Table):
        s = _signatures(table, k)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("members").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        values, places = np.unique(np.concatenate(sets), return_inverse=True)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        sets = [places[edges[i] : edges[i + 1]] for i in range(len(sets))]
        mark = np.zeros(len(values), dtype=bool)

        def near(i, rest):
            hit = (s[rest] == s[i]).sum(axis=1) >= t
            at = np.flatnonzero(hit)
            if len(at):
                mark[sets[i]] = True
                both = np.array([np.count_nonzero(mark[sets[j]]) for j in rest[at]])
                mark[sets[i]] = False
                hit[at] = den * both >= num * (sizes[i] + sizes[rest[at]] - both)
            return hit

        return near

    return _spanned(full, "component", sizes, full.count(), ["signature", "members"], linker)


def near_duplicates(documents: DataFrame, how: MinHash = MinHash(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable, itself included), kept (doc_id = component_id): one row per row.

    A null or empty text has no shingles and links with nothing. A row without an id links with
    nothing either, has no component and is kept. Rows that repeat an id are one document: they
    get the same component, reached through any of their texts. Equal sets are linked, however
    many there are. An empty table gives none; other columns are not read.
    """
    plain = key_and_text(documents, key, text)
    sketches = materialize(_sketch(plain, how), "sketches")
    # equal sets, and rows that repeat an id, meet through the least id of the set
    holders = sketches.where("doc_id is not null and digest is not null")
    classes = materialize(holders.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "classes")
    reps = holders.join(classes.select("digest", F.col("node").alias("doc_id")), ["digest", "doc_id"]).select(F.col("doc_id").alias("node"), "signature", "n_shingles").dropDuplicates(["node", "signature"])
    reps = materialize(reps, "representatives")
    candidates = _candidates(reps.select("node", "signature"), how)
    clusters = components(candidates, "a", "b", "clusters")
    confirmed = _confirmed(plain, clusters, reps, how)
    copies = salted_join(holders.select("digest", "doc_id"), classes.where("n >= 2"), ["digest"], F.xxhash64("doc_id"), holders.count())
    copies = copies.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = components(confirmed.unionAll(copies), "a", "b", "links")
    # rows without an id meet nothing, and would all go to one task
    named = sketches.where("doc_id is not null").select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    out = named.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    return out.unionByName(sketches.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))


def filter_rows(documents: DataFrame, how: MinHash = MinHash(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``documents``, all columns as they are, that stay: one document of each group, the one with the least id.

    Of rows that repeat an id, the one with the least text stays (null first; of equal texts, any of equal rows). Rows without
    an id stay; so do null and empty texts, which link with nothing. An empty table gives none.
    """
    kept = near_duplicates(documents, how, key, text).where("kept and doc_id is not null").select(F.col("doc_id").alias(key)).distinct()
    found = documents.where(F.col(key).isNotNull()).join(kept, key, "left_semi")
    order = Window.partitionBy(key).orderBy(F.col(text).asc_nulls_first(), F.xxhash64(*documents.columns))
    place = "place_" + "_" * max(map(len, documents.columns))  # no column has this name
    first = found.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return first.select(documents.columns).unionAll(documents.where(F.col(key).isNull()))
