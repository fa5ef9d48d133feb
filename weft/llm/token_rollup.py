"""Token counts as a rollup that deltas maintain.

Totals by source, language and tokenizer version are sums of signed deltas: an insert adds a
document and its tokens, a delete takes them away, a revision adds the difference of the new
count and the old one. A batch of changes is summed by key before it is written, so the store
grows with batches and keys, not with documents. Each attempt at a batch writes a folder of its
own; the batch counts when a marker that names the attempt is there, and that file is created
only if it is not there yet, so that of several writers one wins and the others change nothing.
A batch that is committed again changes nothing either; one that broke off is written anew.
Now and then the batches so far are summed to a snapshot, so that totals read few files.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.arrow import as_bytes, map_batches, sized
from weft.llm.storage import materialize
from weft.llm.tokenize import encoder, read_vocabulary

KEYS = ["source", "lang", "tokenizer_version"]
_SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
_MARK = "_COMMITTED"


def inserts(counts: DataFrame) -> DataFrame:
    """Changes that add documents. ``counts``: the keys and n_tokens, one row per document. Null keys are keys of their own, a
    null count is zero, repeated rows count as often as they are there; other columns are not read. So for the others below."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Changes that take documents away, with the counts that they were added with."""
    return inserts(counts).select(*KEYS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(counts: DataFrame) -> DataFrame:
    """``counts`` also has old_n_tokens, the count that holds so far."""
    return counts.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), (F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)) - F.coalesce(F.col("old_n_tokens").cast("long"), F.lit(0))).alias("n_tokens"))


def _sum(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))


class Rollup:
    """A store under ``path``, on any file system that Spark writes to and that creates a file only once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path, jvm.org.apache.hadoop.fs.Path

    def _claim(self, folder: str, what: dict) -> bool:
        """Make the marker of a folder, unless it is there."""
        system, _, make = self._files()
        try:
            out = system.create(make(f"{folder}/{_MARK}"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        return True

    def _marked(self, prefix: str) -> dict[str, dict]:
        """Name and marker of each folder that has one."""
        system, path, make = self._files()
        if not system.exists(path):
            return {}
        names = [x.getPath().getName() for x in system.listStatus(path) if x.isDirectory()]
        marks = [x for x in names if x.startswith(prefix) and system.exists(make(f"{self.path}/{x}/{_MARK}"))]
        found = {}
        for x in marks:
            stream = self.spark._jvm.org.apache.commons.io.IOUtils
            opened = system.open(make(f"{self.path}/{x}/{_MARK}"))
            found[unquote(x.removeprefix(prefix))] = json.loads(stream.toString(opened, "UTF-8"))
            opened.close()
        return found

    def committed(self) -> list[str]:
        """Ids of the batches that count."""
        return sorted(self._marked("batch="))

    def _folder(self, batch: str) -> str:
        return f"{self.path}/batch={quote(batch, safe='')}"

    def _write(self, changes: DataFrame, folder: str, **more) -> bool:
        attempt = uuid.uuid4().hex
        _sum(changes).write.parquet(f"{folder}/{attempt}")
        return self._claim(folder, {"attempt": attempt, **more})

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """False if the batch was committed before, or by another writer meanwhile; then nothing changes. Hot keys are summed where they are read first."""
        if batch in self._marked("batch="):
            return False
        return self._write(changes, self._folder(batch))

    def _parts(self) -> list[str]:
        """Folders to read: the last snapshot, and the batches that it does not hold."""
        batches, snapshots = self._marked("batch="), self._marked("snapshot=")
        last = max(snapshots, key=int) if snapshots else None
        held = set(snapshots[last]["batches"]) if last is not None else set()
        out = [f"{self.path}/snapshot={last}/{snapshots[last]['attempt']}"] if last is not None else []
        return out + [f"{self._folder(x)}/{m['attempt']}" for x, m in sorted(batches.items()) if x not in held]

    def compact(self) -> bool:
        """Sum what is committed to a snapshot. False if another writer made it first. Batches keep their markers."""
        batches, snapshots = self.committed(), self._marked("snapshot=")
        number = 1 + max(map(int, snapshots), default=-1)
        return self._write(self._read(), f"{self.path}/snapshot={number}", batches=batches)

    def _read(self) -> DataFrame:
        parts = self._parts()
        return self.spark.read.schema(_SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], _SCHEMA)

    def totals(self) -> DataFrame:
        """Keys, n_docs, n_tokens: sums over all committed batches. A key whose documents are all gone is left out."""
        return _sum(self._read()).where("n_docs <> 0 or n_tokens <> 0")


#: Tokens by rule: what SQL engines agree on.
RULES = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "pieces-1": r"[0-9A-Za-z]+|[^0-9A-Za-z\x20\x09-\x0D]",
}


def by_rule(text: Column, rule: str) -> Column:
    """Tokens of whole texts; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(RULES[rule])), F.lit(0)).cast("long")


def _by_rules(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    words = by_rule(text, "words-1")
    estimate = F.floor(F.coalesce(F.length(text), F.lit(0)) / 4).cast("long")
    return documents.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), words.alias("words"), words.alias("first_0"), words.alias("exact_0"), estimate.alias("first_1"), by_rule(text, "pieces-1").alias("exact_1"))


def _by_vocabularies(documents: DataFrame, paths: list[str]) -> DataFrame:
    """Counts of whole texts in each vocabulary, by the library's ids; each text is read once."""
    shipped = documents.sparkSession.sparkContext.broadcast([read_vocabulary(p) for p in paths])
    names = [f"exact_{k}" for k in range(len(paths))]

    def run(batches):
        coders = [encoder(v) for v in shipped.value]
        for part in sized(batches, 2):
            texts = as_bytes(part.column(2))
            counts = [np.diff(c.arrays(texts)[1], prepend=0) for c in coders]
            words = [len(x.split()) for x in texts]
            guess = [len(x.decode()) // 4 for x in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words, pa.int64()), pa.array(guess, pa.int64()), *map(pa.array, counts)], names=["source", "lang", "words", "guess", *names])

    plain = documents.select(*(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")))
    found = map_batches(plain, run, "source string, lang string, words long, guess long, " + ", ".join(f"{n} long" for n in names))
    return found.select("*", F.col("exact_0").alias("first_0"), *(F.col("guess").alias(f"first_{k}") for k in range(1, len(paths))))


def maintain(documents: DataFrame, path: str, short: int = 20, back: bool = False, vocabularies: dict[str, str] | None = None) -> DataFrame:
    """Load a table, take short documents out, and put exact counts where estimates stood; each batch comes twice.

    ``vocabularies``: tokenizer versions and the files that they count by; without, the versions are the two rules. Batches:
    ``load`` inserts every document under the first version (exact) and the others (estimated as a fourth of its
    characters); ``short`` deletes the documents of fewer than ``short`` words under all; ``exact`` revises the rest of
    the others. With ``back`` a last batch of that name inserts the short documents again, with exact counts: the totals
    then cover every row. Null sources and languages are keys of their own, a null text has no tokens, repeated rows count
    as often as they are there, an empty table gives no keys, and other columns are not read.
    """
    versions = list(vocabularies or RULES)
    # texts are read once, what is kept is a row of numbers per document
    own = materialize(_by_vocabularies(documents, list(vocabularies.values())) if vocabularies else _by_rules(documents), "counts")

    def under(rows: DataFrame, column: str, some: range, **more) -> DataFrame:
        one = [rows.select("source", "lang", F.lit(versions[k]).alias("tokenizer_version"), F.col(f"{column}_{k}").alias("n_tokens"), *(F.col(f"{v}_{k}").alias(n) for n, v in more.items())) for k in some]
        out = one[0]
        for x in one[1:]:
            out = out.unionAll(x)
        return out

    every, later = range(len(versions)), range(1, len(versions))
    gone, rest = own.where(F.col("words") < short), own.where(F.col("words") >= short)
    store = Rollup(documents.sparkSession, path)
    batches = {"load": inserts(under(own, "first", every)), "short": deletes(under(gone, "first", every))}
    if later:
        batches["exact"] = revisions(under(rest, "exact", later, old_n_tokens="first"))
    if back:
        batches["back"] = inserts(under(gone, "exact", every))
    for _ in range(2):
        for name, changes in batches.items():
            store.commit(name, changes)
    return store.totals()
