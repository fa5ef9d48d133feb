"""Settings by name and type, and named sections that are timed and shown with Spark's jobs."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import time
import uuid
from collections import defaultdict

from weft.errors import BadLogic

UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}


def memory(text: str) -> int:
    """Bytes of "4MB" and the like."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([a-zA-Z]*)\s*", text)
    if not m or m[2].lower() not in UNITS:
        raise BadLogic(f"not a size: {text!r}")
    return int(float(m[1]) * UNITS[m[2].lower()])


class Settings:
    """A map for each type; an unset name gives the type's zero or the default."""

    KINDS = {"str": "", "int": 0, "float": 0.0, "bool": False}

    def __init__(self):
        self._held: dict[str, dict] = {k: {} for k in self.KINDS}

    def set(self, name: str, value) -> None:
        kind = type(value).__name__
        if kind not in self.KINDS:
            raise BadLogic(f"settings are {', '.join(self.KINDS)}, not {kind}")
        self._held[kind][name] = value

    def get(self, name: str, kind: type = str, default=None):
        return self._held[kind.__name__].get(name, self.KINDS[kind.__name__] if default is None else default)


settings = Settings()


def scratch(spark, label: str) -> str:
    """A new folder name for files of the engine's own: under the setting "scratch-dir", else under spark.checkpoint.dir, which
    all executors share. Only a local session may have neither; its folder goes with the process unless "keep-files" is set."""
    root = settings.get("scratch-dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise BadLogic("set spark.checkpoint.dir or scratch-dir to a folder that all executors share")
        held = tempfile.mkdtemp(prefix="weft-")
        if not settings.get("keep-files", bool):
            atexit.register(shutil.rmtree, held, ignore_errors=True)
        root = f"file://{held}"
    return f"{root.rstrip('/')}/{settings.get('file-name', default='weft')}-{label}-{uuid.uuid4().hex}"


def forget(spark, path: str) -> None:
    """Deletes a folder that ``scratch`` named and nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: Seconds and calls of each section.
sections: dict[str, list] = defaultdict(lambda: [0.0, 0])


@contextlib.contextmanager
def labeled_section(spark, name: str):
    """Jobs inside carry the name in Spark's UI and event log; the wall time adds to ``sections``."""
    began = time.perf_counter()
    before = spark.sparkContext.getLocalProperty("spark.job.description")
    spark.sparkContext.setJobDescription(name)
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty("spark.job.description", before)
        sections[name][0] += time.perf_counter() - began
        sections[name][1] += 1
