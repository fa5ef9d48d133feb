"""Tensors on disk: a folder of Parquet rows and their dimensions. Windows are read through pushed-down filters on the index columns."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weft.errors import AccessDenied, DimensionError, Uninitialized
from weft.functions.scalars import DTYPES
from weft.operators.shape import resize
from weft.plans.contraction import einsum
from weft.tensor import Tensor, index_columns


class DiskTensor:
    """``path``/``name``: opened if it is there, else created empty. Each write makes a new version folder and then points to it,
    so that readers of the old one, this tensor's own update among them, are not disturbed. A window is written by itself, as a
    layer that hides what lies under it; ``MOST_LAYERS`` of them are then written anew as one."""

    MOST_LAYERS = 16

    def __init__(self, spark: SparkSession, path: str, name: str, dims: Sequence[int] | None = None, dtype: str = "float64", compression: str | None = None):
        self.spark, self.root, self.name = spark, f"{path.rstrip('/')}/{name}", name
        self._held: Tensor | None = None
        self._read_only = False
        meta = self._meta()
        self._existed = meta is not None
        if meta is None:
            if dims is None:
                raise Uninitialized(f"{self.root} is not there, and no dimensions were given")
            meta = {"dims": list(dims), "dtype": dtype, "compression": compression or ("gzip" if _size(dims) > 1 << 32 else "snappy"), "version": -1, "layers": []}
            self._save(meta)
        elif dims is not None and tuple(dims) != tuple(meta["dims"]):
            raise DimensionError(f"{self.root} has {meta['dims']}, not {list(dims)}")

    def _system(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _meta(self) -> dict | None:
        system, path = self._system()
        if not system.exists(path(self.root)):
            return None
        found = sorted((x.getPath().getName() for x in system.listStatus(path(self.root)) if x.getPath().getName().startswith("meta-")), reverse=True)
        if not found:
            return None
        return json.loads(self.spark.read.text(f"{self.root}/{found[0]}", wholetext=True).first()[0])

    def _save(self, meta: dict) -> None:
        system, path = self._system()
        n = 0
        if system.exists(path(self.root)):
            n = 1 + max((int(x.getPath().getName()[5:]) for x in system.listStatus(path(self.root)) if x.getPath().getName().startswith("meta-")), default=-1)
        out = system.create(path(f"{self.root}/_tmp-{n:09d}"), True)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        system.rename(path(f"{self.root}/_tmp-{n:09d}"), path(f"{self.root}/meta-{n:09d}"))

    @property
    def dims(self) -> tuple[int, ...]:
        return tuple(self._meta()["dims"])

    @property
    def dtype(self) -> str:
        return self._meta()["dtype"]

    def existed(self) -> bool:
        return self._existed

    def set_read_only(self, on: bool = True) -> None:
        self._read_only = on

    def tensor(self) -> Tensor:
        """What is stored, lazily."""
        meta = self._meta()
        dims, rank = tuple(meta["dims"]), len(meta["dims"])
        schema = ", ".join([*(f"{c} bigint" for c in index_columns(rank)), f"v {DTYPES[meta['dtype']][0]}"])
        names = index_columns(rank)
        layers = meta["layers"]
        df = None
        for k, (version, _) in enumerate(layers):
            own = self.spark.read.schema(schema).parquet(f"{self.root}/v{version}")
            for _, window in layers[k + 1 :]:
                inside = F.lit(True)
                for c, (low, high) in zip(names, window, strict=True):
                    inside = inside & (F.col(c) >= low) & (F.col(c) < high)
                own = own.where(~inside)
            df = own if df is None else df.unionByName(own)
        return Tensor(df if df is not None else self.spark.createDataFrame([], schema), dims, meta["dtype"], self.name)

    def _put(self, t: Tensor, meta: dict, window: list | None) -> None:
        version = meta["version"] + 1
        df = t.cast(meta["dtype"]).df
        (df.sortWithinPartitions(*t.columns) if t.rank else df).write.mode("overwrite").option("compression", meta["compression"]).parquet(f"{self.root}/v{version}")
        layers = [*(meta["layers"] if window is not None else []), [version, window or []]]
        self._save(meta | {"version": version, "layers": layers, "dims": list(t.dims) if window is None else meta["dims"]})

    def _writable(self) -> dict:
        if self._read_only:
            raise AccessDenied(f"{self.root} is read-only")
        return self._meta()

    def write(self, t: Tensor) -> None:
        """Replace everything. Rows are sorted by their first index within files, so that windows skip row groups."""
        meta = self._writable()
        if t.dims != tuple(meta["dims"]):
            raise DimensionError(f"{t.dims} into {meta['dims']}")
        self._put(t, meta, None)

    def __getitem__(self, parts) -> Tensor:
        return self.tensor()[parts]

    def write_view(self, parts: Sequence[int | slice], value: Tensor | float) -> None:
        """Replace a window. What is written is the window."""
        meta = self._writable()
        dims = tuple(meta["dims"])
        empty = Tensor(self.tensor().df.limit(0), dims, meta["dtype"])
        if not meta["layers"] or not dims or len(meta["layers"]) >= self.MOST_LAYERS:
            self._put(self.tensor().assign(parts, value), meta, None)
        else:
            self._put(empty.assign(parts, value), meta, [list(x) for x in empty.window(parts)])

    def add_view(self, parts: Sequence[int | slice], value: Tensor | float) -> None:
        """Add to a window."""
        self.write_view(parts, self.tensor().view(*parts) + value)

    def contract(self, spec: str, *tensors: Tensor | DiskTensor, alpha=1.0, beta=0.0) -> None:
        """beta times what is stored plus alpha times the contraction, written back."""
        self._writable()
        held = [t.tensor() if isinstance(t, DiskTensor) else t for t in tensors]
        self.write(einsum(spec, *held, previous=self.tensor(), alpha=alpha, beta=beta))

    def get(self) -> Tensor:
        """Held in executors' memory until put or unget."""
        if self._held is None:
            self._held = self.tensor().cache()
        return self._held

    def get_update(self) -> Tensor:
        self.unget()
        return self.get()

    def put(self, t: Tensor | None = None) -> None:
        if t is None and self._held is None:
            raise Uninitialized("nothing was got")
        self.write(t if t is not None else self._held)
        self.unget()

    def unget(self) -> None:
        if self._held is not None:
            self._held.df.unpersist()
            self._held = None

    def resize(self, *dims: int) -> None:
        """Other dimensions. Cells beyond smaller ones are gone for good: the rest is written anew."""
        meta = self._writable()
        if len(dims) != len(meta["dims"]):
            raise DimensionError(f"{dims} for {meta['dims']}")
        if meta["layers"] and any(n < m for n, m in zip(dims, meta["dims"], strict=True)):
            self._put(resize(self.tensor(), *dims), meta, None)
        else:
            self._save(meta | {"dims": list(dims)})

    def unlink(self) -> None:
        """Delete it all."""
        self._writable()
        self.unget()
        system, path = self._system()
        system.delete(path(self.root), True)


def _size(dims: Sequence[int]) -> int:
    n = 1
    for d in dims:
        n *= d
    return n


def create_disk_tensor(spark: SparkSession, path: str, name: str, dims: Sequence[int], dtype: str = "float64") -> DiskTensor:
    return DiskTensor(spark, path, name, dims, dtype)


def create_disk_tensor_like(t: Tensor, path: str, name: str) -> DiskTensor:
    return DiskTensor(t.spark, path, name, t.dims, t.dtype)
