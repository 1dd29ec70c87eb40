"""Shared plumbing: text columns as byte batches, and lineage that survives lost executors."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes and rows that one step of a Python kernel holds at once.
SLICE_BYTES = 8 << 20
SLICE_ROWS = 4096

_PATH = "_basinforge_kept_at"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, ``spark.checkpoint.dir``; only a session on one machine that names none gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame, packed: bool = False) -> DataFrame:
    """``df`` computed once and kept as a table in the shared checkpoint folder, so that a lost executor costs no more than this step.

    ``packed``: its columns are compressed already.
    """
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4()}"
    df.write.parquet(path, compression="uncompressed" if packed else None)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__[_PATH] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what ``checkpointed`` has kept, once nothing reads it any more."""
    for df in tables:
        if path := df.__dict__.pop(_PATH, None):
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def text_bytes(df: DataFrame, text_col: str) -> Column:
    """The whole text as UTF-8 bytes; a null text is empty."""
    return F.coalesce(df[text_col].cast("string"), F.lit("")).cast("binary")


def crc_bucket(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


_held: dict[tuple, object] = {}


def held(kind: str, key: str, make: Callable[[], object]) -> object:
    """What a kernel keeps in its worker from task to task; a worker holds one such thing at a time."""
    if (kind, key) not in _held:
        _held.clear()
        _held[kind, key] = make()
    return _held[kind, key]


def release() -> None:
    """Frees what another kernel left in the worker."""
    _held.clear()


class Recent:
    """What a kernel has worked out for keys, in two generations: what is still asked for outlives a full store."""

    def __init__(self, most: int, longest: int = 64):
        self.most, self.longest = most, longest
        self._young: dict = {}
        self._old: dict = {}

    def get_all(self, keys: list) -> list:
        """The value of each key, None where it isn't kept."""
        young = list(map(self._young.get, keys))
        if not self._old:
            return young
        return [self._old.get(k) if v is None else v for k, v in zip(keys, young)]

    def keep(self, keys: Iterable, values: Iterable) -> None:
        """Keeps them at least until as many others as a generation holds have come; long keys aren't kept."""
        self._young.update((k, v) for k, v in zip(keys, values) if len(k) <= self.longest)
        if len(self._young) >= self.most:
            self._old, self._young = self._young, {}


def utf8(column: pa.Array) -> pa.Array:
    """A binary column as text; what is not UTF-8 is replaced, a null is empty."""
    try:
        out = column.cast(pa.large_string())
    except pa.ArrowInvalid:
        out = pa.array([x if x is None else x.decode("utf-8", "replace") for x in column.to_pylist()], pa.large_string())
    return pc.fill_null(out, "")


def tidied(kernel: Callable) -> Callable:
    """A kernel (of batches, or of one table) whose worker gives free memory back to the machine at its end.

    Workers outlive tasks and run one kernel after another; what each has freed would add up.
    """
    if inspect.isgeneratorfunction(kernel):

        def run(batches):
            try:
                yield from kernel(batches)
            finally:
                _give_back()

    else:

        def run(table):
            try:
                return kernel(table)
            finally:
                _give_back()

    return run


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def slices(
    batches: Iterator[pa.RecordBatch], column: int, max_bytes: int = SLICE_BYTES, max_rows: int = SLICE_ROWS
) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that ``column`` holds about ``max_bytes`` in each; no row is cut."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + max_bytes, side="right"))
            stop = min(max(stop, start + 1), start + max_rows, n)
            yield batch.slice(start, stop - start)
            start = stop
