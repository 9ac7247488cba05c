"""Shared helpers of the corpus operators: tables, word patterns, hold-outs and shared-folder tables."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Words of ASCII letters, digits and all that isn't ASCII, for Java: the same as [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+, in fewer tests a character.
ALNUM_WORD = r"[\p{Alnum}\P{ASCII}]+"
#: Words between ASCII white space, for Java: [^\x20\x09-\x0D]+.
SPACE_WORD = r"\S+"

#: What Python works on at once: rows, and bytes of the columns that it reads, about (a longer row comes alone).
SLICE_ROWS, SLICE_BYTES = 300, 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _slices(batch: pa.RecordBatch, reads: Sequence[str]) -> Iterator[pa.RecordBatch]:
    size = np.ones(batch.num_rows, np.int64)
    for c in reads:
        if pa.types.is_string(batch.column(c).type) or pa.types.is_large_string(batch.column(c).type):
            size += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        stop = min(at + SLICE_ROWS, max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop


def extended(df: DataFrame, reads: Sequence[str], start: Callable[[], Callable[..., Mapping[str, Sequence]]], added: str, drop: Sequence[str] = ()) -> DataFrame:
    """The columns of ``df`` but ``drop``, then those of ``added`` (DDL, in place of columns of the same name).

    ``start`` is called once in a task and gives a function from the lists of the columns read to the
    lists of the added ones; under ``KEEP`` it may give which rows stay. All other columns pass through
    Arrow as they are, so that no id is ever turned into a float. Nothing is shuffled.
    """
    new = StructType.fromDDL(added) if added else StructType()
    types = {f.name: to_arrow_type(f.dataType) for f in new}
    kept = [f.name for f in df.schema if f.name not in types and f.name not in drop]
    out = StructType([df.schema[c] for c in kept] + list(new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for whole in batches:
            for batch in _slices(whole, reads):
                found = work(*(batch.column(c).to_pylist() for c in reads))
                arrays = [batch.column(c) for c in kept] + [x if isinstance(x := found[c], pa.Array) else pa.array(x, t) for c, t in types.items()]
                made = pa.RecordBatch.from_arrays(arrays, names=[*kept, *types])
                if KEEP in found:
                    made = made.filter(pa.array(found[KEEP], pa.bool_()))
                if made.num_rows:
                    yield made

    return df.mapInArrow(lean(run), out)


#: Under this name a function for ``extended`` tells which rows stay.
KEEP = "__keep"


def held_out(doc_id: Column, modulus: int, remainder: int = 2) -> Column:
    """True for ids whose crc32 (of the id as text) leaves the remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(modulus) == F.lit(remainder), F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="lattica-"))
    return f"file://{_LOCAL[0]}"


_LOCAL: list[str] = []
#: Paths of tables that are still there, with the session that wrote them.
_WRITTEN: dict[str, SparkSession] = {}


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


@atexit.register
def _remove_all() -> None:
    for path, spark in _WRITTEN.items():
        _remove(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder, read back. Survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[path] = spark
    found = spark.read.schema(df.schema).parquet(path)
    found._lattica_path = path
    return found


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` gave; only once nothing is read from it any more."""
    path = getattr(df, "_lattica_path", None)
    if path in _WRITTEN:
        _remove(_WRITTEN.pop(path), path)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives its memory back at the end: Python workers live on for other tasks."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns of the input that clash with names the operator adds (case is ignored, as Spark does)."""
    taken = {n.lower() for n in names}
    clash = [c for c in df.columns if c.lower() in taken]
    return df.drop(*clash) if clash else df
