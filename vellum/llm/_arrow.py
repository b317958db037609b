"""Byte-level kernels over Arrow string columns.

A column of texts is one UTF-8 buffer with offsets; the kernels below work on that buffer with numpy, so that a
whole slice of documents costs a fixed number of vector operations instead of a Python call for each word.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII characters: `[0-9A-Za-z]|[^\\x00-\\x7F]`.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one kernel call gets; longer documents get a call of their own.
SLICE_BYTES = 2 << 20

#: A side of a join is broadcast up to this many rows of a key and a few numbers; beyond it the join shuffles.
BROADCAST_ROWS = 500_000

#: The regular expression of a word, for SQL engines.
WORD_RE = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

IS_WORD = np.zeros(256, bool)
for _r in (b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", bytes(range(128, 256))):
    IS_WORD[list(_r)] = True

# odd 64-bit constants of a seeded generator: the byte table and the base of the polynomial
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_POW: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset and Spark is local, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    where = tempfile.mkdtemp(prefix="vellum-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: cuts lineage, and survives the loss of executors. `discard` removes the table; what a lazy result
    still reads goes with the application."""
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/vellum-{spark.sparkContext.applicationId}"
    path = f"{home}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = _hadoop(spark, home)
    files.deleteOnExit(where)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def _hadoop(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Removes tables made by `written` that nothing reads any more."""
    for table in tables:
        where, files = _hadoop(table.sparkSession, table._written_to)
        files.delete(where, True)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows allow that, else as it is (the join then shuffles)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def text_of(column: str | Column = "text") -> Column:
    """The text, '' for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def unused(name: str, columns: list[str]) -> str:
    """A name like `name` that no column has."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def place_of(column: str, df: DataFrame) -> int:
    """Which of df's columns has that name, in upper or lower case, as Spark resolves names."""
    return [c.lower() for c in df.columns].index(column.lower())


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string array; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    if pa.types.is_large_string(array.type):
        offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    else:
        offsets = np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, array.offset * 4).astype(np.int64) if len(array) else np.zeros(1, np.int64)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batches: Iterator[pa.RecordBatch], column: str | int = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each slice have at most `most` bytes, or are one document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffer(batch.column(column if isinstance(column, int) else batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def strings(raw: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A string array of consecutive byte runs."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.string())


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "f" not in _POW or len(_POW["f"]) < n:
        with np.errstate(over="ignore"):
            for key, base in (("f", _BASE), ("i", _BASE_INV)):
                grown = np.full(max(n, SLICE_BYTES + (1 << 16)), base, np.uint64)
                grown[0] = 1
                _POW[key] = np.cumprod(grown, dtype=np.uint64)
    return _POW["f"], _POW["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs; equal runs have equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        forward, inverse = powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * forward[: len(raw)], out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the maximal runs where mask holds; a document's end also ends a run."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~mask[:-1]
    starts = np.flatnonzero(mask & (before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~mask[1:]
    ends = np.flatnonzero(mask & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(IS_WORD[raw], offsets)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated aranges: starts[i], starts[i]+1, ... for lengths[i] places."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def per_doc(docs: np.ndarray, weights: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(docs, weights, minlength=n)
