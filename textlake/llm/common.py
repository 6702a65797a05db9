"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.sources.readers import spread

TOKENIZER_DIR = "/opt/tokenizers"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local[...] session without one gets a temporary
    folder; for a cluster without one it is an error, as its machines share no such folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if "folder" not in _local:
            _local["folder"] = tempfile.mkdtemp(prefix="textlake-")
            atexit.register(shutil.rmtree, _local["folder"], ignore_errors=True)
        folder = _local["folder"]
    return folder


_local: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the folder that all executors share and read it back.

    That cuts the lineage, survives the loss of executors, and lets joins know the table's true size.
    The caller's session deletes the tables when the interpreter ends (see forget).
    """
    path = f"{shared_folder(df.sparkSession)}/textlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(keep: int = 0) -> None:
    """Delete the tables that cut wrote, but for the first keep of them."""
    for spark, path in _written[keep:]:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session has ended; its folder is the cluster's to clean
            pass
    del _written[keep:]


atexit.register(forget)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns an operator is about to add; a clashing input column gives way."""
    return df.drop(*names)


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def hash_u63(*cols: Column | str, seed: int = 0) -> Column:
    """A non-negative 63-bit hash; nulls hash as well."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 1)


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """A hash over all columns, whatever their types; equal rows have equal hashes."""
    plain = lambda t: "map<" not in t and "variant" not in t
    return hash_u63(*[F.col(f"`{n}`") if plain(t) else F.to_json(F.struct(F.col(f"`{n}`"))) for n, t in df.dtypes], seed=seed)


def partitions_for(df: DataFrame) -> int:
    """As many partitions as the session's shuffles have."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


BROADCAST_ROWS = 1_000_000  # a table of keys is broadcast up to this many rows


def small_side(keys: DataFrame, width: int = 1) -> DataFrame:
    """keys, for a join, to be broadcast if they are few enough; else the join shuffles. width: how
    many numbers a row is as large as. Give it a table that cut wrote, so that counting reads its
    footers only."""
    return F.broadcast(keys) if keys.count() * width <= BROADCAST_ROWS else keys


# flat access to Arrow string columns


def flat_utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the len+1 offsets of the rows (nulls are empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64, count=len(col) + 1 + col.offset)[col.offset :]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def string_array(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The strings raw[offsets[i]:offsets[i+1]], without copying the bytes."""
    return pa.Array.from_buffers(
        pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]
    )


def spaced_units(col: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Cut each text at every space that follows a non-space, after one space is put before it.

    Returns the distinct units, the unit number of each piece in text order, and the offsets of the
    texts in that list. Joined, a text's units are the text with its leading space; an empty text
    has none.
    """
    raw, off = flat_utf8(col)
    n = np.diff(off)
    full = n > 0
    starts = off[:-1][full] + np.arange(full.sum())  # each full text grows by its leading space
    out = np.empty(len(raw) + len(starts), np.uint8)
    keep = np.ones(len(out), bool)
    keep[starts] = False
    out[starts] = 32
    out[keep] = raw
    space = out == 32
    cut_at = space.copy()
    cut_at[1:] &= ~space[:-1]
    cut_at[starts] = True
    at = np.flatnonzero(cut_at)
    units = string_array(out, np.append(at, len(out))).dictionary_encode()
    counts = np.zeros(len(n) + 1, np.int64)
    bounds = np.append(starts, len(out))
    counts[1:][full] = np.diff(np.searchsorted(at, bounds))
    return units.dictionary, np.asarray(units.indices), np.cumsum(counts)


def _trimmer() -> Callable[[], object]:
    """glibc keeps what is freed between kept pieces; this gives it back. Other systems do without."""
    try:
        trim = ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda: None
    return lambda: trim(0)


_trim = _trimmer()


def slices(batch: pa.RecordBatch, column: str = "text", size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive parts of about size bytes of the column (whole rows; none if it has
    none). After each the memory that its work took goes back to the machine, as workers live on."""
    n = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    part = (np.cumsum(n) - n) // size
    at = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(n)]]) if len(n) else [0]
    for a, b in zip(at[:-1], at[1:]):
        yield batch.slice(a, b - a)
        pa.default_memory_pool().release_unused()
        _trim()


def take_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of all ranges, end to end."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def int_lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The lists values[offsets[i]:offsets[i+1]] as an Arrow column."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
