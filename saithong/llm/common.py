"""What the operators of this subpackage share: lineage cuts, let-bindings and Arrow batch slicing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from saithong.functions.text import let as let

#: ASCII white space that separates words; the complement is a word character.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and all run in one process, an own temporary one. On a cluster it must be set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="saithong-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return f"file://{_own_dirs[app]}"


_GROUP = 8 << 20  # bytes of a row group that a Python worker writes
_BATCH = "16m"  # 64 MB, which is usual, are held several times over by an executor and its workers
#: cleanup: what is shuffled for a query leaves the disks when it ends; batch: bytes of the batches that go to Python workers.
_CONF = {"cleanup": "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "batch": "spark.sql.execution.arrow.maxBytesPerBatch"}


@contextlib.contextmanager
def _with_conf(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session for queries run inside, by the names in _CONF."""
    before = {_CONF[k]: spark.conf.get(_CONF[k], None) for k in values}
    for k, v in values.items():
        spark.conf.set(_CONF[k], v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to a table in the shared folder and read from there; survives lost executors. What was shuffled for it leaves the disks once it is written. The table goes when drop() is called or the application ends."""
    path = f"{shared_dir(df.sparkSession)}/saithong/{name}-{uuid.uuid4().hex}"
    with _with_conf(df.sparkSession, cleanup="true"):
        df.write.parquet(path)
    return _table(df.sparkSession, path, df.schema)


def _table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    _folder(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    table = spark.read.schema(schema).parquet(path)
    table._cut_at = path
    return table


def _files(folder: str, run: Callable | None) -> Callable:
    """A function for mapInArrow that writes what it gets, or what run makes of it, to a file in folder, and returns the file's name; nothing makes no file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, writer = f"part-{uuid.uuid4().hex}.parquet", None
        with contextlib.ExitStack() as files:
            for group in _groups(run(batches) if run else batches):
                group = group.cast(pa.schema([(f.name, _nullable(f.type)) for f in group.schema]))
                if writer is None:
                    writer = files.enter_context(pq.ParquetWriter(f"{folder}/{name}", group.schema, use_dictionary=False))
                writer.write_table(group)
        if writer is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    if run:
        write.__module__ = run.__module__
    return tidied(write)


def _nullable(kind: pa.DataType) -> pa.DataType:
    """The type with parts that may be null: a struct that is null has null parts, whatever its type says of them."""
    if pa.types.is_struct(kind):
        return pa.struct([(f.name, _nullable(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(_nullable(kind.value_type))
    return pa.map_(_nullable(kind.key_type), _nullable(kind.item_type)) if pa.types.is_map(kind) else kind


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of consecutive batches, about _GROUP bytes or more of each."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.nbytes for x in held) >= _GROUP:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def cut_by_workers(df: DataFrame, name: str, run: Callable | None = None, schema: str | None = None) -> DataFrame:
    """cut(), or that of df.mapInArrow(run, schema), but for the files, which Python workers write if the shared folder is a local or mounted one.

    Hadoop's local file system starts a process (chmod) for each folder and several for each file that it makes, and until such a process runs its own program it holds the executor's memory a second time. Workers start none. They write to a folder of files not yet in the table; only those of the attempts that counted are moved to it. What a Python function returns should be dealt out anew (repartition) before, or run be that function, so that a task has one worker.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/saithong/{name}-{uuid.uuid4().hex}"
    if _folder(spark, path).getUri().getScheme() != "file":
        return cut(df.mapInArrow(tidied(run), schema) if run else df, name)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath()
    os.makedirs(f"{folder}/_temporary")
    with _with_conf(spark, cleanup="true", batch=_BATCH):
        made = df.mapInArrow(_files(f"{folder}/_temporary", run), "name string").collect()
    for row in made:
        os.replace(f"{folder}/_temporary/{row['name']}", f"{folder}/{row['name']}")
    shutil.rmtree(f"{folder}/_temporary")
    return _table(spark, path, StructType.fromDDL(schema) if run else df.schema)


def _folder(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut() made and that no plan will read again."""
    for t in tables:
        spark, path = t.sparkSession, t._cut_at
        _folder(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def words_of(text: Column) -> Column:
    """The words (runs without ASCII white space) of a text; null has none."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE)),
    )


def n_words_of(text: Column) -> Column:
    """Number of words of a text, without keeping them; null has none."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE))).cast("long")


def by_bytes(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive slices of about `most` bytes; a longer text makes a slice of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t.as_buffer()) if t.is_valid else 0
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


#: What Python workers keep from task to task, by module and name: it goes when another module's function runs, as workers outlive stages.
held: dict[tuple[str, str], object] = {}


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(run: Callable) -> Callable:
    """A function for mapInArrow that gives unused memory back when its task ends, and what other modules hold when it begins."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if foreign := [k for k in held if k[0] != run.__module__]:
            for k in foreign:
                del held[k]
            gc.collect()
            _trim()
        yield from run(batches)
        _trim()

    return wrapped


def coded_words(texts: pa.Array, *, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words between ASCII white space, number of each word of all texts among them, words of each text); lower: A-Z become a-z. No Python object is made for a word. If a text has none, the empty string may be among the distinct words."""
    t = texts.cast(pa.string())
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(t) if lower else t))
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:  # a text without words is split into one empty string
        gone = numbers == empty
        sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[gone], minlength=len(sizes))
        numbers = numbers[~gone]
    return coded.dictionary, numbers, sizes


def word_numbers(texts: pa.Array, *, lower: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """coded_words() with the distinct words as bytes, none of them empty."""
    coded, numbers, sizes = coded_words(texts, lower=lower)
    words = coded.cast(pa.binary()).to_pylist()
    if b"" in words:
        empty = words.index(b"")
        numbers = numbers - (numbers > empty)
        del words[empty]
    return words, numbers, sizes


def hashed_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; the id null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
