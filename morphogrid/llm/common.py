"""What several corpus operators share: tables, durable cuts of lineage, text batches for Arrow kernels."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one kernel call takes at most, but for a single longer text.
KERNEL_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch, whichever it reaches first; a single longer row makes a batch of its own. Spark's own 64 MB of
#: buffers outside the heap, and as much in the worker, for each running task would be most of what an executor has beside its heap.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20
#: Seconds after which a Python worker hands back memory again while its task goes on.
TRIM_SECONDS = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only where none is set (tests, notebooks) a temporary one is made."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """`df` written once, as a table in the shared folder, and read back: a lost executor costs no recomputation, and row ids stay."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    trim_memory()  # of the driver: models and filters made for earlier tables are gone
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that `durable` wrote; nothing lazy may read them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._durable_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def default_spec(name: str = "word_bpe_49k.json") -> str:
    """The text of a public tokenizer's file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def held_out(doc_id: str = "doc_id"):
    """True for the fold that no model learns from: crc32 of the id's text leaves 2 modulo 4. Null ids are in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_batches(batches: Iterable[pa.RecordBatch], column: str, limit: int = KERNEL_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut Arrow batches into slices of about `limit` text bytes; yields (slice, texts), nulls as empty texts."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            continue
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        begin, total = 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(begin, i - begin), texts.slice(begin, i - begin)
                begin, total = i, 0
            total += int(size)
        yield batch.slice(begin), texts.slice(begin)


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What `make` makes, once in a Python worker; it stays until a task of another kernel begins there."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def drop_kept(keep: str | None = None) -> None:
    """Drops what is `kept` under other names. Tasks must call this by its module's name: a closure travels with a copy of `_kept`."""
    for name in [n for n in _kept if n != keep]:
        del _kept[name]


def trim_memory() -> None:
    """Hands freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`; the memory it freed goes back to the system now and then and at its end, as Python workers outlive their tasks and would
    hold on to it. What tasks of other kernels than `keep` left in the worker goes first.

    Arrow batches of this session hold `BATCH_ROWS` rows and about `BATCH_BYTES` bytes at most from now on, unless its settings ask for
    other numbers than Spark's own.
    """
    session = SparkSession.getActiveSession()
    if session is not None:
        for name, own, ours in (("maxRecordsPerBatch", "10000", str(BATCH_ROWS)), ("maxBytesPerBatch", "67108864b", f"{BATCH_BYTES}b")):
            if session.conf.get(f"spark.sql.execution.arrow.{name}") == own:
                session.conf.set(f"spark.sql.execution.arrow.{name}", ours)

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept(keep)
        latest = time.monotonic()
        try:
            for batch in run(batches):
                yield batch
                if time.monotonic() >= latest + TRIM_SECONDS:
                    trim_memory()
                    latest = time.monotonic()
        finally:
            trim_memory()

    return wrapped


def filter_texts(df: DataFrame, verdict: Callable[[pa.Array], np.ndarray], text_col: str = "text", limit: int = KERNEL_BYTES) -> DataFrame:
    """The rows of `df`, all columns as they are, whose text `verdict(texts)` marks true; a narrow map, without a shuffle or an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, text_col, limit):
            yield batch.filter(pa.array(verdict(texts)))

    return df.mapInArrow(releasing(run), df.schema)


def map_texts(df: DataFrame, kernel: Callable[[pa.Array], dict], result: str, id_col: str = "doc_id", text_col: str = "text", limit: int = KERNEL_BYTES, keep: str | None = None) -> DataFrame:
    """One output row for each input row: the id and what `kernel(texts)` returns, a dict of columns typed by the DDL `result`.

    Runs as a narrow map, without a shuffle; other columns of `df` are never read. Rows keep nulls in the id. With `keep`,
    `kernel()` makes the kernel of a task, from what it has `kept` under that name.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    narrow = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], *T._parse_datatype_string(result).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kernel() if keep else kernel
        for batch, texts in text_batches(batches, "text", limit):
            columns = {"doc_id": batch.column(0)} | own(texts)
            arrays = [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name]) for f in arrow]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow, strict=True)], schema=arrow)

    return narrow.mapInArrow(releasing(run, keep), schema)
