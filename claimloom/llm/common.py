"""Helpers that the corpus operators share: table access, words, Arrow batches, lineage cuts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte table that lower-cases A-Z and turns every ASCII byte that is neither letter nor digit into a space.
ALNUM_TABLE = bytes(
    (b | 0x20) if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: bytes | None, lower: bool = True) -> list[bytes]:
    """The runs of `[^\\x20\\x09-\\x0D]`; bytes.split() splits at exactly those six bytes. Null has no words."""
    if not text:
        return []
    return (text.lower() if lower else text).split()


def alnum_words(text: bytes | None) -> list[bytes]:
    """The runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. Null has no words."""
    return text.translate(ALNUM_TABLE).split() if text else []


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A text column's UTF-8 bytes, without decoding."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds at most max_bytes of text, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def map_text(
    docs: DataFrame,
    rows: Callable[[Iterator[tuple[list, list[bytes | None]]]], Iterator[dict[str, list]]],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bytes: int = 8 << 20,
) -> DataFrame:
    """Run rows over slices of (ids, texts as UTF-8 bytes); it yields columns of the schema. Reads only the two columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[list, list[bytes | None]]]:
            for b in slices(batches, "text", max_bytes):
                yield b.column("id").to_pylist(), utf8(b.column("text"))

        for columns in rows(parts()):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)
        release()

    return slim.mapInArrow(run, schema)


def text_slices(column: pa.Array, max_bytes: int) -> Iterator[pa.Array]:
    """Cut a text column so that a slice holds at most max_bytes, or one row."""
    yield from (b.column(0) for b in slices([pa.RecordBatch.from_arrays([column], names=["text"])], "text", max_bytes))


def keep_rows(docs: DataFrame, mask: Callable[[list, list[bytes | None]], list[bool]], id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 2 << 20) -> DataFrame:
    """The rows of docs, all columns, for which mask(ids, texts) holds. Only the two columns go to Python, only flags come back; no shuffle."""

    @F.arrow_udf("boolean")
    def kept(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, texts in columns:
            flags, at = [], 0
            for part in text_slices(texts, max_bytes):
                flags += mask(ids.slice(at, len(part)).to_pylist(), utf8(part))
                at += len(part)
            yield pa.array(flags, pa.bool_())
        release()

    return docs.where(kept(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))


def release() -> None:
    """At the end of a task: hand what the worker has freed back to the system, since the worker, its caches apart, lives on for other stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


@contextmanager
def without_gc() -> Iterator[None]:
    """No cyclic garbage collection: over caches of a million objects every full collection is slow, and the loops inside make no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, or the checkpoint folder set on its context. Without one there is no place that outlives an executor."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = sc._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        found = tempfile.mkdtemp(prefix="claimloom-")  # one machine, one process: driver and executors are the same
        sc.setCheckpointDir(found)
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and a lost executor loses nothing. discard() removes it."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that cut() wrote, once all that reads them has been written itself."""
    for df in tables:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def held_out(id_col: str, modulus: int, remainder: int):
    """crc32 of the id as text, modulo modulus, is remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % modulus == remainder
