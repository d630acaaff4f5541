"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A word: no space, tab, line feed, vertical tab, form feed or carriage return. The same six bytes split bytes.split().
WORD = r"[^\x20\x09-\x0D]+"
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in stretches of a few rows, whose texts alone are Python objects at a time.

    Spark itself bounds a batch by spark.sql.execution.arrow.maxBytesPerBatch (64 MiB, or one row), so that no
    setting of the session has to change.
    """
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each value, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of data in lists of about `size` bytes, so that a very long text needs no list of all its words."""
    if len(data) <= size:
        yield data.split()
        return
    at = 0
    while at < len(data):
        gap = _GAP.search(data, min(len(data), at + size))
        end = gap.start() if gap else len(data)
        yield data[at:end].split()
        at = end


def fold(column, divisor: int):
    """crc32 of the id as text, modulo divisor; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(column.cast("string"), F.lit("")), "UTF-8")) % divisor


def quoted(names: list[str]) -> list[Column]:
    """Columns by name, whatever signs the names hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def fresh(names: list[str], stem: str) -> str:
    """A name, or the beginning of names, that begins none of the given ones in either case."""
    while any(n.lower().startswith(stem.lower()) for n in names):
        stem += "_"
    return stem


def give_back() -> None:
    """Return what this worker no longer holds to the machine; else an executor pays for its idle workers in later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mapped(docs: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """docs.mapInArrow(of, schema) for column names with any signs; columns are told by their place alone."""
    plain = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            for b in of(batches):
                yield pa.RecordBatch.from_arrays(b.columns, plain.names)
        finally:
            give_back()

    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(renamed, plain).toDF(*schema.names)


def training_rows(docs: DataFrame, labels: DataFrame, column: str, folds: int, held_out: int, most: int, resolve: Callable = F.max, most_bytes: int | None = None) -> DataFrame:
    """(doc_id, text, label) of at most `most` training documents, by a hash of their id; and of at most `most_bytes` of text.

    Rows of the held-out fold, and without id, label or text, are no training rows. Rows that repeat an id are one
    document, with the longest of their texts and the label that `resolve` makes of theirs. A text beyond a 64th of
    `most_bytes` is passed over on its own, so that the bound on all text cuts the order only where the sample is full but
    for such a part. The bounds hold for the rows returned, however often a table repeats them.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    known = known.groupBy("doc_id").agg(resolve(column).cast("int").alias("label"))
    given = docs.where("text is not null").select("doc_id", "text", F.octet_length("text").alias("n"), F.xxhash64("text").alias("mark"))
    sized = given.select("doc_id", "n", "mark")
    if most_bytes is not None:
        sized = sized.where(F.col("n") <= most_bytes // 64)
    longest = F.max(F.struct("n", "mark")).alias("longest")
    merged = known.join(sized, "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), longest).select("doc_id", "label", "longest.n", "longest.mark")
    # the candidates are `most` rows, and so is all that is broadcast below
    chosen = merged.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(most)
    if most_bytes is not None:
        upto = F.sum("n").over(Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
        chosen = chosen.withColumn("upto", upto).where(F.col("upto") <= most_bytes)
    chosen = chosen.select("doc_id", "label", "n", "mark")
    return given.join(F.broadcast(chosen), ["doc_id", "n", "mark"]).select("doc_id", "text", "label").dropDuplicates(["doc_id"])
