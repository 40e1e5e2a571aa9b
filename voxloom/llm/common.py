"""What the training-data operators share: inputs, tables that cut lineage, id filters, slices of batches."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of all contracts: space and 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Filters have eight bits an id within these bounds (128 kB to 16 MB), whatever the input.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: Of batches in stages that stand beside a heap that earlier stages have filled.
SMALL_BATCH = 2 << 20
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def in_batches(docs: DataFrame, size: int = BATCH_BYTES) -> DataFrame:
    """docs; from now on Spark hands their rows to Python in Arrow batches of so many bytes at most.

    Ten thousand long texts in one batch would take much of an executor's memory beside its heap, three times over.
    """
    conf = docs.sparkSession.conf
    bytes_now = re.fullmatch(r"(\d+)b?", conf.get(BATCH_SETTING))
    if not bytes_now or int(bytes_now[1]) > size:
        conf.set(BATCH_SETTING, str(size))
    return docs


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a local default only where that is unset in local mode (tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file:///tmp/voxloom-checkpoints"
    return f"{top.rstrip('/')}/voxloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and still there if executors go."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing is read from any more: what came of them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_PLACES.pop(df))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap with a bit for each id's hash: about eight bits an id, MOST_BITS at most.

    Never misses an id; ids that are not there pass at the rate of set bits, so an exact join follows.
    """
    n = ids.count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * n).bit_length()))
    slot = F.pmod(F.col(column), F.lit(size))
    rows = (
        ids.select(slot.alias("slot"))
        .groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits"))
        .toArrow()
    )
    out = np.zeros(size // 8, dtype=np.uint8)
    for bucket, bits in zip(rows.column("bucket").to_pylist(), rows.column("bits")):
        part = np.frombuffer(bits.as_buffer(), dtype=np.uint8)
        out[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(part)] |= part
    return out


def passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids may be in the filter."""
    slot = np.mod(ids, len(bits) * 8)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def maybe_in(ids: DataFrame, column: str, value: Column) -> Column:
    """Whether a value may be among the ids, by their filter: only the values go to Python."""
    sent = ids.sparkSession.sparkContext.broadcast(id_filter(ids, column))

    @F.arrow_udf("boolean")
    def test(x: pa.Array) -> pa.Array:
        return pa.array(passes(sent.value, x.to_numpy(zero_copy_only=False)))

    return test(value)


def text_slices(texts: pa.Array, rows: int, size: int = 1 << 20) -> Iterator[list[str | None]]:
    """An array of texts by slices."""
    for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), rows, size):
        yield part.column("text").to_pylist()


def give_back() -> None:
    """Freed memory goes back to the system: Python workers live on from stage to stage beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batch: pa.RecordBatch, rows: int, size: int = 1 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many rows and about so many bytes of text (or elements of a list column), one
    row at least.

    Arrays that are worked out for a part then have a bounded size, however long the texts of a batch are.
    """
    values = batch.column(column)
    long = values.value_lengths() if pa.types.is_list(values.type) else pc.binary_length(values)
    total = np.concatenate([[0], np.cumsum(pc.fill_null(long, 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(total, total[at] + size, side="right")) - 1
        to = min(max(to, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
    give_back()
