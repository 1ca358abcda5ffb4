"""Helpers shared by the operators: Arrow text buffers, scratch space, table reads."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.storage import spread

BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20
SEPARATOR = 0xFF  # never a byte of UTF-8


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder path inside the shared folder named by spark.checkpoint.dir.

    Where the session names none, a local session (tests) gets a temporary folder; on a
    cluster, whose machines don't share one, it is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="skein-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/skein-{uuid.uuid4().hex}"


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(names: list[str]) -> list[str]:
    """Column names as they stand in expressions, where dots and blanks may be in them."""
    return [f"`{n}`" for n in names]


def unused(df: DataFrame, base: str) -> str:
    """A column name like base that df doesn't have."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def map_texts(df: DataFrame, f, schema) -> DataFrame:
    """df.mapInArrow(f, schema) with batches bounded in bytes, so that long texts don't fill a worker.

    The bound is a session setting; a smaller one of the session's own is kept. Tables too
    small for their files to occupy all cores are spread over them.
    """
    conf = df.sparkSession.conf
    now = conf.get(BATCH_SETTING)
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def run(batches):
        yield from f(batches)
        pa.default_memory_pool().release_unused()

    return spread(df).mapInArrow(run, schema)


def map_rows(docs: DataFrame, f, *more) -> DataFrame:
    """map_texts where f keeps the columns, which may have any names; more: further columns for f to read.

    f gets and gives batches whose columns are named by their place, c0, c1, ...
    """
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    extra = docs.select("*", *more).toDF(*plain.columns, *(f"m{i}" for i in range(len(more)))) if more else plain
    return map_texts(extra, f, plain.schema).toDF(*docs.columns)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without decoding; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if column.null_count:
        column = column.fill_null("") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.fill_null(b"")
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, kind, count=n + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[off[0]: off[-1]]
    return off - off[0], raw


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def with_separators(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts joined with one separator byte after each, and where each then starts."""
    n = len(offsets) - 1
    out = np.full(len(raw) + n, SEPARATOR, np.uint8)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] + np.arange(n)] = False
    out[keep] = raw
    return out, offsets + np.arange(n + 1)


def sample_ids(df: DataFrame, key: str, per_key: int, id_col: str = "doc_id") -> list:
    """Up to per_key ids for each value of `key`, smallest hash of the id first.

    Reads only the two columns; the rank limit is applied before the shuffle.
    """
    from pyspark.sql import Window

    h = F.xxhash64("id")
    w = Window.partitionBy("key").orderBy(h, "id")
    named = df.select(F.col(id_col).alias("id"), F.col(key).alias("key")).where("key IS NOT NULL AND id IS NOT NULL")
    return [r[0] for r in named.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_key).select("id").distinct().collect()]
