"""Operator 10, token counts of documents in flat token files without an index.

A file is nothing but token ids of fixed width, each document ended by the end-of-document
id. It is cut into blocks of `BLOCK` ids that any task can read by offset; each block is
searched for the id at once, as an array. Documents cross blocks: a prefix scan over the
blocks' summaries gives every block the end of the last document before it (a running
maximum) and the number of documents before it (a running sum), and with these every
block's first document gets its whole length.

`write_token_files` makes such files of a table of documents. A task writes under a name
of its own attempt, and only files named in the result count, so that a task run again
leaves no file counted twice.

Defined results: a null or empty text is a document of 0 tokens; so are neighbouring
end-of-document ids; ids after the last one are a document not yet ended, and counted; an
empty file holds none; a file whose size isn't a multiple of the id width raises, and so
does a vocabulary with ids that don't fit the width or with the end mark among them.
"""
from __future__ import annotations

import base64
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import map_texts, materialise, remove_path, scratch_dir

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
EOD = 50_256  # free in this vocabulary
DTYPE = "<u2"
BLOCK = 1 << 20
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}", eod: int = EOD) -> DataFrame:
    """One flat file for each partition; returns (path, n_bytes, ord, doc_id), a row for each document."""

    def run(batches):
        if eod > np.iinfo(DTYPE).max:
            raise ValueError(f"{eod} is no id of {DTYPE}")
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.bin"
        e, written, order, ids = _encoding(vocabulary), 0, 0, []
        with fs.open_output_stream(f"{root}/{name}") as out:
            for b in batches:
                for start in range(0, b.num_rows, 256):
                    part = b.slice(start, 256)
                    data = []
                    for text in part.column(1).to_pylist():
                        if text:
                            found = e.encode_to_numpy(text, disallowed_special=())
                            if len(found) and found.max() > np.iinfo(DTYPE).max or (found == eod).any():
                                raise ValueError(f"the vocabulary has ids that {DTYPE} or the end mark {eod} can't tell apart")
                            data.append(found.astype(DTYPE))
                        data.append(np.array([eod], DTYPE))
                    raw = np.concatenate(data).tobytes()
                    out.write(raw)
                    written += len(raw)
                ids.append(b.column(0))
        for column in ids:
            n = len(column)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * n, pa.string()), pa.array(np.full(n, written)), pa.array(np.arange(order, order + n)), column], names=["path", "n_bytes", "ord", "doc_id"])
            order += n

    return map_texts(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), run, "path string, n_bytes long, ord long, doc_id long")


def token_counts(files: DataFrame, eod: int = EOD, dtype: str = DTYPE, block: int = BLOCK) -> DataFrame:
    """(path, ord, start, n_tokens) for each document in files (path, n_bytes)."""
    width = np.dtype(dtype).itemsize

    def search(batches):
        for b in batches:
            for path, start, total in zip(*(c.to_pylist() for c in b.columns)):
                if total % width:
                    raise ValueError(f"{path}: {total} bytes are no whole number of ids")
                n = min(block, total // width - start)
                fs, name = _open(path)
                with fs.open_input_file(name) as f:
                    ids = np.frombuffer(f.read_at(n * width, start * width), dtype)
                at = np.flatnonzero(ids == eod) + start
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([start]), pa.array([total // width]), pa.array([len(at)]), pa.array([int(at[-1]) + 1 if len(at) else None], pa.int64()), pa.array([at], pa.list_(pa.int64()))],
                    names=["path", "block", "total", "n", "last_end", "seps"])

    spark = files.sparkSession
    starts = files.where("n_bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / width), F.lit(block).cast("long"))).alias("block"), "n_bytes")
    spread = starts.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "block")
    blocks = spread.mapInArrow(search, "path string, block long, total long, n long, last_end long, seps array<long>")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = blocks.select("*", F.coalesce(F.max("last_end").over(before), F.lit(0)).alias("open"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ends = F.col("seps")
    # each document starts after the separator before it, the block's first where the scan says
    begins = F.concat(F.array("open"), F.transform(ends, lambda x: x + 1))
    final = F.col("block") + block >= F.col("total")
    tail = F.when(final & (F.coalesce("last_end", "open") < F.col("total")), F.concat(ends, F.array("total"))).otherwise(ends)
    return scanned.select("path", "first", begins.alias("b"), F.posexplode(tail).alias("i", "end")).select("path", (F.col("first") + F.col("i")).alias("ord"), F.element_at("b", F.col("i") + 1).alias("start"), (F.col("end") - F.element_at("b", F.col("i") + 1)).alias("n_tokens"))


def document_token_counts(docs: DataFrame, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """doc_id and n_tokens of every document, by way of flat token files in the shared folder."""
    spark: SparkSession = docs.sparkSession
    folder = scratch_dir(spark)
    try:
        return _counted(docs, folder, vocabulary)
    finally:
        remove_path(spark, folder)


def _counted(docs: DataFrame, folder: str, vocabulary: str) -> DataFrame:
    written = materialise(write_token_files(docs, folder, vocabulary))
    files = written.groupBy("path").agg(F.max("n_bytes").alias("n_bytes"))
    counts = token_counts(files).select("path", "ord", "n_tokens")
    # a sorted merge: both sides hold a row for each document and are never broadcast
    return materialise(written.hint("merge").join(counts, ["path", "ord"]).select("doc_id", "n_tokens"))
