"""Token counts of the documents in flat token files that have no index.

A flat file is token ids one after another, each document closed by an end-of-document id. Files are cut into blocks of a fixed
number of bytes, wherever documents lie. Each block is searched on its own by a vectorised comparison; a prefix scan over the
few numbers that a block leaves (how many ends, the first and the last) tells each block how many documents and which position
came before it, so that documents across blocks, or longer than many blocks, get their count.

Defined results: documents without tokens count 0; tokens after a file's last end make a document that is not ``closed``; an
empty file has no documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegrain.llm.bpe import encoder
from sitegrain.llm.common import bytes_of, own_columns, slices
from sitegrain.session import cut_lineage, shared_folder

#: Bytes of a file that a task reads at a time.
BLOCK = 4 << 20


def _open(path: str):
    store, inside = fs.FileSystem.from_uri(path)
    return store, inside


def _write(folder: str, tokenizer: str, end: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, True).encode
        name, out, row = f"tokens-{uuid.uuid4().hex}.bin", None, 0
        closing = np.asarray([end], f"<u{width}").tobytes()
        for batch in batches:
            _, offsets = bytes_of(batch.column("text"))
            for a, b in slices(offsets):
                if out is None:
                    store, inside = _open(f"{folder}/{name}")
                    out = store.open_output_stream(inside)
                ids = encode([t or "" for t in batch.column("text").slice(a, b - a).to_pylist()])
                out.write(b"".join(np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes() + closing for x in ids))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array([name] * (b - a)), pa.array(np.arange(row, row + b - a))], ["id", "file", "row"])
                row += b - a
        if out is not None:
            out.close()

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end: int, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a flat file for each partition of ``docs`` and return id, file, row: where each document went.

    ``folder`` must be shared by all executors. A file is named anew in each attempt of a task, and only those of successful attempts
    are in the returned table, so that a lost executor leaves at most a file nobody names.
    """
    store, inside = _open(folder)
    store.create_dir(inside, recursive=True)
    docs = own_columns(docs, id=id_col, text=text_col).selectExpr("CAST(id AS BIGINT) AS id", "text")
    return cut_lineage(docs.mapInArrow(_write(folder, tokenizer, end, width), "id long, file string, row long"))


def _scan(end: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, file, block, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "file", "block", "start", "stop")), strict=True):
                store, inside = _open(path)
                with store.open_input_file(inside) as source:
                    source.seek(start)
                    ids = np.frombuffer(source.read(stop - start), f"<u{width}")
                ends = np.flatnonzero(ids == end) + start // width
                last = int(ends[-1]) if len(ends) else None
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([last], pa.int64()), pa.array([stop // width], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], ["file", "block", "n", "last", "stop", "ends"])

    return run


def count_tokens(spark: SparkSession, folder: str, end: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """file, row, start, n_tokens, closed of each document of the ``*.bin`` files of a folder; ``start`` counts tokens."""
    if block % width:
        raise ValueError("a block must hold whole ids")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length").where("length > 0")
    blocks = files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / block))).alias("block"))
    blocks = blocks.select("path", "file", "block", (F.col("block") * block).alias("start"), F.least("length", (F.col("block") + 1) * block).alias("stop"))
    # a task reads its blocks one by one
    found = cut_lineage(blocks.repartition(max(2, spark.sparkContext.defaultParallelism * 2), "file", "block").mapInArrow(_scan(end, width), "file string, block long, n long, last long, stop long, ends array<long>"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scan = found.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("last_before"))
    joined = found.join(scan, ["file", "block"]).where("n > 0")
    starts = F.concat(F.array("last_before"), F.slice("ends", 1, F.col("n").cast("int") - 1))
    each = joined.select("file", "rows_before", F.posexplode(F.arrays_zip(starts.alias("from"), F.col("ends").alias("to"))).alias("at", "d"))
    closed = each.select("file", (F.col("rows_before") + F.col("at")).alias("row"), (F.col("d.from") + 1).alias("start"), (F.col("d.to") - F.col("d.from") - 1).alias("n_tokens"), F.lit(True).alias("closed"))
    tails = found.groupBy("file").agg(F.sum("n").alias("row"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.max("stop").alias("stop")).where("start < stop")
    return closed.union(tails.select("file", "row", "start", F.col("stop") - F.col("start"), F.lit(False)))


def document_token_counts(docs: DataFrame, tokenizer: str, end: int, width: int = 2, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens of each row: written to flat files in the shared folder and counted there."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    where = write_token_files(docs, folder, tokenizer, end, width, id_col, text_col)
    counts = count_tokens(spark, folder, end, width, block)
    return where.join(counts, ["file", "row"]).select(F.col("id").alias("doc_id"), "n_tokens", "file", "row", "start")
