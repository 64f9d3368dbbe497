"""Token ids as Parquet files: list columns in ascending doc_id order, and reads of a part of them.

Ids are dictionary-encoded (a 50k vocabulary fits one dictionary page, so an id takes 16 bits
before compression); ids of documents, offsets and counts are delta-encoded; row groups and
pages are kept small and the writer stores page indexes, so that a range of documents, or the
metadata columns alone, can be read without the rest. Each file is one range of doc_ids; file
names follow that order. `first` is a document's offset in its file; a file's own offset is the
sum of the files before it.

Defined results: a null text is empty and yields just the end id; repeated doc_ids are ordered
by text; a null doc_id comes first; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.llm import byte_bpe, common

#: Layout of the files; Parquet writer settings, given as options of the write.
LAYOUT = {
    "compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#first": "false", "parquet.enable.dictionary#n_tokens": "false",
}
SCHEMA = "doc_id long, shard int, first long, n_tokens long, tokens array<int>"
END_ID = 2


class Library:
    """The tokenizers library's model behind a store of the pieces it has encoded before; ids as bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        try:
            spec = byte_bpe.checked(path)
        except (ValueError, KeyError):
            self.pieces = None  # cutting is not known to be right for such a file
            return
        tokenize, symbols = self.tokenizer.model.tokenize, str.maketrans({chr(b): c for b, c in byte_bpe.byte_symbols().items()})

        def word(w: str) -> bytes:
            known = w.isascii() and w[1:].isalpha()  # then only a first space has a stand-in
            mapped = w[0].translate(symbols) + w[1:] if known else w.encode().decode("latin-1").translate(symbols)
            return array("I", [t.id for t in tokenize(mapped)]).tobytes()

        self.pieces = byte_bpe.Pieces(word, b"".join, {t["content"]: array("I", [t["id"]]).tobytes() for t in spec["added_tokens"]})

    def ids(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the whole texts one after the other, each text's followed by `end`, and where they begin and end."""
        if self.pieces is None:
            lists = [array("I", self.tokenizer.encode(t or "", add_special_tokens=False).ids).tobytes() + end for t in texts.to_pylist()]
            return np.frombuffer(b"".join(lists), np.int32), np.cumsum([0, *map(len, lists)]) // 4
        values, index, ends = self.pieces.gathered(texts)
        index = np.insert(index, ends, len(values))
        data, at = byte_bpe.joined([*values, end], index, ends + np.arange(1, len(ends) + 1))
        return np.frombuffer(data, np.int32)[: at[-1] // 4], at // 4


@lru_cache(maxsize=2)
def library(path: str) -> Library:
    return Library(path)


def _encoder(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        shard, total, ids, end = TaskContext.get().partitionId(), 0, library(path).ids, array("I", [end_id]).tobytes()
        for batch in batches:
            for start, n in byte_bpe.chunks(batch["text"]):
                part = batch.slice(start, n)
                flat, at = ids(part["text"], end)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), pa.array(np.full(n, shard, np.int32)), pa.array(total + at[:-1]), pa.array(np.diff(at)), lists], ["doc_id", "shard", "first", "n_tokens", "tokens"])
                total += int(at[-1])

    return run


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, files: int | None = None) -> None:
    """docs: doc_id, text. Range-partitions before encoding, so that texts are encoded once and ids never shuffled."""
    n = files or common.partitions(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_encoder(vocabulary or byte_bpe.vocabulary_path(), end_id), SCHEMA).write.options(**LAYOUT).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files with `start`, a document's offset among all ids. Unused columns are not read."""
    files = spark.read.schema(SCHEMA).parquet(path)
    totals = files.groupBy("shard").agg(F.max(F.col("first") + F.col("n_tokens")).alias("total"))  # one row for each file
    before = F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("shard", before.alias("base"))
    return files.join(F.broadcast(starts), "shard").withColumn("start", F.col("base") + F.col("first")).drop("base")


def checksums(df: DataFrame) -> DataFrame:
    """Adds ids_crc32, the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            ids, ends = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            yield pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.int64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn("ids_crc32", F.arrow_udf(run, "long")("tokens"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "tokens")
    write(common.table(spark, sf_dir, "documents"), path)
    return checksums(read(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
