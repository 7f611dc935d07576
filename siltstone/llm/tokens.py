"""Encoding of a whole corpus."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import bpe


def encoded(docs: DataFrame, name: str = "byte_bpe_50k", folder: str = bpe.TOKENIZERS) -> DataFrame:
    """doc_id, ids of every document, in one pass without a shuffle.

    Whole texts, no special tokens; an empty or null text gives an empty list. Other columns are ignored. The driver reads the
    vocabulary (a megabyte or two) and sends it along.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(bpe.read(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = bpe.merges_of(vocabulary.value)
        for b in batches:
            ids = [bpe.encode(t, merges) for t in b.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": b.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decoded(encoded: DataFrame, name: str = "byte_bpe_50k", folder: str = bpe.TOKENIZERS) -> DataFrame:
    """doc_id, text of every row of ids; none give the empty text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(bpe.read(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = bpe.merges_of(vocabulary.value)
        for b in batches:
            texts = ["".join(bpe.decode(ids or [], merges)) for ids in b.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": b.column(0), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def token_counts(docs: DataFrame, name: str = "byte_bpe_50k", folder: str = bpe.TOKENIZERS) -> DataFrame:
    """doc_id, n_tokens of every document (0 for an empty or null text)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(bpe.read(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = bpe.merges_of(vocabulary.value)
        for b in batches:
            n = [len(bpe.encode(t, merges)) for t in b.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": b.column(0), "n_tokens": pa.array(n, pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def round_trip(docs: DataFrame, name: str = "byte_bpe_50k", folder: str = bpe.TOKENIZERS) -> DataFrame:
    """lang, n_docs, n_tokens, n_broken: documents whose decoded ids are not their text (null counts as '')."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(bpe.read(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = bpe.merges_of(vocabulary.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = [bpe.encode(t, merges) for t in texts]
            broken = ["".join(bpe.decode(i, merges)) != (t or "") for i, t in zip(ids, texts, strict=True)]
            yield pa.record_batch({"lang": b.column(0), "n_tokens": pa.array([len(i) for i in ids], pa.int64()), "broken": pa.array(broken, pa.bool_())})

    each = docs.select("lang", "text").mapInArrow(run, "lang string, n_tokens bigint, broken boolean")
    return each.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.count_if("broken").alias("n_broken"))
