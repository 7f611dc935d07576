"""Queries of the text problems over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import dedup, packing, subjects, tokens
from siltstone.operators.skew import hot_keys, salted_join
from siltstone.session import written


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _last_batch(docs: DataFrame) -> tuple[int | None, int | None]:
    """The last batch_no and its first doc_id (None without any)."""
    return tuple(docs.groupBy("batch_no").agg(F.min("doc_id").alias("cut")).where("batch_no is not null and cut is not null").agg(F.max(F.struct("batch_no", "cut")).alias("last")).select("last.*").first())


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """All repeats, from two deliveries to one store: the posts before the last batch, then the rest against them.

    The cut is the last batch's first doc_id, so that posts are taken in order of doc_id whatever their batch_no. Without
    any batch_no all posts are one delivery.
    """
    docs, store = _t(spark, sf, "documents"), dedup.Store(spark)
    _, cut = _last_batch(docs)
    if cut is None:
        return store.append(docs, keep=False)
    return store.append(docs.where(F.col("doc_id") < cut)).unionByName(store.append(docs.where(F.col("doc_id") >= cut), keep=False))


def p5_last_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Only the last batch, against a store that took in the earlier ones.

    A post without batch_no counts to the last batch from that batch's first doc_id on, and to the earlier ones below;
    without any batch_no all posts are the last batch.
    """
    docs, store = _t(spark, sf, "documents"), dedup.Store(spark)
    last, cut = _last_batch(docs)
    if cut is None:
        return store.append(docs, keep=False)
    in_last = F.coalesce(F.col("batch_no") == last, F.col("doc_id") >= cut)
    store.append(docs.where(~in_last))
    return store.append(docs.where(in_last), keep=False)


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encoded(_t(spark, sf, "documents"))


def p6_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.round_trip(_t(spark, sf, "documents"))


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed_documents(_t(spark, sf, "documents"), _t(spark, sf, "pack_sizes"))


def p7_summary(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packing_summary(p7_packed(spark, sf), _t(spark, sf, "pack_sizes"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.subjects_of(*(_t(spark, sf, n) for n in ("documents", "subject_labels", "subjects")))


def p8_composition(spark: SparkSession, sf: str) -> DataFrame:
    return p8_found(spark, sf).groupBy("subject").agg(F.count(F.lit(1)).alias("n_posts"))


def p5_sound(spark: SparkSession, sf: str) -> DataFrame:
    """What must not be among the repeats: pairs out of order, repeats of two posts or of a repeat, and exact copies left out.

    ``n_missed_copies`` counts judged posts whose author and whole text equal those of an earlier post and that are no repeat.
    """
    docs, found = _t(spark, sf, "documents"), written(p5_found(spark, sf))
    twice = found.groupBy("doc_id_b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("n_twice").alias("fault"))
    unordered = found.where("doc_id_a >= doc_id_b").select(F.lit("n_unordered").alias("fault"))
    chained = found.select(F.col("doc_id_a").alias("doc_id_b")).distinct().join(found, "doc_id_b", "left_semi").select(F.lit("n_chained").alias("fault"))
    judged = dedup.post_words(docs).select("doc_id")
    texts = docs.where("text is not null").select("doc_id", F.sha2(F.concat_ws("/", F.coalesce("author", F.lit("")), "text"), 256).alias("digest"))
    groups = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    copies = salted_join(texts, groups.select("digest", "first"), "digest", [F.col("doc_id")], hot_keys(groups, "digest", "n")).where("doc_id > first")
    missed = copies.join(judged, "doc_id", "left_semi").join(found.select(F.col("doc_id_b").alias("doc_id")), "doc_id", "left_anti").select(F.lit("n_missed_copies").alias("fault"))
    faults = unordered.unionByName(twice).unionByName(chained).unionByName(missed)
    return faults.agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("n_unordered", "n_twice", "n_chained", "n_missed_copies")])


def p6_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, text_md5: the digest of every text put together again from its ids."""
    return tokens.decoded(p6_ids(spark, sf)).select("doc_id", F.md5("text").alias("text_md5"))


def p7_sound(spark: SparkSession, sf: str) -> DataFrame:
    """Per pack: documents placed, containers over capacity, documents cut that need not be, gaps in the containers' numbers, copies of a piece."""
    packs = _t(spark, sf, "pack_sizes").select("pack_no", "capacity_tokens")
    filled = written(p7_packed(spark, sf))
    whole = filled.groupBy("pack_no", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"), F.count_distinct("piece_no").alias("different"))
    per_doc = whole.join(packs, "pack_no").groupBy("pack_no").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= F.col("capacity_tokens"))).alias("n_cut"), F.count_if(F.col("pieces") != F.col("different")).alias("n_twice"),
    )
    fill = filled.groupBy("pack_no", "container_no").agg(F.sum("n_tokens").alias("n"))
    per_container = fill.join(packs, "pack_no").groupBy("pack_no").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("n_over"), (F.max("container_no") - F.count(F.lit(1))).alias("n_gaps"))
    return per_doc.join(per_container, "pack_no")


def p8_sound(spark: SparkSession, sf: str) -> DataFrame:
    """What must not be among the subjects: unknown names, rows twice, rows of posts without text."""
    found, names = written(p8_found(spark, sf)), _t(spark, sf, "subjects").select("subject")
    unknown = found.join(names, "subject", "left_anti").select(F.lit("n_unknown").alias("fault"))
    twice = found.groupBy("doc_id", "subject").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("n_twice").alias("fault"))
    blank = _t(spark, sf, "documents").where("trim(coalesce(text, '')) = ''").select("doc_id")
    silent = found.join(blank, "doc_id", "left_semi").select(F.lit("n_blank").alias("fault"))
    return unknown.unionByName(twice).unionByName(silent).agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("n_unknown", "n_twice", "n_blank")])


QUERIES = {f.__name__: f for f in (p5_found, p5_last_batch, p5_sound, p6_ids, p6_round_trip, p6_decoded, p7_packed, p7_summary, p7_sound, p8_found, p8_composition, p8_sound)}
#: SQL has neither tokens nor own words nor a model; it states what must hold of their results.
ORACLE: dict[str, str] = {
    "p5_sound": "SELECT 0 AS n_unordered, 0 AS n_twice, 0 AS n_chained, 0 AS n_missed_copies",
    "p6_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "p7_sound": "SELECT pack_no, (SELECT count(*) FROM documents) AS n_docs, 0 AS n_cut, 0 AS n_twice, 0 AS n_over, 0 AS n_gaps FROM pack_sizes",
    "p8_sound": "SELECT 0 AS n_unknown, 0 AS n_twice, 0 AS n_blank",
}
