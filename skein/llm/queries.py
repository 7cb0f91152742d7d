"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import credentials, neardup, pack, pii, split, subjects, tokens, vectors
from skein.session import cut
from skein.tables import one_per_id, slug, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.secrets_in(table(spark, sf_dir, "memories")).select("id", "secret").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.redact_secrets(one_per_id(table(spark, sf_dir, "memories").select("id", "content")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "memories").select("id", "project", "content")
    return neardup.similar_pairs(rows, "id", "content", slug(F.col("project"))).toDF("id_a", "id_b")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "memories").select("id", "project", "content")
    return neardup.similar_groups(rows, "id", "content", slug(F.col("project")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.details_in(table(spark, sf_dir, "memories")).select("id", "pii_type", "pii_text").distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact_details(one_per_id(table(spark, sf_dir, "memories").select("id", "content")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors.nearest(table(spark, sf_dir, "query_cache"), "text_hash", "embedding", least=0.8)
    return near.select(F.least("text_hash", "other").alias("hash_a"), F.greatest("text_hash", "other").alias("hash_b")).distinct()


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "query_cache"), "text_hash", "embedding")


def p4_nearest_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", dim=64)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = split.oversized_blocks(table(spark, sf_dir, "memories"), "id", "content")
    chunks = split.oversized_blocks(table(spark, sf_dir, "text_chunks"), "chunk_id", "text", "start_line")
    return memories.toDF("item_id", "line_no").unionByName(chunks.toDF("item_id", "line_no")).distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = split.split_items(one_per_id(table(spark, sf_dir, "memories").select("id", "content")), "id", "content")
    chunks = split.split_items(table(spark, sf_dir, "text_chunks").select("chunk_id", "text", "start_line").distinct(), "chunk_id", "text", "start_line")
    names = ("item_id", "piece_no", "text", "start_line", "end_line")
    return memories.toDF(*names).withColumn("source", F.lit("memories")).unionByName(chunks.toDF(*names).withColumn("source", F.lit("text_chunks")))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, same) of every document: whether its ids decode to its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = tokens.encode_texts(docs, "doc_id", "text")
    back = tokens.decode_ids(ids, "doc_id").withColumnRenamed("text", "decoded")
    sizes = ids.select("doc_id", F.size("ids").alias("n_tokens"))
    return docs.join(back, "doc_id").join(sizes, "doc_id").select("doc_id", "n_tokens", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = cut(tokens.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text", lengths=True))
    return pack.pack(sizes, "doc_id", "n_tokens", 2048)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: how many containers, how full, and how many documents were split."""
    placed = p7_containers(spark, sf_dir)
    per = placed.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    split_docs = placed.filter("piece_no = 1").select(F.count(F.lit(1)).alias("split_documents"))
    total = per.agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"))
    return total.withColumn("fill", F.col("tokens") / (F.col("containers") * 2048)).crossJoin(F.broadcast(split_docs))


def p8_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"), table(spark, sf_dir, "subject_areas"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "doc_labels").select("doc_id").distinct()
    return p8_subjects(spark, sf_dir).select("doc_id", "subject").join(labelled, "doc_id", "left_anti")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, documents) over the whole corpus."""
    return p8_subjects(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_redacted": p3_redacted,
    "p4_found": p4_found,
    "p4_nearest": p4_nearest,
    "p4_nearest_embeddings": p4_nearest_embeddings,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p6_ids": p6_ids,
    "p6_round_trip": p6_round_trip,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_subjects": p8_subjects,
    "p8_composition": p8_composition,
}

#: Only what plain SQL can say over whole tables; the tests hold the other queries against brute force.
SQL: dict[str, str] = {
    "p2_found": r"""
        WITH m AS (
          SELECT DISTINCT id, nullif(trim(regexp_replace(lower(project), '[^a-z0-9]+', '-', 'g'), '-'), '') AS g,
                 list_distinct(list_filter(string_split_regex(lower(coalesce(content, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS w
          FROM memories)
        SELECT a.id AS id_a, b.id AS id_b FROM m a JOIN m b ON a.g IS NOT DISTINCT FROM b.g AND a.id < b.id
        WHERE len(a.w) > 0 AND 5 * len(list_intersect(a.w, b.w)) >= 4 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))""",
}
