"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import bpe, decontam, langid, licenses, secrets, sharding, simhash, token_files, topk, warc
from folioforge.llm.common import table

END_ID = 2


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, which every node has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 8)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), END_ID)
    return token_files.read_documents(spark, folder)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.session_ledger(spark))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secrets.BASE_RULES]))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, pattern)
    decoded = bpe.decode_documents(encoded, ranks, pattern)
    return decoded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), bpe.id_digest(F.col("token_ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read_folder(spark, warc.write_pages(table(spark, sf_dir, "pages")), with_payload=False)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return found.where("kind = 'record'").select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.contract_links(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(_hex_of("fp")).alias("fingerprint"), "component_id")


def _hex_of(name: str):
    """Hexadecimal digits of a little-endian number: its bytes from the last to the first."""
    digits = F.hex(name)
    return F.array_join(F.transform(F.sequence(F.lit(15), F.lit(1), F.lit(-2)), lambda i: F.substring(digits, i, F.lit(2))), "")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    starts = F.transform("places", lambda p: p["start"].cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, "more")), ",").alias("labels"),
        "score",
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_token_files, op3_language_id, op4_secret_scan, op5_decontamination, op6_bpe, op7_top_k, op8_warc, op9_simhash, op10_license_scan, pipeline)
}

SQL: dict[str, str] = {
    "op7_top_k": """
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS query_id, a.q AS asked, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op8_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
                   sha1(coalesce(html, '')) AS payload_digest
            FROM pages
        ), g AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS last FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
        FROM g""",
}
