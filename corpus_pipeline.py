"""A corpus pipeline of five stages, each calling an operator of ``folioforge.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import bpe, decontam, langid, secrets, simhash
from folioforge.llm.common import lean, slices, table, written
from folioforge.llm.queries import vocabulary


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents too far from every centroid, and those without letters, go.

    Null and empty texts go, as they have no letters; ids, repeats and further columns play no part.
    """
    return langid.accepted(docs, langid.fit(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group of similar texts one row stays, the first by id.

    Rows without id come last, equal ids are told apart by a hash of the text, and of rows that repeat
    both one stays; so no text goes because another one has its id. Null and empty texts are one group.
    """
    return simhash.one_of_each(docs)


def drop_leaked_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: rows whose text holds a benchmark item within its error budget go.

    Each row is judged by its own text, whatever its id; null and empty texts stay.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: every finding is replaced by the name of its kind, and n_chars, if any, counted again; all rows stay.

    Findings belong to texts, not ids; null texts stay null. Only texts that the application's ledger
    lacks are scanned.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    found = secrets.scan(docs.select("text"), secrets.session_ledger(spark), id_cols=())
    named = found.where(F.size("spans") > 0).groupBy("digest").agg(F.first("spans").alias("spans"))
    rows = docs.select(F.struct("*").alias("row"), digest.alias("digest"))
    joined = rows.join(named, "digest", "left").select("row", "spans")
    names, at = docs.columns, docs.columns.index("text")
    counted = names.index("n_chars") if "n_chars" in names else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns, marks = batch.column(0).flatten(), batch.column(1).to_pylist()
            changed = {k: mark for k, mark in enumerate(marks) if mark}
            if changed:
                texts = columns[at].to_pylist()
                for k, mark in changed.items():
                    texts[k] = secrets.redacted(texts[k], [(s["kind"], s["start"], s["end"]) for s in mark])
                columns[at] = pa.array(texts, columns[at].type)
                if counted is not None:
                    lengths = columns[counted].to_pylist()
                    for k in changed:
                        lengths[k] = len(texts[k])
                    columns[counted] = pa.array(lengths, columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(lean(work), docs.schema)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: doc_id, token_ids, n_tokens and whether the decoded bytes hash like the text.

    Null texts are empty; rows without id and repeated rows have a row each; further columns are left out.
    """
    import public_tokenizers

    ranks, pattern = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    keyed = docs.select(F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256")).alias("key"), "text")
    decoded = bpe.decode_documents(bpe.encode_documents(keyed, ranks, pattern, id_col="key"), ranks, pattern)
    return decoded.select(F.col("key.doc_id").alias("doc_id"), F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", (F.sha2("decoded", 256) == F.col("key.text_sha256")).alias("round_trip"))


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_dedup", keep_one_of_each_group),
    ("decontamination", drop_leaked_benchmarks),
    ("secret_scan", mask_secrets),
    ("bpe", tokenize),
]

#: SQL cannot express the stages; ``tests/llm/test_pipeline.py`` holds each, and ``run``, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
