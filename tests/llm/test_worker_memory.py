"""Python workers that wait for tasks hold neither vocabularies nor freed memory of earlier tasks."""

import pyarrow as pa
from pyspark.sql import functions as F

from folioforge.llm import bpe
from folioforge.llm.common import lean
from folioforge.llm.queries import vocabulary


def held(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([bpe.encoder.cache_info().currsize] * batch.num_rows, pa.int64())], names=["n"])


def test_waiting_workers_hold_no_vocabulary(spark):
    import public_tokenizers

    ranks, pattern = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.range(40, numPartitions=4).select(F.col("id").alias("doc_id"), F.format_string("text number %d", "id").alias("text"))
    decoded = bpe.decode_documents(bpe.encode_documents(docs, ranks, pattern), ranks, pattern)
    assert decoded.where(F.col("decoded").cast("string") == F.format_string("text number %d", "doc_id")).count() == 40
    assert spark.range(40, numPartitions=4).mapInArrow(held, "n long").agg(F.max("n")).first()[0] == 0


def test_memory_goes_back_when_a_task_ends_or_fails(monkeypatch):
    from folioforge.llm import common

    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    assert list(lean(lambda batches: (b for b in batches))(iter("ab"))) == ["a", "b"] and given == [1]

    def broken(batches):
        yield next(batches)
        raise ValueError("broken")

    try:
        list(lean(broken)(iter("ab")))
    except ValueError:
        pass
    assert given == [1, 1]
