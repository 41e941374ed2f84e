"""Token files encode few characters at once, however long the texts of a batch are."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from folioforge.llm import token_files
from folioforge.llm.queries import vocabulary


def test_few_characters_are_encoded_at_once():
    texts = ["word " * 1000] * 3000
    batch = pa.record_batch({"doc_id": pa.array(range(3000)), "text": texts})
    portions = list(token_files.joined(iter([batch, batch]), token_files.AT_ONCE))
    assert [i for ids, _ in portions for i in ids] == [*range(3000)] * 2
    assert sum((t for _, t in portions), []) == texts * 2
    assert max(sum(map(len, t)) for _, t in portions) <= 8_000_000 + 5000
    assert [len(t) for _, t in token_files.joined(iter([batch]), 1)] == [1] * 3000


def test_ids_do_not_depend_on_portions(spark, monkeypatch):
    draw = random.Random(2)
    docs = [(k, " ".join(draw.choices(["a", "token", "of", "texts,", "", "né", "x\n"], k=draw.randrange(60)))) for k in range(300)]
    rows = spark.createDataFrame([*docs, (300, None)], "doc_id long, text string").repartition(3)

    def read():
        folder = token_files.write_documents(rows, vocabulary("byte_bpe_50k.json"), 2)
        return token_files.read_documents(spark, folder, with_ids=True).withColumn("token_ids", F.to_json("token_ids")).orderBy("doc_id").collect()

    want = read()
    assert len(want) == 301
    monkeypatch.setattr(token_files, "AT_ONCE", 500)
    assert read() == want
