"""The search for similar texts keeps prefixes no longer than it needs them, and each set's once."""

import os
import random

from folioforge.llm import common, simhash
from tests.llm.test_similar_sets import WORDS, exact_groups, groups

DRAW = random.Random(21)


def test_prefixes_go_before_the_search_and_copies_share_theirs(spark, monkeypatch):
    texts = [" ".join(DRAW.choices(WORDS, k=DRAW.randint(30, 90))) for _ in range(20)]
    texts = [t for t in texts for _ in range(4)] + [" ".join(t.split()[:-2]) for t in texts[:10]]
    folder, seen = common.session_dir(spark).removeprefix("file:"), {}

    def live():
        return {name.rsplit("-", 1)[0]: f"{folder}/{name}" for name in os.listdir(folder)}

    before, write = set(live().values()), common.written

    def watched(df, label, kept=None):
        if label == "links" and not seen:
            now = {k: spark.read.parquet(path) for k, path in live().items() if path not in before}
            seen.update({k: (table.columns, table.count(), table.distinct().count()) for k, table in now.items()})
        return write(df, label, kept)

    monkeypatch.setattr(simhash, "written", watched)
    assert groups(spark, texts) == exact_groups(texts)
    assert set(seen) == {"fingerprints", "distinct", "shared"}
    assert not any("prefix" in columns for columns, _, _ in seen.values())
    assert seen["shared"][1] == seen["shared"][2] > 0


def test_few_texts_are_shuffled_for_their_sets(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.format_string("text %d", "id").alias("text"))
    rows = rows.select("*", *simhash.keys_of_rows("doc_id", "text"))
    used = rows.where("doc_id % 100 = 7").select(*simhash.KEYS)
    want = list(range(7, 2000, 100))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = simhash.chosen(rows, used)
        assert "BroadcastHashJoin" in found._jdf.queryExecution().toString()
        assert sorted(r.doc_id for r in found.collect()) == want
        monkeypatch.setattr(simhash, "SLOTS", 3)
        assert sorted(r.doc_id for r in simhash.chosen(rows, used).collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
