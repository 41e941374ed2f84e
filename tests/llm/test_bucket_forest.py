"""Large groups of near copies: what the buckets of the near-dedup send on grows with their rows, not with the pairs."""

import random

from folioforge.llm import simhash
from tests.llm.test_similar_sets import exact_groups, groups

DRAW = random.Random(5)


def near_copies(n, length=40):
    """Short texts that differ from one text at an end only."""
    base = [f"w{k}" for k in range(length)]
    return [" ".join([f"h{DRAW.randrange(10**9)}", *base[1:-1], f"t{DRAW.randrange(10**9)}"]) for _ in range(n)]


def test_a_bucket_gives_a_forest(spark):
    n = 60
    texts = near_copies(n)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = docs.select("doc_id", "text", *simhash.keys_of_rows("doc_id", "text"))
    marked = simhash.prefixes(docs, 5, 0.8).localCheckpoint()
    tokens = marked.where("prefix is not null").selectExpr("fp", "posexplode(prefix) as (at, token)")
    often = tokens.groupBy("token").count().where("count > 1").withColumnRenamed("count", "n")
    shared = tokens.join(often, "token").select("token", "n", "at", "fp").localCheckpoint()
    sets = marked.dropDuplicates(["fp"])
    stars = spark.createDataFrame([], "node binary, root binary")
    pairs = simhash.other_pairs(shared, stars, sets, 0.8).collect()
    assert 0 < len(pairs) <= shared.count()
    assert len({x for p in pairs for x in (p.a, p.b)}) == sets.count() == n


def test_groups_stay_whole(spark):
    texts = near_copies(30) + [t.replace("w", "v") for t in near_copies(30)]
    assert groups(spark, texts) == exact_groups(texts)
