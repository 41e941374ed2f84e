"""Large groups of longer near copies: buckets of the near-dedup send on trees of the pairs still open, not the pairs."""

import random

from folioforge.llm import simhash
from tests.llm.test_similar_sets import WORDS, exact_groups, groups

DRAW = random.Random(8)


def loose_copies(n, length=150, apart=5):
    """Texts of one text's sentences, some of them written anew in each: about as many pairs under 0.8 as over it."""
    base, out = DRAW.choices(WORDS, k=length), []
    for _ in range(n):
        words, at = list(base), DRAW.randrange(length - apart)
        words[at : at + apart] = DRAW.choices(WORDS, k=apart)
        out.append(" ".join(words[: length - DRAW.randrange(20)]))
    return out


def test_open_pairs_are_sent_on_as_trees(spark):
    n = 80
    docs = spark.createDataFrame(list(enumerate(loose_copies(n))), "doc_id long, text string")
    docs = docs.select("doc_id", "text", *simhash.keys_of_rows("doc_id", "text"))
    marked = simhash.prefixes(docs, 5, 0.8).localCheckpoint()
    tokens = marked.where("prefix is not null").selectExpr("fp", "posexplode(prefix) as (at, token)")
    often = tokens.groupBy("token").count().where("count > 1").withColumnRenamed("count", "n")
    shared = tokens.join(often, "token").select("token", "n", "at", "fp").coalesce(1).localCheckpoint()
    pairs = simhash.other_pairs(shared, spark.createDataFrame([], "node binary, root binary"), marked, 0.8).collect()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = [int.from_bytes(p[k][40:44], "little") for p in pairs for k in ("a", "b")]
    assert ends and min(ends) >= simhash.MANY
    assert 0 < len(pairs) <= partitions * (n - 1)


def test_trees_lose_no_link(spark, monkeypatch):
    texts = loose_copies(60) + loose_copies(40, 200, 8) + [" ".join(DRAW.choices(WORDS, k=DRAW.randint(55, 75))) for _ in range(5)]
    texts += [" ".join(t.split()[:-9]) for t in texts[-5:]]
    want = exact_groups(texts)
    assert 2 < len(set(want)) < 90
    assert groups(spark, texts) == want
    # without links within the radius, all are found in trees
    monkeypatch.setattr(simhash, "first_earlier", lambda fps, ends, radius: simhash.np.arange(len(fps)))
    assert groups(spark, texts) == want
    monkeypatch.setattr(simhash, "TREE_ROWS", 9)
    assert groups(spark, texts) == want
