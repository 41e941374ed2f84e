"""The near-dedup stage's groups against exact Jaccard similarities of all pairs."""

import random

from folioforge.llm import simhash

DRAW = random.Random(11)
WORDS = ["".join(DRAW.choices("abcdefghijklmnop", k=DRAW.randint(3, 8))) for _ in range(3000)]


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def exact_groups(texts):
    """The smallest number of all texts reached by links of 0.8 or more."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for j in range(len(texts)):
        for i in range(j):
            n = len(sets[i] & sets[j])
            if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def groups(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(docs).collect()}
    return [got[k] for k in range(len(texts))]


def family(n, length, changed):
    """Variants of one text, each with a block of its own in place of ``changed`` words."""
    base, out = DRAW.choices(WORDS, k=length), []
    for _ in range(n):
        size = DRAW.randint(*changed)
        at = DRAW.randrange(length - size)
        out.append(" ".join(base[:at] + DRAW.choices(WORDS, k=size) + base[at + size :]))
    return out


def test_equal_prints_of_different_texts_are_not_linked(spark):
    line = " ".join(WORDS[:9])
    texts = [f"{line}\n" * 50 + " ".join(WORDS[a : a + 100]) for a in (100, 200)]
    assert groups(spark, texts) == exact_groups(texts) == [0, 1]


def test_repeated_lines_do_not_part_similar_sets(spark):
    words = DRAW.choices(WORDS, k=400)
    texts = [" ".join(words), " ".join(words) + ("\n" + " ".join(words[50:59])) * 100]
    assert groups(spark, texts) == exact_groups(texts) == [0, 0]


def test_pairs_at_the_threshold_are_all_found(spark):
    texts = []
    for k in range(150):
        words, new = DRAW.choices(WORDS, k=300), DRAW.choices(WORDS, k=70)
        size = DRAW.randint(24, 34)
        texts += [" ".join(words), " ".join(words + new[: 2 * size] if k % 2 else words[:100] + new[:size] + words[100 + size :])]
    want = exact_groups(texts)
    assert 40 < sum(want[k] != k for k in range(len(texts))) < 150
    assert groups(spark, texts) == want


def test_no_pair_is_lost_to_a_failed_neighbour(spark):
    texts = [t for _ in range(4) for t in family(40, 200, (5, 24))]
    want = exact_groups(texts)
    assert 4 < len(set(want)) < 120
    assert groups(spark, texts) == want


def test_hot_buckets_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 7)
    texts = [t for _ in range(2) for t in family(50, 150, (4, 22))]
    want = exact_groups(texts)
    assert 2 < len(set(want)) < 90
    assert groups(spark, texts) == want


def test_short_texts_with_a_passage_in_common(spark):
    passage, texts = WORDS[500:540], []
    for _ in range(120):
        texts.append(" ".join(DRAW.choices(WORDS, k=DRAW.randint(0, 14)) + passage + DRAW.choices(WORDS, k=DRAW.randint(0, 14))))
    texts += [" ".join(passage), "one", "one", "two words", "a b c d e", "a b c d e f"]
    want = exact_groups(texts)
    assert 3 < len(set(want)) < 120
    assert groups(spark, texts) == want
