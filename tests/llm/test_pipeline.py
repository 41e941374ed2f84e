"""Every stage of the corpus pipeline, and the whole run, against plain code on a small data set."""

import random
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

import corpus_pipeline
from folioforge.llm import bpe, decontam, langid, secrets
from folioforge.llm.common import table
from folioforge.llm.queries import QUERIES, vocabulary

SMALL = "/root/testdata/sf0.001"
RATE = 0.08


def edited(text, n, draw):
    """``text`` with n letters replaced, apart from each other."""
    places = [k for k, c in enumerate(text) if c.isalpha() and c.isascii()]
    out = list(text)
    for k in draw.sample(places[::3], n):
        out[k] = "q" if out[k].lower() != "q" else "x"
    return "".join(out)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Folder, documents (id, text) and items: the smallest data with rows that make each stage decide."""
    draw = random.Random(21)
    folder = tmp_path_factory.mktemp("world")
    docs = table(spark, SMALL, "documents")
    base = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    prose = [t for _, t, lang, _ in base if lang == base[0][2] and 900 < len(t) < 3000][:12]
    items = [r.text for r in table(spark, SMALL, "benchmark").orderBy("item_id").limit(10).collect()] + ["zebra umbrella", "q"]
    more = []

    def add(doc_id, text):
        more.append((doc_id, text, None, "planted"))

    words = prose[0].split()
    near = words[: len(words) // 2] + ["brandnew"] + words[len(words) // 2 :]
    apart = [w if k % 4 else "other" for k, w in enumerate(words)]
    for doc_id, text in ((90_000, " ".join(near)), (None, " ".join(near) + " tail"), (90_001, " ".join(apart)), (90_001, " ".join(reversed(words))), (90_001, prose[1] + " one more"), (90_001, prose[2]), (90_001, prose[2]), (None, prose[3]), (None, prose[3])):
        add(doc_id, text)
    for k, item in enumerate(items[:10]):
        budget = int(RATE * len(decontam.normalised(item)))
        clean = prose[4 + k % 6].split()
        draw.shuffle(clean)
        for n in {0, budget, budget + 3}:
            draw.shuffle(clean)
            add(91_000 + 10 * k + min(n, 9), " ".join(clean[:90]) + " " + edited(item, n, draw) + " " + " ".join(clean[90:180]))
    leak = prose[5].split()
    draw.shuffle(leak)
    add(92_000, " ".join(leak) + " Zebra, umbrella! " + " ".join(leak[:30]))  # a short item
    draw.shuffle(leak)
    add(92_001, " ".join(leak) + " zebra umbrellas")
    draw.shuffle(leak)
    add(None, " ".join(leak) + " " + items[0])  # leaked, without id
    draw.shuffle(leak)
    add(92_000, " ".join(leak) + " clean under the id of a leaked one")
    draw.shuffle(leak)
    add(93_000, " ".join(leak) + " password = abcdefgh12345 eyJhbGciOiJI." + "A" * 10_000 + ".c2lnbmF0dXJl end")
    add(93_001, "Это совсем другой язык, которого модель никогда не видела. " * 30)
    add(93_002, None)
    add(93_003, "... 123 ...")
    draw.shuffle(leak)
    add(93_004, (" ".join(leak) + " ") * 200 + " " * 1_200_000 + "x")
    schema = docs.schema
    rows = [dict(zip(("doc_id", "text", "lang", "source"), r, strict=True)) | {"n_chars": None if r[1] is None else len(r[1])} for r in base + more]
    spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), tuple((r["doc_id"], r["text"]) for r in rows), tuple(items)


def plain_vector(text, idf):
    """TF-IDF by the definition, one n-gram at a time."""
    low = text.replace("Σ", "σ").lower()
    letters = "".join(c if c.isalpha() else " " for c in low)
    stream = [32]
    for k, c in enumerate(letters):
        if c != " " or (k and letters[k - 1] != " "):
            stream.append(ord(c))
    stream.append(32)
    counts = Counter()
    for n in (1, 2, 3):
        for k in range(len(stream) - n + 1):
            h = n
            for j in range(n):
                h = ((h ^ stream[k + j]) * int(langid.MIX[j])) % 2**32
            counts[(h ^ (h >> 15)) % langid.DIMENSIONS] += 1
    v = {d: float(np.log1p(c)) * float(idf[d]) for d, c in counts.items()}
    norm = sum(x * x for x in v.values()) ** 0.5
    return {d: x / norm for d, x in v.items()}, sum(map(str.isalpha, low))


def plain_language(text, model, known={}):  # noqa: B006
    """(language, cosine, rejected) by cosines with every centroid."""
    if text not in known:
        known[text] = _plain_language(text, model)
    return known[text]


def _plain_language(text, model):
    if not text or not any(map(str.isalpha, text)):
        return "und", 0.0, True
    v, n = plain_vector(text, model.idf)
    best = max(range(len(model.owner)), key=lambda c: (sum(x * float(model.centroids[c][d]) for d, x in v.items()), -c))
    score = sum(x * float(model.centroids[best][d]) for d, x in v.items())
    return model.languages[model.owner[best]], score, 1 - score > model.limits[min(n.bit_length(), 15)]


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


@lru_cache(maxsize=None)
def plain_dedup(rows):
    """Rows that stay, as a multiset."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for j in range(len(rows)):
        for i in range(j):
            n, both = len(sets[i] & sets[j]), len(sets[i]) + len(sets[j])
            if sets[i] == sets[j] or 5 * n >= 4 * (both - n):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for k, row in enumerate(rows):
        groups.setdefault(find(k), []).append(row)
    return list(groups.values())


@lru_cache(maxsize=None)
def leaked(text, items):
    norm = decontam.normalised(text)
    for item in map(decontam.normalised, items):
        if len(item) < 40:
            if f" {item} " in f" {norm} ":
                return True
        elif norm and decontam.nearest(decontam.masks_of(item), len(item), norm, int(RATE * len(item))):
            return True
    return False


def masked(text):
    return None if text is None else secrets.redacted(text, secrets.find(text, secrets.compiled(secrets.RULES)))


def ids_of(text):
    import public_tokenizers

    return bpe.encode_text(text, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def key(row):
    return (row[0] is None, row[0] or 0, row[1] or "")


def test_language_stage(spark, world):
    folder, rows, _ = world
    model = langid.fit(table(spark, folder, "documents"))
    got = {(r.doc_id, r.text): (r.lang_pred, r.score, r.rejected) for r in langid.identify(table(spark, folder, "documents"), model).collect()}
    for row in rows:
        lang, score, rejected = plain_language(row[1], model)
        assert got[row][0] == lang and abs(got[row][1] - score) < 1e-4 and got[row][2] == rejected
    kept = corpus_pipeline.keep_known_languages(spark, table(spark, folder, "documents"), folder).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=key) == sorted((r for r in rows if not got[r][2]), key=key)
    assert not {93_001, 93_002, 93_003} & {r.doc_id for r in kept}


def test_dedup_stage(spark, world):
    folder, rows, _ = world
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each_group(spark, table(spark, folder, "documents"), folder).collect()), key=key)
    groups = plain_dedup(rows)
    assert len(got) == len(groups)
    for group in groups:
        mine = [r for r in got if r in group]
        least = min((r[0] is None, r[0] or 0) for r in group)
        assert len(mine) == 1 and (mine[0][0] is None, mine[0][0] or 0) == least  # of equal ids, any text of the group
    assert sum(r[0] == 90_001 for r in got) >= 2  # different texts under one id


def test_decontamination_stage(spark, world):
    folder, rows, items = world
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_leaked_benchmarks(spark, table(spark, folder, "documents"), folder).collect()]
    want = [r for r in rows if not leaked(r[1], items)]
    assert sorted(got, key=key) == sorted(want, key=key) and len(rows) - len(want) > 20


def test_op5_distances(spark, world):
    folder, rows, items = world
    got = {(r.doc_id, r.item_id, r.distance) for r in QUERIES["op5_decontamination"](spark, folder).collect()}
    want = set()
    for doc_id, text in rows:
        norm = decontam.normalised(text)
        for k, item in enumerate(map(decontam.normalised, items)):
            if len(item) < 40:
                hit = (0, 0) if f" {item} " in f" {norm} " else None
            else:
                hit = decontam.nearest(decontam.masks_of(item), len(item), norm, int(RATE * len(item))) if norm else None
            if hit:
                want.add((doc_id, k, hit[0]))
    assert got == want and len({d for _, _, d in got}) > 3


def test_several_blocks_of_items(spark, world, monkeypatch):
    folder, rows, items = world
    whole = sorted(map(str, QUERIES["op5_decontamination"](spark, folder).collect()))
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 700)
    assert sorted(map(str, QUERIES["op5_decontamination"](spark, folder).collect())) == whole
    got = corpus_pipeline.drop_leaked_benchmarks(spark, table(spark, folder, "documents"), folder).count()
    assert got == sum(not leaked(t, items) for _, t in rows)


def test_secret_stage(spark, world):
    folder, rows, _ = world
    got = [(r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.mask_secrets(spark, table(spark, folder, "documents"), folder).collect()]
    want = [(d, masked(t), None if t is None else len(masked(t))) for d, t in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert not any("A" * 20 in (t or "") for _, t, _ in got if t != dict(rows).get(93_004))
    without = table(spark, folder, "documents").drop("n_chars").withColumnRenamed("source", "spans")
    assert corpus_pipeline.mask_secrets(spark, without, folder).columns == without.columns


def test_bpe_stage(spark, world):
    folder, rows, _ = world
    got = sorted(((r.doc_id, r.token_ids) for r in corpus_pipeline.tokenize(spark, table(spark, folder, "documents"), folder).collect()), key=str)
    assert got == sorted(((d, ids_of(t)) for d, t in rows), key=str)


def test_run(spark, world):
    folder, rows, items = world
    model = langid.fit(table(spark, folder, "documents"))
    left = tuple(r for r in rows if not plain_language(r[1], model)[2])
    # of equal least ids the text's hash decides, which plain code leaves open
    groups = []
    for group in plain_dedup(left):
        least = min((r[0] is None, r[0] or 0) for r in group)
        groups.append({r for r in group if (r[0] is None, r[0] or 0) == least})
    got = sorted(((r.doc_id, tuple(r.token_ids), r.n_tokens, r.round_trip) for r in corpus_pipeline.run(spark, folder).collect()), key=str)
    assert all(n == len(ids) and same for _, ids, n, same in got)
    shown = Counter((d, ids) for d, ids, _, _ in got)
    for group in groups:
        choices = {(d, tuple(ids_of(masked(t)))) for d, t in group if not leaked(t, items)}
        if len(choices) < len(group) and choices:
            continue  # which of the group went is open
        assert sum(shown[c] for c in choices) >= bool(choices)
    sure = [g for g in groups if len(g) == 1]
    want = Counter((d, tuple(ids_of(masked(t)))) for g in sure for d, t in g if not leaked(t, items))
    assert not want - shown and len(got) <= len(groups) and sum(want.values()) > 150
