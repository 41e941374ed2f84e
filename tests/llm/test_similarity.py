"""SimHash, license scans and the pipeline against plain code and on awkward rows."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from folioforge.llm import decontam, licenses, secrets, simhash
from folioforge.llm.common import table
from folioforge.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(prints, radius):
    """Smallest id reachable; ids may repeat."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints():
    for text in (None, "", " \t\n", "one", "One two", "a b c", "A B C d E f\x0bg h é Ü", "x y " * 9000):
        assert int.from_bytes(simhash.fingerprint(simhash.shingle_hashes(text, 3)), "little") == plain_print(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_forest_equals_brute_force(radius, monkeypatch):
    monkeypatch.setattr(simhash, "ACROSS", 128)
    draw = random.Random(radius)
    seeds = [draw.getrandbits(64) for _ in range(30)]
    prints = [s ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 3))) for s in draw.choices(seeds, k=500)]
    sizes = [1, 2, 64, 65, 200, 168]
    ends = np.repeat(np.cumsum(sizes), sizes)
    bits = np.unpackbits(np.array(prints, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    labels = simhash.forest(bits, ends, radius)
    begin = 0
    for size in sizes:
        want = groups_of({k: prints[k] for k in range(begin, begin + size)}, radius)
        assert [int(x) for x in labels[begin : begin + size]] == [want[k] for k in range(begin, begin + size)]
        begin += size


def test_exact_tables_miss_no_pair():
    tables = simhash.exact_tables(list(range(64)), 2)
    draw = random.Random(1)
    for _ in range(500):
        flipped = set(draw.sample(range(64), 2))
        assert any(not flipped & set(t) for t in tables)


def test_components(spark):
    draw = random.Random(2)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)]
    named = lambda k: bytes([k >> 8, k & 255])
    rows = simhash.components(spark.createDataFrame([(bytearray(named(a)), bytearray(named(b))) for a, b in edges], "a binary, b binary")).collect()
    root = {bytes(r.node): bytes(r.root) for r in rows}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            todo += [x for x in near[todo.pop()] if x not in seen and not seen.add(x)]
        assert root.get(named(start), named(start)) == named(min(seen))


ODD = [(5, None), (2, ""), (9, " \n"), (None, "null id text here now"), (4, "null ID text here now"), (7, "same words " * 3000), (7, "same words " * 3000), (8, "same words " * 3000)]


def test_simhash_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'x' fp", "1 component_id")
    rows = simhash.contract_links(docs).collect()
    assert len(rows) == len(ODD)
    got = {r.doc_id: r.component_id for r in rows}
    assert got == {5: 2, 2: 2, 9: 2, None: 4, 4: 4, 7: 7, 8: 7}
    assert simhash.contract_links(docs.limit(0)).count() == 0


def test_hot_buckets_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 4)
    docs = table(spark, SMALL, "documents")
    want = {r.doc_id: r.component_id for r in simhash.contract_links(docs).collect()}
    assert want == groups_of({r.doc_id: plain_print(r.text) for r in docs.collect()}, 2)
    assert simhash.similar_texts(docs).count() == docs.count()


def test_op9_whole_table(spark):
    prints = {r.doc_id: plain_print(r.text) for r in table(spark, SMALL, "documents").collect()}
    rows = QUERIES["op9_simhash"](spark, SMALL).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == groups_of(prints, 2)


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_similar_texts_are_found_and_others_left(spark):
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 8))) for _ in range(3000)]
    rows, pairs = [], []
    for k in range(0, 400, 2):
        text = draw.choices(words, k=draw.randint(150, 600))
        near = list(text)
        for at in draw.sample(range(len(near)), max(1, len(near) // 80)):
            near[at] = draw.choice(words)
        rows += [(k, " ".join(text)), (k + 1, " ".join(near))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        if len(a & b) / len(a | b) >= 0.85:
            pairs.append(k)
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 100
    assert sum(got[k + 1] == k for k in pairs) >= 0.97 * len(pairs)
    assert all(got[k] == k for k in range(0, 400, 2))


def plain_licenses(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    more = {}
    for line in low.split("\n"):
        have = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line))
        for t in licenses.templates_of(licenses.TEMPLATES, 0.9):
            if len(have & set(t.words)) >= t.need:
                more[t.label] = max(more.get(t.label, 0), len(have & set(t.words)) / len(t.words))
    return len(words), places, more


LICENSED = [
    (1, None),
    (2, ""),
    (3, "Under the MIT license. under the  mit-license\nAPACHE License, Version 2.0; cc by nc"),
    (4, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."),
    (5, "UNDER THE MİT LICENSE under the mit license Kfoo"),
    (5, "Licensed under CC BY-NC 4.0."),
    (None, "This work is licensed under the GNU General Public License, version 3."),
    (7, "word " * 30_000 + "cc by nc by nc cc by nc"),
    (8, "...!!!"),
    (9, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files"),
]


def test_licenses_of_odd_rows(spark):
    docs = spark.createDataFrame(LICENSED, "doc_id long, text string").selectExpr("*", "'x' key", "1 n_words", "2 places")
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(LICENSED)
    want = sorted((str(i), n, sorted(p), sorted(m), 1.0 if p else round(max(m.values(), default=0.0), 9)) for i, t in LICENSED for n, p, m in [plain_licenses(t)])
    assert sorted((str(r.doc_id), r.n_words, sorted(map(tuple, r.places)), list(r.more), round(r.score, 9)) for r in rows) == want
    assert licenses.scan(docs.limit(0)).count() == 0


def test_op10_whole_table(spark):
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    rows = QUERIES["op10_license_scan"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, places, more = plain_licenses(texts[r.doc_id])
        base = sorted({label for _, label in places})
        assert (r.n_words, r.n_base, r.base_labels, r.labels) == (n, len(places), ",".join(base), ",".join(sorted({*base, *more})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))


def test_stages_and_run(spark):
    docs = table(spark, SMALL, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    columns, left = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, SMALL)
        kept[name] = {r.doc_id: r for r in left.collect()}
        if name != "bpe":
            assert left.columns == columns
    assert [len(k) for k in kept.values()] == sorted([len(k) for k in kept.values()], reverse=True)
    # decontamination: what went holds an item, what stayed holds none word for word
    items = [decontam.normalised(r.text) for r in table(spark, SMALL, "benchmark").collect()]
    assert all(not any(i in decontam.normalised(r.text) for i in items) for r in kept["decontamination"].values())
    gone = set(kept["simhash_dedup"]) - set(kept["decontamination"])
    assert gone and all(any(i in decontam.normalised(texts[d]) for i in items) for d in gone)
    # near-dedup: exact copies go, the first stays
    first = {}
    for d in sorted(kept["language_id"]):
        first.setdefault(texts[d], d)
    assert set(kept["simhash_dedup"]) <= set(first.values())
    # secrets are masked, nothing else changes
    ready = secrets.compiled(secrets.RULES)
    for d, r in kept["secret_scan"].items():
        assert not secrets.find(r.text, ready) and r.n_chars == len(r.text)
        assert r.text == texts[d] or secrets.find(texts[d], ready)
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in kept["bpe"].values())
    assert {r.doc_id for r in QUERIES["pipeline"](spark, SMALL).collect()} == set(kept["bpe"])


def test_stages_on_odd_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, spans string"
    rows = [(1, None), (2, ""), (3, "the and of " * 20_000), (4, "token=abcdefgh12 text"), (4, "token=abcdefgh12 text"), (None, "token=abcdefgh12 text"), (None, None)]
    odd = spark.createDataFrame([(i, t, "en", "s", None, "x") for i, t in rows], kind)
    for docs in (odd, odd.limit(0)):
        left = docs
        for name, stage in corpus_pipeline.STAGES:
            left = stage(spark, left, SMALL)
            assert name == "bpe" or left.columns == docs.columns
            left.count()
    once = corpus_pipeline.keep_one_of_each_group(spark, odd, SMALL).collect()
    assert sorted(r.doc_id for r in once) == [1, 3, 4]
    assert F.lit(1) is not None


@pytest.mark.parametrize("radius", [0, 3, 20])
def test_first_earlier_equals_brute_force(radius, monkeypatch):
    monkeypatch.setattr(simhash, "ACROSS", 128)
    draw = random.Random(radius)
    seeds = [draw.getrandbits(128) for _ in range(12)]
    prints = [s ^ sum(1 << b for b in draw.sample(range(128), draw.randint(0, 12))) for s in draw.choices(seeds, k=400)]
    sizes = [1, 3, 64, 132, 200]
    ends = np.repeat(np.cumsum(sizes), sizes)
    raw = np.frombuffer(b"".join(p.to_bytes(16, "little") for p in prints), np.uint8).reshape(-1, 16)
    got = simhash.first_earlier(np.unpackbits(raw, axis=1, bitorder="little"), ends, radius)
    for j in range(len(prints)):
        begin = max((e for e in np.cumsum(sizes) if e <= j), default=0)
        assert got[j] == next((i for i in range(begin, j) if (prints[i] ^ prints[j]).bit_count() <= radius), j)
