"""Sharding, top-k search, WARC and decontamination against plain code and on awkward rows."""

import gzip
import hashlib
import io
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import decontam, sharding, topk, warc
from folioforge.llm.common import table
from folioforge.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


def jump_one(key, buckets):
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) & 0xFFFFFFFFFFFFFFFF
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(3).integers(0, 2**64 - 1, 2000, dtype=np.uint64)
    for n in (1, 2, 8, 9, 1000):
        assert sharding.jump(keys, n).tolist() == [jump_one(int(k), n) for k in keys]
    old, new = sharding.jump(keys, 8), sharding.jump(keys, 9)
    assert set(new[old != new].tolist()) == {8}


def check_slots(rows):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_one_id_with_many_texts_is_dealt_to_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 100)
    docs = spark.range(2000).selectExpr("cast(null as long) doc_id", "concat('text ', id % 1500) text")
    rows = sharding.assign(docs, 8).collect()
    check_slots(rows)
    assert len(rows) == 2000 and len({r.shard for r in rows}) == 1
    plan = sharding.assign(docs, 8)._jdf.queryExecution().toString()
    assert "windowspecdefinition(shard" in plan and "block" in plan


def test_op1_whole_table(spark):
    keys = {r.doc_id: r.key for r in table(spark, SMALL, "documents").select("doc_id", F.xxhash64("doc_id").alias("key")).collect()}
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    rows = QUERIES["op1_sharding"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    check_slots(rows)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert (r.shard, r.grown_shard) == (jump_one(keys[r.doc_id] % 2**64, 8), jump_one(keys[r.doc_id] % 2**64, 9))


def test_shards_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 3)
    rows = [(1, None), (2, ""), (None, "x"), (None, "x"), (3, "y" * 100_000)] + [(7, "same")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 shard", "'a' slot")
    got = sharding.assign(docs, 3).collect()
    assert len(got) == len(rows)
    check_slots(got)
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    assert next((r.size, r.text_crc32) for r in got if r.doc_id == 1) == (1, 0)
    assert sharding.assign(docs.limit(0), 3).count() == 0


def brute_top(vectors, queries, k):
    good = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.setdefault(i, np.floor(256 * np.array(v, float)).astype(int))
    out = []
    for q in sorted(set(queries) & set(good)):
        dot = lambda a, b: int(sum(x * y for x, y in zip(a, b, strict=False)))
        best = sorted(((-dot(good[q], v), i) for i, v in good.items() if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_with_ties_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "ANNULUS", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    draw = random.Random(5)
    rows = [(i, [draw.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 6) for i in range(200)]  # one very common vector
    rows += [(900, None), (901, [1.0, None]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (None, [1.0] * 6), (904, []), (905, [9.0]), (906, [0.0] * 6), (300, [0.5] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 rank", "2 score")
    got = topk.top_k(vectors, vectors.where("vec_id % 25 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, [i for i, _ in rows if i is not None and i % 25 == 0], 5)
    few = vectors.where("vec_id < 3")
    assert len(topk.top_k(few, few, 5).collect()) == 6
    assert topk.top_k(few.limit(0), few.limit(0), 5).count() == 0


def test_top_k_of_repeats_equals_its_sql(spark, tmp_path):
    rows = [(50, [1.0, 2.0]), (50, [1.0, 2.0]), (100, [1.0, 2.0]), (100, [3.0, -1.0]), (7, [2.0, 2.0]), (7, [2.0, 2.0]), (8, [2.0, 2.0]), (8, [-1.0, 0.5]), (9, None), (0, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = QUERIES["op7_top_k"](spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    want = duckdb.sql(SQL["op7_top_k"]).select("query_id", "rank", "vec_id", "score").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 10


def test_top_k_of_huge_values(spark):
    rows = [(0, [1e20, 1.0]), (1, [1e20, 0.0]), (2, [-1e20, 0.0]), (3, [1e19, 5.0]), (4, [1e305, 0.0]), (5, [1.7e308, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(vectors, vectors.where("vec_id = 0"), 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(4, 2**63 - 1), (1, 2**63 - 1), (3, 2**63 - 1), (2, -(2**63))]
    exact = spark.createDataFrame([(0, [2.0**25, 1.0]), (1, [2.0**20, 3.0]), (2, [2.0**20, 4.0])], vectors.schema)
    got = topk.top_k(exact, exact.where("vec_id = 0"), 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 2**61 + 4 * 65536), (1, 2**61 + 3 * 65536)]


def test_the_search_runs_in_many_tasks(spark):
    draw = np.random.default_rng(9)
    rows = [(i, draw.normal(size=4).tolist()) for i in range(400)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    spark.sparkContext.setJobGroup("search", "search")
    topk.top_k(vectors, vectors.where("vec_id % 4 = 0"), 3).collect()
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("search") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    for t in ("embeddings", "pages"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = duckdb.sql(SQL[name])
    got = QUERIES[name](spark, SMALL).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


PAGES = [(1, "http://a/\r\nx", "p" * 1500), (5, None, "p" * 1500), (9, "http://c", "p" * 1500), (9, "http://c", "p" * 1500), (2, "u", None), (3, "u", ""), (4, "u", "short"), (6, "u", "short"), (None, "u", "p" * 1500), (7, "ü", "é\r\n\r\nWARC/1.1\r\n" * 50_000)]


def test_warc_of_odd_rows(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' digest", "1 refers_to")
    folder = warc.write_pages(pages, file_bytes=2000)
    rows = warc.read_folder(spark, folder).collect()
    assert len(rows) == len(PAGES) and {r.kind for r in rows} == {"record"}
    kinds = {}
    for r in rows:
        kinds.setdefault(r.record_id, []).append((r.record_type, r.refers_to))
    assert kinds["<urn:page:1>"] == kinds["<urn:page:5>"] == [("revisit", "<urn:page:9>")]
    assert kinds["<urn:page:9>"] == [("response", None)] * 2 and kinds[None] == [("response", None)]
    assert kinds["<urn:page:4>"] == kinds["<urn:page:6>"] == [("response", None)]
    by_id = {f"<urn:page:{i}>": (h or "").encode() for i, _, h in PAGES}
    for r in rows:
        data = by_id.get(r.record_id, b"p" * 1500)
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert r.record_type == "revisit" or bytes(r.payload) == data
    none = warc.write_pages(pages.limit(0))
    assert warc.read_folder(spark, none).count() == 0


def archive(n=6):
    members = []
    for k in range(n):
        payload = f"page {k} ".encode() * 400
        members.append(gzip.compress(warc.page_record(k, f"http://x/{k}", payload, hashlib.sha1(payload).hexdigest(), None, "2000-01-01T00:00:00Z")))
    return members


def salvaged(data):
    return list(warc.salvage(io.BytesIO(data), len(data)))


def test_salvage_of_damaged_members():
    members = archive()
    starts = np.cumsum([0, *map(len, members)]).tolist()
    data = bytearray(b"".join(members))
    data[starts[2] + 40] ^= 0xFF
    found = salvaged(bytes(data[:-7]))  # and the last member cut off
    ids = [f.headers["warc-record-id"] for f in found if f.kind == "record"]
    assert ids == [f"<urn:page:{k}>" for k in (0, 1, 3, 4)]
    gaps = [(f.offset, f.offset + f.length) for f in found if f.kind == "gap"]
    assert gaps == [(starts[2], starts[3]), (starts[5], len(data) - 7)]
    assert all(f.reason for f in found if f.kind == "gap")


def test_salvage_of_garbage_and_plain_records():
    plain = [gzip.decompress(m) for m in archive(3)]
    wrong = plain[1].replace(b"page 1 page", b"page 1 pagE", 1)
    found = salvaged(b"\x1f\x8b\x08junk" + plain[0] + wrong + plain[2] + archive(1)[0] + b"tail")
    assert [f.kind for f in found] == ["gap", "record", "gap", "record", "record", "gap"]
    assert sum(f.length for f in found) == len(b"\x1f\x8b\x08junk" + plain[0] + wrong + plain[2] + archive(1)[0] + b"tail")
    assert salvaged(b"") == [] and [f.kind for f in salvaged(b"nothing here")] == ["gap"]


def test_several_records_in_a_member_and_small_window(monkeypatch):
    monkeypatch.setattr(warc, "STEP", 64)
    whole = gzip.compress(b"".join(gzip.decompress(m) for m in archive(3)))
    assert len([f for f in salvaged(whole + b"x" * 500 + archive(1)[0]) if f.kind == "record"]) == 4


def distance(a, b):
    """Smallest edits of a to any substring of b."""
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [row[0] + 1]
        for j, y in enumerate(b):
            row.append(min(before[j] + (x != y), before[j + 1] + 1, row[j] + 1))
    return min(row)


def test_myers_equals_dynamic_programming():
    draw = random.Random(7)
    for _ in range(300):
        a = "".join(draw.choices("abc ", k=draw.randint(1, 70)))
        b = "".join(draw.choices("abc ", k=draw.randint(0, 90)))
        want = distance(a, b)
        for budget in (0, want - 1, want, want + 3):
            got = decontam.nearest(decontam.masks_of(a), len(a), b, budget)
            assert (got[0] if got else None) == (want if want <= budget else None)


def test_matcher_equals_brute_force():
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(1, 6))) for _ in range(40)]
    items = [decontam.Item(k, decontam.normalised(" ".join(draw.choices(words, k=12))), 0) for k in range(8)]
    for i in items:
        i.budget = int(0.12 * len(i.text))
    matcher, hits = decontam.Matcher(items), 0
    for _ in range(60):
        item = draw.choice(items).text
        text = list(item)
        for _ in range(draw.randint(0, 10)):
            at = draw.randrange(len(text))
            text[at : at + 1] = draw.choice(["", "z", text[at] + "q"])
        text = decontam.normalised(" ".join(draw.choices(words, k=draw.randint(0, 8))) + " " + "".join(text) + " " + " ".join(draw.choices(words, k=draw.randint(0, 8))))
        want = {k: d for k, i in enumerate(items) if (d := distance(i.text, text)) <= i.budget}
        assert {k: d for k, d, _ in matcher.find(text)} == want
        hits += len(want)
    assert hits > 20


def test_decontamination_of_odd_rows(spark, monkeypatch):
    item = "The quick brown fox jumps over the lazy dog, and then it sleeps for a week."
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short"), (4, item), (None, "Another, quite different benchmark question with enough letters?")], "item_id long, text string")
    near = item.upper().replace("QUICK", "QUIKC").replace(",", " --")
    docs = spark.createDataFrame([(1, "x " * 50_000 + near), (1, "x " * 50_000 + near), (2, None), (3, ""), (None, item), (5, "clean text " * 30)], "doc_id long, text string").selectExpr("*", "1 item_id", "'d' distance")
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 100)
    found = decontam.matches(docs, bench).collect()
    got = sorted((str(r.doc_id), r.item_id, r.distance) for r in found)
    assert got == [("1", 1, 2), ("1", 1, 2), ("1", 4, 2), ("1", 4, 2), ("None", 1, 0), ("None", 4, 0)]
    assert decontam.matches(docs.limit(0), bench).count() == 0 and decontam.matches(docs, bench.limit(0)).count() == 0


def test_short_items_are_found_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "Wie geht's?"), (2, "..."), (3, "42")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "wie GEHT s"), (2, "Hallo! Wie geht's dir?"), (3, "wie gehts"), (4, "142 or 421"), (5, "is it 42?"), (6, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.distance) for r in decontam.matches(docs, bench).collect()) == [(1, 1, 0), (2, 1, 0), (5, 3, 0)]
    assert sorted(r.doc_id for r in decontam.clean(docs, bench).collect()) == [3, 4, 6]
    assert decontam.clean(docs, bench.limit(0)).count() == 6 and decontam.clean(docs.limit(0), bench).count() == 0


def test_op5_finds_every_verbatim_item(spark):
    docs = {r.doc_id: decontam.normalised(r.text) for r in table(spark, SMALL, "documents").collect()}
    items = {r.item_id: decontam.normalised(r.text) for r in table(spark, SMALL, "benchmark").collect()}
    got = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op5_decontamination"](spark, SMALL).collect()}
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert exact and {k for k, v in got.items() if v == 0} == exact
    assert F.lit(1) is not None
