"""BPE, token files, secrets and language ID against plain code and on awkward rows."""

import hashlib
import io
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import bpe, langid, secrets, token_files
from folioforge.llm.common import run_dir, table
from folioforge.llm.queries import QUERIES, vocabulary

SMALL = "/root/testdata/sf0.001"
LONG = "word, and ümlaut 123  \n" * 9000 + "a" * 70_000
ODD = [(1, None), (2, ""), (3, LONG), (3, LONG), (None, "null id"), (4, "  two  spaces\n\n x'll it's\t"), (5, "  é x <|endoftext|>")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("doc_id", "text", "'x' token_ids", "1 slot", "'en' lang_pred", "2.0 score")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def ranks():
    import public_tokenizers

    return vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_safe_pieces_keep_the_ids():
    encode = bpe.encoder(*ranks()).encode_ordinary
    for _, text in ODD:
        if text:
            pieces = list(bpe.safe_pieces(text, 50))
            assert "".join(pieces) == text
            assert [i for p in pieces for i in encode(p)] == encode(text)
    assert len(list(bpe.safe_pieces(LONG, 50))) > 1000


def test_bpe_round_trip(spark, odd, empty):
    encoded = bpe.encode_documents(odd, *ranks())
    rows = bpe.decode_documents(encoded, *ranks()).collect()
    assert sorted(bytes(r.decoded).decode() for r in rows) == sorted(t or "" for _, t in ODD)
    plain = bpe.encoder(*ranks())
    assert all(r.token_ids == plain.encode_ordinary(bytes(r.decoded).decode()) for r in rows)
    assert bpe.encode_documents(empty, *ranks()).count() == 0
    part = spark.createDataFrame([(1, plain.encode_ordinary("é")[:1])], "doc_id long, token_ids array<int>")
    assert bpe.decode_documents(part, *ranks()).first().decoded is not None  # half a character


def test_op6_digests(spark):
    plain = bpe.encoder(*ranks())
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    for r in QUERIES["op6_bpe"](spark, SMALL).collect():
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_are_inverse(kind):
    draw = np.random.default_rng(1)
    for top in (1, 2, 255, 256, 65_536, 2**32 - 1):
        for n in (1, 7, 64, 1000):
            ids = draw.integers(0, top, n, dtype=np.uint32)
            assert (token_files.from_planes(token_files.to_planes(ids, kind), n, kind) == ids).all()


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_file_round_trip_and_damage(kind):
    out, draw, docs = io.BytesIO(), np.random.default_rng(2), []
    writer = token_files.PlaneWriter(out, block_ids=100, kind=kind)
    for k in range(50):
        docs.append((None if k == 0 else k, draw.integers(0, 50_000, int(draw.integers(0, 450)), dtype=np.uint32)))
        writer.add(*docs[-1])
    writer.close()
    reader = token_files.PlaneReader(Source(out.getvalue()))
    read = list(reader.documents())
    assert [d for d, _, _ in read] == [d for d, _ in docs]
    assert all((a == b).all() for (_, _, a), (_, b) in zip(read, docs, strict=True))
    stream = np.concatenate([d for _, d in docs])
    assert (reader.ids(95, 330) == stream[95:330]).all() and not len(reader.ids(5, 5))
    damaged = bytearray(out.getvalue())
    damaged[token_files.HEAD.size + 3] ^= 1
    with pytest.raises(ValueError, match="block 0"):
        list(token_files.PlaneReader(Source(bytes(damaged))).documents())


def test_text_encoder_equals_the_library(monkeypatch):
    plain = tokenizer()
    texts = [t for _, t in ODD] + ["a.b,c\nd", "x \n y", "don't.s stop,\n\nNow 12.5% ... 'sx'll", "²,. é.\n²a"]
    want = [np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    coder = token_files.TextEncoder(vocabulary("byte_bpe_50k.json"))
    assert coder.encode(texts) == want and coder.encode(texts) == want
    monkeypatch.setattr(token_files, "CACHE", 2)
    assert token_files.TextEncoder(vocabulary("byte_bpe_50k.json")).encode(texts) == want


def test_token_files_of_odd_rows(spark, odd, empty):
    folder = token_files.write_documents(odd, vocabulary("byte_bpe_50k.json"), 2, file_ids=1000, block_ids=512, kind="bit")
    rows = sorted(token_files.read_documents(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    want = sorted([(d if d is not None else -1, t or "") for d, t in ODD])
    at, plain = 0, tokenizer()
    for (doc_id, text), r in zip(want, rows, strict=True):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
        assert (r.doc_id if r.doc_id is not None else -1, r.start, r.token_ids) == (doc_id, at, ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    folder = token_files.write_documents(empty, vocabulary("byte_bpe_50k.json"), 2)
    assert token_files.read_documents(spark, folder).count() == 0


def test_one_id_with_many_texts_is_dealt_to_many_tasks(spark):
    docs = spark.range(3000).selectExpr("if(id % 10 = 0, id, 7) doc_id", "concat('text ', id) text").repartition(4)
    merged = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merged, "false")  # else so little data is one task's
    try:
        folder = token_files.write_documents(docs, vocabulary("byte_bpe_50k.json"), 2)
    finally:
        spark.conf.unset(merged)
    rows = token_files.read_documents(spark, folder, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in docs.collect())
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    files = token_files.manifest(spark, folder).where("first_id <= 7 and last_id >= 7")
    assert files.count() > 1 and files.agg(F.max("n_docs")).first()[0] < 2500


def test_op2_whole_table(spark):
    plain, at = tokenizer(), 0
    rows = {r.doc_id: r for r in QUERIES["op2_token_files"](spark, SMALL).collect()}
    for d in table(spark, SMALL, "documents").orderBy("doc_id").collect():
        ids = np.array([*plain.encode(d.text, add_special_tokens=False).ids, 2], "<u4")
        r = rows[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def base_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


TRICKY = ["secret: token: abcdefghij", "password=token=abcdefgh1", "AKIAAKIA12345678901", "é API_KEY='x' apikey = \"12345678\"", "toKen=abcdefgh1", "0" * 31 + "g" + "a" * 32, "", "token=" + "f" * 100_000]


def test_secrets_on_tricky_texts():
    for text in TRICKY:
        assert [s for s in secrets.find(text, secrets.compiled(secrets.RULES)) if s[0] in ("assign", "access", "hex")] == base_spans(text)
    more = "-----BEGIN RSA PRIVATE KEY-----\nabc\n ghp_" + "a1" * 20 + " https://me:pw@host/ xoxb-1234567890 eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"
    assert {k for k, _, _ in secrets.find(more, secrets.compiled(secrets.RULES))} >= {"pem", "forge", "login", "chat", "jwt"}
    assert secrets.redacted("a token=12345678 b", [("assign", 2, 16)]) == "a [assign] b"


def test_ledger_scans_only_what_is_new(spark, empty):
    ledger = run_dir(spark, "test-ledger")
    docs = spark.createDataFrame([*enumerate(TRICKY), (90, TRICKY[0]), (None, TRICKY[0]), (91, None)], "doc_id long, text string")
    found = secrets.scan(docs, ledger)
    for r in found.collect():
        text = TRICKY[r.doc_id] if r.doc_id is not None and r.doc_id < 90 else "" if r.doc_id == 91 else TRICKY[0]
        assert [tuple(s) for s in r.spans if s.kind in ("assign", "access", "hex")] == base_spans(text)
        assert r.digest == hashlib.sha256(text.encode()).hexdigest()
    n = secrets.read_ledger(spark, ledger).count()
    assert n == len(set(TRICKY))
    secrets.scan(docs.union(spark.createDataFrame([(99, "new token=abcdefgh")], docs.schema)), ledger).count()
    assert secrets.read_ledger(spark, ledger).count() == n + 1
    assert secrets.scan(docs, ledger, rules=secrets.BASE_RULES).count() == docs.count()  # another rule version
    assert secrets.read_ledger(spark, ledger).count() == 2 * n + 1
    assert secrets.scan(empty, run_dir(spark, "test-ledger")).count() == 0


def test_op4_whole_table(spark):
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    rows = QUERIES["op4_secret_scan"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op3_language_id"](spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert sum(r.rejected for r in rows) < 0.01 * len(rows)


def test_language_of_odd_rows(spark, odd, empty):
    docs = table(spark, SMALL, "documents")
    model = langid.fit(docs)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == len(ODD) and {r.lang_pred for r in rows if not r.text} == {"und"}
    blank = langid.identify(spark.createDataFrame([(1, "123 ... 456")], "doc_id long, text string"), model).first()
    assert (blank.lang_pred, blank.score, blank.rejected) == ("und", 0.0, True)
    assert langid.fit(empty).languages == [] and langid.identify(docs, langid.fit(empty)).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty, model).count() == 0
    foreign = spark.createDataFrame([(1, "Это совсем другой язык, которого модель никогда не видела. " * 20)], "doc_id long, text string")
    assert langid.identify(foreign, model).first().rejected
    a, b = langid.ngram_counts(LONG)[0], sum(langid.ngram_counts(LONG[i : i + 1])[1] for i in range(1000))
    assert a.sum() > 0 and b > 0


def test_learning_ignores_held_out_rows(spark):
    docs = table(spark, SMALL, "documents")
    changed = docs.withColumn("lang", F.when(langid.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    assert "xx" not in langid.fit(changed).languages
