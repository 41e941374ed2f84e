"""Texts of millions of characters, and findings longer than any bound."""

import re

import numpy as np
import pytest

from folioforge.llm import bpe, langid, licenses, secrets, simhash, token_files
from folioforge.llm.queries import vocabulary

MILLIONS = 5_000_000


def ranks():
    import public_tokenizers

    return vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.mark.parametrize("text", [" " * MILLIONS, "word" + "\n" * MILLIONS + "end", "a  b" + " \t" * (MILLIONS // 2)], ids=["spaces", "line ends", "mixed"])
def test_bpe_of_long_white_space(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = bpe.decode_documents(bpe.encode_documents(docs, *ranks()), *ranks()).first()
    assert bytes(row.decoded) == text.encode()
    # what the library gives for a shorter run, from which the ids go on alike
    short = text.replace(" " * MILLIONS, " " * 600_000).replace("\n" * MILLIONS, "\n" * 600_000).replace(" \t" * (MILLIONS // 2), " \t" * 300_000)
    assert bpe.encode_text(short, *ranks()) == bpe.encoder(*ranks()).encode_ordinary(short)


def test_white_space_runs_keep_the_ids():
    plain = bpe.encoder(*ranks())
    pieces = [" ", "  ", "\n", "\t", chr(0xA0), chr(0x2003), chr(0x1C), chr(0x85), "a", "word", "'s", "1", ".", "é", chr(0x3000), "   \n  "]
    draw = np.random.default_rng(4)
    for _ in range(3000):
        text = "".join(draw.choice(pieces, draw.integers(0, 14)))
        got = []
        for part, blank in bpe.parts_of(text, 3):
            got += plain._encode_single_piece(part) if blank else plain.encode_ordinary(part)
        assert got == plain.encode_ordinary(text)


def test_token_ids_of_long_white_space_and_special_tokens():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = [" " * 400_000, "x" + " y " * 100_000, " " * 300_000 + "x", "a <|endoftext|> b", "a<|endoftext|><|endoftext|>b c", "<|endoftext|", "\n" * 200_000 + "<|endoftext|>"]
    coder = token_files.TextEncoder(vocabulary("byte_bpe_50k.json"))
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    plain.encode_special_tokens = True
    coder = token_files.TextEncoder(vocabulary("byte_bpe_50k.json"), special_as_text=True)
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(token_files.cut(" " * MILLIONS + "x y")) == 2


LONG_FINDINGS = {
    "jwt": "eyJhbGciOiJI." + "A" * 10_000 + ".c2lnbmF0dXJl",
    "login": "https://me:" + "p" * 500 + "@host",
    "forge": "ghp_" + "a1" * 400,
    "chat": "xoxb-" + "12-ab" * 200,
    "pem": "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n" + ("QUJD" * 16 + "\n") * 2000 + "QQ==\n-----END RSA PRIVATE KEY-----",
}


@pytest.mark.parametrize("kind", sorted(LONG_FINDINGS))
def test_no_finding_is_too_long(kind):
    secret = LONG_FINDINGS[kind]
    text = f"before {secret} behind"
    spans = [s for s in secrets.find(text, secrets.compiled(secrets.RULES)) if s[0] == kind]
    end = 7 + len(secret) - 4 * (kind == "login")
    assert spans == [(kind, 7, end)]
    left = secrets.redacted(text, spans)
    assert left.startswith("before [") and left.endswith(" behind") and len(left) < 40


def test_secrets_in_millions_of_characters():
    ready = secrets.compiled(secrets.RULES)
    for filler in ("token" + " " * 1_200_000, "eyJ" + "a" * 1_200_000, "a" * 1_200_000, "-" * 1_200_000, "-----BEGIN " * 100_000, "http://" * 200_000, "a:b@" * 300_000, "eyJaaaaaaaa." * 100_000):
        found = secrets.find(filler + "\ntoken=abcdefgh12\n", ready)
        assert ("assign", len(filler) + 1, len(filler) + 17) in found
    cut_off = "-----BEGIN PRIVATE KEY-----\n" + ("QUJD" * 16 + "\n") * 3 + "plain words follow here"
    (span,) = [s for s in secrets.find(cut_off, ready) if s[0] == "pem"]
    assert cut_off[span[2] :] == "\nplain words follow here"


def test_language_counts_do_not_depend_on_pieces(monkeypatch):
    draw, letters = np.random.default_rng(5), ["a", "B", "é", " ", "  ", ".", "1", "Σ", "İ", "ß", "x", "\n"]
    whole = "".join(draw.choice(letters, 1_200_000))
    texts = [whole, *("".join(draw.choice(letters, n)) for n in range(60))]
    counted = [langid.ngram_counts(t) for t in texts]
    monkeypatch.setattr(langid, "PIECE", 7)
    assert all((a[0] == b[0]).all() and a[1] == b[1] for a, b in zip(counted[1:], map(langid.ngram_counts, texts[1:]), strict=True))
    monkeypatch.setattr(langid, "PIECE", 1 << 24)
    assert (counted[0][0] == langid.ngram_counts(whole)[0]).all()


def test_licenses_and_fingerprints_of_millions_of_characters(spark):
    text = "word and more " * 100_000 + "\nReleased under the MIT License.\n\n" + "x" * 1_200_000
    docs = spark.createDataFrame([(1, text), (2, " " * MILLIONS)], "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert [(p.start, p.label) for p in rows[1].places] == [(300_001, "mit")] and rows[1].n_words == len(re.findall(r"\w+", text))
    assert (rows[2].n_words, rows[2].score) == (0, 0.0)
    assert {r.doc_id: r.component_id for r in simhash.contract_links(docs).collect()} == {1: 1, 2: 2}
