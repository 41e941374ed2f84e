"""New words are encoded many as one text, and get the ids that each text has by itself."""

import random

import pyarrow as pa

from folioforge.llm import token_files
from folioforge.llm.queries import vocabulary


class Watched:
    """A tokenizer that counts the texts it gets."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def made(n):
    draw = random.Random(7)
    word = lambda: "".join(draw.choices("abcdefghijklmnoprstuvæøå0123456789😀", k=draw.randint(1, 12)))
    marks = ["", "", "", ",", ".", "'s", "\n", "\n\nx", "|", "-y", "\t", "\x1c", " ", "<|endoftext|>", "…", "!?", "_"]
    return [" ".join(word() + draw.choice(marks[: draw.choice((3, 17))]) for _ in range(draw.randint(0, 40))) for _ in range(n)] + ["", " ", "  ", "\n", " a", "a ", "  a, b", "   a. b\nc", "x, y  a,", None]


def test_ids_are_those_of_the_whole_texts():
    for as_text in (False, True):
        encoder = token_files.TextEncoder(vocabulary("byte_bpe_50k.json"), as_text)
        texts = made(600)
        for part in (texts[:200], texts[200:], texts):
            want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]
            assert [list(memoryview(x).cast("I")) for x in encoder.encode(part)] == want


def test_a_full_cache_and_no_sizes_change_nothing(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE", 50)
    encoder = token_files.TextEncoder(vocabulary("byte_bpe_50k.json"))
    texts, plain = made(300), token_files.TextEncoder(vocabulary("byte_bpe_50k.json"))
    plain.sizes = None
    assert encoder.encode(texts) == plain.encode(texts) == encoder.encode(texts)


def test_a_piece_has_one_key():
    for piece in ("a", " a", "  a", "   a", " ", "  ", "\n", " \n", ","):
        assert token_files.piece_of(token_files.key_of(piece)) == piece


def test_few_texts_are_encoded():
    encoder = token_files.TextEncoder(vocabulary("byte_bpe_50k.json"))
    encoder.tokenizer = Watched(encoder.tokenizer)
    encoder.encode([" ".join(f"w{k}q{k * k}" for k in range(5000))] * 3)
    assert encoder.tokenizer.texts < 100


def test_white_space_is_that_of_python():
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    assert token_files.blank_ended(pa.array(["", *letters], pa.large_string())).tolist() == [True, *[c.isspace() for c in letters]]
