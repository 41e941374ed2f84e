"""License scans by an exact set-similarity join, with DataFrame operations only.

Texts are cut into blocks (paragraphs, which end at lines without words) and templates and blocks
become sets of words. A template of T words matches a block if a window of it, a line with the T
words behind it, contains at least ``threshold`` of the template's words: notices may be hard-wrapped.
Words are ordered by their
number of blocks in the whole corpus, rare ones first; a template of T words that needs o of them
can only be met by a block that has one of its T - o + 1 rarest words (prefix filter), has o words
of the vocabulary (length filter), and can still reach o behind the first common word (positional
filter). Candidates meet in an equi-join on a prefix word; the overlap is then counted exactly.

Texts are cut into words once: base places, and each block's words of the vocabulary, go to a written
table, from which words are counted and candidates joined. Only texts with a block that meets a template
are read again, for its windows.

Base places are where a phrase's words stand consecutively, over the words of the whole text.

Nulls count as empty texts: no words, no labels, score 0; repeated rows get equal results; an empty
table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import written

# ASCII characters that end a word, as ranges and one by one.
GAPS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
GAP_CHARS = "".join(chr(c) for c in range(0x80) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A))
#: A letter that Unicode lower-cases into ASCII, and what stands for it, so that only A-Z change.
KELVIN, STAND_IN = "K", "к"

#: Where blocks end.
BREAK = rf"\n[{GAPS}]*\n"

# The base phrases of the contract with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Wording of license notices, as published with the licenses.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike license"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Keys of texts that are broadcast at most.
FEW = 200_000


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    need: int
    length: int = 0


def templates_of(texts: Sequence[tuple[str, str]], threshold: float) -> list[Template]:
    out = []
    for label, text in texts:
        words = tuple(sorted(set(text.lower().split())))
        out.append(Template(label, words, max(1, math.ceil(threshold * len(words) - 1e-9)), len(text.split())))
    return out


def lowered(text: Column) -> Column:
    """Lower case such that no other letter becomes an ASCII one."""
    return F.lower(F.replace(text, F.lit(KELVIN), F.lit(STAND_IN)))


def words_of(low: Column) -> Column:
    """Words of a lower-case text: runs of digits, a-z and everything beyond ASCII."""
    core = F.btrim(low, F.lit(GAP_CHARS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, f"[{GAPS}]+"))


def read_once(low: Column, known: Column, phrases: Sequence[tuple[str, str]] = PHRASES) -> Column:
    """struct(base: struct(n_words, places), have) of a text: places are (start, label), found only where a cheap pattern sees a
    phrase; ``have`` holds the words of ``known`` of each block."""

    def places(w: Column) -> Column:
        out = []
        for phrase, label in phrases:
            parts = phrase.split()
            seen = low.rlike(f"[{GAPS}]+".join(parts))
            starts = F.filter(F.sequence(F.lit(0), F.size(w) - len(parts)), stands(w, parts))
            spots = F.transform(starts, labelled(label))
            out.append(F.when(seen & (F.size(w) >= len(parts)), spots).otherwise(F.array().cast("array<struct<start:int,label:string>>")))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.concat(*out).alias("places"))

    def found(blocks: Column) -> Column:
        return F.struct(bound(F.flatten(blocks), places).alias("base"), F.transform(blocks, lambda b: F.array_intersect(b, known)).alias("have"))

    # breaks hold no words, so the blocks' words are the text's
    return bound(F.transform(F.split(low, BREAK), words_of), found)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is bound to a lambda's variable, so it is computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stands(w: Column, parts: list[str]) -> Callable[[Column], Column]:
    """Whether the words ``parts`` stand in ``w`` from a place on."""
    return lambda i: reduce(and_, [F.get(w, i + k) == part for k, part in enumerate(parts)])


def labelled(label: str) -> Callable[[Column], Column]:
    return lambda i: F.struct(i.alias("start"), F.lit(label).alias("label"))


def most_in_window(block: Column, words: Column, length: Column) -> Column:
    """The most of ``words`` that stand in a line of the block and the ``length`` words behind it."""

    def most(lines: Column) -> Column:
        # inside a paragraph every line has a word, so ``length`` lines hold as many words at least
        behind = lambda i: F.slice(F.flatten(F.slice(lines, i + 2, length + 1)), F.lit(1), length)
        window = lambda line, i: F.size(F.array_intersect(F.concat(line, behind(i)), words))
        return F.array_max(F.transform(lines, window))

    return F.get(F.transform(F.array(F.transform(F.split(block, "\n"), words_of)), most), F.lit(0))


def word_order(read: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary, a fixed and short list, by number of blocks in the whole corpus, rare first."""
    counts = {r["word"]: r["count"] for r in read.select(F.explode(F.flatten("have")).alias("word")).groupBy("word").count().collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def candidates(read: DataFrame, templates: list[Template]) -> DataFrame:
    """key, no (of the block), template, label, size, need, words and length of every block and template whose sets meet the threshold.

    ``read`` has key and have (each block's words of the vocabulary).
    """
    order = word_order(read, sorted({w for t in templates for w in t.words}))
    rank = {w: k for k, w in enumerate(order)}
    prefixes = []
    for n, t in enumerate(templates):
        own = sorted(rank[w] for w in t.words)
        prefixes += [(own[i], n, t.label, i, len(own), t.need, own, list(t.words), t.length) for i in range(len(own) - t.need + 1)]
    # bounded by the templates, which are constants
    table = F.broadcast(read.sparkSession.createDataFrame(prefixes, "word int, template int, label string, at int, size int, need int, own array<int>, words array<string>, length int"))
    fewest = min(t.need for t in templates)
    ranks = F.create_map(*[F.lit(x) for w, k in rank.items() for x in (w, k)])
    blocks = read.select("key", F.posexplode("have").alias("no", "block")).where(F.size("block") >= fewest)
    blocks = blocks.select("key", "no", F.sort_array(F.transform("block", lambda w: F.element_at(ranks, w))).alias("have"))
    opened = blocks.select("key", "no", "have", F.posexplode(F.slice("have", F.lit(1), F.size("have") - fewest + 1)).alias("spot", "word"))
    reach = 1 + F.least(F.col("size") - F.col("at") - 1, F.size("have") - F.col("spot") - 1)
    met = opened.join(table, "word").where((F.size("have") >= F.col("need")) & (reach >= F.col("need")))
    met = met.where(F.size(F.array_intersect("have", "own")) >= F.col("need"))
    return met.select("key", "no", "template", "label", "size", "need", "words", "length").dropDuplicates(["key", "no", "template"])


def similarity_join(rows: DataFrame, read: DataFrame, texts: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """key, no (of the block), label and containment of every block and template that meet the threshold in a window.

    ``rows`` has key and low (lower-case text), ``read`` key and have.
    """
    found = written(candidates(read, templates_of(texts, threshold)), "candidates")
    keys = found.select("key").distinct()
    own = rows.join(F.broadcast(keys) if keys.count() <= FEW else keys, "key", "left_semi").dropDuplicates(["key"])
    blocks = own.select("key", F.posexplode(F.split("low", BREAK)).alias("no", "line")).join(found, ["key", "no"])
    inside = blocks.withColumn("found", most_in_window(F.col("line"), F.col("words"), F.col("length")))
    return inside.where(F.col("found") >= F.col("need")).select("key", "no", "label", (F.col("found") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """id, n_words, places, method labels and score of every row. Results are joined by id and the text's hash."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h")).alias("key"), lowered(text).alias("low"))
    known = F.array(*map(F.lit, sorted({w for _, t in TEMPLATES for w in t.split()})))
    read = written(rows.select("key", read_once(F.col("low"), known).alias("r")).select("key", "r.base.*", "r.have"), "words")
    found = similarity_join(rows, read, threshold=threshold).groupBy("key").agg(F.array_sort(F.collect_set("label")).alias("more"), F.max("containment").alias("best"))
    joined = read.drop("have").join(found, read["key"].eqNullSafe(found["key"]), "left")
    return joined.select(
        read["key"]["id"].alias(id_col),
        "n_words",
        "places",
        F.coalesce("more", F.array().cast("array<string>")).alias("more"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
