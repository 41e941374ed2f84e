"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised (lower case, runs of anything but letters and digits become one
space). An item may occur with up to k edits, k being ``rate`` of its length. It is split into k + 1
pieces: an occurrence within k edits leaves one piece at least untouched. All pieces of a block of
items go into one Aho-Corasick automaton that reads each text once; around every hit, Myers'
bit-parallel algorithm finds the smallest edit distance of the whole item to the text there.
Hits that agree on item and shift within the budget are verified once. Items of fewer than ``least``
normalised characters have no edits to spare: they are found exactly, as whole words.

Items are the stated query set; they are searched in blocks of about ``BLOCK_CHARS`` characters, so an
automaton's size does not grow with the benchmark. All blocks are searched in one reading of the texts:
each is a step of one chain, and ``clean`` hands each step only the texts that the steps before left.

Null and empty texts match nothing; items that are null or hold no letter or digit are left out; equal
items are found each; repeated rows get equal results; empty tables give empty results; other columns
of the input are not looked at, and ``clean`` keeps them all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import lean, slices, written

#: Characters of items in one automaton, about, and items whose bit masks a worker keeps.
BLOCK_CHARS, MASKS = 4_000_000, 2000
APART = re.compile(r"[\W_]+")


def normalised(text: str | None) -> str:
    return APART.sub(" ", (text or "").lower()).strip()


def pieces_of(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget`` + 1 pieces of nearly equal length with their places."""
    n, out, begin = budget + 1, [], 0
    for k in range(n):
        end = (k + 1) * len(item) // n
        out.append((begin, item[begin:end]))
        begin = end
    return out


def masks_of(item: str) -> dict[str, int]:
    """For each character the places where the item has it, as bits."""
    masks: dict[str, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    return masks


def nearest(masks: dict[str, int], m: int, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the best approximate occurrence of an item of m characters in ``text``.

    Myers (1999): vertical differences of the edit matrix as two bit vectors. None beyond the budget;
    of equal distances the first end.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = (m, 0) if m <= budget else None
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        hp = down | (full & ~(d0 | up))
        hn = d0 & up
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 & full
        hn = hn << 1 & full
        up = hn | (full & ~(d0 | hp))
        down = d0 & hp
        if score <= budget and (best is None or score < best[0]):
            best = (score, j + 1)
            if not score:
                break
    return best


@dataclass
class Item:
    """A normalised item; ``whole`` ones count only between word ends."""

    id: int | None
    text: str
    budget: int
    whole: bool = False


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[Item]):
        import ahocorasick

        self.items = items
        self.masks = lru_cache(maxsize=MASKS)(lambda k: masks_of(items[k].text))
        places: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(items):
            pieces = [(0, f" {item.text} ")] if item.whole else pieces_of(item.text, item.budget)
            for at, piece in pieces:
                places.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def hits(self, text: str | None) -> Iterator[tuple[int, int, int]]:
        """(number of the item, distance, end in the normalised text) of verified windows, some items often."""
        norm = normalised(text)
        if not norm or not self.items:
            return
        nearest_of: dict[int, int] = {}
        tried: dict[int, set[int]] = {}
        # a space at either end lets whole items stand there; places in ``norm`` are one less
        for end, (n, found) in self.automaton.iter(f" {norm} "):
            for k, at in found:
                item = self.items[k]
                if item.whole:
                    if k not in nearest_of:
                        nearest_of[k] = 0
                        yield k, 0, end - 1
                    continue
                shift = end - n - at
                # the window covers every shift within the budget, so near shifts share one check
                step = max(1, item.budget)
                if not nearest_of.get(k, 1) or shift // step in tried.setdefault(k, set()):
                    continue
                tried[k].add(shift // step)
                begin = max(0, shift // step * step - item.budget)
                window = norm[begin : shift // step * step + step + len(item.text) + item.budget]
                if len(window) < len(item.text) - item.budget:
                    continue
                hit = nearest(self.masks(k), len(item.text), window, item.budget)
                if hit and hit[0] < nearest_of.get(k, item.budget + 1):
                    nearest_of[k] = hit[0]
                    yield k, hit[0], begin + hit[1]

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(number of the item, distance, end in the normalised text), the best of each item."""
        best: dict[int, tuple[int, int]] = {}
        for k, d, e in self.hits(text):
            best[k] = (d, e)  # of an item, every hit is nearer than the one before
        return [(k, d, e) for k, (d, e) in sorted(best.items())]

    def any(self, text: str | None) -> bool:
        return next(self.hits(text), None) is not None


def blocks_of(benchmark: DataFrame, *, rate: float, least: int, id_col: str, text_col: str) -> Iterator[list[Item]]:
    """Items in blocks of about ``BLOCK_CHARS`` characters, dealt by a hash."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS)
    numbered = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(max(1, blocks))))
    if blocks > 1:
        numbered = written(numbered, "items")
    for block in range(blocks):
        items = []
        for row in numbered.where(F.col("block") == block).select("id", "text").collect():
            if text := normalised(row["text"]):
                short = len(text) < least
                items.append(Item(row["id"], text, 0 if short else int(rate * len(text)), short))
        if items:
            yield sorted(items, key=lambda i: (i.id is None, i.id or 0, i.text))


def matches(docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.08, least: int = 40, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, distance and end of every document and item that occurs in it within its budget."""
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int32())])
    blocks = [spark.sparkContext.broadcast(items) for items in blocks_of(benchmark, rate=rate, least=least, id_col=item_id, text_col=item_text)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not blocks:
        return spark.createDataFrame([], "doc_id long, item_id long, distance int, end int")
    # a step hands all texts on, and what it and the steps before found with the text's row
    hit = "array<struct<item_id:long,distance:int,end:int>>"
    hit_type = pa.list_(pa.struct(list(schema)[1:]))

    def step(shared):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value)
            for batch in slices(batches):
                found = [[*(before or []), *({"item_id": shared.value[k].id, "distance": d, "end": e} for k, d, e in matcher.find(text))] for text, before in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, hit_type)], names=["doc_id", "text", "hits"])

        return work

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, items = Matcher(blocks[-1].value), blocks[-1].value
        for batch in slices(batches):
            found = []
            for doc_id, text, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found += [(doc_id, h["item_id"], h["distance"], h["end"]) for h in before or []]
                found += [(doc_id, items[k].id, d, e) for k, d, e in matcher.find(text)]
            columns = zip(*found, strict=True) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    rows = rows.withColumn("hits", F.lit(None).cast(hit))
    for shared in blocks[:-1]:
        rows = rows.mapInArrow(lean(step(shared)), f"doc_id long, text string, hits {hit}")
    return rows.mapInArrow(lean(last), "doc_id long, item_id long, distance int, end int")


def clean(docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.08, least: int = 40, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, in whose text no item occurs within its budget; neither ids nor a shuffle are needed."""
    at = docs.columns.index(text_col)
    schema = docs.schema

    def step(shared):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value)
            for batch in slices(batches):
                yield batch.filter(pa.array([not matcher.any(text) for text in batch.column(at).to_pylist()], pa.bool_()))

        return work

    for items in blocks_of(benchmark, rate=rate, least=least, id_col=item_id, text_col=item_text):
        docs = docs.mapInArrow(lean(step(docs.sparkSession.sparkContext.broadcast(items))), schema)
    return docs
