"""Language identification by nearest centroid.

A text becomes the L2-normalised TF-IDF vector of its letter n-grams (orders 1 to 3, lower case,
every other character a word boundary), hashed to a fixed number of dimensions. Each language has
several centroids from spherical k-means; the prediction is the language of the centroid with the
largest cosine. A text is rejected if its distance, 1 - cosine, is beyond the limit for its length;
limits come from the learning rows, cut to many lengths, as short texts lie further away.

The model is learned on a bounded sample: ``per_language`` rows of each of the ``max_languages``
most frequent languages, and ``sample_chars`` characters of each row, chosen by a hash of the id.
Prediction reads whole texts; long ones in pieces of ``PIECE`` characters, whose counts add up to those
of the text in one piece.

A null text or one without letters is ``und`` with score 0 and rejected. Ties go to the language
that sorts first. Without rows to learn from, everything is ``und``. Repeated rows get equal
predictions; input columns called like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import lean, slices

DIMENSIONS, ORDERS, PIECE = 4096, 3, 1 << 20
UNKNOWN = "und"
#: Odd multipliers that mix the code points of an n-gram.
MIX = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters; a table over all of Unicode from Python's own rule."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str) -> tuple[np.ndarray, int]:
    """Hashed counts of the letter n-grams of a whole text, and its number of letters."""
    total, n_letters = np.zeros(DIMENSIONS, np.int64), 0
    # what the next piece needs of those before: their last points, and whether a letter came last
    tail, after_letter = np.array([32], np.uint32), False
    for begin in range(0, max(1, len(text)), PIECE):
        # by itself the capital sigma always becomes the same letter, wherever a piece ends
        lowered = text[begin : begin + PIECE].replace("Σ", "σ").lower()
        points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter = _letters()[points]
        n_letters += int(np.count_nonzero(is_letter))
        keep = is_letter.copy()
        if len(points):
            keep[0] |= after_letter
            keep[1:] |= is_letter[:-1]
            after_letter = bool(is_letter[-1])
        own = np.where(is_letter, points, np.uint32(32))[keep]
        stream = np.concatenate([tail, own, [32] if begin + PIECE >= len(text) else []]).astype(np.uint32)
        for n in range(1, ORDERS + 1):
            # n-grams that end behind the tail
            first = max(0, len(tail) - n + 1) if begin else 0
            if len(stream) >= first + n:
                size = len(stream) - n + 1 - first
                h = np.full(size, n, np.uint32)
                for k in range(n):
                    h = (h ^ stream[first + k : first + k + size]) * MIX[k]
                total += np.bincount((h ^ (h >> np.uint32(15))) % np.uint32(DIMENSIONS), minlength=DIMENSIONS)
        tail = stream[-(ORDERS - 1) :]
    return total, n_letters


@dataclass
class Model:
    """Languages of the centroids, idf weights, centroids (rows of unit length) and limits by length."""

    languages: list[str]
    owner: np.ndarray
    idf: np.ndarray
    centroids: np.ndarray
    limits: np.ndarray

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts).astype(np.float32) * self.idf
        return v / max(float(np.sqrt(v @ v)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected)."""
        if not text or not self.languages:
            return UNKNOWN, 0.0, True
        counts, n_letters = ngram_counts(text)
        if not n_letters:
            return UNKNOWN, 0.0, True
        near = self.centroids @ self.vector(counts)
        best = int(near.argmax())
        score = min(1.0, max(0.0, float(near[best])))
        return self.languages[self.owner[best]], score, bool(1 - score > self.limits[bucket(n_letters)])


def bucket(n_letters: int) -> int:
    """Length class of a text: powers of two up to 2**15 letters."""
    return min(int(n_letters).bit_length(), 15)


def clustered(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to k unit centroids by spherical k-means; starts from the mean and then the furthest vectors."""
    mean = vectors.mean(axis=0)
    centroids = [mean / max(float(np.linalg.norm(mean)), 1e-12)]
    while len(centroids) < min(k, len(vectors)):
        centroids.append(vectors[(vectors @ np.array(centroids).T).max(axis=1).argmin()])
    found = np.array(centroids, np.float32)
    for _ in range(rounds):
        nearest = (vectors @ found.T).argmax(axis=1)
        sums = np.array([vectors[nearest == c].sum(axis=0) if (nearest == c).any() else found[c] for c in range(len(found))])
        found = (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    return found


def learn(texts: list[str], languages: list[str], *, per_centroid: int = 3, margin: float = 1.35, least_limit: float = 0.5) -> Model:
    """Learn from texts in the driver; ``margin`` widens the largest distance seen for a length, and no limit is under ``least_limit``."""
    pairs = [(t, lang, ngram_counts(t)[0]) for t, lang in zip(texts, languages, strict=True) if any(map(str.isalpha, t))]
    names = sorted({lang for _, lang, _ in pairs})
    if not names:
        return Model([], np.empty(0, int), np.ones(DIMENSIONS, np.float32), np.empty((0, DIMENSIONS), np.float32), np.ones(16))
    counts = np.array([c for _, _, c in pairs])
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    model = Model(names, np.empty(0, int), idf, np.empty((0, DIMENSIONS), np.float32), np.ones(16))
    vectors, of = np.array([model.vector(c) for c in counts]), np.array([names.index(lang) for _, lang, _ in pairs])
    own = [clustered(vectors[of == k], per_centroid) for k in range(len(names))]
    model.owner, model.centroids = np.concatenate([[k] * len(c) for k, c in enumerate(own)]).astype(int), np.concatenate(own)
    furthest = np.zeros(16)
    for text, lang, _ in pairs:
        for n in (1 << np.arange(2, 15)).tolist():
            piece = text[:n] if n <= len(text) else text
            c, letters = ngram_counts(piece)
            if letters:
                near = float((own[names.index(lang)] @ model.vector(c)).max())
                furthest[bucket(letters)] = max(furthest[bucket(letters)], 1 - near)
            if n > len(text):
                break
    # a longer text never lies further than a shorter one may
    allowed = np.maximum.accumulate(furthest[::-1])[::-1]
    allowed[: np.argmax(allowed > 0)] = 1.0
    model.limits = np.clip(allowed * margin, least_limit, 1.0)
    model.limits[:4] = 1.0  # under eight letters there is nothing to measure
    return model


def held_out(id_col: str) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 4, is 2. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, max_languages: int = 64, sample_chars: int = 20_000) -> Model:
    """Learn from a bounded sample of the labelled rows that are not held out."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    counts = rows.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not counts:
        return learn([], [])
    order, scale = F.xxhash64(F.col(id_col)), 1 << 20
    share = F.create_map(*[F.lit(x) for row in counts for x in (row["lang"], int(min(scale, 1 + 2 * scale * per_language // row["count"])))])
    sample = rows.where(F.pmod(order, F.lit(scale)) < F.try_element_at(share, F.col(lang_col)))
    picked = sample.select(F.col(lang_col).alias("lang"), F.substring(text_col, 1, sample_chars).alias("text"), order.alias("h"), F.col(id_col).alias("id"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    got = picked.withColumn("r", rank).where(F.col("r") <= per_language).select("lang", "text").orderBy("lang", "text").collect()
    return learn([r["text"] for r in got], [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected. The model's size is fixed by its parameters."""
    rows = docs.drop("lang_pred", "score", "rejected")
    at = rows.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = shared.value.predict
        for batch in slices(batches):
            found = [predict(text) for text in batch.column(at).to_pylist()]
            more = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(lean(work), f"{schema}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that the model does not reject, with all their columns and no others."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = shared.value.predict
        for batch in slices(batches):
            yield batch.filter(pa.array([not predict(text)[2] for text in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(work), docs.schema)
