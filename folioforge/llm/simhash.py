"""SimHash near-duplicates with bit-sliced comparison.

A document's fingerprint takes a bit for each place where over half of its shingles' XXH64 values
have a one. Distinct fingerprints that agree on the bits of some table of bit places meet in a
bucket. Inside a bucket, bit planes are stored vertically: one word operation updates the distances
of 64 fingerprints with carry-save counters, and a block of comparisons is abandoned as soon as all
of its distances exceed the radius. Buckets give spanning forests, never all pairs; an alternating
large-star, small-star iteration joins the forests to components.

``exact_tables`` finds every pair within a small radius: of r + 2 blocks of bits, two pairs at least
agree. A bucket of more than ``HOT`` fingerprints is dealt again by the same rule over its other
bits, after which, for 64 bits, no bucket holds more than 2**16 different fingerprints.
``similar_texts`` finds every pair of a Jaccard similarity by prefixes of the shingle sets.

Rows meet what was found for their fingerprint by ``looked_up``, so copies of one text, however many,
are no task's alone; working tables are deleted as soon as the links are joined.

Null and empty texts have the fingerprint zero, linked like any other; null ids are fingerprinted
and linked, and never name a component that has an id; repeated rows share a fingerprint; an empty table
gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import lean, looked_up, remove, run_dir, slices, tidy, written

#: Fingerprints of a bucket from which it is dealt again; rows compared at once, with so many others.
HOT, TILE, ACROSS = 20_000, 64, 4096
#: Shingles of which it is known that they are common, at most; hashes counted together; classes of a sketch.
COMMON, AT_ONCE, CLASSES = 100_000, 4_000_000, 128
#: Bits of 256 by which similar sets of ``MANY`` shingles or more may differ. Of sets at 0.8, 39 bits are expected to
#: differ with a deviation of 6, so that this is seven deviations away: about one such pair in 10**12 is passed over.
APART, MANY = 80, 64
#: Sets of a tree of open pairs, and hashes of all its sets, from which it is dealt into blocks.
TREE_ROWS, TREE_HASHES = 1024, 2_000_000
#: Odd multipliers that make further hashes of a shingle from its first.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words, repeats included; A-Z in lower case."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray, words: int = 1) -> bytes:
    """The SimHash of 64 * ``words`` bits, little-endian."""
    if not len(hashes):
        return bytes(8 * words)
    out = []
    for k in range(words):
        ones = np.zeros(64, np.int64)
        for begin in range(0, len(hashes), 1 << 15):
            h = hashes[begin : begin + (1 << 15)]
            if k:
                with np.errstate(over="ignore"):
                    h = (h ^ np.uint64(k)) * MIX[0]
                    h = (h ^ (h >> np.uint64(29))) * MIX[1]
                    h ^= h >> np.uint64(32)
            ones += np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, prints: list[tuple[int, int]], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp: the fingerprints for each (shingle size, words of 64 bits), joined."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [b"".join(fingerprint(shingle_hashes(text, size), words) for size, words in prints) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], names=["doc_id", "fp"])

    return rows.mapInArrow(lean(work), f"doc_id {rows.schema[0].dataType.simpleString()}, fp binary")


def exact_tables(places: list[int], radius: int) -> list[list[int]]:
    """Bit places such that any two fingerprints within the radius agree on one table at least."""
    blocks = [b.tolist() for b in np.array_split(places, radius + 2)]
    return [blocks[i] + blocks[j] for i, j in combinations(range(radius + 2), 2)]


def keys_of(bits: np.ndarray, places: list[int]) -> np.ndarray:
    """Up to 63 chosen bits of each row as one number; ``bits`` has a row of 0 and 1 for each fingerprint."""
    packed = np.packbits(bits[:, places], axis=1, bitorder="little")
    wide = np.zeros((len(bits), 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view("<i8").reshape(-1)


def dealt(fps: DataFrame, tables: list[list[int]], again: list[list[list[int]]] | None = None) -> DataFrame:
    """A row (tab, key, fp) for each table; with ``again``, hot rows (tab, key, fp) go by its tables, too: (tab, key, sub, subkey, fp)."""

    def split(fp: list[bytes]) -> np.ndarray:
        return np.unpackbits(np.frombuffer(b"".join(fp), np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits = split(batch.column(0).to_pylist())
                for t, places in enumerate(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bits), t, np.int32)), pa.array(keys_of(bits, places)), batch.column(0)], names=["tab", "key", "fp"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                tabs, bits = batch.column(0).to_numpy(), split(batch.column(2).to_pylist())
                for t in np.unique(tabs):
                    mine = np.flatnonzero(tabs == t)
                    rows = batch.take(pa.array(mine))
                    for s, places in enumerate(again[t]):
                        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.full(len(mine), s, np.int32)), pa.array(keys_of(bits[mine], places)), rows.column(2)], names=["tab", "key", "sub", "subkey", "fp"])

    if again is None:
        return fps.select("fp").mapInArrow(lean(first), "tab int, key long, fp binary")
    return fps.select("tab", "key", "fp").mapInArrow(lean(second), "tab int, key long, sub int, subkey long, fp binary")


def low_bits(n: np.ndarray, words: int) -> np.ndarray:
    """A row of words whose lowest n bits are set, for each n."""
    c = np.clip(n[:, None] - 64 * np.arange(words)[None], 0, 64).astype(np.uint64)
    return np.where(c == 64, ALL, (np.uint64(1) << (c & np.uint64(63))) - np.uint64(1))


def compared(fps: np.ndarray, ends: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Bit-sliced comparison of the rows of sorted buckets with the later rows of their bucket.

    ``fps`` has a row of bits (0, 1) for each fingerprint, ``ends`` the end of each row's bucket. Yields
    row numbers, the number of the first word of columns, and the columns within the radius as bits.
    """
    n, n_bits = fps.shape
    width = -(-n // 64)
    padded = np.zeros((width * 64, n_bits), np.uint8)
    padded[:n] = fps
    planes = np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little")).view("<u8")
    depth = max(1, int(radius).bit_length())
    masks = np.where(fps == 1, ALL, np.uint64(0))
    for begin in range(0, n, TILE):
        rows = np.arange(begin, min(begin + TILE, n))
        if (ends[rows] <= rows + 1).all():
            continue
        word, last = begin // 64, -(-int(ends[rows[-1]]) // 64)
        for left in range(word, last, ACROSS // 64):
            right = min(left + ACROSS // 64, last)
            alive = low_bits(ends[rows] - left * 64, right - left) & ~low_bits(rows + 1 - left * 64, right - left)
            counters = [np.full(alive.shape, ALL if bias(radius) >> d & 1 else np.uint64(0)) for d in range(depth)]
            for b in range(n_bits):
                carry = planes[b, left:right][None] ^ masks[rows, b][:, None]
                for counter in counters:  # carry-save: add one bit to each of many counters
                    held = counter & carry
                    counter ^= carry
                    carry = held
                alive &= ~carry  # a counter that overflows is beyond the radius
                if b % 8 == 7 and not alive.any():
                    break
            else:
                yield rows, left, alive


def bias(radius: int) -> int:
    """Where counters start, such that one step beyond the radius overflows them."""
    return (1 << max(1, int(radius).bit_length())) - 1 - radius


def unpacked(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")


def forest(fps: np.ndarray, ends: np.ndarray, radius: int) -> np.ndarray:
    """Links within the radius as labels: rows of one bucket share the smallest row they reach."""
    labels, begins = np.arange(len(fps)), np.searchsorted(ends, ends, side="left")
    for rows, left, alive in compared(fps, ends, radius):
        near = unpacked(alive)
        for i in np.flatnonzero(near.any(axis=1)):
            row = int(rows[i])
            found = np.unique(labels[left * 64 + np.flatnonzero(near[i])])
            found = np.union1d(found, labels[row : row + 1])
            if len(found) > 1:
                bucket = labels[begins[row] : ends[row]]
                bucket[np.isin(bucket, found[1:])] = found[0]
    return labels


def first_earlier(fps: np.ndarray, ends: np.ndarray, radius: int) -> np.ndarray:
    """For each row the first row of its bucket within the radius, if that is an earlier one; else itself."""
    n = len(fps)
    partner = np.arange(n)
    for rows, left, alive in compared(fps, ends, radius):
        near = unpacked(alive)
        columns = np.arange(left * 64, min(n, left * 64 + near.shape[1]))
        found = near.any(axis=0)[: len(columns)] & (partner[columns] == columns)
        partner[columns[found]] = rows[near.argmax(axis=0)[: len(columns)][found]]
    return partner


def links(buckets: DataFrame, keys: list[str], radius: int, decide: slice, joined=forest) -> DataFrame:
    """(a, b) of fingerprints within the radius; ``decide``: the bytes compared.

    ``joined`` chooses a partner for each row of a bucket. Rows stand in the same order in all buckets, so
    those that meet often choose each other again; rows that come twice count once.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    parted = buckets.repartition(*keys).sortWithinPartitions(*keys, F.xxhash64("fp"), "fp")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(held: pa.Table) -> pa.RecordBatch:
            change = np.zeros(held.num_rows, bool)
            for key in keys:
                k = held.column(key).to_numpy()
                change[1:] |= k[1:] != k[:-1]
            name = held.column("fp").combine_chunks().dictionary_encode().indices.to_numpy()
            new = np.ones(held.num_rows, bool)
            new[1:] = change[1:] | (name[1:] != name[:-1])
            if not new.all():
                held, change = held.filter(pa.array(new)), change[new]
            group = np.cumsum(change)
            sizes = np.bincount(group)
            many = np.flatnonzero(sizes[group] > 1)  # alone in a bucket: nothing to compare
            fp = held.column("fp").take(pa.array(many)).to_pylist()
            if not fp:
                return pa.RecordBatch.from_arrays([pa.array([], pa.binary())] * 2, schema=schema)
            counts = np.bincount(group[many])
            counts = counts[counts > 0]
            ends = np.repeat(np.cumsum(counts), counts)
            raw = np.frombuffer(b"".join(fp), np.uint8).reshape(len(fp), -1)[:, decide]
            labels = joined(np.unpackbits(raw, axis=1, bitorder="little"), ends, radius)
            pairs = sorted({(fp[i], fp[labels[i]]) for i in np.flatnonzero(labels != np.arange(len(labels)))})
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], schema=schema)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= 8192:
                whole = pa.Table.from_batches(held)
                # the last bucket may go on: it waits for the next batch
                same = np.ones(whole.num_rows, bool)
                for key in keys:
                    k = whole.column(key).to_numpy()
                    same &= k == k[-1]
                at = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if at:
                    yield linked(whole.slice(0, at))
                    held = whole.slice(at).combine_chunks().to_batches()
        if held:
            yield linked(pa.Table.from_batches(held))

    return parted.mapInArrow(lean(work), "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) that is not itself the smallest of its component.

    Alternates large-star and small-star until the edges stay the same, which they do after a number of
    rounds that grows as the squared logarithm of the nodes at most (Kiveris and others, 2014); each round
    is written, so lineage stays short, and the round before is deleted.
    """
    spark = edges.sparkSession

    def keep(df: DataFrame, label: str) -> tuple[DataFrame, str, tuple]:
        path = run_dir(spark, label)
        with tidy(spark):
            df.write.parquet(path)
        back = spark.read.schema("u binary, v binary").parquet(path)
        mark = back.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return back, path, tuple(mark)

    now, path, mark = keep(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        # the centre of a star meets all its rows; it may have very many
        large = looked_up(both, least, ["u"], "n", 2 * mark[0]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        before, old = mark, path
        now, path, mark = keep(small, "edges")
        remove(spark, old)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def named(distinct: DataFrame, stars: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """fp, n and ``best`` of every fingerprint: the least ``first`` of its component.

    ``distinct`` has fp, n (rows) and first (comparable), ``stars`` the links as ``components`` gives them.
    """
    old: list[str] = []
    members = written(stars.union(stars.select("root", "root").distinct()).toDF("fp", "root").join(distinct, "fp").select("fp", "root", "n", "first"), "members", old)
    names = written(members.groupBy("root").agg(F.min("first").alias("best"), F.count("*").alias("_n")), "names", old)
    known = looked_up(members.select("fp", "root"), names, ["root"], "_n", members.count()).select("fp", "best")
    out = written(distinct.join(known, "fp", "left").select("fp", "n", F.coalesce("best", "first").alias("best")), "named", kept)
    remove(distinct.sparkSession, *old)
    return out


def least_id(id_name: str, *more: str):
    """Order of rows by id, those without last."""
    return F.min(F.struct(F.col(id_name).isNull().alias("lacks"), F.col(id_name).alias("id"), *more))


def near_duplicates(docs: DataFrame, *, prints: list[tuple[int, int]], tables: list[list[int]], again: list[list[list[int]]], radius: int, decide: slice, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id, the smallest id of all documents linked directly or through others."""
    spark, old = docs.sparkSession, []
    marked = written(fingerprints(docs, prints, id_col=id_col, text_col=text_col), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(least_id("doc_id").alias("first"), F.count("*").alias("n")), "distinct", old)
    buckets = dealt(distinct, tables)
    hot = written(buckets.groupBy("tab", "key").count().where(F.col("count") > HOT).select("tab", "key", F.lit(True).alias("hot")), "hot", old)
    if hot.isEmpty():
        edges = links(buckets, ["tab", "key"], radius, decide)
    else:
        flagged = buckets.join(hot, ["tab", "key"], "left")
        cool, warm = flagged.where("hot is null").drop("hot"), flagged.where("hot").drop("hot")
        edges = links(cool, ["tab", "key"], radius, decide).union(links(dealt(warm, tables, again), ["tab", "key", "sub", "subkey"], radius, decide))
    found = named(distinct, components(edges)).select("fp", "n", F.col("best.id").alias("component_id"))
    remove(spark, *old)
    return looked_up(marked, found, ["fp"], "n", marked.count()).select("doc_id", "fp", "component_id")


def contract_links(docs: DataFrame) -> DataFrame:
    """64 bits over 3-word shingles, all pairs at two or fewer differing bits."""
    tables = exact_tables(list(range(64)), 2)
    again = [exact_tables([b for b in range(64) if b not in set(t)], 2) for t in tables]
    return near_duplicates(docs, prints=[(3, 1)], tables=tables, again=again, radius=2, decide=slice(0, 8))


def set_print(hashes: np.ndarray) -> bytes:
    """Names a set of sorted distinct shingle hashes: 256-bit SimHash, 64-bit hash of the set, its size in 4 bytes."""
    from xxhash import xxh64_digest

    return fingerprint(hashes, 4) + xxh64_digest(hashes.tobytes()) + len(hashes).to_bytes(4, "little")


def common_shingles(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that stand in many texts, sorted, and in how many, at least.

    Only the order of shingles in ``prefixes`` depends on it, which may be any order.
    """

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *held]), return_counts=True)
        kept = counts >= 3
        return pa.RecordBatch.from_arrays([pa.array(found[kept].view(np.int64)), pa.array(counts[kept].astype(np.int64))], names=["token", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()
        for batch in slices(batches):
            for text in batch.column(1).to_pylist():
                hashes = np.unique(shingle_hashes(text, size))
                name = hash(hashes.tobytes())
                if name in seen:  # copies say nothing about how common their shingles are
                    continue
                seen.add(name)
                held.append(hashes)
                n += len(hashes)
                if n >= AT_ONCE:
                    yield often(held)
                    held, n = [], 0
        yield often(held)

    counts = rows.mapInArrow(lean(work), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    found = top.column("token").to_numpy().view(np.uint64)
    order = np.argsort(found)
    return found[order], top.column("n").to_numpy()[order]


def prefix_of(hashes: np.ndarray, similarity: float, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The rarest hashes of a set, so many that any set of that similarity has one of them in its own prefix, in order."""
    n = len(hashes)
    counts = np.zeros(n, np.int64)
    if n and len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        counts = np.where(common[at] == hashes, often[at], 0)
    return hashes[np.lexsort((hashes, counts))][: n - math.ceil(similarity * n - 1e-9) + 1]


def sketch_of(hashes: np.ndarray) -> bytes:
    """How many hashes of a set fall into each of ``CLASSES`` classes, up to 65535, which stands for any number."""
    return np.minimum(np.bincount((hashes % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES), 65535).astype("<u2").tobytes()


def most_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many elements two sets can share at most, by the rows of their sketches."""
    least = np.minimum(a, b)
    return least.sum(axis=1, dtype=np.int64) + np.where((least == 65535).any(axis=1), 1 << 40, 0)


def least_shared(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """How many elements two sets of the sizes share at least if they are similar."""
    return np.ceil(similarity * (a + b) / (1 + similarity) - 1e-9)


def prefixes(rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """Every row (doc_id, text, ...) without its text but with fp (``set_print`` of the distinct shingles), id (a number
    from it), and prefix, sketch and small, which are null where an earlier row of the input partition had the same fp;
    small holds the hashes of sets of fewer than ``MANY``, in order."""
    shared = rows.sparkSession.sparkContext.broadcast(common_shingles(rows, size))
    kept = [f for f in rows.schema if f.name != "text"]
    ordered = rows.select("text", *[f.name for f in kept])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (common, often), seen = shared.value, set()
        for batch in slices(batches):
            text, *others = batch.columns
            fps, parts, sketches, small = [], [], [], []
            for t in text.to_pylist():
                hashes = np.unique(shingle_hashes(t, size))
                fps.append(set_print(hashes))
                new = fps[-1] not in seen
                seen.add(fps[-1])
                parts.append(prefix_of(hashes, similarity, common, often).view(np.int64) if new else None)
                sketches.append(sketch_of(hashes) if new else None)
                small.append(hashes.tobytes() if new and len(hashes) < MANY else None)
            ids = np.frombuffer(b"".join(fp[32:40] for fp in fps), "<i8")
            yield pa.RecordBatch.from_arrays([*others, pa.array(fps, pa.binary()), pa.array(ids), pa.array(parts, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(small, pa.binary())], names=[*batch.schema.names[1:], "fp", "id", "prefix", "sketch", "small"])

    return ordered.mapInArrow(lean(work), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", fp binary, id long, prefix array<long>, sketch binary, small binary")


def shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """fp and the distinct 64-bit hashes of the shingles of every row (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(text, size)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_print(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["fp", "sh"])

    return rows.mapInArrow(lean(work), "fp binary, sh array<long>")


def cross_pairs(begins: np.ndarray, groups: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs of different groups of a bucket, in pieces.

    ``begins`` and ``groups`` have the first row of each row's bucket and, in it, of its group.
    """
    counts = groups - begins
    total = np.cumsum(counts)
    row = 0
    while row < len(counts):
        end = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + most, side="right")))
        n = counts[row:end]
        i = np.repeat(np.arange(row, end), n)
        j = begins[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        if len(i):
            yield i, j
        row = end


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets of hashes, each in order, are similar."""
    n = len(np.intersect1d(a, b, assume_unique=True))
    return n >= similarity * (len(a) + len(b) - n)


def top(above: list[int], k: int) -> int:
    """The top of k's tree; paths are halved on the way."""
    while above[k] != k:
        above[k] = above[above[k]]
        k = above[k]
    return k


def whole_buckets(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[pa.Table]:
    """Rows sorted by ``keys`` as tables of whole buckets, of ``least`` rows or more but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= least:
            whole = pa.Table.from_batches(held)
            k = np.stack([whole.column(c).to_numpy() for c in keys])
            apart = np.flatnonzero((k != k[:, -1:]).any(axis=0))
            if len(apart):  # the last bucket may go on: it waits for the next batch
                yield whole.slice(0, int(apart[-1]) + 1)
                held = whole.slice(int(apart[-1]) + 1).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


#: A bucket, or a pair of blocks of a bucket that is too large for a task.
TILE_KEYS = ["token", "lo", "hi"]


def other_pairs(shared: DataFrame, stars: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, sure): forests of the pairs of fingerprints that share a prefix shingle, are not joined by ``stars``
    (node, root) and are similar (sure) or may be (not sure).

    The tests on sizes and places are necessary conditions of the similarity, and that on SimHash fails for
    a similar pair about once in 10**12. Small sets (column ``small`` of ``sets``) travel with their rows and
    are compared on the spot. All other pairs are open: both ends of each lie in one tree of the open forest,
    where ``tree_links`` compares the sets. So a bucket sends on fewer rows than it has twice. Rows of a hot
    shingle are split into blocks and each pair of blocks is a bucket of its own.
    """
    keys = TILE_KEYS
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("sure", pa.bool_())])
    known = shared.join(stars.toDF("fp", "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    known = written(known.join(sets.where("small is not null").select("fp", "small"), "fp", "left"), "labelled")
    zero = F.lit(0).cast("long")
    rows = known.where(F.col("n") <= HOT).select("token", zero.alias("lo"), zero.alias("hi"), zero.alias("block"), "fp", "at", "root", "small")
    hot = known.where(F.col("n") > HOT)
    mixed = written(hot.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token"), "mixed")
    if not mixed.isEmpty():
        blocks = F.ceil(F.col("n") / HOT)
        tiles = hot.join(mixed, "token").withColumn("block", F.pmod(F.xxhash64("fp"), blocks)).withColumn("other", F.explode(F.sequence(zero, blocks - 1)))
        rows = rows.union(tiles.select("token", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "fp", "at", "root", "small"))

    def found(held: pa.Table) -> pa.RecordBatch:
        k = np.stack([held.column(c).to_numpy() for c in keys])
        fp, root = held.column("fp").combine_chunks().dictionary_encode(), held.column("root").combine_chunks().dictionary_encode()
        names, code, roots = fp.dictionary, fp.indices.to_numpy().astype(np.int64), root.indices.to_numpy()
        raw = np.frombuffer(b"".join(names.to_pylist()), np.uint8).reshape(len(names), -1)
        bits, size = np.ascontiguousarray(raw[:, :32]).view("<u8"), np.ascontiguousarray(raw[:, 40:44]).view("<u4").reshape(-1).astype(np.int64)[code]
        where = np.zeros(len(names), np.int64)
        where[code] = np.arange(held.num_rows)
        small = [None if b is None else np.frombuffer(b, "<u8") for b in held.column("small").take(pa.array(where)).to_pylist()]
        is_small = np.array([h is not None for h in small], bool)
        counts = np.zeros((len(names), CLASSES), np.uint8)
        for c in np.flatnonzero(is_small):
            counts[c] = np.bincount((small[c] % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES)
        at, block, lone = held.column("at").to_numpy(), held.column("block").to_numpy(), k[1] == k[2]
        new = np.ones(held.num_rows, bool)
        new[1:] = (k[:, 1:] != k[:, :-1]).any(axis=0)
        first = new.copy()
        first[1:] |= roots[1:] != roots[:-1]
        row = np.arange(held.num_rows)
        begins, groups = (np.maximum.accumulate(np.where(mark, row, 0)) for mark in (new, first))
        # pairs of sets that are joined already, by ``root`` or by links found here, add nothing; nor do open pairs of one tree
        above, tree = list(range(len(root.dictionary))), list(range(len(names)))
        own = np.zeros(len(names), np.int64)
        own[code] = roots
        own, links_found, open_ = own.tolist(), [], []

        def settle(held_pairs: list[np.ndarray]) -> None:
            pairs = np.unique(np.concatenate(held_pairs))
            x, y = pairs // max(1, len(names)), pairs % max(1, len(names))
            both = is_small[x] & is_small[y]
            for p, q in zip(x[both].tolist(), y[both].tolist(), strict=True):
                a, b = top(above, own[p]), top(above, own[q])
                if a != b and similar(small[p], small[q], similarity):
                    above[a] = b
                    links_found.append((p, q))
            for p, q in zip(x[~both].tolist(), y[~both].tolist(), strict=True):
                a, b = top(tree, p), top(tree, q)
                if a != b and top(above, own[p]) != top(above, own[q]):
                    tree[a] = b
                    open_.append((p, q))

        held_pairs, n_held = [np.empty(0, np.int64)], 0
        for i, j in cross_pairs(begins, groups):
            least = least_shared(size[i], size[j], similarity)
            # shared shingles lie at this place or behind it, unless an earlier one is shared: that has a bucket, too
            fits = (np.minimum(size[i] - at[i], size[j] - at[j]) >= least) & (np.minimum(size[i], size[j]) >= least) & (lone[i] | (block[i] != block[j]))
            i, j = i[fits], j[fits]
            x, y = code[i], code[j]
            apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            both, fewest = is_small[x] & is_small[y], least_shared(size[i], size[j], similarity)
            possible = np.where(both, np.minimum(counts[x], counts[y]).sum(axis=1, dtype=np.int64) >= fewest, (apart <= APART) | (np.minimum(size[i], size[j]) < MANY))
            x, y = x[possible], y[possible]
            held_pairs.append(np.unique(np.minimum(x, y) * len(names) + np.maximum(x, y)))
            n_held += len(held_pairs[-1])
            if n_held > 1 << 20:
                settle(held_pairs)
                held_pairs, n_held = [np.empty(0, np.int64)], 0
        settle(held_pairs)
        ends = np.array(links_found + open_, np.int64).reshape(-1, 2)
        sure = np.arange(len(ends)) < len(links_found)
        return pa.RecordBatch.from_arrays([names.take(pa.array(ends[:, 0])), names.take(pa.array(ends[:, 1])), pa.array(sure)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(found, whole_buckets(batches, keys, 8192))

    return rows.repartition(*keys).sortWithinPartitions(*keys, "root").mapInArrow(lean(work), "a binary, b binary, sure boolean").distinct()


def joined_sets(fps: list[bytes], sets: list[np.ndarray], labels: np.ndarray, meets: np.ndarray | None, similarity: float) -> list[tuple[bytes, bytes]]:
    """A forest of the similar pairs of sets of different labels; ``meets`` has blocks, of which only different ones meet.

    Pairs of two sets of fewer than ``MANY`` are left out: ``other_pairs`` has decided them.
    """
    bits = np.ascontiguousarray(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1)[:, :32]).view("<u8")
    size, sketches = np.array([len(s) for s in sets]), np.frombuffer(b"".join(map(sketch_of, sets)), "<u2").reshape(len(sets), CLASSES)
    labels, out = labels.copy(), []
    for i in range(1, len(fps)):
        rest = (labels[:i] != labels[i]) & (np.maximum(size[:i], size[i]) >= MANY)
        if meets is not None:
            rest &= meets[:i] != meets[i]
        j = np.flatnonzero(rest & (np.minimum(size[:i], size[i]) >= least_shared(size[:i], size[i], similarity)))
        j = j[(np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64) <= APART) | (np.minimum(size[j], size[i]) < MANY)]
        room = most_shared(sketches[j], sketches[i]) - least_shared(size[j], size[i], similarity)
        for k in j[np.argsort(-room, kind="stable")][: np.count_nonzero(room >= 0)].tolist():  # the likeliest first
            if labels[k] != labels[i] and similar(sets[k], sets[i], similarity):
                out.append((fps[k], fps[i]))
                labels[labels == labels[k]] = labels[i]
    return out


def tree_links(trees: DataFrame, stars: DataFrame, sets: DataFrame, similarity: float, old: list[str]) -> DataFrame:
    """(a, b): a forest of the similar pairs, not joined by ``stars``, of each tree of open pairs.

    ``trees`` and ``stars`` are (node, root), ``sets`` has fp and sh of every node of ``trees``. A set goes once to each
    pair of blocks that its tree is dealt into; each pair of blocks is a bucket of its own.
    """
    schema, zero = pa.schema([("a", pa.binary()), ("b", pa.binary())]), F.lit(0).cast("long")
    ends = trees.union(trees.select("root", "root").distinct()).toDF("fp", "tree").withColumn("token", F.xxhash64("tree"))
    byte = [F.hex(F.substring("fp", 41 + k, 1)) for k in (3, 2, 1, 0)]
    members = ends.join(stars.toDF("fp", "root"), "fp", "left").select("token", "fp", F.coalesce("root", "fp").alias("root"), F.conv(F.concat(*byte), 16, 10).cast("long").alias("size"))
    members = written(members, "members", old)
    blocks = F.ceil(F.greatest(F.count("*") / TREE_ROWS, F.sum("size") / TREE_HASHES, F.lit(1))).cast("long")
    large = written(members.groupBy("token").agg(F.count("*").alias("n"), blocks.alias("blocks")), "blocks", old)
    known = looked_up(members, large, ["token"], "n", members.count()).withColumn("block", F.pmod(F.xxhash64("fp"), "blocks"))
    tiles = known.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    tiles = tiles.select("token", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "fp", "root")

    def found(held: pa.Table) -> Iterator[tuple[bytes, bytes]]:
        k = np.stack([held.column(c).to_numpy() for c in TILE_KEYS])
        cuts = np.flatnonzero(np.r_[True, (k[:, 1:] != k[:, :-1]).any(axis=0), True])
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            bucket = held.slice(begin, end - begin)
            sh = bucket.column("sh").combine_chunks()
            at = sh.offsets.to_numpy()
            each = np.split(sh.flatten().to_numpy().view(np.uint64), at[1:-1] - at[0])
            labels = bucket.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
            meets = None if k[1, begin] == k[2, begin] else bucket.column("block").to_numpy()
            yield from joined_sets(bucket.column("fp").to_pylist(), each, labels, meets, similarity)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_buckets(batches, TILE_KEYS, 1):
            pairs = list(found(held))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], schema=schema)

    return tiles.join(sets, "fp").select(*tiles.columns, "sh").repartition(*TILE_KEYS).sortWithinPartitions(*TILE_KEYS, "fp").mapInArrow(lean(work), "a binary, b binary")


def keys_of_rows(id_name: str, text_name: str) -> list:
    """Columns without nulls that name a row by its id and its text."""
    zero = F.lit(0).cast("long")
    return [F.coalesce(F.xxhash64(F.col(id_name).cast("string")), zero).alias("_i"), F.col(id_name).isNull().alias("_z"), F.xxhash64(F.coalesce(F.col(text_name), F.lit(""))).alias("_h")]


KEYS = ["_i", "_z", "_h"]
#: Classes of KEYS by hash: as many numbers, at most, are broadcast to keep the other rows' texts from a shuffle.
SLOTS = 1 << 22


def chosen(rows: DataFrame, used: DataFrame) -> DataFrame:
    """The rows whose KEYS are in ``used``; of the others, few are shuffled."""
    slot = F.pmod(F.xxhash64(*KEYS), F.lit(SLOTS).cast("long"))
    slots = used.select(slot.alias("_slot")).distinct()
    return rows.withColumn("_slot", slot).join(F.broadcast(slots), "_slot", "left_semi").drop("_slot").join(used, KEYS, "left_semi")


def with_both(pairs: DataFrame, facts: DataFrame, name: str, old: list[str], groups: int) -> DataFrame:
    """``pairs`` (a, b) with a column of ``facts`` (fp, ...) for either side, however often a fingerprint stands there."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = pairs.select(F.col("a").alias("fp"), one.alias("na"), none.alias("nb")).union(pairs.select("b", none, one))
    counts = ends.groupBy("fp").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    known, total = written(facts.select("fp", name).join(counts, "fp"), "facts", old), pairs.count()
    for side in ("a", "b"):
        pairs = looked_up(pairs, known.select(F.col("fp").alias(side), F.col(name).alias(f"{name}_{side}"), f"n{side}"), [side], f"n{side}", total, groups)
    return pairs


def possible(pairs: DataFrame, sketches: DataFrame, similarity: float, old: list[str]) -> DataFrame:
    """The pairs (a, b) whose sketches leave room for the similarity; none that is similar goes."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 10_000):
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(batch.num_rows, CLASSES) for k in (2, 3))
                a, b = (np.array([int.from_bytes(fp[-4:], "little") for fp in batch.column(k).to_pylist()], np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(batch.columns[:2], schema=schema).filter(pa.array(most_shared(x, y) >= least_shared(a, b, similarity)))

    return with_both(pairs, sketches, "sketch", old, 10_000).select("a", "b", "sketch_a", "sketch_b").mapInArrow(lean(work), "a binary, b binary")


def similar_groups(docs: DataFrame, *, similarity: float = 0.8, radius: int = 36, id_col: str = "doc_id", text_col: str = "text", kept: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, groups) of ``similar_texts``: doc_id, fp and the row's KEYS; fp, n and best (lacks, id, KEYS).

    ``best`` names the row of the group that comes first: by id, rows without id last, then by the text's hash.
    ``kept`` gets the names of the folders that both are read from.
    """
    spark, old = docs.sparkSession, []
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.select("doc_id", "text", *keys_of_rows("doc_id", "text"))
    prints, whole, common = [], [], []  # what goes before the search, as only its start needs the prefixes
    every = written(prefixes(texts, 5, similarity), "prints", prints)
    marked = written(every.select("doc_id", "fp", *KEYS), "fingerprints", kept)
    firsts = [F.first(c, ignorenulls=True).alias(c) for c in ("sketch", "small", "prefix")]
    each = written(every.groupBy("fp", "id").agg(least_id("doc_id", *KEYS).alias("first"), F.count("*").alias("n"), *firsts), "sets", whole)
    remove(spark, *prints)
    # a set has each of its shingles once, so two rows of a shingle are two sets; its rows are shuffled once, and after its counts
    tokens = each.select("id", F.posexplode("prefix").alias("at", "token"))
    often = written(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "often", common)
    shared = written(tokens.join(often, "token").join(each.select("id", "fp"), "id").select("token", "n", "at", "fp"), "shared", old)
    remove(spark, *common)
    distinct = written(each.drop("prefix"), "distinct", old)
    remove(spark, *whole)

    def sets_of(pairs: DataFrame) -> DataFrame:
        """fp and sh of both ends; only their texts are read again."""
        wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct().join(distinct, "fp")
        used = written(wanted.select(*[F.col(f"first.{k}").alias(k) for k in KEYS]), "used", old)
        return written(shingle_sets(chosen(texts, used).select("doc_id", "text"), 5).dropDuplicates(["fp"]), "shingles", old)

    def checked(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar, of those that their sketches leave."""
        if pairs.isEmpty():
            return pairs
        left = written(possible(pairs, distinct, similarity, old), "possible", old)
        both = with_both(left, sets_of(left), "sh", old, 100).withColumn("n", F.size(F.array_intersect("sh_a", "sh_b")))
        return written(both.where(F.col("n") >= F.lit(similarity) * (F.size("sh_a") + F.size("sh_b") - F.col("n"))).select("a", "b"), "checked", old)

    sub = F.pmod(F.xxhash64("token", "fp"), F.ceil(F.col("n") / HOT)).alias("sub")
    buckets = shared.select(F.pmod("token", F.lit(64)).cast("int").alias("tab"), F.col("token").alias("key"), sub, "fp")
    near = checked(written(links(buckets, ["tab", "key", "sub"], radius, slice(0, 32), first_earlier).distinct(), "links", old))
    stars = components(near)
    others = written(other_pairs(shared, stars, distinct, similarity), "others", old)
    rest, open_ = others.where("sure").select("a", "b"), others.where("not sure").select("a", "b")
    if not open_.isEmpty():
        rest = rest.union(written(tree_links(components(open_), stars, sets_of(open_), similarity, old), "trees", old))
    if not rest.isEmpty():
        stars = components(near.union(rest))
    groups = named(distinct.select("fp", "n", "first"), stars, kept)
    remove(spark, *old)
    return marked, groups


def similar_texts(docs: DataFrame, *, similarity: float = 0.8, radius: int = 36, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of texts whose sets of five-word shingles have a Jaccard similarity of ``similarity`` or more.

    Texts with one set of shingles are one. Of two similar sets, the prefixes share a shingle. In the
    bucket of each prefix shingle every set is compared with all others by bit-sliced SimHash and linked
    with the first one within the radius; links are checked on the sets. Then the pairs of a bucket that
    checked links have not joined are compared, too, if sizes, places, and SimHash at a distance that similar
    sets practically never have, leave it possible: small sets in the bucket, others in the tree of such pairs. The component is named by its smallest id, null if no row has one.
    """
    rows, groups = similar_groups(docs, similarity=similarity, radius=radius, id_col=id_col, text_col=text_col)
    facts = groups.select("fp", "n", F.col("best.id").alias("component_id"))
    return looked_up(rows.select("doc_id", "fp"), facts, ["fp"], "n", rows.count()).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, *, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, whole, of each group of ``similar_texts``: the first by id, rows without id last, then by the text's hash.

    Rows are told apart by id and text, so different texts under one id, or without id, are rows of their
    own; of rows that repeat both, one stays.
    """
    old: list[str] = []
    rows, groups = similar_groups(docs, similarity=similarity, id_col=id_col, text_col=text_col, kept=old)
    first = groups.select(*[F.col(f"best.{k}").alias(k) for k in KEYS]).distinct()
    several = rows.groupBy(*KEYS).agg(F.count("*").alias("several")).where("several > 1")
    kept = written(first.join(several, KEYS, "left").select(*KEYS, F.coalesce("several", F.lit(1).cast("long")).alias("n"), (F.col("several") > 1).alias("_more")), "kept")
    # the row travels as one struct, so its columns may have any names
    own = docs.select(F.struct("*").alias("row"), *keys_of_rows(id_col, text_col))
    found = looked_up(own, kept, KEYS, "n", rows.count())
    remove(docs.sparkSession, *old)
    if kept.where("n > 1").isEmpty():
        return found.select("row.*")
    once = found.where("_more").dropDuplicates(KEYS)
    return found.where("_more is null").union(once).select("row.*")
