"""Exact top-k search by inner product with a pivot-distance index.

Vectors are lifted into a space with one more component, sqrt(M^2 - |v|^2) with M the largest
norm, where the largest inner product is the smallest distance. Every vector is keyed by its
nearest pivot and its distance to it; vectors of one pivot, sorted by distance, are cut into annuli
of a bounded number of vectors. A block of queries visits annuli by their lower bound,
|d(query, pivot) - distance| from the triangle inequality, and each query stops once the bound
admits no score as large as its k-th. Bounds are widened by far more than rounding can take, and
scores are exact integers, so the result is exact. Pivots grow as the square root of the number of
vectors, up to ``PIVOT_BYTES`` in all.

Equal vectors are kept once, with their smallest ids: no other copy can be in a result, as
ties go to the smaller id. Equal query vectors are searched once. Annuli are binary files in the
shared folder; their table (pivot, distances, place) has one row for some thousand vectors.

Vectors that are null or hold nulls, NaN or infinities, before or after scaling, and rows without id,
take no part; missing trailing components count as zero; exact repeats of a row count once, as candidate
and as query; different vectors under one id are candidates and queries each, but never candidates of
their own id; scores beyond 64 bits rank exactly and are shown as the largest or smallest long; fewer
than k candidates give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import looked_up, open_store, run_dir, slices, written

#: Vectors of an annulus at most, queries searched together, and annuli bounded together.
ANNULUS, QUERIES, ACROSS = 2048, 256, 4096
#: Bytes of all pivots at most, which every task holds.
PIVOT_BYTES = 1 << 25
LONG = 2**63
ANNULI = pa.schema([("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int32()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def quantised(vectors: DataFrame, k: int, scale: int, id_col: str, vec_col: str, query: bool) -> DataFrame:
    """Distinct whole-number vectors as bytes (float64, trailing zeros cut) with their k + 1 smallest ids; all ids for queries."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    schema = pa.schema([("v", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen: dict[bytes, list[int]] = {}
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if None in x:
                    continue
                with np.errstate(over="ignore"):
                    a = np.floor(np.array(x, np.float64) * scale) + 0.0  # no negative zeros
                if np.isfinite(a).all():
                    seen.setdefault(np.trim_zeros(a, "b").astype("<f8").tobytes(), []).append(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([sorted(set(x)) if query else sorted(set(x))[: k + 1] for x in seen.values()], schema.types[1])], schema=schema)

    found = rows.mapInArrow(work, "v binary, ids array<long>")
    return found if query else found.groupBy("v").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))


def unpacked(blobs: list[bytes], dim: int) -> np.ndarray:
    """Vectors of equal length."""
    out = np.zeros((len(blobs), dim))
    for row, blob in zip(out, blobs, strict=True):
        v = np.frombuffer(blob, "<f8")
        row[: len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows: int64, or Python's whole numbers where those could overflow."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62 and max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return exact(a) @ exact(b).T


def lifted(a: np.ndarray, top: float) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.column_stack([a, np.sqrt(np.maximum(0, top - (a * a).sum(axis=1)))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)))


def build(distinct: DataFrame, pivots: np.ndarray, dim: int, top: float) -> DataFrame:
    """Write the annuli; their table."""
    spark = distinct.sparkSession
    folder = run_dir(spark, "annuli")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if batch.num_rows:
                d = distances(lifted(unpacked(batch.column(0).to_pylist(), dim), top), pivots)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), *batch.columns], names=["pivot", "d", "v", "ids"])

    keyed = written(distinct.mapInArrow(key, "pivot int, d double, v binary, ids array<long>"), "keyed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        held: list[tuple] = []
        rows: list[dict] = []
        name, at, out = uuid.uuid4().hex, 0, None

        def flush(upto: int) -> None:
            nonlocal at, out
            part = held[:upto]
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}")
            sink = pa.BufferOutputStream()
            table = pa.table({"v": pa.array([r[2] for r in part], pa.binary()), "ids": pa.array([r[3] for r in part], pa.list_(pa.int64()))})
            with pa.ipc.new_stream(sink, table.schema) as stream:
                stream.write_table(table)
            data = sink.getvalue()
            out.write(data)
            rows.append({"pivot": part[0][0], "low": part[0][1], "high": part[-1][1], "n": len(part), "path": f"{folder}/{name}", "offset": at, "length": data.size})
            at += data.size
            del held[:upto]

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[0][0] != row[0] or len(held) >= ANNULUS):
                    flush(len(held))
                held.append(row)
        if held:
            flush(len(held))
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pylist(rows, schema=ANNULI)

    ordered = keyed.repartitionByRange("pivot", "d", "v").sortWithinPartitions("pivot", "d", "v")
    return written(ordered.mapInArrow(cut, "pivot int, low double, high double, n int, path string, offset long, length long"), "annuli-table")


def search_block(queries: np.ndarray, near: np.ndarray, annuli: dict[str, np.ndarray], load, top: float, keep: int) -> list[list[tuple[int, int]]]:
    """The ``keep`` best (score, id) of each query. near: distances of queries and pivots."""
    best: list[list[tuple[int, int]]] = [[] for _ in queries]
    bar = np.full(len(queries), -np.inf)
    with np.errstate(all="ignore"):
        q2 = (queries * queries).sum(axis=1)
        slack = 1e-6 * (top + q2 + 1)

    def most(begin: int, end: int) -> np.ndarray:
        """The largest score that each annulus can hold for each query."""
        with np.errstate(all="ignore"):
            d = near[:, annuli["pivot"][begin:end]]
            bound = np.maximum(0, np.maximum(d - annuli["high"][begin:end], annuli["low"][begin:end] - d))
            out = (q2[:, None] + top - bound**2) / 2 + slack[:, None]
        return np.where(np.isnan(out), np.inf, out)

    n = len(annuli["pivot"])
    ceiling = np.concatenate([most(begin, min(n, begin + ACROSS)).max(axis=0) for begin in range(0, n, ACROSS)])
    for k in np.argsort(-ceiling, kind="stable").tolist():
        if ceiling[k] < bar.min():
            break  # nor can any annulus behind it
        at = np.flatnonzero(most(k, k + 1)[:, 0] >= bar)
        if not len(at):
            continue
        vectors, ids = load(k)
        for q, row in zip(at.tolist(), products(queries[at], vectors), strict=True):
            least = np.sort(row)[-keep] if len(row) > keep else row.min()
            found = [(int(row[j]), i) for j in np.flatnonzero(row >= max(least, bar[q])).tolist() for i in ids[j]]
            best[q] = sorted(best[q] + found, key=lambda x: (-x[0], x[1]))[:keep]
            if len(best[q]) == keep:
                score = best[q][-1][0]
                bar[q] = score if abs(score) < 2**53 else np.nextafter(float(score), -np.inf)
    return best


def top_k(vectors: DataFrame, queries: DataFrame, k: int, *, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` the k best other rows of ``vectors``."""
    spark = vectors.sparkSession
    distinct = written(quantised(vectors, k, scale, id_col, vec_col, False), "vectors")
    asked = written(quantised(queries, k, scale, id_col, vec_col, True), "queries")
    facts = distinct.agg(F.max(F.octet_length("v")).alias("bytes"), F.count("*").alias("n")).first()
    wanted = asked.agg(F.max(F.octet_length("v")).alias("bytes"), F.sum(F.size("ids")).alias("rows"), F.count("*").alias("n")).first()
    out = "query_id long, rank int, vec_id long, score long"
    if not facts["n"] or not wanted["n"]:
        return spark.createDataFrame([], out)
    dim = max(1, facts["bytes"] // 8, wanted["bytes"] // 8)
    # of the best, so many may be of the query's own id
    own = distinct.select(F.explode("ids").alias("id")).groupBy("id").count().agg(F.max("count")).first()[0]

    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a = unpacked(batch.column(0).to_pylist(), dim)
            with np.errstate(over="ignore"):
                yield pa.RecordBatch.from_arrays([pa.array([float((a * a).sum(axis=1).max(initial=0))])], names=["top"])

    top = distinct.select("v").mapInArrow(norm, "top double").agg(F.max("top")).first()[0]
    n_pivots = int(max(1, min(PIVOT_BYTES // (8 * dim + 8), facts["n"] ** 0.5 / 4)))
    chosen = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(n_pivots).collect()
    pivots = lifted(unpacked([bytes(r["v"]) for r in chosen], dim), top)
    annuli = build(distinct, pivots, dim, top)
    places = annuli.inputFiles()
    shared = spark.sparkContext.broadcast(pivots)

    def pivot_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a = np.column_stack([unpacked(batch.column(0).to_pylist(), dim), np.zeros(batch.num_rows)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(distances(a, shared.value).argmin(axis=1).astype(np.int32))], names=["v", "n", "pivot"])

    # blocks of queries near one pivot visit the same annuli; a stated number of tasks is never merged
    tasks = max(spark.sparkContext.defaultParallelism, -(-wanted["n"] // QUERIES))
    different = asked.groupBy("v").agg(F.sum(F.size("ids")).alias("n"))
    grouped = different.mapInArrow(pivot_of, "v binary, n long, pivot int").repartitionByRange(tasks, "pivot", "v").sortWithinPartitions("pivot", "v")
    found_schema = pa.schema([("v", pa.binary()), ("n", pa.int64()), ("best", pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64())])))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        table = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if table is None:
                table = pa.concat_tables([pq.read_table(path, filesystem=store) for store, path in map(open_store, places)])
                ring = {c: table.column(c).to_numpy() for c in ("pivot", "low", "high", "offset", "length")}
                paths = table.column("path")

            def load(j: int) -> tuple[np.ndarray, list[list[int]]]:
                store, path = open_store(paths[j].as_py())
                with store.open_input_file(path) as source:
                    source.seek(int(ring["offset"][j]))
                    got = pa.ipc.open_stream(source.read(int(ring["length"][j]))).read_all()
                return unpacked(got.column("v").to_pylist(), dim), got.column("ids").to_pylist()

            for part in slices(iter([batch]), QUERIES):
                a = unpacked(part.column(0).to_pylist(), dim)
                best = search_block(a, distances(np.column_stack([a, np.zeros(len(a))]), shared.value), ring, load, top, k + own)
                shown = [[{"score": max(-LONG, min(LONG - 1, s)), "id": i} for s, i in row] for row in best]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shown, found_schema.types[2])], schema=found_schema)

    results = written(grouped.mapInArrow(search, "v binary, n long, best array<struct<score:long,id:long>>"), "best")
    rows = looked_up(asked.select("v", F.explode("ids").alias("query_id")).distinct(), results, ["v"], "n", wanted["rows"])
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k)
    opened = rows.select("query_id", F.posexplode(others).alias("at", "b"))
    return opened.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))
