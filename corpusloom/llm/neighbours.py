"""The most similar vectors of every vector (problem 2), by an inverted multi-index.

Each vector is cut into two halves and each half is quantised by its own codebook of K centroids, so K*K cells
exist with only 2*K centroids. K follows the number of vectors (about `per_cell` a cell), so the candidates of
one query stay level as the collection grows. A query walks the centroid pairs by summed distance with a heap,
visits the `probes` nearest cells, and the entries found there are reranked by their exact cosine in double
precision.

Shuffle layout: an index row goes to the centroid of its first half; a query row goes once to each distinct
first centroid among its cells and carries the second centroids as a short list, so a vector is not sent once
per cell. First centroids with more than `block` entries or queries are split into a grid of entry and query salts, so no
task sees an unbounded group. Exact copies of a vector are indexed once and expanded at the end.

The codebooks are fitted on a sample of at most `sample` vectors (the only sampled step); all vectors are
indexed and all are queries.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, latest

PLANNED = 64
Codebooks = dict[int, tuple[np.ndarray, np.ndarray]]


def valid_vectors(rows: DataFrame) -> DataFrame:
    """chunk_id, scope, vector: the latest usable vector of each chunk_id.

    Null ids, null or empty vectors, vectors with null or non-finite values and zero vectors have no cosine and
    are left out. A null scope is a scope of its own. `indexed_at` decides between repeated ids where present.
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    stamp = F.col("indexed_at") if "indexed_at" in rows.columns else F.lit(0)
    kept = rows.select("chunk_id", "scope", F.col("vector").cast("array<float>").alias("vector"), stamp.alias("indexed_at")).where(F.col("chunk_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)
    return latest(kept, ["chunk_id"], ["indexed_at", "scope"], ["scope", "vector", "indexed_at"]).drop("indexed_at")


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"chunk_id": b["chunk_id"], "scope": b["scope"], "dim": [len(v) for v in b["vector"]], "vec": [np.asarray(v, dtype="<f4").tobytes() for v in b["vector"]]})


def packed(vectors: DataFrame) -> DataFrame:
    """chunk_id, space, key, vec: the vector as bytes; `space` separates scopes and lengths, `key` names equal vectors."""
    rows = vectors.mapInPandas(_pack, "chunk_id string, scope string, dim int, vec binary")
    return rows.select("chunk_id", F.to_json(F.struct("scope", "dim")).alias("space"), "vec").withColumn("key", F.xxhash64("space", "vec"))


def _unit(raw: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(raw), dtype="<f4").reshape(len(raw), -1).astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _halves(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = (m.shape[1] + 1) // 2
    return m[:, :h], m[:, h:]


def _distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points * points).sum(1)[:, None] - 2 * points @ centroids.T + (centroids * centroids).sum(1)[None, :]


def _kmeans(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from evenly spaced distinct points; an empty cluster keeps its centroid."""
    distinct = np.unique(points, axis=0)
    k = min(k, len(distinct))
    order = np.random.default_rng(17).permutation(len(distinct))[:k]
    centroids = distinct[order].copy()
    for _ in range(rounds):
        near = np.concatenate([_distances(points[i : i + 4096], centroids).argmin(1) for i in range(0, len(points), 4096)])
        sums, counts = np.zeros_like(centroids), np.bincount(near, minlength=k)
        np.add.at(sums, near, points)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def fit_codebooks(index: DataFrame, n: int, per_cell: int, sample: int, centroids: int | None = None, most_centroids: int = 8192) -> Codebooks:
    """Two codebooks of `centroids` (else about n / per_cell cells) for each length, from about `sample` vectors chosen by hash."""
    share = min(1.0, sample / max(1, n))
    picked = index.select("vec").where(F.pmod(F.col("key"), F.lit(1_000_003)) < int(share * 1_000_003) + 1)  # no limit: it would gather one partition
    by_dim: dict[int, list[bytes]] = {}
    for v in picked.toArrow().column("vec").to_pylist():
        by_dim.setdefault(len(v) // 4, []).append(v)
    k = max(1, min(most_centroids, centroids or round(math.sqrt(n / per_cell))))
    return {dim: tuple(_kmeans(half, k) if half.shape[1] else np.zeros((1, 0)) for half in _halves(_unit(raw))) for dim, raw in by_dim.items()}


def probe_cells(d1: np.ndarray, d2: np.ndarray, probes: int) -> list[tuple[int, int]]:
    """The `probes` centroid pairs of least summed distance, walked with a heap over the two sorted lists."""
    o1, o2 = d1.argsort(kind="stable"), d2.argsort(kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap, out = [(s1[0] + s2[0], 0, 0)], []
    while heap and len(out) < probes:
        _, i, j = heapq.heappop(heap)
        out.append((int(o1[i]), int(o2[j])))
        if j + 1 < len(s2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return out


def _by_dim(batch: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    dims = batch["vec"].map(len) // 4
    for dim in sorted(dims.unique()):
        yield dim, batch[dims == dim]


def _entries(books: Codebooks) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, b in _by_dim(batch):
                c1 = c2 = np.zeros(len(b), dtype=np.int32)
                if dim in books:  # a length the sample missed is one cell, searched whole
                    c1, c2 = (_distances(half, book).argmin(1).astype(np.int32) for half, book in zip(_halves(_unit(list(b["vec"]))), books[dim]))
                yield pd.DataFrame({"space": b["space"], "c1": c1, "c2": c2, "key": b["key"], "vec": b["vec"]})

    return run


def _probes(books: Codebooks, probes: int | float) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, b in _by_dim(batch):
                rows, most = [], probes
                if dim in books:
                    most = probes if isinstance(probes, int) else math.ceil(probes * len(books[dim][0]) * len(books[dim][1]))
                    d1, d2 = (_distances(half, book) for half, book in zip(_halves(_unit(list(b["vec"]))), books[dim]))
                for n, (space, key, vec) in enumerate(zip(b["space"], b["key"], b["vec"])):
                    lists: dict[int, list[int]] = {}
                    for i, j in probe_cells(d1[n], d2[n], most) if dim in books else [(0, 0)]:
                        lists.setdefault(i, []).append(j)
                    rows += [(space, i, np.asarray(js, dtype="<i2").tobytes(), key, vec) for i, js in lists.items()]
                yield pd.DataFrame(rows, columns=["space", "c1", "c2s", "key", "vec"])

    return run


def _match(k: int, min_cosine: float, both: bool) -> Callable:
    """Rerank the entries of a block for its queries: cells as matrix products in single precision, with a running
    list of the k best for each query whose floor skips rows that cannot enter; the lists in double precision.
    With `both` a pair is given from either end, since what one side sees holds for the other.
    """

    def run(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"key": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})
        if not len(entries) or not len(queries):
            return empty
        entries = entries.sort_values(["c2", "key"], kind="stable")
        e_unit, e_key, c2 = _unit(list(entries["vec"])), entries["key"].to_numpy(), entries["c2"].to_numpy()
        q_unit, q_key = _unit(list(queries["vec"])), queries["key"].to_numpy()
        e_single, q_single = e_unit.astype(np.float32), q_unit.astype(np.float32)
        lists = [np.frombuffer(x, dtype="<i2") for x in queries["c2s"]]
        cell, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = cell.argsort(kind="stable")
        cell, owner = cell[order], owner[order]
        least = min_cosine - 1e-5
        score = np.full((len(q_key), k), -np.inf, dtype=np.float32)
        place = np.zeros((len(q_key), k), dtype=np.int64)
        for c in np.unique(c2):
            lo, hi = np.searchsorted(c2, [c, c + 1])
            a, b = np.searchsorted(cell, [c, c + 1])
            step = max(1, 2_000_000 // (hi - lo))
            for at in range(a, b, step):
                who = owner[at : min(b, at + step)]
                cos = q_single[who] @ e_single[lo:hi].T
                cos[q_key[who][:, None] == e_key[lo:hi][None, :]] = -np.inf
                floor = score[who].min(axis=1)
                rows = np.flatnonzero(cos.max(axis=1) > np.maximum(floor, least))
                if not len(rows):
                    continue
                who, cos = who[rows], cos[rows]
                joint = np.concatenate([score[who], cos], axis=1)
                where = np.concatenate([place[who], np.broadcast_to(np.arange(lo, hi), cos.shape)], axis=1)
                top = np.argpartition(-joint, k - 1, axis=1)[:, :k]
                score[who] = np.take_along_axis(joint, top, axis=1)
                place[who] = np.take_along_axis(where, top, axis=1)
        q, n = np.nonzero(score > least)
        e = place[q, n]
        exact = np.concatenate([np.einsum("ij,ij->i", q_unit[q[x : x + 65_536]], e_unit[e[x : x + 65_536]]) for x in range(0, len(q), 65_536)]) if len(q) else np.empty(0)
        keep = exact >= min_cosine
        a, b, exact = q_key[q[keep]], e_key[e[keep]], exact[keep]
        if both:
            a, b, exact = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([exact, exact])
        return pd.DataFrame({"key": a, "other": b, "cosine": exact})

    return run


def similar_vectors(rows: DataFrame, k: int = 10, min_cosine: float = -1.0, probes: int | float = 12, per_cell: int = 32, centroids: int | None = None, sample: int = 32_768, block: int = 20_000, most_centroids: int = 8192) -> DataFrame:
    """chunk_id, scope, neighbour_id, cosine, rank: up to k most similar other chunks of the same scope.

    `probes` is a number of cells, or as a float below 1 a share of all cells: near neighbours (cosine over 0.8)
    lie in the first few cells at any size, while neighbours hardly nearer than chance need a large share.
    Ties go to the smaller neighbour_id; between equally near groups of copies at the very cut, to the one the
    index meets first, which is the same in every run. Lone vectors and empty input give no rows. Results are approximate by the probing only: see
    `recall` for the measured share. `most_centroids` a half serve per_cell * most_centroids ** 2 vectors (two billion);
    beyond that cells grow, so raise it with `sample`, which should hold several vectors a centroid.
    """
    all_rows = cut(packed(valid_vectors(rows)))
    index = cut(all_rows.groupBy("key").agg(F.first("space").alias("space"), F.first("vec").alias("vec"), F.count("*").alias("copies")))
    n = index.count()
    books = fit_codebooks(index, n, per_cell, sample, centroids, most_centroids)
    entries = index.select("space", "key", "vec").mapInPandas(_entries(books), "space string, c1 int, c2 int, key bigint, vec binary")
    queries = index.select("space", "key", "vec").mapInPandas(_probes(books, probes), "space string, c1 int, c2s binary, key bigint, vec binary")
    # At most `most_centroids` first centroids a space; only those above the block size, in entries or queries, need a grid.
    # Which draw many queries is estimated from one in PLANNED of them; that decides the cut into blocks, and no result.
    held = {(r["space"], r["c1"]): r["count"] for r in entries.groupBy("space", "c1").count().where(F.col("count") > block).collect()}
    planned = index.where(F.pmod(F.xxhash64("key"), F.lit(PLANNED)) == 0).select("space", "key", "vec").mapInPandas(_probes(books, probes), "space string, c1 int, c2s binary, key bigint, vec binary")
    asked = {(r["space"], r["c1"]): r["count"] * PLANNED for r in planned.groupBy("space", "c1").count().collect()}  # at most the first centroids
    rows_asked = sum(asked.values())
    asked = {place: k for place, k in asked.items() if k > block}
    hot = [(space, c1, math.ceil(held.get((space, c1), 1) / block), math.ceil(asked.get((space, c1), 1) / block)) for space, c1 in sorted({*held, *asked})]
    if hot:
        cuts = F.broadcast(index.sparkSession.createDataFrame(hot, "space string, c1 int, e_parts int, q_parts int"))
        entries, queries = (x.join(cuts, ["space", "c1"], "left") for x in (entries, queries))
        e_parts, q_parts = F.coalesce("e_parts", F.lit(1)), F.coalesce("q_parts", F.lit(1))
        salt = lambda parts: F.pmod(F.xxhash64("key"), parts).cast("int")
        every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
        entries = entries.withColumn("es", salt(e_parts)).withColumn("qs", every(q_parts)).drop("e_parts", "q_parts")
        queries = queries.withColumn("qs", salt(q_parts)).withColumn("es", every(e_parts)).drop("e_parts", "q_parts")
    keys = ["space", "c1", *(["es", "qs"] if hot else [])]
    # As many tasks as the rows need: the groups of a cogroup are not split by the adaptive plan.
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((n + rows_asked) / (4 * block)))
    entries, queries = entries.repartition(tasks, *keys), queries.repartition(tasks, *keys)
    near = entries.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(_match(k, min_cosine, min_cosine > 0), "key bigint, other bigint, cosine double")
    if min_cosine > 0:
        near = near.groupBy("key", "other").agg(F.max("cosine").alias("cosine"))
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("cosine"), "other"))).where(F.col("r") <= k).select("key", "other", "cosine")
    # Copies: k + 1 members of a group are enough for anybody's k nearest.
    members = all_rows.select("key", "chunk_id")
    some = members.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("chunk_id"))).where(F.col("r") <= k + 1).select(F.col("key").alias("other"), F.col("chunk_id").alias("neighbour_id"))
    copied = index.where(F.col("copies") > 1).select("key", F.col("key").alias("other"), F.lit(1.0).alias("cosine"))
    wide = all_rows.select("key", "chunk_id", "space").join(top.unionByName(copied), "key").join(some, "other").where(F.col("chunk_id") != F.col("neighbour_id"))
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("cosine"), "neighbour_id"))
    return wide.withColumn("rank", rank).where(F.col("rank") <= k).select("chunk_id", F.get_json_object("space", "$.scope").alias("scope"), "neighbour_id", "cosine", "rank")


def similar_pairs(rows: DataFrame, min_cosine: float = 0.9, k: int = 10) -> DataFrame:
    """chunk_id_a < chunk_id_b, cosine: distinct pairs among the k nearest whose cosine reaches the threshold."""
    near = similar_vectors(rows, k=k, min_cosine=min_cosine)
    pair = near.select(F.least("chunk_id", "neighbour_id").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour_id").alias("chunk_id_b"), "cosine")
    return pair.groupBy("chunk_id_a", "chunk_id_b").agg(F.max("cosine").alias("cosine"))


def exact_neighbours(rows: DataFrame, k: int = 10, every: int = 50, block: int = 4096) -> DataFrame:
    """Brute force for a stated query set: ids whose CRC is divisible by `every`, against all rows, in blocks.

    At most `block` query vectors are on the driver and in a task at a time.
    """
    all_rows = cut(packed(valid_vectors(rows)).select("chunk_id", "space", "vec"))
    picked = all_rows.where(F.crc32("chunk_id") % every == 0)
    blocks = max(1, math.ceil(picked.count() / block * 1.25))
    parts = []
    for n in range(blocks):
        part = picked.where(F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)) == n).toArrow().to_pydict()
        by_space: dict[str, tuple[list, list]] = {}
        for cid, space, vec in zip(part["chunk_id"], part["space"], part["vec"]):
            ids, vecs = by_space.setdefault(space, ([], []))
            ids.append(cid)
            vecs.append(vec)
        parts.append(all_rows.mapInPandas(_scan({s: (np.array(i, dtype=object), _unit(v)) for s, (i, v) in by_space.items()}, k), "chunk_id string, neighbour_id string, cosine double"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("cosine"), "neighbour_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _scan(queries: dict[str, tuple[np.ndarray, np.ndarray]], k: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for space, b in batch.groupby("space"):
                if space not in queries:
                    continue
                ids, unit = queries[space]
                e_ids, e_unit = b["chunk_id"].to_numpy(), _unit(list(b["vec"]))
                for at in range(0, len(ids), 512):
                    who = ids[at : at + 512]
                    cos = unit[at : at + 512] @ e_unit.T
                    cos[who[:, None] == e_ids[None, :]] = -2
                    if cos.shape[1] > k:
                        hit = cos >= np.partition(cos, cos.shape[1] - k, axis=1)[:, -k][:, None]
                    else:
                        hit = cos > -2
                    r, s = np.nonzero(hit)
                    yield pd.DataFrame({"chunk_id": who[r], "neighbour_id": e_ids[s], "cosine": cos[r, s]})

    return run


def recall(rows: DataFrame, k: int = 10, every: int = 50, **index: float) -> DataFrame:
    """scope, n_queries, n_true, n_found, recall: the index against brute force on the stated query set.

    A neighbour as near as the true k-th counts as true, so copies at the cut do not decide.
    """
    truth = exact_neighbours(rows, k, every)
    floor = truth.groupBy("chunk_id").agg(F.min("cosine").alias("floor"), F.count("*").alias("n_true"))
    got = similar_vectors(rows, k, **index).join(floor, "chunk_id").where(F.col("cosine") >= F.col("floor") - 1e-9)
    hits = got.groupBy("chunk_id", "scope").agg(F.count("*").alias("n_found"))
    scopes = valid_vectors(rows).select("chunk_id", "scope")
    return (
        floor.join(scopes, "chunk_id")
        .join(hits.drop("scope"), "chunk_id", "left")
        .groupBy("scope")
        .agg(F.count("*").alias("n_queries"), F.sum("n_true").alias("n_true"), F.sum(F.coalesce("n_found", F.lit(0))).alias("n_found"))
        .withColumn("recall", F.round(F.col("n_found") / F.col("n_true"), 4))
    )
