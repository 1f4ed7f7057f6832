"""Nearest neighbours by inner product: probed lists, each scanned with adaptive numbers of dimensions.

Directions are grouped into lists around centroids of a bounded sample; every vector is in one list. A
query probes the lists whose centroids suit it best; how many is measured on the sample, so that brute
force agrees for at least Settings.recall of the neighbours. The best lists that together hold more than k
rows are scanned first; the k-th best there is the query's bar in its other lists. A scan that is given no
bar takes it from the k best of Settings.first vectors of its list. Within a list, vectors lie rotated in
column blocks. After each block the partial squared distance, scaled to all dimensions, is tested against
the distance that the bar allows; a candidate whose test rejects at Settings.epsilon is abandoned.
Survivors get their inner product on the original vectors in double precision. A query whose lists gave
fewer than k (rows repeated, or its own) goes on to all other lists.

A list's vectors and its queries are dealt to chunks and every pair of chunks is one group, so a list that
holds a third of all vectors is scanned by many tasks. Equal vectors of a chunk are scanned once: ties go
to the smaller id, so only the k + 1 smallest ids of each can be among anyone's nearest.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, or have another
dimension than most, take no part, nor do null ids; rows with the query's own id are its own and never its
candidates; repeated rows count once; of different vectors with one id the nearest is the candidate, the least is the query; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.support import materialize


@dataclass(frozen=True)
class Settings:
    k: int = 20
    #: Rows that the index is fitted on: the least number, more with the root of the table's rows, the most, and the most bytes that they take.
    sample: int = 20_000
    growth: float = 40.0
    most_sample: int = 200_000
    sample_bytes: int = 256 << 20
    #: Queries among them that the number of probes is measured with.
    trials: int = 256
    #: Share of the true neighbours that the probed lists must hold on the sample.
    recall: float = 0.97
    #: Vectors, and queries, of a list that one task scans at a time.
    chunk: int = 8192
    #: Vectors of a list that give a bar where there is none yet.
    first: int = 256
    #: Dimensions of a column block, and the test's width in standard deviations.
    block: int = 16
    epsilon: float = 2.1
    seed: int = 7


    def sampled(self, rows: int, dimension: int) -> int:
        """How many rows of a table the index is fitted on."""
        wanted = min(self.most_sample, max(self.sample, int(self.growth * rows**0.5)) if self.sample >= 20_000 else self.sample)
        return max(1, min(wanted, self.sample_bytes // (8 * dimension)))


@dataclass
class Index:
    centroids: np.ndarray
    #: Longest vector of each list, and rows in it.
    norms: np.ndarray
    sizes: np.ndarray
    probes: int
    dimension: int


def rotation(dimension: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimension, dimension)))
    return q * np.sign(np.diag(r))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _nearest(u: np.ndarray, c: np.ndarray, cells: int = 1 << 23) -> np.ndarray:
    """The centroid of each unit vector, some rows at a time."""
    step = max(1, cells // max(1, len(c)))
    return np.concatenate([np.empty(0, np.int64), *((u[k : k + step] @ c.T).argmax(axis=1) for k in range(0, len(u), step))])


def _centroids(x: np.ndarray, lists: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng, u = np.random.default_rng(seed), _unit(x)
    c = u[rng.choice(len(u), lists, replace=False)]
    for _ in range(rounds):
        near = _nearest(u, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, u)
        empty = np.bincount(near, minlength=lists) == 0
        c = np.where(empty[:, None], c, _unit(np.where(empty[:, None], 1.0, sums)))
    return c


def _probe_order(q: np.ndarray, index: Index) -> np.ndarray:
    score = q @ index.centroids.T
    score = np.where(score > 0, score * index.norms, score)
    score[:, index.sizes == 0] = -np.inf
    return np.argsort(-score, axis=1, kind="stable")


def probed(q: np.ndarray, index: Index, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Lists of each query, best first: those that hold more than k rows, and the others up to the measured number."""
    order = _probe_order(q, index)
    held = np.cumsum(index.sizes[order], axis=1)
    enough, most = (held <= k).sum(axis=1) + 1, int((index.sizes > 0).sum())
    cut = [(o[: min(max(index.probes, n), most)], min(n, most)) for o, n in zip(order, enough.tolist(), strict=True)]
    return [o[:n] for o, n in cut], [o[n:] for o, n in cut]


def fit(x: np.ndarray, rows: int, s: Settings) -> Index:
    """Centroids and the number of probes from sampled vectors x of a table with so many rows."""
    # lists grow with the root of the rows; each has some rows of the sample to be fitted on
    lists = int(max(1, min(round(rows**0.5 / 2), max(len(x) // 4, 1))))
    c = _centroids(x, lists, s.seed)
    near = _nearest(_unit(x), c)
    norms = np.zeros(lists)
    np.maximum.at(norms, near, np.linalg.norm(x, axis=1))
    index = Index(c, norms, np.bincount(near, minlength=lists), lists, x.shape[1])
    q = x[np.random.default_rng(s.seed + 1).choice(len(x), min(len(x), s.trials), replace=False)]
    order = _probe_order(q, index)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None, :], axis=1)
    top = np.argsort(-(q @ x.T), axis=1)[:, : s.k + 1]
    at = np.take_along_axis(place, near[top], axis=1).ravel()
    index.probes = int(min(lists, np.quantile(at, s.recall, method="higher") + 2))
    return index


def lowered(score, size=np.abs):
    """A bar that rows of this score reach though sums in another order may differ in the last bits."""
    return score - 1e-9 * (1 + size(score))


def scan(queries: np.ndarray, own: np.ndarray, bar: np.ndarray, vectors: np.ndarray, ids: np.ndarray, s: Settings, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's k best among the vectors that reach its bar (-inf: none is known yet), by the adaptive dimension scan."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    vectors, ids = vectors[order], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(ids))
    x = vectors[starts]
    d, k = x.shape[1], s.k
    xr, qr = (x @ turn), (queries @ turn)
    cuts = list(range(0, d, s.block)) + [d]
    x2, q2 = (x * x).sum(axis=1), (queries * queries).sum(axis=1)
    head = (xr[:, : cuts[1]] ** 2).sum(axis=1)
    only = np.where(ends - starts == 1, ids[starts], np.iinfo(np.int64).min)  # the id of a vector that one row has
    first = np.unique(np.linspace(0, len(x) - 1, s.first).astype(np.int64))
    out_q, out_id, out_s = [], [], []
    for a in range(0, len(queries), 256):
        q, qq, low = queries[a : a + 256], qr[a : a + 256], bar[a : a + 256].copy()
        new = np.flatnonzero(low == -np.inf)
        sure_i = sure_j = np.empty(0, np.int64)
        if len(new) and len(first) > k:
            score = q[new] @ x[first].T
            score[only[first][None, :] == own[a + new][:, None]] = -np.inf
            top = np.argpartition(score, len(first) - k, axis=1)[:, len(first) - k :]
            kth = np.take_along_axis(score, top, axis=1)
            low[new] = np.where(kth.min(axis=1) > -np.inf, lowered(kth.min(axis=1)), -np.inf)
            known = kth > -np.inf
            sure_i, sure_j = np.broadcast_to(new[:, None], top.shape)[known], first[top[known]]
        # squared distance at which a vector's inner product equals the bar
        reach = np.maximum(q2[a : a + 256, None] + x2[None, :] - 2 * low[:, None], 0) + 1e-9
        hi = cuts[1]
        part = (qq[:, :hi] ** 2).sum(axis=1)[:, None] + head[None, :] - 2 * qq[:, :hi] @ xr[:, :hi].T
        i, j = np.nonzero(part * (d / hi) <= (1 + s.epsilon / hi**0.5) ** 2 * reach)
        p, limit = part[i, j], reach[i, j]
        for lo, hi in zip(cuts[1:], cuts[2:], strict=False):
            if not len(i):
                break
            step = np.empty(len(i))
            for b in range(0, len(i), 65536):
                step[b : b + 65536] = ((qq[i[b : b + 65536], lo:hi] - xr[j[b : b + 65536], lo:hi]) ** 2).sum(axis=1)
            p = p + step
            width = (1 + s.epsilon / hi**0.5) ** 2 if hi < d else 1 + 1e-9
            live = p * (d / hi) <= width * limit
            i, j, p, limit = i[live], j[live], p[live], limit[live]
        # those that made the bar are never abandoned; a query's own vector is no candidate
        i, j = np.divmod(np.unique(np.concatenate([i * len(x) + j, sure_i * len(x) + sure_j])), len(x))
        other = only[j] != own[a + i]
        i, j = i[other], j[other]
        exact = np.empty(len(i))
        for b in range(0, len(i), 65536):
            exact[b : b + 65536] = (q[i[b : b + 65536]] * x[j[b : b + 65536]]).sum(axis=1)
        best = np.lexsort((ids[starts[j]], -exact, i))
        i, j, exact = i[best], j[best], exact[best]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        # one of the k + 1 may be the query itself; all that tie with the last of them stay
        edge = np.full(len(q), -np.inf)
        at = rank == k
        edge[i[at]] = exact[at]
        for n in np.flatnonzero(exact >= edge[i]):
            mine = ids[starts[j[n]] : ends[j[n]]]
            mine = mine[: k + 1][mine[: k + 1] != own[a + i[n]]][:k]
            out_q.append(np.full(len(mine), a + i[n]))
            out_id.append(mine)
            out_s.append(np.full(len(mine), exact[n]))
    if not out_q:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    fq, fi, fs = np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_s)
    best = np.lexsort((fi, -fs, fq))
    fq, fi, fs = fq[best], fi[best], fs[best]
    few = np.arange(len(fq)) - np.searchsorted(fq, fq) < k
    return fq[few], fi[few], fs[few]


def valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dimension)


def nearest(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row for which is_query holds, among all rows."""
    s, spark = settings, vectors.sparkSession
    ok = vectors.withColumn("query_", F.coalesce(is_query, F.lit(False))).select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"), "query_").filter(F.col("id").isNotNull() & valid(F.col("v")))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = ok.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return empty
    dimension, rows = sizes[0]["d"], sizes[0]["n"]
    ok = ok.filter(F.size("v") == dimension)
    drawn = ok.orderBy(F.xxhash64("id"), "id").limit(s.sampled(rows, dimension)).select("id", "v").toArrow()
    drawn_x = drawn.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
    index = fit(drawn_x, rows, s)
    given = spark.sparkContext.broadcast(index.centroids)  # a quarter of the sample at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
                near = _nearest(_unit(x), given.value)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(near.astype(np.int32)), pa.array(np.linalg.norm(x, axis=1)), b.column(2)], names=["id", "v", "list", "norm", "query_"])

    placed = materialize(ok.mapInArrow(assign, "id long, v binary, list int, norm double, query_ boolean"))
    index.sizes[:] = 0
    for r in placed.groupBy("list").agg(F.count("*").alias("n"), F.max("norm").alias("m")).collect():  # one row for each list
        index.sizes[r["list"]], index.norms[r["list"]] = r["n"], r["m"]
    known = spark.sparkContext.broadcast(index)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, (1 << 21) // len(known.value.centroids))
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                near, far = probed(_matrix(b.column(1), dimension), known.value, s.k)
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.astype(np.int32) for x in near], kind), pa.array([x.astype(np.int32) for x in far], kind)], names=["id", "v", "near", "far"])

    asked = materialize(placed.filter("query_").groupBy("id").agg(F.min("v").alias("v")).mapInArrow(probe, "id long, v binary, near array<int>, far array<int>"))
    turn = rotation(dimension, s.seed)

    def cell(of: pd.DataFrame, by: pd.DataFrame) -> pd.DataFrame:
        if not len(of) or not len(by):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        of = of.drop_duplicates(["id", "v"])
        matrix = lambda f: np.frombuffer(b"".join(f["v"]), np.float64).reshape(-1, dimension)
        own = by["id"].to_numpy(np.int64)
        q, i, score = scan(matrix(by), own, by["bar"].to_numpy(), matrix(of), of["id"].to_numpy(np.int64), s, turn)
        return pd.DataFrame({"query_id": own[q], "vec_id": i, "score": score})

    def hits(asked: DataFrame) -> DataFrame:
        """query_id, vec_id, score: the k best of each list that is asked (id, v, bar, list)."""
        chunks = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / s.chunk).cast("int").alias(name))
        cells = materialize(chunks(placed, "vcs").join(chunks(asked, "qcs"), "list"))
        deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = placed.select("id", "v", "list").join(cells, "list").select("id", "v", "list", deal("vcs").alias("vc"), every("qcs").alias("qc"))
        right = asked.join(cells, "list").select("id", "v", "bar", "list", every("vcs").alias("vc"), deal("qcs").alias("qc"))
        keys = ["list", "vc", "qc"]
        return materialize(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, "query_id long, vec_id long, score double"))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= s.k)
    none = F.lit(float("-inf"))
    # a vec_id counts once, by the nearest of its vectors
    once = lambda df: df.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    found = hits(asked.select("id", "v", none.alias("bar"), F.explode("near").alias("list")))
    bars = ranked(once(found)).filter(F.col("rank") == s.k).select(F.col("query_id").alias("id"), lowered(F.col("score"), F.abs).alias("bar"))
    found = found.unionByName(hits(asked.join(bars, "id", "left").select("id", "v", F.coalesce("bar", none).alias("bar"), F.explode("far").alias("list"))))
    # rows that are repeated or the query's own fill lists too: who lacks some of the k goes on to all other lists
    every_list = F.sequence(F.lit(0), F.lit(len(index.sizes) - 1))
    got = once(found).groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"))
    short = asked.join(got, "id", "left").filter(F.coalesce("n", F.lit(0)) < s.k)
    short = materialize(short.select("id", "v", none.alias("bar"), F.explode(F.array_except(every_list, F.concat("near", "far"))).alias("list")))
    if not short.isEmpty():
        found = found.unionByName(hits(short))
    return ranked(once(found)).select("query_id", "rank", "vec_id", "score")
