"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

Candidates lie in blocks of at most CANDIDATES rows: each is placed with the nearest of some centres, which are fitted on
a bounded sample, and the rows of a centre are cut into rings by their distance from it. Each block holds one
sorted list per dimension. A query reads the lists from its best end in growing depths, scores what it has not
met, and stops when no unmet vector can beat its kth score: the bound is the query's product with the values
where the lists stand. A first pass over the block of the centre that suits it best gives each query a lower bound
of its kth score, which it takes along. No vector within r of a centre c scores more than q c + |q| r, so blocks that
cannot reach the bound are not visited at all, and in the others the search stops by it at once. A query is copied
once for each block that it visits, and a block once for each QUERIES queries that visit it, so that both grow
with visits.

Defined cases: vectors that are null, empty, of another length than the query's, or that hold null
or non-finite components take no part; ties go to the smaller id; equal vectors are scored once and all
count; a query never finds its own id; rows with a null id take no part; repeated rows count once, and an id with
several vectors, on either side, scores the best of its pairs, so that no query finds an id twice; fewer
candidates than k give fewer rows; other columns are ignored. A score has 64 bits: vectors of a norm of LARGEST or
more, whose products might not fit, raise an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shinglery.llm.common import discard, written
from shinglery.llm.mixing import ranged, running

#: Rows of a block of candidates and of a group of queries, the most centres, and rows on which these are fitted.
CANDIDATES, QUERIES, CENTRES, SAMPLE = 8192, 16384, 256, 4096
#: Where these leave fewer tasks than the cluster has cores, groups of queries are smaller, down to so many rows.
LEAST = 64
FIRST_DEPTH, GROWTH = 8, 4
#: No product of two vectors below this norm leaves 64 bits.
LARGEST = 1 << 31


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, or null if the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(F.size(x) > 0, F.when(~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * scale).cast("long"))))


class Lists:
    """A block of candidates: distinct vectors, the ids of each, and a sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.vectors, of = np.unique(vectors, axis=0, return_inverse=True)
        of, self.ids = np.unique(np.c_[of.ravel(), ids], axis=0).T
        self.starts = np.searchsorted(of, np.arange(len(self.vectors) + 1))
        self.repeated = np.unique(self.ids).size < self.ids.size
        self.ascending = np.argsort(self.vectors, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(self.vectors, self.ascending.T, axis=0).T

    def top(self, own: int, query: np.ndarray, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """(score, id) of the best k, by score and then id, as far as they reach `floor`."""
        n, down = len(self.vectors), query >= 0
        met = np.zeros(n, bool)
        scores = np.empty(n, np.int64)
        depth, step, kth = 0, FIRST_DEPTH, None
        rows = np.arange(query.size)
        while depth < n:
            until = min(n, depth + step)
            front = np.where(down[:, None], self.ascending[:, n - until : n - depth], self.ascending[:, depth:until])
            fresh = np.zeros(n, bool)
            fresh[front.ravel()] = True
            fresh &= ~met
            at = np.flatnonzero(fresh)
            scores[at] = self.vectors[at] @ query
            met[at] = True
            depth, step = until, step * GROWTH
            kth = self._kth(scores, met, own, k)
            stand = np.where(down, self.sorted[rows, n - depth], self.sorted[rows, depth - 1])
            if floor is not None and (kth is None or kth < floor):
                kth = floor
            if kth is not None and kth > int(stand @ query):
                break
        held = np.flatnonzero(met if kth is None else met & (scores >= kth))
        out = []
        for c in held:
            ids = self.ids[self.starts[c] : min(self.starts[c + 1], self.starts[c] + k + 1)]
            out += [(int(scores[c]), int(i)) for i in ids if i != own]
        best = dict(sorted((i, s) for s, i in out))
        return sorted(((s, i) for i, s in best.items()), key=lambda x: (-x[0], x[1]))[:k]

    def _kth(self, scores: np.ndarray, met: np.ndarray, own: int, k: int) -> int | None:
        """The kth best score of other rows so far; equal vectors count as often as they occur."""
        at = np.flatnonzero(met)
        if self.repeated:
            found: set[int] = set()
            for c in at[np.argsort(-scores[at], kind="stable")]:
                found.update(i for i in self.ids[self.starts[c] : min(self.starts[c + 1], self.starts[c] + k + 1)].tolist() if i != own)
                if len(found) >= k:
                    return int(scores[c])
            return None
        if at.size > k + 1:
            at = at[np.argpartition(-scores[at], k)[: k + 1]]
        have = 0
        for c in at[np.argsort(-scores[at], kind="stable")]:
            ids = self.ids[self.starts[c] : self.starts[c + 1]]
            have += ids.size - bool(ids[np.searchsorted(ids, own) % ids.size] == own)
            if have >= k:
                return int(scores[c])
        return None


def fitted(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """n centres of a sample, by a few rounds of means."""
    rng = np.random.default_rng(0)
    centres = sample[rng.permutation(len(sample))[:n]].astype(float)
    for _ in range(rounds):
        own = nearest(sample, centres)[0]
        size = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and how far it is."""
    own = ((centres**2).sum(1) - 2.0 * (x @ centres.T)).argmin(1)
    return own, np.sqrt(((x - centres[own]) ** 2).sum(1))


def vectors_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of a list column one row after another, where rows start, and their sizes."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy()[column.offsets[0].as_py() :]
    return flat, np.cumsum(sizes) - sizes, sizes


def placed_near(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """`(id, v, centre, far)`: the nearest centre and the distance from it. Vectors of other lengths than the centres' have
    centre -1, and their norm for the distance."""
    dim = centres.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, starts, sizes = vectors_of(b.column(1))
            centre, far, own = np.full(b.num_rows, -1, np.int64), np.sqrt(b.column(2).to_numpy()), np.flatnonzero(sizes == dim)
            far = far.copy()
            for lo in range(0, own.size, 4096):
                at = own[lo : lo + 4096]
                centre[at], far[at] = nearest(flat[starts[at][:, None] + np.arange(dim)].astype(float), centres)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(centre), pa.array(far)], ["id", "v", "centre", "far"])

    return rows.select("id", "v", "norm").mapInArrow(place, "id long, v array<long>, centre long, far double")


class Blocks:
    """What the driver knows of the blocks, a few numbers for CANDIDATES rows: centre, ring and radius."""

    def __init__(self, centres: np.ndarray, found: list):
        self.centres = centres
        self.keys = np.array([r["block"] for r in found], np.int64)
        self.centre = self.keys >> 32
        self.radius = np.array([r["far"] for r in found], float)

    def bounds(self, q: np.ndarray, odd: bool) -> tuple[np.ndarray, np.ndarray]:
        """For queries of one length, what a vector of each block can score at most (-inf: it holds none of the
        length), and what its centre scores."""
        norms, none = np.sqrt((q.astype(float) ** 2).sum(1)), self.centre < 0
        if odd:
            middle = np.where(none, 0.0, -np.inf)[None, :] + np.zeros((len(q), 1))
            size = self.radius
        else:
            products = q.astype(float) @ self.centres.T
            middle = np.where(none, -np.inf, products[:, np.maximum(self.centre, 0)])
            size = self.radius + np.sqrt((self.centres**2).sum(1))[np.maximum(self.centre, 0)]
        return middle + norms[:, None] * self.radius + norms[:, None] * size * 1e-9 + 1e-6, middle

    def visited(self, q: np.ndarray, odd: bool, floors: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(row of q, block): without floors the first block of each query, else all others that can reach its floor."""
        top, middle = self.bounds(q, odd)
        first = middle.argmax(1)
        real = middle[np.arange(len(q)), first] > -np.inf
        if floors is None:
            return np.flatnonzero(real), self.keys[first[real]]
        may = top >= floors[:, None]
        may[middle == -np.inf] = False
        may[np.arange(len(q)), first] = False
        i, j = np.nonzero(may)
        return i, self.keys[j]


def visits(asked: DataFrame, blocks: Blocks, first: bool) -> DataFrame:
    """`(block, id, v, floor)`: a row for each block that a query visits; `asked` has `(id, v)`, and `floor` but for the
    first pass."""
    dim = blocks.centres.shape[1]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, starts, sizes = vectors_of(b.column(1))
            for d in np.unique(sizes):
                mine = np.flatnonzero(sizes == d)
                for lo in range(0, mine.size, 256):
                    at = mine[lo : lo + 256]
                    floors = None if first else b.column(2).take(pa.array(at)).cast(pa.float64()).fill_null(-np.inf).to_numpy()
                    i, block = blocks.visited(flat[starts[at][:, None] + np.arange(d)], d != dim, floors)
                    rows = pa.array(at[i])
                    yield pa.RecordBatch.from_arrays([pa.array(block), *[b.column(c).take(rows) for c in range(3)]], ["block", "id", "v", "floor"])

    return asked.select("id", "v", "floor").mapInArrow(visit, "block long, id long, v array<long>, floor long")


def searched(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """`_search` with as many groups of queries for a block as its visits ask for, and at least as the cores can take."""
    wanted = 2 * candidates.sparkSession.sparkContext.defaultParallelism
    met = queries.groupBy(F.col("block").alias("met")).agg(F.count("*").alias("n"))
    few = met.agg(F.count("*")).scalar()
    groups = F.greatest(F.ceil(F.col("n") / QUERIES), F.least(F.ceil(wanted / few), F.ceil(F.col("n") / LEAST))).cast("long")
    table = F.broadcast(met.select("met", groups.alias("groups")))  # a row for a block: at most one for CANDIDATES rows, and a centre
    here = F.col("block") == F.col("met")
    copies = candidates.join(table, here).select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("grp"), "id", "v")
    dealt = queries.join(table, here).select("block", F.pmod(F.xxhash64("id"), F.col("groups")).alias("grp"), "id", "v", "floor")
    return _search(copies, dealt, k)


def _search(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """`(query_id, vec_id, score)`: the best k of each block that a query visits. candidates: `(block, grp, id, v)`;
    queries: `(block, grp, id, v, floor)`."""
    one = candidates.select(F.lit(0).alias("role"), "block", "grp", "id", "v", F.lit(None).cast("long").alias("floor"))
    rows = one.unionByName(queries.withColumn("role", F.lit(1)))

    def search(_: tuple, table: pa.Table) -> pa.Table:
        role, ids = table.column("role").to_numpy(), table.column("id").to_numpy()
        floors = table.column("floor").to_pylist()
        flat, starts, sizes = vectors_of(table.column("v").combine_chunks())
        best: dict[tuple[int, int], int] = {}
        for dim in np.unique(sizes):
            mine = np.flatnonzero(sizes == dim)
            cand = role[mine] == 0
            if cand.any() and not cand.all():
                m = flat[starts[mine][:, None] + np.arange(dim)]
                block = Lists(ids[mine][cand], m[cand])
                for row, v in zip(mine[~cand].tolist(), m[~cand], strict=True):
                    q = int(ids[row])
                    for s, i in block.top(q, v, k, floors[row]):
                        best[q, i] = max(s, best.get((q, i), s))
        cols = list(zip(*[(q, i, s) for (q, i), s in best.items()], strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return rows.groupBy("block", "grp").applyInArrow(search, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def blocked(vectors: DataFrame) -> tuple[DataFrame, Blocks] | None:
    """`(block, id, v)` of vectors `(id, v, norm)`, written, and what is known of the blocks; None if there are none.

    The sample is the SAMPLE rows of least hash. A block's number is its centre's, times 2^32, and its ring's.
    """
    rows = written(vectors, "vectors")
    n = rows.count()
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).select("v").collect()]
    if not sample:
        return None
    dim = Counter(map(len, sample)).most_common(1)[0][0]
    sample = np.array([v for v in sample if len(v) == dim])
    centres = fitted(sample, max(1, min(CENTRES, n // CANDIDATES, len(sample))))
    order = [F.col("centre"), F.col("far"), F.col("id"), F.xxhash64("v")]
    parts = ranged(placed_near(rows, centres), *order)
    ring = F.floor(F.col("mix_rank") / CANDIDATES).cast("long")
    placed = running(parts, order[1:], {"rank": F.lit(1)}, ["centre"]).select((F.col("centre") * (1 << 32) + ring).alias("block"), "id", "v", "far")
    placed = written(placed, "candidates")
    found = placed.groupBy("block").agg(F.max("far").alias("far")).orderBy("block").collect()
    discard(rows, parts)
    return placed.select("block", "id", "v"), Blocks(centres, found)


def slim(df: DataFrame, key: str = "vec_id", vector: str = "q") -> DataFrame:
    """Distinct `(id, v, norm)` of the vectors that take part; norms are squared."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    norm = F.when(square < float(LARGEST) ** 2, square).otherwise(F.raise_error(F.lit("a vector is too long for 64-bit scores")))
    return df.where(F.col(key).isNotNull() & (F.size(vector) > 0)).select(F.col(key).alias("id"), F.col(vector).alias("v")).distinct().withColumn("norm", norm)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "q") -> DataFrame:
    """`(query_id, rank, vec_id, score)` for integer vectors `(key, vector)`."""
    none = F.lit(None).cast("long")
    asked = written(slim(queries, key, vector).select("id", "v", none.alias("floor")), "queries")
    if (made := blocked(slim(vectors, key, vector))) is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    placed, blocks = made
    found = written(searched(placed, visits(asked, blocks, first=True), k), "first-blocks")
    if blocks.keys.size < 2:
        return _ranked(found, k)
    floors = _ranked(found, k).where(F.col("rank") == k).select(F.col("query_id").alias("bound_id"), F.col("score").alias("floor"))
    more = asked.drop("floor").join(floors, F.col("id") == F.col("bound_id"), "left").select("id", "v", "floor")
    return _ranked(found.unionByName(searched(placed, visits(more, blocks, first=False), k)), k)


def sql(k: int = 5, every: int = 50) -> str:
    return f"""WITH v AS MATERIALIZED (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
numbered AS MATERIALIZED (SELECT *, row_number() OVER () AS r FROM v),
flat AS MATERIALIZED (SELECT r, vec_id, unnest(q) AS x, generate_subscripts(q, 1) AS d, len(q) AS n FROM numbered),
fitting AS (SELECT vec_id, CASE WHEN list_sum(list_transform(q, lambda x: x::DOUBLE * x)) >= {float(LARGEST) ** 2!r}::DOUBLE THEN error('a vector is too long for 64-bit scores') END AS fits FROM v),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, a.r AS ra, b.r AS rb, sum(a.x * b.x)::BIGINT AS score FROM flat a JOIN flat b ON a.d = b.d AND a.n = b.n AND a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0 GROUP BY ALL),
best AS (SELECT query_id, vec_id, max(score) AS score FROM scored GROUP BY query_id, vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM best)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k} AND (SELECT count(fits) FROM fitting) = 0"""
