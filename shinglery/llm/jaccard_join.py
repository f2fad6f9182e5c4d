"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles; equal sets are one class, and only classes are compared. MinHash
values propose pairs (bands that agree), and are then compared a few at a time: a pair is dropped when the
posterior probability that its similarity reaches the threshold falls below the tolerance. The pairs that remain,
and no others, are verified exactly on the shingle sets, so no pair is reported wrongly.

No stage emits all pairs of a group: large buckets and groups are cut into blocks, each pair of blocks is one
task's work, and it leaves link counts and a spanning forest of its links. In a group of many remaining pairs
each class goes to all pairs of blocks with its own, which is at most as many copies as there are pair ends. A
large group of fewer pairs, such as a long chain of copies, is pruned a second time, now to learn which pairs of
its blocks hold a remaining pair at all, and a class goes only to these. A pair of similarity 0.8, the worst
case, is missed with 1.4e-5 (see `missed`: no band agrees, or a step drops it).

Defined cases: null text is empty; a text of one to four words has the one shingle of all its words; texts
without words are copies of each other only if they are equal; repeated rows are copies; null ids are rows like
others and never name a class that has another id; other columns are ignored. Classes and texts are told apart
by 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shinglery.llm.common import Memory, discard, kept, map_texts, numbered, written
from shinglery.llm.components import components
from shinglery.llm.licences import LOWER, WORDS

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 3
FUNCTIONS = BANDS * ROWS
#: MinHash values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 12, 1e-6
#: Rows of a block of a bucket, and of a group that is verified.
BUCKET, GROUP = 256, 128
#: Shingles folded at once, bytes of words that a worker remembers, columns of a block's incidence matrix.
CHUNK, REMEMBERED, COLUMNS = 1 << 14, 24 << 20, 8192
#: From so many pairs a class on, the sizes of intersections come from an incidence matrix.
DENSE = 4

_RNG = np.random.default_rng(20)
MULTIPLY = _RNG.integers(1, 1 << 63, FUNCTIONS, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RNG.integers(0, 1 << 63, FUNCTIONS, np.uint64)
POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, j, 1 << 64)) for j in range(SHINGLE)]


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts."""

    def __init__(self):
        self.words = Memory(xxhash.xxh3_64_intdigest, REMEMBERED)

    def __call__(self, text: str) -> np.ndarray:
        words = self.words
        h = np.array([words[w] for w in text.encode("utf-8", "replace").translate(LOWER).translate(WORDS).split()], np.uint64)
        self.words = words.aged()
        n = max(h.size - SHINGLE + 1, min(h.size, 1))
        if not n:
            return h
        x = np.zeros(n, np.uint64)
        for j in range(min(SHINGLE, h.size)):
            x += h[j : j + n] * POWERS[j]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return np.unique(x ^ (x >> np.uint64(32)))


def shingler() -> Shingler:
    return kept("shingles", Shingler)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, FUNCTIONS) 32-bit values, the high halves of minima; all ones for an empty set."""
    out = np.full((len(sets), FUNCTIONS), 0xFFFFFFFF, np.uint32)
    rows = [i for i, s in enumerate(sets) if s.size]
    if not rows:
        return out
    flat, sizes = np.concatenate([sets[i] for i in rows]), np.array([sets[i].size for i in rows])
    of = np.repeat(np.array(rows), sizes)
    for lo in range(0, flat.size, CHUNK):
        part, own = flat[lo : lo + CHUNK], of[lo : lo + CHUNK]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        work = np.empty_like(part)
        for j in range(FUNCTIONS):
            np.multiply(part, MULTIPLY[j], out=work)
            work += ADD[j]
            least = (np.minimum.reduceat(work, starts) >> np.uint64(32)).astype(np.uint32)
            out[own[starts], j] = np.minimum(out[own[starts], j], least)
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n compared values, the fewest matches with which a pair stays.

    Under a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1), and its chance to be
    at the threshold or above is that of at most m successes in n + 1 trials.
    """
    out = {}
    for n in range(STEP, FUNCTIONS + 1, STEP):
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


LEAST = least_matches()


def missed(similarity: float = THRESHOLD) -> float:
    """The probability that a pair of this similarity is not verified: the steps and bands as a chain over
    (values compared, matches, does the band so far agree, did a band agree)."""
    states = {(0, True, False): 1.0}
    for n in range(1, FUNCTIONS + 1):
        after: dict[tuple[int, bool, bool], float] = {}
        for (m, whole, met), p in states.items():
            for hit, q in ((1, similarity), (0, 1 - similarity)):
                own = whole and bool(hit)
                state = (m + hit, True, met or own) if n % ROWS == 0 else (m + hit, own, met)
                if state[0] >= LEAST.get(n, 0):
                    after[state] = after.get(state, 0.0) + p * q
        states = after
    return 1 - sum(p for (_, _, met), p in states.items() if met)


def surviving(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that no step drops and that agree in a band, and the first such band."""
    met = np.zeros((len(a), len(b)), np.uint8)
    for j in range(STEP):
        met += a[:, j, None] == b[None, :, j]
    i, j = np.nonzero(met >= LEAST[STEP])
    m = met[i, j].astype(np.int64)
    for n in range(STEP, FUNCTIONS, STEP):
        m += (a[i, n : n + STEP] == b[j, n : n + STEP]).sum(1)
        stays = m >= LEAST[n + STEP]
        i, j, m = i[stays], j[stays], m[stays]
    agree = (a[i] == b[j]).reshape(-1, BANDS, ROWS).all(2)
    some = agree.any(1)
    return i[some], j[some], agree[some].argmax(1)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that each row is linked to."""
    root = np.arange(n)
    while i.size:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def blocks(count: str, size: int) -> tuple[Column, Column]:
    """How many blocks of about `size` a group of `count` nodes has, and the block of a node."""
    n = F.ceil(F.col(count) / size).cast("int")
    return n, F.pmod(F.xxhash64("node"), n.cast("long")).cast("int")


def dealt(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows by (group, pair of blocks), sorted; the pairs of a group go to partitions in turn, so that a large
    group does not fill some by chance."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = F.col("lo").cast("long") + F.expr("hi * (hi + 1L) div 2")
    at = F.pmod(F.xxhash64(group).bitwiseAND(F.lit((1 << 62) - 1)) + turn, F.lit(parts)).cast("int")
    return df.repartitionById(parts, at).sortWithinPartitions(*order)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows of equal keys from sorted batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        if held and any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for c in [*cut.tolist(), b.num_rows]:
            held.append(b.slice(at, c - at))
            if c < b.num_rows:
                yield pa.Table.from_batches(held)
                held = []
            at = c
    if held:
        yield pa.Table.from_batches(held)


def text_digest(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def node_of(text: str, shingles: np.ndarray) -> bytes:
    """The digest of the set of shingles, or of the text if it has none."""
    return xxhash.xxh3_128_digest(shingles.tobytes() if shingles.size else b"text:" + text.encode("utf-8", "replace"))


def described(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`(key, text_hash, node, n_shingles, sig)` by document; equal sets have equal nodes."""

    def fold(texts: list[str]) -> dict[str, list]:
        make = shingler()
        sets = [make(t) for t in texts]
        return {"node": [node_of(t, s) for t, s in zip(texts, sets, strict=True)], "n_shingles": [s.size for s in sets], "sig": [row.tobytes() for row in minhashes(sets)]}

    source = docs.select(F.col(key), text_digest(text).alias("text_hash"), F.col(text).alias("text"))
    return map_texts(source, fold, {"node": pa.binary(), "n_shingles": pa.int64(), "sig": pa.binary()}, "text")


def signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, FUNCTIONS)


def candidates(classes: DataFrame, found: Callable[[pa.Table, np.ndarray, np.ndarray], pa.RecordBatch | None], schema: str, carry: list[str]) -> DataFrame:
    """What `found` makes of the pairs that pruning leaves, per pair of blocks of each bucket: it gets the rows
    `(node, *carry)` and the pairs of which this bucket is the first. classes: `(node, sig, *carry)`.

    Buckets are grouped by key alone first; signatures are joined only to rows of buckets of two and more.
    Sizes of groups are written before a join here and below, so that a skewed join can be split.
    """
    words = [F.substring("sig", 4 * ROWS * i + 1, 4 * ROWS) for i in range(BANDS)]
    keys = F.array(*[F.xxhash64(F.lit(i), w) for i, w in enumerate(words)])
    rows = classes.select("node", F.posexplode(keys).alias("band", "bucket"))
    sizes = written(rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").withColumnRenamed("bucket", "full"), "buckets")
    n, own = blocks("size", BUCKET)
    met = rows.join(sizes, F.col("bucket") == F.col("full")).select("node", "band", "bucket", own.alias("own"), F.explode(F.sequence(F.lit(0), n - 1)).alias("with"))
    met = met.select("node", "band", "bucket", "own", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"))
    work = met.join(classes.withColumnRenamed("node", "sig_node"), F.col("node") == F.col("sig_node")).drop("sig_node")
    order = ["bucket", "band", "lo", "hi"]

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, order):
            own, lo, hi = t.column("own").to_numpy(), t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
            sig = signatures(t.column("sig"))
            left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            i, j, band = surviving(sig[left], sig[right])
            mine = band == t.column("band")[0].as_py()
            i, j = left[i[mine]], right[j[mine]]
            if lo == hi:
                i, j = i[i < j], j[i < j]
            if i.size and (out := found(t, i, j)) is not None:
                yield out

    return dealt(work.select("node", "own", "sig", *carry, *order), "bucket", order).mapInArrow(pruned, schema)


def candidate_links(classes: DataFrame) -> DataFrame:
    """`(a, b, pairs)`, per pair of blocks of each bucket: a spanning forest of the pairs that pruning leaves, with
    pairs null, and how many of them each of its trees stands for, with b null."""

    def linked(t: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        root = forest(t.num_rows, i, j)
        at = np.flatnonzero(root != np.arange(t.num_rows))
        tops, pairs = np.unique(root[i], return_counts=True)
        node = t.column("node").combine_chunks()
        b = pa.concat_arrays([node.take(pa.array(at)), pa.nulls(tops.size, pa.binary())])
        return pa.RecordBatch.from_arrays([node.take(pa.array(np.r_[root[at], tops])), b, pa.array([*[None] * at.size, *pairs.tolist()], pa.int64())], ["a", "b", "pairs"])

    return candidates(classes, linked, "a binary, b binary, pairs long", [])


def places(members: DataFrame) -> DataFrame:
    """`(root, lo, hi, node)`: the pairs of blocks of its group in which a class may have a pair to verify.

    members: `(root, size, pairs, node, own, sig)`. All pairs of blocks with its own, or those that hold one of
    the group's pairs, where these are fewer.
    """
    n = blocks("size", GROUP)[0]
    many = (F.col("size") <= GROUP) | (2 * F.col("pairs") >= F.col("size") * n)
    dense = members.where(many).select("root", "own", "node", F.explode(F.sequence(F.lit(0), n - 1)).alias("with"))
    dense = dense.select("root", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "node")
    sparse = members.where(~many).select("node", "sig", "root", F.col("own").alias("part"))

    def placed(t: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        part = t.column("part").to_numpy().astype(np.int64)
        lo, hi = np.minimum(part[i], part[j]), np.maximum(part[i], part[j])
        found = np.unique(np.stack([np.r_[i, j], np.r_[lo, lo], np.r_[hi, hi]]), axis=1)
        at = pa.array(found[0])
        return pa.RecordBatch.from_arrays([t.column("root").combine_chunks().take(at), *[pa.array(x.astype(np.int32)) for x in found[1:]], t.column("node").combine_chunks().take(at)], ["root", "lo", "hi", "node"])

    return dense.unionByName(candidates(sparse, placed, "root binary, lo int, hi int, node binary", ["root", "part"]).distinct())


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections; shingles of one set alone are left out first."""
    flat = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), [s.size for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    of, column = of[shared], column[shared]
    out = np.zeros((len(sets), len(sets)), np.float64)
    if column.size:
        column = np.unique(column, return_inverse=True)[1]
        ends = np.searchsorted(column, np.arange(0, column[-1] + 1 + COLUMNS, COLUMNS))
        for k, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
            m = np.zeros((len(sets), COLUMNS), np.float32)
            m[of[lo:hi], column[lo:hi] - k * COLUMNS] = 1
            out += m @ m.T
    return out


def similar(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs of sorted sets reach the threshold."""
    if i.size >= DENSE * len(sets):
        both = overlaps(sets)[i, j]
    else:
        both = np.array([np.intersect1d(sets[a], sets[b], assume_unique=True).size for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.float64)
    sizes = np.array([s.size for s in sets], np.float64)
    return both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9


def verified(work: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """From `(root, lo, hi, node, own, copies, sig, shingles)`: exact links, as `(a, b)` of a spanning forest with
    `links` null, and as `(a, links)` with b null: how many documents a pair of blocks links to a node's."""
    order = ["root", "lo", "hi"]

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, order):
            own, lo, hi = t.column("own").to_numpy(), t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
            node, copies, sig = t.column("node").combine_chunks(), t.column("copies").to_numpy(), signatures(t.column("sig"))
            left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            i, j, _ = surviving(sig[left], sig[right])
            i, j = left[i], right[j]
            if lo == hi:
                i, j = i[i < j], j[i < j]
            if not i.size:
                continue
            some = np.unique(np.r_[i, j])
            sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").combine_chunks().take(pa.array(some)).to_pylist()]
            near = similar(sets, np.searchsorted(some, i), np.searchsorted(some, j), threshold)
            i, j = i[near], j[near]
            count = np.bincount(np.r_[i, j], np.r_[copies[j], copies[i]], t.num_rows).astype(np.int64)
            root = forest(t.num_rows, i, j)
            at, some = np.flatnonzero(root != np.arange(t.num_rows)), np.flatnonzero(count)
            if some.size:
                yield pa.RecordBatch.from_arrays([node.take(pa.array(at)), node.take(pa.array(root[at])), pa.nulls(at.size, pa.int64())], ["a", "b", "links"])
                yield pa.RecordBatch.from_arrays([node.take(pa.array(some)), pa.nulls(some.size, pa.binary()), pa.array(count[some])], ["a", "b", "links"])

    return dealt(work, "root", order).mapInArrow(exact, "a binary, b binary, links long")


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`(key, class_id, rep_id, n_links, n_shingles, text_hash, class_hash)`, a row per document: the least id
    of all documents that links connect, the least id of its copies, how many documents are linked to it
    (copies included), and digests of its text and of the text that stands for its class."""
    rows = written(described(docs, key, text), "sets")
    first = F.min(F.struct(F.col(key).isNull(), F.col(key), "text_hash"))
    classes = written(rows.groupBy("node").agg(first.alias("first"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")), "classes")
    found = written(candidate_links(classes.where("n_shingles > 0").select("node", "sig")), "candidates")
    near = components(found.where("b IS NOT NULL").select("a", "b"))
    pairs = found.where("b IS NULL").groupBy("a").agg(F.sum("pairs").alias("pairs"))
    sizes = near.join(pairs.hint("shuffle_hash"), F.col("node") == F.col("a"), "left").groupBy("root").agg(F.count("*").alias("size"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    sizes = written(sizes.withColumnRenamed("root", "sized"), "sizes")
    discard(found)
    sized = near.join(sizes, F.col("root") == F.col("sized")).select("root", "size", "pairs", "node", blocks("size", GROUP)[1].alias("own"))
    names = classes.select(F.col("node").alias("own_node"), F.col(f"first.{key}").alias("first_key"), F.col("first.text_hash").alias("first_hash"), "copies", "sig")
    wanted = sized.join(names, F.col("node") == F.col("own_node")).drop("own_node").hint("shuffle_hash")
    texts = docs.select(F.col(key).alias("text_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.withColumn("own_hash", text_digest("text"))
    found = texts.join(wanted, F.col("text_key").eqNullSafe(F.col("first_key")) & (F.col("own_hash") == F.col("first_hash")))
    found = map_texts(found.select("root", "size", "pairs", "node", "own", "copies", "sig", "text"), lambda x: {"shingles": [shingler()(t).tobytes() for t in x]}, {"shingles": pa.binary()})
    members = written(found.groupBy("node").agg(*[F.first(c).alias(c) for c in found.columns if c != "node"]), "members")
    at = places(members.select("root", "size", "pairs", "node", "own", "sig"))
    work = at.join(members.select(F.col("node").alias("own_node"), "own", "copies", "sig", "shingles"), F.col("node") == F.col("own_node")).drop("own_node")
    links = written(verified(work), "links")
    roots = components(links.where("b IS NOT NULL").select("a", "b"))
    counts = links.where("links IS NOT NULL").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "counted")
    own = classes.select("node", F.col(f"first.{key}").alias("rep_id"), F.col("first.text_hash").alias("rep_hash"), "copies")
    own = own.join(roots.select(F.col("node").alias("linked"), "root").hint("shuffle_hash"), F.col("node") == F.col("linked"), "left")
    own = own.join(counts.hint("shuffle_hash"), F.col("node") == F.col("counted"), "left")
    own = written(own.select("node", "rep_id", "rep_hash", "copies", F.coalesce("root", "node").alias("group"), F.coalesce("links", F.lit(0)).alias("links")), "nodes")
    least = own.groupBy("group").agg(F.min(F.struct(F.col("rep_id").isNull(), "rep_id", "rep_hash")).alias("least"))
    least = written(least.withColumnRenamed("group", "grouped"), "least")
    final = written(own.join(least, F.col("group") == F.col("grouped")).select(F.col("node").alias("final"), F.col("least.rep_id").alias("class_id"), F.col("least.rep_hash").alias("class_hash"), "rep_id", (F.col("links") + F.col("copies") - 1).alias("n_links")), "final")
    discard(classes, near, sizes, members, links, roots, own, least)
    out = rows.select(key, "node", "n_shingles", "text_hash").join(final, F.col("node") == F.col("final"))
    return out.select(key, "class_id", "rep_id", "n_links", "n_shingles", "text_hash", "class_hash")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, without those that stand behind another one of their class. Of rows with equal
    id and text one stays, whichever has the least hash. Texts move once: the join and the choice deal them out alike,
    as their key is never null."""
    place = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    found = jaccard_join(docs, key, text)
    stay = found.where(F.col(key).eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash")))
    stay = stay.select(place(key).alias("stay_place"), F.col("text_hash").alias("stay_hash")).distinct().hint("shuffle_hash")
    own, own_text = numbered(docs, text)
    placed = own.withColumns({"own_place": place(own.columns[docs.columns.index(key)]), "own_hash": text_digest(own_text)})
    kept = placed.join(stay, (F.col("own_place") == F.col("stay_place")) & (F.col("own_hash") == F.col("stay_hash")), "left_semi")
    hashed = F.xxhash64(*[c for c, t in own.dtypes if "map<" not in t])
    one = kept.groupBy("own_place", "own_hash").agg(F.min_by(F.struct(*own.columns), hashed).alias("row"))
    return one.select("row.*").toDF(*docs.columns)


def sql() -> str:
    """The query as one statement over all pairs of classes that share a shingle."""
    letters = "".join(map(chr, range(65, 91)))
    windows = f"list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' '))"
    return f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
sets AS MATERIALIZED (SELECT r, doc_id, t, list_sort(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')] ELSE list_distinct({windows}) END) AS s FROM docs),
noded AS MATERIALIZED (SELECT r, doc_id, s, CASE WHEN len(s) = 0 THEN 'text:' || t ELSE 'set:' || array_to_string(s, chr(10)) END AS node FROM sets),
classes AS MATERIALIZED (SELECT row_number() OVER () AS c, node, min(doc_id) AS rep_id, count(*) AS copies, any_value(s) AS s, len(any_value(s)) AS n FROM noded GROUP BY node),
flat AS MATERIALIZED (SELECT c, n, unnest(s) AS x FROM classes),
links AS MATERIALIZED (SELECT a.c AS a, b.c AS b FROM flat a JOIN flat b ON a.x = b.x AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING count(*) >= {THRESHOLD} * (a.n + b.n - count(*)) - 1e-9),
counted AS (SELECT l.a AS c, sum(copies)::BIGINT AS linked FROM links l JOIN classes k ON l.b = k.c GROUP BY l.a),
reached AS (WITH RECURSIVE walk AS (SELECT c, c AS top FROM classes UNION SELECT l.b, w.top FROM walk w JOIN links l ON l.a = w.c) SELECT * FROM walk),
tops AS (SELECT w.c, min(k.rep_id) AS class_id FROM reached w JOIN classes k ON w.top = k.c GROUP BY w.c)
SELECT d.doc_id, t.class_id, k.rep_id, coalesce(x.linked, 0) + k.copies - 1 AS n_links, k.n AS n_shingles FROM noded d JOIN classes k ON d.node = k.node JOIN tops t ON t.c = k.c LEFT JOIN counted x ON x.c = k.c"""
