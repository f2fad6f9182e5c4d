"""Filter interaction audit: what each order of five filters keeps, removes and hides.

Texts are scanned as Arrow buffers: byte classes by a table, prefix sums of them at the ends of documents count
words, capitals and symbols; sorted 64-bit word hashes of each document give its distinct words, and the bytes of
neighbours of equal hash are compared, so that a collision is found and counted by the words themselves. A row
leaves a mask of the filters that it fails and a digest of its text; copies are found by joins on (digest, id),
which no group of copies makes uneven. Rows are then counted by part, mask and labels, at most 128 counts a part,
and the orders are read from these counts alone.

Defined cases: null text is empty (fails A only: no words, and 0 < 0 is false); a null source is the part ''; a null
id has no smaller one and is none, so E passes; rows of one id are no copies of each other; several labels of
an id count if any is 1; documents without labels are neither good nor toxic; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shinglery.llm.common import discard, written

# The filters in order and their bounds.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
SPACES, SYMBOLS = bytes([32, *range(9, 14)]), b"#$%&*|"
ORDERS = ["".join(p) for p in permutations(FILTERS)]

#: Byte classes: white space, capital, symbol, and bytes that continue a code point.
SPACE, CAPITAL, SYMBOL, INNER = 1, 2, 4, 8
CLASSES = np.zeros(256, np.uint8)
for _bytes, _class in ((SPACES, SPACE), (range(65, 91), CAPITAL), (SYMBOLS, SYMBOL), (range(128, 192), INNER)):
    CLASSES[list(_bytes)] |= _class

#: Bytes of texts looked at together, and of words hashed together; a longer text or word is alone.
PIECE, STRETCH = 1 << 20, 1 << 18
_ODD = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])


POWERS, INVERSE = _powers(_ODD, STRETCH), _powers(pow(_ODD, -1, 1 << 64), STRETCH)


def word_bounds(space: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end, from what is white space and where documents end."""
    cut = np.zeros(space.size + 1, bool)
    cut[0] = True
    cut[ends] = True
    inside = ~space
    starts = inside & np.r_[True, space[:-1]] | inside & cut[:-1]
    stops = inside & np.r_[space[1:], True] | inside & cut[1:]
    return np.flatnonzero(starts), np.flatnonzero(stops) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a difference of prefix sums of bytes times powers, moved to the word's start."""
    out = np.empty(starts.size, np.uint64)
    at = 0
    while at < starts.size:
        lo = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(stops, lo + STRETCH, side="right")))
        own = data[lo : int(stops[upto - 1])]
        if own.size > STRETCH:  # one word that is longer than a stretch
            digest = hashlib.blake2b(own.tobytes(), digest_size=8).digest()
            out[at] = np.uint64(int.from_bytes(digest, "little"))
        else:
            sums = np.zeros(own.size + 1, np.uint64)
            np.cumsum((own + np.uint64(1)) * POWERS[: own.size], out=sums[1:])
            first = starts[at:upto] - lo
            out[at:upto] = (sums[stops[at:upto] - lo] - sums[first]) * INVERSE[first]
        at = upto
    out ^= (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def equal_words(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the words that start at a and b are equal over `size` bytes, compared in pieces of bounded size."""
    out = np.ones(a.size, bool)
    ends = np.cumsum(size)
    at = done = 0
    while at < a.size:
        upto = max(at + 1, int(np.searchsorted(ends, done + PIECE, side="right")))
        n = size[at:upto]
        if upto == at + 1:
            out[at] = np.array_equal(data[a[at] : a[at] + n[0]], data[b[at] : b[at] + n[0]])
        else:
            first = np.cumsum(n) - n
            step = np.arange(int(n.sum())) - np.repeat(first, n)
            same = data[np.repeat(a[at:upto], n) + step] == data[np.repeat(b[at:upto], n) + step]
            out[at:upto] = np.logical_and.reduceat(same, first)
        at, done = upto, int(ends[upto - 1])
    return out


def distinct_words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The number of distinct words of each document; `words` has how many each of them holds."""
    hashes, size, doc = word_hashes(data, starts, stops), stops - starts, np.repeat(np.arange(words.size), words)
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    again = np.flatnonzero((h[1:] == h[:-1]) & (d[1:] == d[:-1])) + 1
    before, now = order[again - 1], order[again]
    alike = size[before] == size[now]
    alike[alike] = equal_words(data, starts[before[alike]], starts[now[alike]], size[now[alike]])
    out = words - np.bincount(d[again], minlength=words.size)
    ends = np.cumsum(words)
    for k in np.unique(d[again[~alike]]).tolist():  # different words of one hash
        own = range(int(ends[k] - words[k]), int(ends[k]))
        out[k] = len({data[starts[i] : stops[i]].tobytes() for i in own})
    return out


def counted(marked: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many marked bytes each document holds: differences of prefix sums, made a piece at a time."""
    out, carry = np.zeros(ends.size, np.int64), 0
    for lo in range(0, marked.size, PIECE):
        sums = np.cumsum(marked[lo : lo + PIECE], dtype=np.int64)
        a, b = np.searchsorted(ends, [lo, lo + sums.size], side="right")
        out[a:b] = carry + sums[ends[a:b] - lo - 1]
        carry += int(sums[-1])
    return np.diff(out)


def failures(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The mask of filters A to D that each document fails; documents lie one after another, `ends` from 0 on."""
    kinds = CLASSES[data]
    sums = lambda k: counted((kinds & k) != 0, ends)
    starts, stops = word_bounds((kinds & SPACE) != 0, ends)
    words = np.diff(np.searchsorted(starts, ends))
    points = np.diff(ends) - sums(INNER)
    fails = (words < MIN_WORDS, 100 * distinct_words(data, starts, stops, words) < MIN_DISTINCT * words, 100 * sums(CAPITAL) > MAX_CAPITALS * points, sums(SYMBOL) > 0)
    return sum(x.astype(np.int32) << i for i, x in enumerate(fails))


def scanned(docs: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """`(key, part, mask, digest)` of each row; narrow."""
    kinds = dict(docs.dtypes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).fill_null("")
            wide = pa.types.is_large_string(texts.type)
            buffers = texts.buffers()
            ends = np.frombuffer(buffers[1], np.int64 if wide else np.int32, texts.offset + len(texts) + 1)[texts.offset :].astype(np.int64)
            data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.empty(0, np.uint8)
            masks, digests = np.empty(b.num_rows, np.int32), []
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PIECE, side="right")) - 1)
                masks[lo:hi] = failures(data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo])
                lo = hi
            for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                digests.append(hashlib.blake2b(data[s:e], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(masks), pa.array(digests, pa.binary())], ["id", "part", "mask", "digest"])

    return docs.select(F.col(key).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), text).mapInArrow(scan, f"id {kinds[key]}, part string, mask int, digest binary")


def masked(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """`(part, mask, good, toxic, n)`: how many rows fail which filters, E included."""
    rows = written(scanned(docs, key, part, text), "scanned")
    first = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first_id")).withColumnRenamed("digest", "first_digest")
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("label_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copies = rows.join(first.hint("shuffle_hash"), (F.col("id") == F.col("first_id")) & (F.col("digest") == F.col("first_digest")), "left")
    late = F.col("id").isNotNull() & F.col("first_id").isNull()
    mask = F.col("mask").bitwiseOR(F.when(late, F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0)))
    labelled = copies.select("id", "part", mask.alias("mask")).join(known.hint("shuffle_hash"), F.col("id") == F.col("label_id"), "left")
    flag = lambda c: (F.coalesce(F.col(c), F.lit(0)) == 1).alias(c)
    counts = written(labelled.groupBy("part", "mask", flag("good"), flag("toxic")).agg(F.count("*").alias("n")), "masks")
    discard(rows)
    return counts


def effects() -> pd.DataFrame:
    """What each step of each order does to rows of each mask: 32 * 120 * 5 rows, whatever the input."""
    rows = []
    for order in ORDERS:
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            for mask in range(1 << len(FILTERS)):
                fails, gone = bool(mask & bit), bool(mask & before)
                # a filter comes first among the k filters that a row fails in 1 of k orders
                rows.append((mask, order, step, not fails and not gone, fails and not gone, fails and gone, mask == bit, len(ORDERS) // mask.bit_count() if fails else 0))
            before |= bit
    return pd.DataFrame(rows, columns=["of", "filter_order", "step", "keeps", "removes", "repeats", "alone", "orders"])


def audit(counts: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, from `masked` counts."""
    table = counts.sparkSession.createDataFrame(effects(), "of int, filter_order string, step int, keeps boolean, removes boolean, repeats boolean, alone boolean, orders int")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    made = {
        "kept": total(F.col("keeps")), "removed": total(F.col("removes")), "redundant": total(F.col("repeats")), "unique_fails": total(F.col("alone")),
        "good_lost": total(F.col("removes") & F.col("good")), "toxic_lost": total(F.col("removes") & F.col("toxic")), "shapley": F.sum(F.col("n") * F.col("orders")).cast("long"),
    }
    seen = counts.join(F.broadcast(table), F.col("mask") == F.col("of"))
    return seen.groupBy("part", "filter_order", "step").agg(*[v.alias(c) for c, v in made.items()])


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """`(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`."""
    return audit(masked(docs, labels, key, part, text))


def sql() -> str:
    """The same as one statement over the masks of all documents."""
    return f"""WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM docs),
firsts AS (SELECT t, min(doc_id) AS first_id FROM docs GROUP BY t),
known AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
masks AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(ws) < {MIN_WORDS} THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < {MIN_DISTINCT} * len(ws) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(w.t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > f.first_id THEN 'E' ELSE '' END AS failed
  FROM words w JOIN firsts f ON w.t = f.t LEFT JOIN known k ON w.doc_id = k.doc_id),
counts AS MATERIALIZED (SELECT part, failed, good, toxic, count(*) AS n FROM masks GROUP BY ALL),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM (SELECT unnest({ORDERS}) AS o)),
placed AS (SELECT o, step, o[step] AS f, o[:step - 1] AS done FROM steps),
seen AS (SELECT c.*, o, step, f, contains(failed, f) AS fails, len(list_filter(string_split(done, ''), lambda x: x <> '' AND contains(failed, x))) > 0 AS earlier FROM counts c, placed)
SELECT part, o AS filter_order, step::INT AS step, sum(CASE WHEN NOT fails AND NOT earlier THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed,
sum(CASE WHEN fails AND earlier THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN failed = f THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN fails AND NOT earlier AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
sum(CASE WHEN fails AND NOT earlier AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost, sum(CASE WHEN fails THEN n * 120 // length(failed) ELSE 0 END)::BIGINT AS shapley FROM seen GROUP BY part, o, step"""
