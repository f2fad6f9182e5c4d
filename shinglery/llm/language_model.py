"""Language-model scores: an interpolated modified Kneser-Ney n-gram model, counted in Spark, stored as sorted
hash arrays in the shared folder and memory-mapped by the workers that score.

Counting: each task turns its texts into word hashes, counts its distinct n-grams in numpy and deals them out
by context in compressed blocks; n-grams of the most frequent contexts, found on a random share of all rows, are
dealt out by themselves, so that no context fills a task (the share only balances work, it changes no count). A
part merges its blocks, writes its array and passes on what its n-grams say of the next lower order, which is
merged in parts of its own, down to single words. Where there are more than FAN parts, blocks are dealt out
digit by digit, so that neither blocks nor open files grow with tasks times parts; at most FILES files hold the
parts of an order. Hashes and counts have 64 bits.

Every document begins after order - 1 start symbols. An n-gram counts as often as it occurs in the highest order
and by the number of distinct words before it in lower ones.

Defined cases: null and empty texts are the end token alone; repeated rows count as often as they occur; with
nothing to learn from, all tokens have the uniform probability of the unknown word; other columns are kept, but
for those named as outputs; a file of the model that is lost raises FileNotFoundError.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections import Counter, OrderedDict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shinglery.llm.common import Memory, file_system, kept, map_texts, shared_path

# The base model's added count.
ADDED = 0.1
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
START, END = (xxhash.xxh3_64_intdigest(x) for x in (b"\n<s>", b"\n</s>"))
ORDER = 2
#: Tokens that a task counts at once, bytes of text meant for a part, bytes of words that a worker remembers.
FLUSH, PART, REMEMBERED = 2_000_000, 6_400_000, 32 << 20
#: Parts that a task deals out to at once, files of an order, files that a worker maps at once.
FAN, FILES, MAPS = 1024, 1 << 16, 4096
#: The share of rows in which frequent contexts are sought, and how many contexts are dealt out by n-gram.
SHARE, FREQUENT = 0.02, 256
#: What is known of an n-gram of a lower order: occurrences, distinct words before it, its count as a context,
#: and distinct words after it that count once, twice, more often.
NUMBERS = ("raw", "before", "total", "once", "twice", "more")
#: Discounts stay so far inside (0, k).
MARGIN = 0.05
DECIMALS = 6
ROWS = "part long, block binary, stats array<long>"


class Hashes:
    """Hashes of the words of texts."""

    def __init__(self):
        self.words = Memory(xxhash.xxh3_64_intdigest, REMEMBERED)

    def of(self, text: str) -> list[int]:
        words = self.words
        out = [words[w] for w in text.encode("utf-8", "replace").translate(LOWER).split()]
        out.append(END)
        self.words = words.aged()
        return out


def worker_hashes() -> Hashes:
    return kept("hashes", Hashes)


def mixed(a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    """A 64-bit hash of pairs."""
    x = (a ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x = (x + b) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(31))


def keys_of(words: list[np.ndarray]) -> np.ndarray:
    """The keys of n-grams given word by word: that of an n-gram is made of its context's and its last word."""
    key = mixed(words[0])
    for w in words[1:]:
        key = mixed(key, w)
    return key


def dealt(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def part_of(contexts: np.ndarray, grams: np.ndarray, frequent: np.ndarray, parts: int) -> np.ndarray:
    """The part of each n-gram of the highest order: by context, or by itself for the frequent contexts."""
    return dealt(np.where(np.isin(contexts, frequent), grams, contexts), parts)


def narrow(a: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest unsigned type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def packed(words: list[np.ndarray], numbers: list[np.ndarray]) -> bytes:
    """Word hashes by a dictionary of the block, and numbers, column by column and compressed."""
    known, ids = np.unique(np.concatenate(words), return_inverse=True)
    columns = [known.astype("<u8"), narrow(ids), *map(narrow, numbers)]
    top = json.dumps([len(words), len(known), len(words[0]), *[c.itemsize for c in columns[1:]]]).encode()
    return zstandard.compress(top + b"\n" + b"".join([c.tobytes() for c in columns]), 1)


def unpacked(block: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    data = zstandard.decompress(block)
    at = data.index(b"\n") + 1
    order, kinds, n, *widths = json.loads(data[:at])
    known = np.frombuffer(data, "<u8", kinds, at)
    at, columns = at + 8 * kinds, []
    for i, width in enumerate(widths):
        columns.append(np.frombuffer(data, f"<u{width}", n * (1 if i else order), at))
        at += columns[-1].nbytes
    return list(known[columns[0]].reshape(order, n)), columns[1:]


def summed(words: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Keys of the distinct n-grams in order, their words, and sums of the numbers."""
    keys = keys_of(words)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if keys.size else np.empty(0, np.int64)
    sums = [np.add.reduceat(n[order].astype(np.uint64), first) if keys.size else n.astype(np.uint64) for n in numbers]
    return keys[first], [w[order[first]] for w in words], sums


def gathered(blocks: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    got = [unpacked(b) for b in blocks]
    return summed(*[[np.concatenate([g[side][i] for g in got]) for i in range(len(got[0][side]))] for side in (0, 1)])


def blocks_by(part: np.ndarray, words: list[np.ndarray], numbers: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """A block for each part that has rows."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    words, numbers = [h[order] for h in words], [n[order] for n in numbers]
    cuts = [*np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist(), part.size] if part.size else [0]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        yield int(part[lo]), packed([h[lo:hi] for h in words], [n[lo:hi] for n in numbers])


def rows_of(parts: list[int], blocks: list[bytes | None], stats: list[list[int] | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(blocks, pa.binary()), pa.array(stats, pa.list_(pa.int64()))], ["part", "block", "stats"])


def block_rows(found: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    rows = list(found)
    return rows_of([r[0] for r in rows], [r[1] for r in rows], [None] * len(rows))


def padded(texts: list[list[int]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of documents, each after order - 1 start symbols, and where the documents' own words stand."""
    start = [START] * (order - 1)
    words = np.fromiter((h for t in texts for part in (start, t) for h in part), np.uint64)
    sizes = np.array([len(t) for t in texts])
    own = np.arange(int(sizes.sum())) + np.repeat((order - 1) * np.arange(1, sizes.size + 1), sizes)
    return words, own


def ngrams(words: np.ndarray, own: np.ndarray, order: int) -> list[np.ndarray]:
    """The words of the n-gram that ends at each own word, the first word first."""
    return [words[own - j] for j in range(order - 1, -1, -1)]


def stored(order: int, highest: int, numbers: Sequence) -> Sequence:
    """Those of NUMBERS that the arrays of an order hold: the count alone in the highest one."""
    return numbers[:1] if order == highest else numbers if order == 1 else numbers[1:]


class Writer:
    """The files of an order: parts one after another, and an index of them at the end. A rename makes repeated
    tasks harmless."""

    def __init__(self, uri: str, shelf: int):
        self.fs, self.path = file_system(f"{uri}/{shelf}")
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.out, self.index, self.at = self.fs.open_output_stream(self.own), {}, 0

    def add(self, part: int, columns: list[np.ndarray]) -> None:
        self.index[part] = [self.at, len(columns[0]), *[c.itemsize for c in columns]]
        for c in columns:
            data = c.tobytes() + bytes(-c.nbytes % 8)
            self.out.write(data)
            self.at += len(data)

    def close(self) -> None:
        index = json.dumps(self.index).encode()
        self.out.write(index + len(index).to_bytes(8, "little"))
        self.out.close()
        self.fs.move(self.own, self.path)


class Arrays:
    """The parts of an order, mapped when first needed, at most MAPS files at once. Where the folder is not a
    local path, a file is fetched first. A file that was written and is gone raises FileNotFoundError."""

    def __init__(self, uri: str, parts: int, shelf: int, files: set[int], numbers: int):
        self.uri, self.parts, self.shelf, self.files, self.numbers = uri, parts, shelf, files, numbers
        self.open: OrderedDict[int, tuple[np.ndarray, dict]] = OrderedDict()

    def _file(self, shelf: int) -> tuple[np.ndarray, dict]:
        if shelf in self.open:
            self.open.move_to_end(shelf)
            return self.open[shelf]
        fs, path = file_system(f"{self.uri}/{shelf}")
        if fs.type_name != "local":
            with fs.open_input_stream(path) as f, tempfile.NamedTemporaryFile(delete=False) as own:
                while chunk := f.read(1 << 22):
                    own.write(chunk)
            path = own.name
        data = np.memmap(path, np.uint8, "r")
        if fs.type_name != "local":
            os.unlink(path)
        size = int.from_bytes(data[-8:].tobytes(), "little")
        self.open[shelf] = data, json.loads(data[-8 - size : -8].tobytes())
        if len(self.open) > MAPS:
            self.open.popitem(last=False)
        return self.open[shelf]

    def _part(self, part: int) -> list[np.ndarray]:
        data, index = self._file(part // self.shelf) if part // self.shelf in self.files else (None, {})
        if str(part) not in index:
            return [np.empty(0, np.uint64)]
        at, n, *widths = index[str(part)]
        out = []
        for w in widths:
            out.append(data[at : at + n * w].view(f"<u{w}"))
            at += n * w + -(n * w) % 8
        return out

    def get(self, keys: np.ndarray, part: np.ndarray) -> list[np.ndarray]:
        """The numbers of each key, 0 where it is absent; keys ascend within parts, so that pages are read in order."""
        out = [np.zeros(keys.size, np.int64) for _ in range(self.numbers)]
        order = np.lexsort((keys, part))
        ends = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
        for lo, hi in zip(ends, ends[1:], strict=False):
            at = order[lo:hi]
            known, *columns = self._part(int(part[at[0]]))
            if known.size:
                spot = np.minimum(np.searchsorted(known, keys[at]), known.size - 1)
                found = known[spot] == keys[at]
                for o, c in zip(out, columns, strict=True):
                    o[at[found]] = c[spot[found]]
        return out


def discounts(n: list[int]) -> np.ndarray:
    """The discounts of counts 0, 1, 2 and more from how many counts are 1, 2, 3, 4: inside (0, k), so that
    something is always left for what was not seen."""
    if min(n) <= 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *[min(max(k - (k + 1) * y * n[k] / n[k - 1], MARGIN), k - MARGIN) for k in (1, 2, 3)]])


class Model:
    """Where the arrays are and the numbers that all words share; stats by order: how many n-grams count 1, 2,
    3, 4, how many there are, the sum of their counts, occurrences."""

    def __init__(self, uri: str, order: int, parts: int, shelf: int, frequent: np.ndarray, stats: dict[int, list[int]], files: dict[int, set[int]]):
        self.uri, self.order, self.parts, self.shelf, self.frequent, self.files = uri, order, parts, shelf, frequent, files
        self.discounts = {k: discounts(stats[k][:4]) for k in range(1, order + 1)}
        once, twice, _, _, self.distinct, self.pairs, self.tokens = stats[1]
        self.rest = [once, twice, self.distinct - once - twice]
        self.arrays, self.hashes = None, Hashes()

    def __getstate__(self):
        return self.__dict__ | {"arrays": None, "hashes": Hashes()}

    def score(self, hashes: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per document: known tokens, the base score, the model's log10 probability."""
        if self.arrays is None:
            self.arrays = {k: Arrays(f"{self.uri}/{k}", self.parts, self.shelf, self.files[k], len(stored(k, self.order, NUMBERS))) for k in range(1, self.order + 1)}
        words, own = padded(hashes, self.order)
        key, last = None, None
        for k in range(1, self.order + 1):
            before, key = key, mixed(words)
            if k > 1:
                key = np.r_[np.uint64(0), mixed(before[:-1], words[1:])]
            if k < self.order:
                distinct, back = np.unique(key, return_inverse=True)
                numbers = [n[back] for n in self.arrays[k].get(distinct, dealt(distinct, self.parts))]
                raw, *numbers = numbers if k == 1 else (raw, *numbers)
                count = numbers[0][own]
            else:
                distinct, first, back = np.unique(key[own], return_index=True, return_inverse=True)
                count = self.arrays[k].get(distinct, part_of(before[own - 1][first], distinct, self.frequent, self.parts))[0][back]
            less = np.maximum(count - self.discounts[k][np.minimum(count, 3)], 0.0)
            if k == 1:
                left = float(np.dot(self.discounts[1][1:], self.rest)) if self.pairs else 1.0
                p = (less + left / (self.distinct + 1)) / max(self.pairs, 1)
                raw = raw[own]
            else:
                _, total, *kinds = (n[own - 1] for n in last)
                weight = sum(d * n for d, n in zip(self.discounts[k][1:], kinds, strict=True))
                p = less / np.maximum(total, 1) + np.where(total > 0, weight / np.maximum(total, 1), 1.0) * p
            last = numbers
        base = np.log10((raw + ADDED) / (self.tokens + ADDED * (self.distinct + 1)))
        starts = np.cumsum([0, *[len(h) for h in hashes[:-1]]])
        return np.add.reduceat((raw > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def frequent_contexts(source: DataFrame, order: int) -> np.ndarray:
    """Keys of the contexts that are most frequent in a random share of the texts, and of the start's."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, n = worker_hashes(), Counter()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                words, own = padded([hashes.of(t) for t in b.column(0).slice(lo, 256).to_pylist()], order)
                keys, counts = np.unique(keys_of(ngrams(words, own, order)[:-1]), return_counts=True)
                n.update(dict(zip(keys.view(np.int64).tolist(), counts.tolist(), strict=True)))
        top = n.most_common(4 * FREQUENT)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in top], pa.int64()) for i in (0, 1)], ["key", "n"])

    counts = source.where(F.rand(11) < SHARE).mapInArrow(listed, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = np.array([r["key"] for r in counts.orderBy(F.desc("n"), "key").limit(FREQUENT).collect()], np.int64).view(np.uint64)
    return np.r_[keys_of([np.array([START], np.uint64)] * (order - 1)), found]


def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[list[int]]]]:
    """Runs of rows of equal part: blocks, and stats of the rows that carry those."""
    part, blocks, stats = None, [], []
    for b in batches:
        for p, block, s in zip(*[b.column(c).to_pylist() for c in ("part", "block", "stats")], strict=True):
            if p != part:
                if part is not None:
                    yield part, blocks, stats
                part, blocks, stats = p, [], []
            if s is None:
                blocks.append(block)
            else:
                stats.append(s)
    if part is not None:
        yield part, blocks, stats


class Counting:
    """The steps of a fit, as functions over Arrow batches."""

    def __init__(self, uri: str, order: int, parts: int, shelf: int, frequent: np.ndarray):
        self.uri, self.order, self.parts, self.shelf, self.frequent = uri, order, parts, shelf, frequent

    def part(self, words: list[np.ndarray]) -> np.ndarray:
        if len(words) < self.order:
            return dealt(keys_of(words), self.parts)
        context = keys_of(words[:-1])
        return part_of(context, mixed(context, words[-1]), self.frequent, self.parts)

    def counted(self, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct n-grams of about FLUSH tokens at a time, dealt out to groups of `width` parts."""
        hashes, held, size = worker_hashes(), [], 0

        def flush() -> pa.RecordBatch:
            grams = [np.concatenate([h[i] for h in held]) for i in range(self.order)]
            _, words, counts = summed(grams, [np.ones(size, np.uint8)])
            return block_rows(blocks_by(self.part(words) // width, words, counts))

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                words, own = padded([hashes.of(t) for t in b.column(0).slice(lo, 256).to_pylist()], self.order)
                held.append(ngrams(words, own, self.order))
                size += own.size
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def redealt(self, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of larger groups, dealt out to groups of `width` parts; stats pass."""
        for part, blocks, stats in sorted_groups(batches):
            if stats:
                yield rows_of([part] * len(stats), [None] * len(stats), stats)
            lo = 0
            while lo < len(blocks):
                hi, size = lo, 0
                while hi < len(blocks) and (hi == lo or size < FLUSH):
                    size += len(blocks[hi]) // 4
                    hi += 1
                _, words, numbers = gathered(blocks[lo:hi])
                yield block_rows(blocks_by(self.part(words) // width, words, numbers))
                lo = hi

    def merged(self, order: int, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes the parts of an order, and passes on what they say of the next lower one. Stats go along in
        rows of negative part: of order k its counts in part -k, and its number of files."""
        writer, shelf, total = None, None, np.zeros(8, np.int64)
        for part, blocks, stats in sorted_groups(batches):
            if part < 0:
                yield rows_of([part], [None], [np.sum(stats, axis=0).tolist()])
                continue
            if part // self.shelf != shelf:
                if writer:
                    writer.close()
                shelf = part // self.shelf
                writer = Writer(f"{self.uri}/{order}", shelf)
                total[7] += 1
            keys, words, numbers = gathered(blocks)
            raw, count = numbers[0], numbers[order < self.order]
            writer.add(part, [keys, *map(narrow, stored(order, self.order, numbers))])
            total[:7] += [*[int((count == k).sum()) for k in (1, 2, 3, 4)], int((count > 0).sum()), int(count.sum()), int(raw.sum())]
            if order > 1:
                real = np.flatnonzero(count)
                words, raw, count = [w[real] for w in words], raw[real], count[real]
                none, one = np.zeros(count.size, np.uint8), np.ones(count.size, np.uint8)
                pairs = [(raw, none), (one, none), (none, count), (none, count == 1), (none, count == 2), (none, count > 2)]
                both = [np.concatenate([a, b]) for a, b in zip(words[1:], words[:-1], strict=True)]
                _, lower, sums = summed(both, [np.concatenate(p) for p in pairs])
                yield block_rows(blocks_by(self.part(lower) // width, lower, sums))
        if writer:
            writer.close()
            yield rows_of([-order], [None], [total.tolist()])


def fit(docs: DataFrame, text: str = "text", order: int = ORDER, part_bytes: int = PART) -> Model:
    """Counts all of `docs`; the blocks of a part meet in one task, at the driver only sums and file names."""
    if order < 2:
        raise ValueError("the order must be 2 or more")
    spark = docs.sparkSession
    uri = shared_path(spark, "language-model")
    fs, path = file_system(uri)
    for k in range(1, order + 1):
        fs.create_dir(f"{path}/{k}", recursive=True)
    source = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = max(1, round((source.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / part_bytes))
    steps = Counting(uri, order, parts, -(-parts // FILES), frequent_contexts(source, order))
    widths = [1]
    while -(-parts // widths[0]) > FAN:
        widths.insert(0, widths[0] * FAN)

    def met(rows: DataFrame) -> DataFrame:
        """Rows, dealt out digit by digit until those of a part, and of the parts of a file, are in one task."""
        for width in widths[1:]:
            salted = rows.withColumn("salt", F.spark_partition_id() % 64).repartition("part", "salt").sortWithinPartitions("part")
            rows = salted.drop("salt").mapInArrow(lambda batches, w=width: steps.redealt(w, batches), ROWS)
        shelf = F.when(F.col("part") >= 0, F.floor(F.col("part") / steps.shelf)).otherwise(F.col("part"))
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartitionById(tasks, F.pmod(shelf, F.lit(tasks)).cast("int")).sortWithinPartitions("part")

    rows = source.mapInArrow(lambda batches: steps.counted(widths[0], batches), ROWS)
    for k in range(order, 0, -1):
        rows = met(rows).mapInArrow(lambda batches, k=k: steps.merged(k, widths[0], batches), ROWS)
    sums = [F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(8)]
    got = {-r["part"]: [r[f"s{i}"] for i in range(8)] for r in rows.groupBy("part").agg(*sums).collect()}
    stats = {k: got.get(k, [0] * 8) for k in range(1, order + 1)}
    files = {k: {int(f.base_name) for f in fs.get_file_info(pa.fs.FileSelector(f"{path}/{k}")) if f.base_name.isdigit()} for k in stats}
    if any(len(files[k]) != stats[k][7] for k in files):
        raise FileNotFoundError(f"files of the model in {uri} are missing")
    return Model(uri, order, parts, steps.shelf, steps.frequent, {k: v[:7] for k, v in stats.items()}, files)


SCHEMA = {"n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "perplexity": pa.float64()}


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the columns of SCHEMA; narrow. Perplexity is that of the model, per token. Scores are rounded to
    DECIMALS and perplexities to half as many, so that they do not depend on the order of sums."""

    def scored(texts: list[str]) -> dict[str, list]:
        own = kept(model.uri, lambda: model)
        hashes = [own.hashes.of(t) for t in texts]
        known, base, log = own.score(hashes)
        base, log = np.round(base, DECIMALS), np.round(log, DECIMALS)
        sizes = np.array([len(h) for h in hashes])
        return {"n_tokens": sizes, "n_known": known, "train_tokens": np.full(sizes.size, model.tokens), "base_score": base, "score": log, "perplexity": np.round(10 ** (-log / sizes), DECIMALS // 2)}

    return map_texts(df, scored, SCHEMA, text, keep, rows=2048)


def sql() -> str:
    """The query of order 2 as one statement; chr(10) is the end and chr(10) || 's' the start."""
    letters = "".join(map(chr, range(65, 91)))
    bits = "flatten(list_transform(range(length(k)), lambda i: list_transform(range(8), lambda j: (ascii(k[i + 1]) >> j) & 1)))"
    step = "xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, b: {step}), 4294967295)"
    count = lambda c, of: ", ".join(f"count(*) FILTER ({c} = {k}) AS n{k}" for k in (1, 2, 3, 4)) + f" FROM {of}"
    least = "least(n1, n2, n3, n4) <= 0"
    less = ", ".join(f"CASE WHEN {least} THEN {k / 2} ELSE least(greatest({k} - {k + 1} * (n1 / (n1 + 2.0 * n2)) * n{k + 1} / n{k}, {MARGIN}), {k - MARGIN}) END AS d{k}" for k in (1, 2, 3))
    taken = lambda n, d: f"CASE {n} WHEN 0 THEN 0 WHEN 1 THEN {d}.d1 WHEN 2 THEN {d}.d2 ELSE {d}.d3 END"
    return f"""WITH k AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, translate(coalesce(text, ''), '{letters}', '{letters.lower()}') AS t FROM documents),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {crc} % 10 = 0 AS held_out, list_append(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'), chr(10)) AS ws FROM k),
tokens AS MATERIALIZED (SELECT r, held_out, unnest(list_prepend(chr(10) || 's', ws[:-2])) AS u, unnest(ws) AS w FROM docs),
c2 AS MATERIALIZED (SELECT u, w, count(*) AS n FROM tokens WHERE NOT held_out GROUP BY u, w),
c1 AS MATERIALIZED (SELECT w, count(*) AS n, sum(n)::BIGINT AS raw FROM c2 GROUP BY w),
x AS MATERIALIZED (SELECT u, sum(n) AS total, count(*) FILTER (n = 1) AS once, count(*) FILTER (n = 2) AS twice, count(*) FILTER (n > 2) AS more FROM c2 GROUP BY u),
e2 AS (SELECT {less} FROM (SELECT {count("n", "c2")})),
e1 AS (SELECT {less}, n1, n2, kinds - n1 - n2 AS rest, kinds, pairs, total FROM (SELECT count(*) AS kinds, coalesce(sum(n), 0) AS pairs, coalesce(sum(raw), 0)::BIGINT AS total, {count("n", "c1")})),
found AS (SELECT r, coalesce(c1.raw, 0) AS raw, coalesce(c1.n, 0) AS n1, coalesce(c2.n, 0) AS n2, x.total, x.once, x.twice, x.more FROM tokens t LEFT JOIN c2 ON t.u = c2.u AND t.w = c2.w LEFT JOIN c1 ON t.w = c1.w LEFT JOIN x ON t.u = x.u),
low AS (SELECT f.*, (greatest(f.n1 - {taken("f.n1", "e1")}, 0) + CASE WHEN e1.pairs > 0 THEN e1.d1 * e1.n1 + e1.d2 * e1.n2 + e1.d3 * e1.rest ELSE 1 END / (e1.kinds + 1)) / greatest(e1.pairs, 1) AS p1, log10((raw + {ADDED}) / (e1.total + {ADDED} * (e1.kinds + 1))) AS base FROM found f, e1),
scored AS (SELECT l.*, CASE WHEN l.total > 0 THEN greatest(l.n2 - {taken("l.n2", "e2")}, 0) / l.total + (e2.d1 * l.once + e2.d2 * l.twice + e2.d3 * l.more) / l.total * l.p1 ELSE l.p1 END AS p FROM low l, e2),
summed AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (raw > 0) AS n_known, round(sum(base), {DECIMALS}) AS base_score, round(sum(log10(p)), {DECIMALS}) AS score FROM scored GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, (SELECT total FROM e1) AS train_tokens, base_score, score, round(10 ** (-score / n_tokens), {DECIMALS // 2}) AS perplexity FROM docs JOIN summed USING (r)"""
