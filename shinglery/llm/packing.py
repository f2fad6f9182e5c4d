"""Packing by shortest-pack-first over the histogram of lengths: lengths are placed longest first and the
counts of packing patterns updated; patterns join back to the pieces of documents by rank.

Defined cases: null and empty texts are the end id alone; the vocabulary's special tokens, written out in a text,
are their own ids, as the tokenizer reads them by default; a document of more ids than a sequence holds is
cut into full pieces and a rest; equal rows get places of their own; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shinglery.llm.common import Memory, kept, written
from shinglery.llm.mixing import ranged, running

# Ids a sequence holds, and the id that ends a document.
LENGTH, END = 2048, 1
#: Bytes of words of other scripts that a worker remembers in each of two generations, and of parts of words in arrays.
REMEMBERED, REMEMBERED_PARTS = 32 << 20, 16 << 20
#: Bytes of texts, and their words of other scripts, that are looked up at a time.
CHARS, RUN = 4 << 20, 1 << 16
#: Symbols of new parts that are merged at a time.
CELLS = 1 << 19
#: Up to so many places (40 bytes each) are broadcast.
SLOTS = 200_000
#: What the vocabulary's pattern tells apart: `'s|'t|'re|'ve|'m|'ll|'d|letters+|number|others+`, between white space of
#: six and two characters; and words that are left to the tokenizer.
SPACE, LETTER, NUMBER, OTHER, WORD = range(5)
_LATIN = [chr(c) for c in range(0x180)]
_KINDS = np.array([SPACE if c in "\t\n\v\f\r \x85\xa0" else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER) for c in _LATIN], np.uint8)
_LOWER = np.array([ord(c.lower()[0]) for c in _LATIN], np.uint16)
#: Kinds and lower case by byte; characters of two bytes are looked up by their number.
_KIND_BYTES = bytes(_KINDS[:128]) + bytes([OTHER] * 128)
_LOWER_BYTES = bytes(range(256)).lower()
_SOLID = bytes([b not in b"\t\n\v\f\r " for b in range(256)])
_BLANK = re.compile(b"[\t-\r ]").search


def _ids_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: How byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from 256 on.
_PLAIN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
BYTE_CHARS = {b: b if b in _PLAIN else 256 + i for i, b in enumerate(_PLAIN + [b for b in range(256) if b not in _PLAIN], -len(_PLAIN))}


class Merges:
    """Ids of many words at once by byte-pair merges: in each step every word merges its pair of least rank, the leftmost
    of equal ones, as the vocabulary's model does word by word. Symbols lie in a column for each word."""

    #: Bytes of a word; a pair's rank and place are one number, NONE where no merge is.
    WIDEST, NONE = 63, np.int32(2**31 - 1)

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        own = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(own)
        self.pairs, self.ranks = own[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.bytes = np.array([[vocab[chr(BYTE_CHARS[b])], vocab[chr(BYTE_CHARS[b]) + end]] for b in range(256)], np.int64)
        self.first = self._rank(np.repeat(self.bytes[:, 0], 512), np.tile(self.bytes.ravel(), 256))

    @classmethod
    def of(cls, path: str) -> Merges | None:
        """None where the vocabulary's model is of another kind."""
        with open(path) as f:
            model = json.load(f)["model"]
        plain = model.get("type") == "BPE" and model.get("end_of_word_suffix") and not any(model.get(x) for x in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix"))
        known = plain and all(chr(c) + x in model["vocab"] for c in BYTE_CHARS.values() for x in ("", model["end_of_word_suffix"]))
        return cls(model) if known and len({*map(str, model["merges"])}) == len(model["merges"]) else None

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, shifted by the bits of a place."""
        pair = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, pair), self.pairs.size - 1)
        return np.where(self.pairs[at] == pair, self.ranks[at] << 6, self.NONE)

    def ids(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and how many each has. Words are 1 to WIDEST bytes of `data`."""
        counts, done = np.zeros(sizes.size, np.int64), []
        for least, most in ((0, 8), (8, 12), (12, 20), (20, self.WIDEST)):
            rows = np.flatnonzero((sizes > least) & (sizes <= most))
            for lo in range(0, rows.size, CELLS // most):
                own = rows[lo : lo + CELLS // most]
                found, counts[own] = self._merged(data, starts[own], sizes[own])
                done.append((own, found))
        first = np.cumsum(counts) - counts
        ids = np.empty(int(counts.sum()), np.uint32)
        for own, found in done:
            ids[spread(first[own], counts[own])] = found
        return ids, counts

    def _merged(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, wide = sizes.size, int(sizes.max())
        places = np.arange(wide + 1)[:, None]
        data = np.where(places < sizes, text.take(starts + places, mode="clip"), 0).astype(np.int64)
        kind = data * 2 + (places == sizes - 1)
        held = places < sizes
        best = np.full((wide + 1, n), self.NONE)
        best[:-1] = self.first.take(data[:-1] * 512 + kind[1:])
        best[:-1][~held[1:]] = self.NONE
        best |= np.where(best < self.NONE, places, 0).astype(np.int32)
        # Flat places from here on: a row below, and after the last one, holds what is read beyond a word.
        own, symbols = held.ravel(), self.bytes.ravel().take(kind).ravel()
        after, before = np.arange(n, (wide + 2) * n), np.arange(-n, (wide + 1) * n)
        flat, live, ends = best.ravel(), np.arange(n), sizes * n
        while live.size:
            least = best.take(live, 1).min(0)
            some = np.flatnonzero(least < self.NONE)
            live, least = live.take(some), least.take(some)
            at = (least & 63) * n + live
            right, lead = after.take(at), before.take(at)
            follow, made = after.take(right), self.made.take(least >> 6)
            symbols[at], after[at], flat[right], own[right] = made, follow, self.NONE, False
            has, led = np.flatnonzero(follow < ends.take(live)), np.flatnonzero(lead >= 0)
            before[follow.take(has)] = at.take(has)
            flat[at] = self.NONE
            left = np.concatenate([at.take(has), lead.take(led)])
            ranks = self._rank(symbols.take(left), np.concatenate([symbols.take(follow.take(has)), made.take(led)]))
            flat[left] = np.where(ranks < self.NONE, ranks | (left // n).astype(np.int32), ranks)
        return symbols.reshape(wide + 1, n).T[held.T].astype(np.uint32), held.sum(0)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers `starts[i]`, `starts[i] + 1`, ..., `counts[i]` of them for each i."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if ends.size else 0)


class Parts:
    """Ids of parts of words, kept in arrays of about `most` bytes: beyond that the half goes that was used longest ago.
    Parts above the widest that can be merged are made one by one by `make` and not remembered."""

    #: Bytes of a part besides its characters and its ids.
    ENTRY = 8 + 8 + 8 + 4

    def __init__(self, make: Callable[[str], bytes], merges: Merges | None, most: int):
        self.make, self.merges, self.most, self.held, self.turn = make, merges, most, 0, 0
        self.keys = pa.array([], pa.large_binary())
        self.ids, self.counts, self.used = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.starts = self.counts

    def _new(self, keys: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.merges and sizes.size and sizes.max() <= Merges.WIDEST:
            ends = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys)]
            return self.merges.ids(np.frombuffer(keys.buffers()[2], np.uint8), ends, sizes)
        made = [self.make(k.decode()) for k in keys.to_pylist()]
        return np.frombuffer(b"".join(made), "<u4"), np.array([len(x) // 4 for x in made], np.int64)

    def of(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them and how many are those of each key; keys are different."""
        at = pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy().astype(np.int64)
        sizes = pc.binary_length(keys).to_numpy()
        self.turn += 1
        self.used[at[at >= 0]] = self.turn
        known = self.counts.size
        for wide in (False, True):
            new = np.flatnonzero((at < 0) & ((sizes > Merges.WIDEST) == wide))
            own = keys.take(pa.array(new))
            ids, counts = self._new(own, sizes[new])
            at[new] = np.arange(new.size) + self.counts.size
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
            if not wide:
                known = self.counts.size
                self.keys, self.used = pa.concat_arrays([self.keys, own]), np.concatenate([self.used, np.full(new.size, self.turn, np.int32)])
                self.held += int(sizes[new].sum()) + 4 * ids.size + self.ENTRY * new.size
        self.starts = np.cumsum(self.counts) - self.counts
        found = self.ids, self.starts[at], self.counts[at]
        self._keep(np.arange(known) if self.held <= self.most else np.flatnonzero(self.used > np.median(self.used)))
        return found

    def _keep(self, rows: np.ndarray) -> None:
        if rows.size == self.counts.size:
            return
        self.ids, self.counts = self.ids[spread(self.starts[rows], self.counts[rows])], self.counts[rows]
        if rows.size < len(self.keys):
            self.keys, self.used = self.keys.take(pa.array(rows)), self.used[rows]
            self.held = int(pc.sum(pc.binary_length(self.keys)).as_py() or 0) + 4 * self.ids.size + self.ENTRY * rows.size


class Words:
    """Ids of texts. White space always ends a token of this vocabulary.

    Latin letters are lower-cased and split into parts here as the tokenizer would, in arrays over many texts; each
    different part is looked up once, and new ones are merged at once. Words that hold a special token or another
    character go through the whole tokenizer. What is remembered has a bounded size.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = Memory(self._word, REMEMBERED)
        self.parts = Parts(self._made, Merges.of(path), REMEMBERED_PARTS)

    def _made(self, part: str) -> bytes:
        spelt = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(BYTE_CHARS)
        return _ids_bytes([t.id for t in self.model.tokenize(spelt)])

    def _word(self, word: bytes) -> bytes:
        return _ids_bytes(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)

    def _words(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(words), RUN):
            out += map(self.words.__getitem__, words[lo : lo + RUN])
            self.words = self.words.aged()
        return out

    def _apart(self, raw: bytes, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in words that are left to the tokenizer: characters beyond Latin or of no valid form, the capital I
        with a dot, whose lower case is two characters, and special tokens. Then where characters of two bytes begin."""
        high = np.flatnonzero(data >= 0x80)
        b, c = data[high], data.take(high + 1, mode="clip")
        lead = (b >= 0xC2) & (b <= 0xC5)
        paired = lead & (c & 0xC0 == 0x80) & ~first[high + 1]
        after = np.zeros(high.size, bool)
        after[1:] = paired[:-1] & (high[1:] == high[:-1] + 1)
        places = [high[~(paired | after & (b < 0xC0)) | paired & (b == 0xC4) & (c == 0xB0)]]
        for x in self.special:
            at = raw.find(x)
            while at >= 0:
                places.append(np.array([at]))
                at = raw.find(x, at + 1)
        return np.concatenate(places), high[paired]

    def _split(self, raw: bytes, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The parts of some texts, which of them are words left to the tokenizer, and how many lie before each bound."""
        data, size = np.frombuffer(raw, np.uint8), len(raw)
        low, kinds = np.frombuffer(bytearray(raw.translate(_LOWER_BYTES)), np.uint8), np.frombuffer(bytearray(raw.translate(_KIND_BYTES)), np.uint8)
        first = np.zeros(size + 1, bool)
        first[bounds] = True
        apart, lead = self._apart(raw, data, first)
        char = ((data[lead] & 0x1F).astype(np.uint16) << 6) | (data[lead + 1] & 0x3F)
        kinds[lead] = kinds[lead + 1] = _KINDS[char]
        low[lead], low[lead + 1] = 0xC0 | (_LOWER[char] >> 6), 0x80 | (_LOWER[char] & 0x3F)
        starts = first[:-1] | (kinds == NUMBER)
        starts[1:] |= kinds[1:] != kinds[:-1]
        starts[lead + 1] = False
        self._contractions(low, kinds, starts, first)
        if apart.size:
            solid = np.frombuffer(raw.translate(_SOLID), np.bool_)
            begins = solid & (first[:-1] | ~np.concatenate([[False], solid[:-1]]))
            begins = np.append(np.flatnonzero(begins), size)
            own = np.unique(np.searchsorted(begins, apart, "right") - 1)
            within = np.zeros(size + 1, np.int8)
            within[begins[own]] += 1
            within[begins[own + 1]] -= 1
            within = np.cumsum(within[:-1], dtype=np.int8).astype(bool) & solid
            low[within], kinds[within], starts[within] = data[within], WORD, False
            starts[begins[own]] = True
        held = kinds != SPACE
        places = np.flatnonzero(starts & held)
        low = low[held]
        ends = np.append(np.flatnonzero(starts[held]), low.size)
        parts = pa.Array.from_buffers(pa.large_binary(), places.size, [None, pa.py_buffer(ends), pa.py_buffer(low)])
        return parts, kinds[places] == WORD, np.searchsorted(places, bounds)

    @staticmethod
    def _contractions(low: np.ndarray, kinds: np.ndarray, starts: np.ndarray, first: np.ndarray) -> None:
        """An apostrophe that begins a part takes some letters behind it along; the rest is a part of its own."""
        at = np.flatnonzero(low[:-1] == ord("'"))
        at = at[starts[at] & (kinds[at + 1] == LETTER) & ~first[at + 1]]
        one, two = low[at + 1], np.where(at + 2 < low.size, low.take(at + 2, mode="clip"), 0)
        two[starts.take(at + 2, mode="clip")] = 0
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for own, n in ((at[np.isin(one, list(b"stmd"))], 2), (at[long], 3)):
            starts[own + 1] = False
            rest = own + n
            starts[rest[rest < low.size]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        return list(self.column(pa.array([t.encode("utf-8", "replace") for t in texts], pa.large_binary())))

    def column(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text with the end's, as little-endian 32-bit bytes; null texts are empty."""
        texts = texts.cast(pa.large_binary())
        texts = texts.fill_null(b"") if texts.null_count else texts
        if not len(texts):
            return
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held = memoryview(texts.buffers()[2] or b"")
        end, at = END.to_bytes(4, "little"), 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHARS, "right")) - 1)
            ids: list[list[bytes]] = [[] for _ in range(at, upto)]
            lo, last = int(offsets[at]), int(offsets[upto])
            while True:
                # A text above CHARS is cut behind white space.
                blank = _BLANK(held, lo + CHARS, last) if last - lo > CHARS else None
                stop = blank.end() if blank else last
                bounds = np.array([0, stop - lo]) if upto == at + 1 else offsets[at : upto + 1] - lo
                for own, found in zip(ids, self._found(bytes(held[lo:stop]), bounds), strict=True):
                    own.append(found)
                lo = stop
                if lo == last:
                    break
            yield from (b"".join([*own, end]) for own in ids)
            at = upto

    def _found(self, raw: bytes, bounds: np.ndarray) -> list[bytes]:
        """Ids of the texts between bounds."""
        parts, apart, before = self._split(raw, bounds)
        coded = parts.dictionary_encode()
        codes, keys = coded.indices.to_numpy(), coded.dictionary
        word = np.zeros(len(keys), bool)
        word[codes[apart]] = True
        starts, counts = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        ids, starts[~word], counts[~word] = self.parts.of(keys.filter(pa.array(~word)) if word.any() else keys)
        if word.any():
            more = self._words(keys.filter(pa.array(word)).to_pylist())
            counts[word] = [len(x) // 4 for x in more]
            starts[word] = ids.size + np.cumsum(counts[word]) - counts[word]
            ids = np.concatenate([ids, np.frombuffer(b"".join(more), "<u4")])
        counts = counts[codes]
        ends = np.concatenate([[0], np.cumsum(counts)])[before] * 4
        flat = ids.take(spread(starts[codes], counts)).astype("<u4", copy=False).tobytes()
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def words_of(path: str) -> Words:
    return kept(f"words of {path}", lambda: Words(path))


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """`(key, start, length, ids_crc32, doc_tokens)`: documents cut at every full sequence."""
    kind = dict(docs.dtypes)[key]
    names = [key, "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        for b in batches:
            rows = []
            for i, ids in enumerate(words.column(b.column(1))):
                total = len(ids) // 4
                rows += [(i, s, min(length, total - s), zlib.crc32(ids[4 * s : 4 * (s + length)]), total) for s in range(0, total, length)]
            if rows:
                at, *cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *[pa.array(c, pa.int64()) for c in cols]], names)

    return docs.select(key, text).mapInArrow(cut, f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[int]]]:
    """(how many sequences, lengths in each) for lengths below a full sequence.

    A length goes to the pack that holds least, while it fits; else a new pack opens, which then is the
    shortest and takes further pieces of that length. Packs alike are one pattern with a count.
    """
    heap: list[tuple[int, int, int, tuple]] = []
    made = 0
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left > 0:
            if heap and heap[0][0] + size <= length:
                total, _, count, held = heapq.heappop(heap)
                put = min(count, left)
                grown = [(total + size, put, (held, size, 1))]
                if count > put:
                    grown.append((total, count - put, held))
                left -= put
            else:
                fit = length // size
                grown = [(f * size, n, ((), size, f)) for f, n in ((fit, left // fit), (left % fit, 1)) if f and n]
                left = 0
            for total, count, held in grown:
                made += 1
                heapq.heappush(heap, (total, made, count, held))
    out = []
    for _, _, count, held in sorted(heap, key=lambda x: x[1]):
        lengths: list[int] = []
        while held:
            held, size, n = held
            lengths += [size] * n
        out.append((count, lengths[::-1]))
    return out


def places(found: list[tuple[int, list[int]]]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, rank after the last, first sequence, offset) of each place in a pattern, and
    the number of sequences. There are at most as many as lengths and patterns allow, whatever the input."""
    out, used, sequence = [], {}, 0
    for count, lengths in found:
        offset = 0
        for size in lengths:
            rank = used.get(size, 0)
            used[size] = rank + count
            out.append((size, rank, rank + count, sequence, offset))
            offset += size
        sequence += count
    return out, sequence


def pack(cut: DataFrame, key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """Adds `sequence_id` and `offset` to pieces, whose `mix_row` keeps equal ones apart and goes. Only the
    histogram, of `length` rows at most, meets at the driver; ranks within a length are distributed prefix counts
    over a range sort. The places are broadcast up to SLOTS, else dealt out by length."""
    spark = cut.sparkSession
    order = [F.col(key), F.col("start"), F.col("ids_crc32"), F.col("mix_row")]
    parts = ranged(cut, F.col("length"), *order)
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    slots, sequences = places(patterns({k: v for k, v in counts.items() if k < length}, length))
    slots.append((length, 0, counts.get(length, 0), sequences, 0))
    table = spark.createDataFrame(slots, "slot_length long, slot_from long, slot_to long, slot_sequence long, slot_offset long")
    ranked = running(parts, order, {"rank": F.lit(1)}, ["length"])
    here = (F.col("length") == F.col("slot_length")) & (F.col("mix_rank") >= F.col("slot_from")) & (F.col("mix_rank") < F.col("slot_to"))
    placed = ranked.join(F.broadcast(table) if len(slots) <= SLOTS else table, here)
    return placed.select(*[c for c in cut.columns if c != "mix_row"], (F.col("slot_sequence") + F.col("mix_rank") - F.col("slot_from")).alias("sequence_id"), F.col("slot_offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Cuts, writes the pieces once (they are small) and packs them."""
    cut = pieces(docs, path or vocabulary(), key, text, length)
    return pack(written(cut.withColumn("mix_row", F.monotonically_increasing_id()), "pieces"), key, length)
