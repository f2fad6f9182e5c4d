"""Media columns: a lossless FLAC store for 8-bit samples. The reader decodes Rice residuals and linear
predictors, verifies the frame checksums and gives PCM blocks with seekable sample offsets.

All frames of many streams are worked on in step: frame headers, Rice codes and predictors advance one
sample at a time over an array of frames, so that the cost is that of numpy and not of a loop per byte.

The media column is read by an operator of its own, which gets the stored bytes as any reader of the table would.

Defined cases: null and empty values become 64 zero samples; equal values give equal streams; a damaged
header, frame or sample digest raises ValueError; rows keep their other columns, but for those named as outputs.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shinglery.llm.common import map_texts

BLOCK, UNIT, RATE = 512, 64, 8000
#: A seek point for every frame, but at most so many a stream, as its table's length has three bytes.
POINTS = 900_000
#: Coefficient precision and shift of the writer's linear predictor, which is of order 2.
PRECISION, SHIFT = 12, 9
#: Frames that are written and read at once: rows that fit a core's cache, and enough for numpy.
WRITE_STEP, STEP = 1 << 9, 1 << 13


def _crc_table(width: int, poly: int) -> np.ndarray:
    """The table of a CRC that takes as many bits a step as it has itself, from its polynomial."""
    t = np.arange(1 << width, dtype=np.int32)
    for _ in range(width):
        t = (t << 1) ^ np.where(t >> (width - 1) & 1, poly | 1 << width, 0).astype(np.int32)
    return t


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)
#: Predictors by fixed order: s[n] is predicted from the samples before.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def payload(data: bytes) -> bytes:
    """The bytes, then bytes 0 up to a positive multiple of 64."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def _crc(width: int, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC of each stretch of data; stretches are worked on in step, longest first.

    CRC-16 takes two bytes a step; as a leading byte 0 leaves a CRC alone, odd sizes begin with one.
    """
    order = np.argsort(-sizes, kind="stable")
    at, left, crc = starts[order].copy(), sizes[order], np.zeros(starts.size, np.int32)
    if width == 16:
        odd = left & 1
        crc ^= np.where(odd, CRC16[data[at]], 0)
        at, left = at + odd, left >> 1
    for n in np.searchsorted(-left, -np.arange(int(left[0]) if left.size else 0), side="left").tolist():
        spot = at[:n]
        if width == 8:
            crc[:n] = CRC8[crc[:n] ^ data[spot]]
            spot += 1
        else:
            crc[:n] = CRC16[crc[:n] ^ data[spot].astype(np.int32) << 8 ^ data[spot + 1]]
            spot += 2
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _frame_number(i: int) -> bytes:
    """The number in the extended UTF-8 of frame headers."""
    if i < 0x80:
        return bytes([i])
    n = next(n for n in range(2, 8) if i < 1 << (5 * n + 1))
    lead = (0xFF << (8 - n)) & 0xFF
    return bytes([lead | i >> 6 * (n - 1), *(0x80 | i >> 6 * j & 0x3F for j in reversed(range(n - 1)))])


def _head(i: int, size: int) -> bytes:
    """A frame header without its CRC: fixed blocking, rate from STREAMINFO, one channel, 8 bits."""
    if size == BLOCK:
        code, extra = 8 + (BLOCK // 256).bit_length() - 1, b""
    else:
        code, extra = (6, bytes([size - 1])) if size <= 256 else (7, (size - 1).to_bytes(2, "big"))
    return bytes([0xFF, 0xF8, code << 4, 0x02]) + _frame_number(i) + extra


def _residuals(s: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Candidate subframes of a (frames, size) array: (type bits, coefficients per frame, residuals)."""
    none = np.zeros((len(s), 2), np.int32)
    made = [(8, none, s)]
    x = s.astype(np.float32)
    dot = lambda i, j: np.einsum("ij,ij->i", x[:, 2 - i : x.shape[1] - i], x[:, 2 - j : x.shape[1] - j])
    a, b, d, p, q = (v.astype(np.float64) for v in (dot(1, 1), dot(1, 2), dot(2, 2), dot(0, 1), dot(0, 2)))
    det = a * d - b * b
    det[det < 1e-6] = np.inf
    top = (1 << (PRECISION - 1)) - 1
    coef = np.clip(np.rint(np.stack([(p * d - q * b) / det, (q * a - p * b) / det], 1) * (1 << SHIFT)), -top, top).astype(np.int32)
    r = s.copy()
    r[:, 2:] -= (coef[:, :1] * s[:, 1:-1] + coef[:, 1:] * s[:, :-2]) >> SHIFT
    made.append((32 + 1, coef, r))
    return made


def _encode_frames(s: np.ndarray) -> list[bytes]:
    """Subframes of equal size: each takes the shortest of a constant, verbatim samples and the predictors."""
    n, size = s.shape
    best, kinds, ks = np.full(n, 1 << 30), np.ones(n, np.int64), np.zeros(n, np.int64)
    tried = []
    for kind, coef, r in _residuals(s.astype(np.int32)):
        order = kind - 31 if kind >= 32 else kind - 8
        u = (r << 1) ^ (r >> 31)
        total = u[:, order:].sum(1)
        k = np.zeros(n, np.int64)
        for t in range(1, 15):
            k += total >= (size - order) << t
        bits = (total >> k) + (size - order) * (k + 1) + 8 * order + (9 + PRECISION * order) * (kind >= 32) + 10
        less = bits < best
        best, kinds, ks = np.where(less, bits, best), np.where(less, kind, kinds), np.where(less, k, ks)
        tried.append((kind, order, coef, u))
    kinds = np.where((s == s[:, :1]).all(1), 0, np.where(best >= 8 * size, 1, kinds))
    rows: list[bytes] = [b""] * n
    for kind, order, coef, u in [(0, 0, None, None), (1, 0, None, None), *tried]:
        at = np.flatnonzero(kinds == kind)
        if at.size:
            for j, row in zip(at, _subframes(kind, order, s[at], None if u is None else u[at], ks[at], None if coef is None else coef[at]), strict=True):
                rows[j] = row
    return rows


def _closed(heads: list[bytes], rows: list[bytes]) -> list[bytes]:
    """Frames: header and its CRC-8, subframe, CRC-16."""
    tops = np.array([len(h) for h in heads], np.int64)
    crc = _crc(8, np.frombuffer(b"".join(heads), np.uint8), np.cumsum(tops) - tops, tops)
    whole = [h + bytes([c]) + r for h, c, r in zip(heads, crc.tolist(), rows, strict=True)]
    sizes = np.array([len(w) for w in whole], np.int64)
    crc = _crc(16, np.frombuffer(b"".join(whole), np.uint8), np.cumsum(sizes) - sizes, sizes)
    return [w + c.to_bytes(2, "big") for w, c in zip(whole, crc.tolist(), strict=True)]


def _put(bits: np.ndarray, at: int, value: np.ndarray, width: int) -> int:
    """Writes the lowest `width` bits of each row's value from bit `at`; returns the bit after."""
    for j in range(width):
        bits[:, at + j] = value >> (width - 1 - j) & 1
    return at + width


def _subframes(kind: int, order: int, s: np.ndarray, u: np.ndarray | None, k: np.ndarray, coef: np.ndarray | None) -> list[bytes]:
    """The subframe of each row; u: folded residuals, k: their Rice parameters."""
    n, size = s.shape
    if kind <= 1:
        return [bytes([kind << 1]) + row.tobytes() for row in (s[:, :1] if kind == 0 else s)]
    fixed = 8 + 8 * order + (9 + PRECISION * order if kind >= 32 else 0) + 10
    top = np.zeros((n, fixed), np.uint8)
    at = _put(top, 0, np.full(n, kind << 1), 8)
    for j in range(order):
        at = _put(top, at, s[:, j].astype(np.int64), 8)
    if kind >= 32:
        at = _put(top, at, np.full(n, PRECISION - 1), 4)
        at = _put(top, at, np.full(n, SHIFT), 5)
        for j in range(order):
            at = _put(top, at, coef[:, j], PRECISION)
    at = _put(top, at, np.zeros(n, np.int64), 6)  # Rice codes, one partition
    _put(top, at, k, 4)
    u, k1 = u[:, order:], k.astype(np.int32)[:, None]
    ends = fixed + np.cumsum((u >> k1) + (k1 + 1), axis=1, dtype=np.int32)
    width = (int(ends[:, -1].max()) >> 3) + 4
    # A code is zeros, then k + 1 bits that begin with a one: these touch three bytes at most, in which
    # no other code has the same bits, so that sums put them together.
    code = (np.int32(1) << k1) | (u & ((np.int32(1) << k1) - 1))
    byte = (ends - k1 - 1) >> 3
    code <<= 24 - ((ends - k1 - 1) & 7) - k1 - 1
    spot = (byte + (np.arange(n, dtype=np.int32) * width)[:, None]).ravel()
    body = np.zeros(n * width, np.int32)
    for j in range(3):
        body[j:] += np.bincount(spot, ((code >> (16 - 8 * j)) & 255).ravel(), n * width)[: n * width - j].astype(np.int32)
    body = body.astype(np.uint8).reshape(n, width)
    body[:, : -(-fixed // 8)] |= np.packbits(top, axis=1)
    return [body[i, :e].tobytes() for i, e in enumerate(((ends[:, -1] + 7) >> 3).tolist())]


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads, each a positive multiple of 64 bytes; byte 128 is sample 0."""
    jobs: dict[int, list[tuple[int, int, bytes]]] = {}
    for p, data in enumerate(payloads):
        for i in range(0, len(data), BLOCK):
            jobs.setdefault(min(BLOCK, len(data) - i), []).append((p, i // BLOCK, data[i : i + BLOCK]))
    frames: list[list[bytes]] = [[b""] * -(-len(data) // BLOCK) for data in payloads]
    for size, todo in jobs.items():
        s = (np.frombuffer(b"".join([x[2] for x in todo]), np.uint8).reshape(-1, size) ^ 128).view(np.int8)
        rows = [r for lo in range(0, len(todo), WRITE_STEP) for r in _encode_frames(s[lo : lo + WRITE_STEP])]
        for (p, i, _), f in zip(todo, _closed([_head(i, size) for _, i, _ in todo], rows), strict=True):
            frames[p][i] = f
    out = []
    for data, own in zip(payloads, frames, strict=True):
        digest = hashlib.md5((np.frombuffer(data, np.uint8) ^ 128).tobytes(), usedforsecurity=False).digest()
        sizes = [len(f) for f in own]
        info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(data) & (1 << 36) - 1).to_bytes(8, "big") + digest
        at = np.cumsum([0, *sizes[:-1]]).tolist()
        every = -(-len(at) // POINTS)
        points = b"".join([struct.pack(">QQH", i * BLOCK, at[i], min(BLOCK, len(data) - i * BLOCK)) for i in range(0, len(at), every)])
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + b"".join(own))
    return out


class Stream:
    """What the metadata of a stream says: STREAMINFO, and the seek points as (sample, byte, samples)."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.points, self.samples = 4, False, [], -1
        while not last:
            last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + size]
            if len(body) < size:
                raise ValueError("metadata ends early")
            if kind == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.rate, self.channels, self.bits, self.samples, self.digest = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, body[18:34]
            elif kind == 3:
                self.points = list(struct.iter_unpack(">QQH", body))
            at += 4 + size
        if self.samples < 0 or (self.channels, self.bits) != (1, 8):
            raise ValueError("one channel of 8 bits is read here")
        self.first = at


def _words(data: np.ndarray) -> np.ndarray:
    """From each byte on, the next eight bytes as a big-endian number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    w = np.zeros(data.size, np.uint64)
    for j in range(8):
        w = (w << np.uint64(8)) | padded[j : j + data.size]
    return w


class _Bits:
    """Reads from many places of one buffer in step."""

    def __init__(self, words: np.ndarray, pos: np.ndarray):
        self.words, self.pos = words, pos

    def _here(self) -> np.ndarray:
        at = np.minimum(self.pos >> 3, self.words.size - 1)
        return self.words[at] << (self.pos & 7).astype(np.uint64)

    def take(self, width: int) -> np.ndarray:
        out = (self._here() >> np.uint64(64 - width)).astype(np.int64)
        self.pos = self.pos + width
        return out

    def signed(self, width: int) -> np.ndarray:
        v = self.take(width)
        return v - (v >> (width - 1) << width)

    def rice(self, k: np.ndarray) -> np.ndarray:
        """A Rice code each: zeros, a one, k bits; unfolded to a signed number."""
        word, more = self._here(), 0
        top = (word >> np.uint64(32)).astype(np.float64)
        while not top.all():  # 32 zeros or more
            zero = top == 0
            more = more + np.where(zero, 32, 0)
            self.pos = self.pos + np.where(zero, 32, 0)
            if (self.pos >> 3 >= self.words.size).any():
                raise ValueError("a frame ends early")
            word = self._here()
            top = (word >> np.uint64(32)).astype(np.float64)
        q = 32 - np.frexp(top)[1]
        rest = (word << (q + 1).astype(np.uint64) >> np.uint64(1)) >> (63 - k).astype(np.uint64)
        self.pos = self.pos + (q + 1 + k)
        u = ((q + more) << k) | rest.astype(np.int64)
        return (u >> 1) ^ -(u & 1)

    def raw(self, width: np.ndarray) -> np.ndarray:
        rest = (self._here() >> np.uint64(1)) >> (63 - width).astype(np.uint64)
        self.pos = self.pos + width
        v = rest.astype(np.int64)
        return np.where(width > 0, v - (v >> np.maximum(width - 1, 0) << width), 0)


def _residual(bits: _Bits, size: int, order: int, coef: np.ndarray, shift: np.ndarray, s: np.ndarray) -> None:
    """Rice partitions and the predictor: fills s[order:], one sample of all frames at a time."""
    method, parts = bits.take(2), bits.take(4)
    if (method > 1).any() or (size >> parts << parts != size).any():
        raise ValueError("bad residual coding")
    each, k, escaped = size >> parts, np.zeros(parts.size, np.int64), np.zeros(parts.size, bool)
    split = bool(parts.any())
    for n in range(order, size):
        new = (n % each == 0) | (n == order) if split else np.full(parts.size, n == order)
        if n == order or (split and new.any()):
            pos = bits.pos
            got = np.where(method == 0, bits.take(5) >> 1, 0)
            bits.pos = pos
            got = np.where(method == 0, got, bits.take(5))
            bits.pos = np.where(new, pos + 4 + method, pos)
            k, escaped = np.where(new, got, k), np.where(new, got == np.where(method == 0, 15, 31), escaped)
            if (new & escaped).any():
                pos = bits.pos
                width = bits.take(5)
                bits.pos = np.where(new & escaped, pos + 5, pos)
                k = np.where(new & escaped, width, k)
        if escaped.any():
            pos = bits.pos
            raw, after = bits.raw(np.where(escaped, k, 0)), bits.pos
            coded = np.flatnonzero(~escaped)
            part = _Bits(bits.words, pos[coded])
            r = raw
            if coded.size:
                r[coded] = part.rice(k[coded])
                after[coded] = part.pos
            bits.pos = after
        else:
            r = bits.rice(k)
        guess = np.zeros(parts.size, np.int64)
        for j in range(order):
            guess += coef[j] * s[n - 1 - j]
        s[n] = r + (guess >> shift)


def _frames(data: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples of the frames that begin at `starts`, and where each frame ends."""
    tail = np.concatenate([data, np.zeros(32, np.uint8)])
    at = lambda i: tail[np.minimum(starts + i, data.size)].astype(np.int64)
    if (starts >= data.size).any() or ((at(0) << 8 | at(1)) != 0xFFF8).any() or (at(3) & 0xF1).any():
        raise ValueError("no frame here")
    code, rate, lead = at(2) >> 4, at(2) & 15, at(4)
    number = np.where(lead < 0x80, 1, np.searchsorted([0xC0, 0xE0, 0xF0, 0xF8, 0xFC, 0xFE], lead, side="right") + 1)
    tops = 4 + number
    extra = np.where(code == 6, 1, np.where(code == 7, 2, 0))
    sizes = np.where(code == 1, 192, np.where(code <= 5, 576 << np.maximum(code - 2, 0), 256 << np.maximum(code - 8, 0)))
    sizes = np.where(code == 6, at(tops) + 1, np.where(code == 7, (at(tops) << 8 | at(tops + 1)) + 1, sizes))
    tops = tops + extra + np.where(rate == 12, 1, np.where((rate == 13) | (rate == 14), 2, 0))
    if (code == 0).any() or (rate == 15).any() or (_crc(8, tail, starts, tops) != at(tops)).any():
        raise ValueError("a frame header is damaged")
    kind = at(tops + 1) >> 1
    if (at(tops + 1) & 0x81).any():
        raise ValueError("wasted bits are not read here")
    words, begin = _words(tail), 8 * (starts + tops + 2)
    out: list[np.ndarray] = [np.empty(0, np.int8)] * starts.size
    ends = np.zeros(starts.size, np.int64)
    keys = kind << 20 | sizes
    for key in np.unique(keys):
        mine = np.flatnonzero(keys == key)
        k, size = int(key >> 20), int(key & 0xFFFFF)
        bits = _Bits(words, begin[mine])
        s = np.zeros((size, mine.size), np.int64)
        if k == 0:
            s[:] = bits.signed(8)
        elif k == 1:
            for n in range(size):
                s[n] = bits.signed(8)
        elif 8 <= k <= 12 or k >= 32:
            order = k - 31 if k >= 32 else k - 8
            for n in range(order):
                s[n] = bits.signed(8)
            shift = np.zeros(mine.size, np.int64)
            coef = [np.full(mine.size, c) for c in FIXED[order]] if k < 32 else []
            if k >= 32:
                wide, shift = bits.take(4) + 1, bits.signed(5)
                coef = [bits.raw(wide) for _ in range(order)]
            _residual(bits, size, order, coef, shift, s)
        else:
            raise ValueError("a reserved subframe type")
        ends[mine] = (bits.pos + 7) >> 3
        if s.max(initial=0) > 127 or s.min(initial=0) < -128:
            raise ValueError("a sample is out of range")
        for i, row in zip(mine, s.T.astype(np.int8), strict=True):
            out[i] = row
    if (ends + 2 > data.size).any() or (_crc(16, tail, starts, ends - starts) != (tail[ends].astype(np.int32) << 8 | tail[ends + 1])).any():
        raise ValueError("a frame is damaged")
    return out, ends + 2


Block = tuple[int, int, bytes]


def _stretches(info: Stream) -> list[tuple[int, int, int]]:
    """(first sample, sample after the last, byte) of the stretches between seek points; the whole stream is
    one where the points do not begin with its first sample."""
    points = sorted({(p[0], p[1]) for p in info.points if p[0] < info.samples})
    if not points or points[0] != (0, 0):
        points = [(0, 0)]
    ends = [p[0] for p in points[1:]] + [info.samples]
    return [(p[0], e, info.first + p[1]) for p, e in zip(points, ends, strict=True) if e > p[0]]


def _decoded(streams: list[bytes], jobs: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """Samples of the jobs (stream, byte of the first frame, samples); the frames of a job follow each other,
    jobs advance together. ValueError if a frame is damaged or does not end with its job."""
    data = np.frombuffer(b"".join(streams), np.uint8)
    base = np.cumsum([0, *[len(x) for x in streams]])
    parts: list[list[np.ndarray]] = [[] for _ in jobs]
    live = [(j, int(base[i]) + at, left) for j, (i, at, left) in enumerate(jobs)]
    while live:
        after = []
        for lo in range(0, len(live), STEP):
            own = live[lo : lo + STEP]
            first, last = min(x[1] for x in own), int(base[max(jobs[x[0]][0] for x in own) + 1])
            got, ends = _frames(data[first:last], np.array([x[1] - first for x in own], np.int64))
            for (j, _, left), s, e in zip(own, got, ends.tolist(), strict=True):
                parts[j].append(s)
                if s.size > left:
                    raise ValueError("a frame crosses a seek point or the end")
                if s.size < left:
                    after.append((j, first + e, left - s.size))
        live = after
    return [np.concatenate(p) for p in parts]


def blocks_of(streams: list[bytes]) -> list[list[Block]]:
    """The PCM blocks of each stream, (sample offset, byte offset, payload bytes), one for each seek point.

    Every frame's checksums and the digest of all samples are verified.
    """
    infos = [Stream(x) for x in streams]
    spans = [_stretches(i) for i in infos]
    pcm = iter(_decoded(streams, [(i, at, end - lo) for i, own in enumerate(spans) for lo, end, at in own]))
    out = []
    for info, own in zip(infos, spans, strict=True):
        parts = [next(pcm) for _ in own]
        digest = hashlib.md5(usedforsecurity=False)
        for p in parts:
            digest.update(p.tobytes())
        if sum(p.size for p in parts) != info.samples or digest.digest() != info.digest:
            raise ValueError("the samples do not fit the stream's digest")
        out.append([(lo, at, (p.view(np.uint8) ^ 128).tobytes()) for (lo, _, at), p in zip(own, parts, strict=True)])
    return out


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads."""
    return [b"".join([pcm for _, _, pcm in blocks]) for blocks in blocks_of(streams)]


def seek(stream: bytes, sample: int, count: int) -> bytes:
    """`count` samples from `sample` on, decoding only the stretches between seek points that hold them."""
    held = [x for x in _stretches(Stream(stream)) if x[0] < sample + count and x[1] > sample]
    if not held:
        return b""
    got = np.concatenate(_decoded([stream], [(0, at, end - lo) for lo, end, at in held]))
    lo = sample - held[0][0]
    return (got[lo : lo + count].view(np.uint8) ^ 128).tobytes()


def features(samples: np.ndarray) -> str:
    """Integers of the signal: sum, energy, crossings of sample 0, and the largest step."""
    s = samples.astype(np.int64)
    crossings = int(np.count_nonzero((s[1:] < 0) != (s[:-1] < 0)))
    return f"sum={int(s.sum())};energy={int((s * s).sum())};crossings={crossings};step={int(np.abs(np.diff(s)).max(initial=0))}"


def grouped(values: list, most: int = 1 << 22) -> Iterator[list]:
    """Runs of values of about `most` bytes: enough frames for numpy, few enough for memory."""
    run, size = [], 0
    for v in values:
        if run and size + len(v) > most:
            yield run
            run, size = [], 0
        run.append(v)
        size += len(v)
    if run:
        yield run


def store(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Replaces the text by a `media` column, the FLAC stream of its payload, and its own `n_bytes`; narrow."""

    def stored(texts: list[str]) -> dict[str, list]:
        raw = [t.encode("utf-8", "replace") for t in texts]
        return {media: [m for run in grouped([payload(x) for x in raw]) for m in encode(run)], "n_bytes": [len(x) for x in raw]}

    return map_texts(df, stored, {media: pa.binary(), "n_bytes": pa.int64()}, text, rows=1024)


def pcm_blocks(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """`(key, sample_offset, byte_offset, pcm)`: the verified blocks of each stream, by seek point. Rows with
    null media have none."""
    source = df.where(F.col(media).isNotNull()).select(key, media)
    names = [key, "sample_offset", "byte_offset", "pcm"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = 0
            for run in grouped(b.column(1).to_pylist()):
                got = [(row + i, *x) for i, own in enumerate(blocks_of(run)) for x in own]
                row += len(run)
                at, *cols = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)]], names)

    return source.mapInArrow(blocks, f"`{key}` {dict(df.dtypes)[key]}, sample_offset long, byte_offset long, pcm binary")


def described(df: DataFrame, media: str = "media") -> DataFrame:
    """Replaces the `media` column by what its verified PCM blocks, read back, say of it; null media give nulls."""

    def digests(streams: list[bytes]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in DIGESTS}
        for run in grouped([x or b"" for x in streams]):
            blocks = iter(blocks_of([x for x in run if x]))
            for stream in run:
                row = [None] * len(DIGESTS)
                if stream:
                    back = b"".join([pcm for _, _, pcm in next(blocks)])
                    row = [len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stream), hashlib.sha256(stream).hexdigest(), features((np.frombuffer(back, np.uint8) ^ 128).view(np.int8))]
                for c, v in zip(DIGESTS, row, strict=True):
                    out[c].append(v)
        return out

    return map_texts(df, digests, DIGESTS, media, rows=1024)


DIGESTS = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
