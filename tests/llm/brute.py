"""The queries' results by plain Python, straight from their definitions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from shinglery.llm import language_model


def low(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(spans) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def licences(text: str) -> tuple:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    found = [(i, label) for i in range(len(words)) for p, label in phrases.items() if tuple(words[i : i + len(p)]) == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def _luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def personal(text: str) -> list:
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and _luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, good in rules for m in re.finditer(p, text) if good(m[0])]


def secrets(text: str) -> list:
    rules = (
        ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )
    found = [(m.start(), i, k, m.end()) for i, (k, p, good) in enumerate(rules) for m in re.finditer(p, text) if good(m)]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def payload(text: str) -> bytes:
    data = text.encode()
    return data + b"\0" * (-len(data) % 64 if data else 64)


def tokens(text: str) -> list[str]:
    return [*re.findall(r"[^\x20\x09-\x0D]+", low(text)), "\n"]


def kneser_ney(train: list[str], texts: list[str], order: int) -> list[tuple]:
    """(known tokens, base score, score) of each text, by dictionaries of n-grams."""
    pad, counts, raw = ["<"] * (order - 1), {k: Counter() for k in range(1, order + 1)}, Counter()
    for t in train:
        w = pad + tokens(t)
        raw.update(w[order - 1 :])
        counts[order].update(tuple(w[i - order + 1 : i + 1]) for i in range(order - 1, len(w)))
    for k in range(order - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])
    less = {k: language_model.discounts([sum(v == j for v in c.values()) for j in (1, 2, 3, 4)]) for k, c in counts.items()}
    contexts = {k: defaultdict(lambda: [0, 0, 0, 0]) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            contexts[k][g[:-1]][0] += n
            contexts[k][g[:-1]][min(n, 3)] += 1
    kinds, total = len(raw), sum(raw.values())

    def p(g: tuple) -> float:
        if not g:
            return 1 / (kinds + 1)
        x = contexts[len(g)].get(g[:-1])
        if not x:
            return p(g[1:])
        d, n = less[len(g)], counts[len(g)][g]
        return max(n - d[min(n, 3)], 0) / x[0] + sum(d[j] * x[j] for j in (1, 2, 3)) / x[0] * p(g[1:])

    out = []
    for t in texts:
        w = pad + tokens(t)
        own = w[order - 1 :]
        score = sum(math.log10(p(tuple(w[i - order + 1 : i + 1]))) for i in range(order - 1, len(w)))
        out.append((sum(raw[x] > 0 for x in own), sum(math.log10((raw[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in own), score))
    return out


def classes(sets: dict) -> dict:
    """(least linked id, links) of each id, by all pairs of sets."""
    links, root, ids = Counter(), {d: d for d in sets}, sorted(sets, key=lambda d: (d is None, d))

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                links[a] += 1
                links[b] += 1
                lo, hi = sorted((top(a), top(b)), key=lambda d: (d is None, d))
                root[hi] = lo
    return {d: (top(d), links[d]) for d in ids}


def chain(field, words: list[str]) -> np.ndarray:
    """Marginals of toxic by the plain forward and backward recursions."""
    n = len(words)
    w = [[field.weights[side][field.seen(x)].sum() for side in range(3)] for x in words]
    z = [w[i][0] + field.place[i * 4 // n] + (w[i - 1][1] if i else 0) + (w[i + 1][2] if i + 1 < n else 0) for i in range(n)]
    e, (up, down, stay) = np.exp(z), np.exp(field.step)
    forward, backward = [np.array([1.0, e[0]])], [np.ones(2)]
    for i in range(1, n):
        a, b = forward[-1]
        x = np.array([a + b * down, (a * up + b * stay) * e[i]])
        forward.append(x / x.sum())
    for i in range(n - 1, 0, -1):
        a, b = backward[-1]
        x = np.array([a + up * e[i] * b, down * a + stay * e[i] * b])
        backward.append(x / x.sum())
    return np.array([a[1] * b[1] / (a @ b) for a, b in zip(forward, backward[::-1], strict=True)])


class FlacWriter:
    """A second writer of FLAC streams, bit by bit; 8-bit samples, one frame of given subframe for each block."""

    def __init__(self):
        self.bits: list[int] = []

    def put(self, value: int, width: int) -> None:
        self.bits += [value >> i & 1 for i in reversed(range(width))]

    def rice(self, r: int, k: int) -> None:
        u = 2 * r if r >= 0 else -2 * r - 1
        self.bits += [0] * (u >> k) + [1]
        self.put(u, k)

    def done(self) -> bytes:
        self.bits += [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, self.bits[i : i + 8])), 2) for i in range(0, len(self.bits), 8))


def _crc(data: bytes, width: int, poly: int) -> int:
    c = 0
    for byte in data:
        c ^= byte << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ (poly if c >> (width - 1) else 0)) & ((1 << width) - 1)
    return c


def flac_frame(s: list[int], number: int, kind: str, order: int, coef: list[int], shift: int, parts: int, ks: list[int | None], method: int) -> bytes:
    """ks: the Rice parameter of each partition, or None for raw samples of 12 bits."""
    w = FlacWriter()
    for v, n in ((0xFFF8, 16), (7, 4), (0, 4), (0, 4), (1, 3), (0, 1), (number, 8), (len(s) - 1, 16)):
        w.put(v, n)
    head = w.done()
    w.put(_crc(head, 8, 0x07), 8)
    w.put({"fixed": 8 + order, "lpc": 31 + order}[kind] << 1, 8)
    for x in s[:order]:
        w.put(x & 255, 8)
    if kind == "lpc":
        w.put(14, 4)
        w.put(shift, 5)
        for c in coef:
            w.put(c & 0x7FFF, 15)
    w.put(method, 2)
    w.put(parts, 4)
    each = len(s) >> parts
    for p in range(1 << parts):
        k = ks[p % len(ks)]
        w.put((15, 31)[method] if k is None else k, 4 + method)
        if k is None:
            w.put(12, 5)
        for n in range(max(order, p * each), (p + 1) * each):
            r = s[n] - (sum(c * s[n - 1 - j] for j, c in enumerate(coef)) >> shift)
            if k is None:
                w.put(r & 0xFFF, 12)
            else:
                w.rice(r, k)
    data = w.done()
    return data + _crc(data, 16, 0x8005).to_bytes(2, "big")


def flac_stream(blocks: list[tuple[list[int], dict]]) -> tuple[bytes, bytes]:
    """A stream without seek points, and its samples' bytes."""
    pcm = np.concatenate([b for b, _ in blocks]).astype(np.int8).tobytes()
    info = (16).to_bytes(2, "big") + (65535).to_bytes(2, "big") + bytes(6) + (8000 << 44 | 7 << 36 | len(pcm)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + b"".join(flac_frame(s, i, **how) for i, (s, how) in enumerate(blocks)), pcm


def pieces(ids: list[int], length: int = 2048) -> list[tuple]:
    data = [np.array(ids[i : i + length], "<u4") for i in range(0, len(ids), length)]
    return [(i * length, d.size, zlib.crc32(d.tobytes()), len(ids)) for i, d in enumerate(data)]
