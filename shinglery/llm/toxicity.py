"""Toxicity: a linear-chain conditional random field tags toxic spans; marginals by forward-backward give
document scores and offending offsets.

Token labels come from labelled documents: a word, or a beginning of words, that is significantly more frequent
in toxic than in clean training documents is a sign, and a token is toxic where it bears a sign in a toxic
document. The field sees of each token its word, beginnings, endings and shape, the same of the words before and
after it, and the quarter of the text in which it stands. Forward-backward runs over every token of every document. A document's
score is a logistic function of its best stretch of text (the sum of the marginals less a rate for each token,
between the rates of clean and of toxic documents) and of the highest marginal, so that length alone adds
nothing and a toxic passage counts in a text of any length. Training takes a sample of documents of all lengths,
bounded in number and in all characters, see TRAIN_DOCS and TRAIN_CHARS; texts that copy one another count once,
and scores are given for the share of toxic documents among all labels, not that of the sample.

Defined cases: null and empty texts score as a document without toxic tokens; without labels every score is
0, and with labels of one kind only it is that label; a label of a missing document is ignored; repeated rows
are scored alike, as scores are rounded to DECIMALS; other columns are kept, but for those named as outputs.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shinglery.llm.common import ENTRY, kept, map_texts
from shinglery.llm.jaccard_join import ROWS, forest, minhashes, shingler

#: At most so many labelled documents of each label, of at most so many characters on average, are learned from.
TRAIN_DOCS, TRAIN_CHARS = 1500, 8_000
#: A word counts as a sign from this log-likelihood ratio and number of toxic documents on.
SIGNIFICANT, LEAST_DOCS = 15.0, 5
#: Share of toxic documents, at equal numbers of both, among those that hold a sign.
PURE = 0.8
#: Features of words enter the field from this ratio on; lengths of the beginnings and endings that are looked at.
TELLING, PREFIXES, SUFFIXES = 4.0, (4, 5, 6, 7, 8), (3, 4)
STEPS, RATE, RIDGE = 60, 0.3, 1e-3
REJECT, SPAN, DECIMALS = 0.7, 0.5, 6
#: Tokens of a segment of the chain, tokens that are learned from at once, bytes of words that a worker remembers.
SEGMENT, CHUNK, REMEMBERED = 64, 200_000, 32 << 20
QUARTERS = 4
TOKEN = re.compile(r"\w+")


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _ratio(a: int, n: int, b: int, m: int) -> float:
    """Log-likelihood ratio of a of n against b of m."""
    term = lambda k, e: k * math.log(k / e) if k else 0.0
    p = (a + b) / (n + m)
    return 2 * (term(a, n * p) + term(n - a, n * (1 - p)) + term(b, m * p) + term(m - b, m * (1 - p)))


def units(word: str) -> list[str]:
    """The word and its beginnings, which are marked by a star."""
    return [word, *[word[:k] + "*" for k in PREFIXES if len(word) > k]]


def traits(word: str) -> list[str]:
    """What the field sees of a word as written: units, endings, shape."""
    low = word.lower()
    shape = "upper" if word.isupper() and len(word) > 1 else "title" if word[:1].isupper() else "lower" if word.isalpha() else "digit"
    return [*units(low), *["*" + low[-k:] for k in SUFFIXES if len(low) > k], f"<{shape}>"]


def told(docs: list[set[str]], toxic: list[int]) -> tuple[dict[str, float], list[str]]:
    """The signs with their log-likelihood ratios, and the traits that tell labels apart at all.

    A sign cannot be chance, and goes if the documents show that a shorter beginning says as much.
    """
    n = sum(toxic)
    m = len(docs) - n
    yes, no, known = Counter(), Counter(), {}
    for words, label in zip(docs, toxic, strict=True):
        (yes if label else no).update({t for w in words for t in (known.get(w) or known.setdefault(w, traits(w)))})
    found, telling = {}, []
    for t in sorted(yes.keys() | no.keys()):
        a, b = yes[t], no[t]
        if a + b < LEAST_DOCS or (g := _ratio(a, n, b, m)) < TELLING:
            continue
        telling.append(t)
        rate = a / n
        if a >= LEAST_DOCS and g >= SIGNIFICANT and rate >= PURE * (rate + b / m) and t[0] not in "*<":
            found[t] = g
    best = {u: max([found.get(x, 0.0) for x in units(u.rstrip("*")) if x != u and len(x) <= len(u)], default=0.0) for u in found}
    return {u: g for u, g in found.items() if g > best[u]}, telling


def ratios(m: np.ndarray) -> np.ndarray:
    """Of a chain of positive 2 x 2 matrices (m00, m01, m10, m11), each applied to the vector that the one
    before leaves: second by first entry of every vector. The first matrix must not look at its vector.

    The chain is cut into segments that advance together: products of the segments give the vectors at their
    starts, from which all are filled. That is the recursion itself, but for rounding.
    """
    size = m.shape[1]
    n = -(-size // SEGMENT)
    padded = np.empty((4, n * SEGMENT))
    padded[:, :size] = m
    padded[:, size:] = np.array([[1.0], [0.0], [0.0], [1.0]])
    steps = padded.reshape(4, n, SEGMENT).transpose(2, 0, 1).copy()
    p = np.array([[1.0], [0.0], [0.0], [1.0]]) * np.ones(n)
    for a, b, c, d in steps:
        p = np.stack([a * p[0] + b * p[2], a * p[1] + b * p[3], c * p[0] + d * p[2], c * p[1] + d * p[3]])
        p /= p.sum(0)
    starts, x = np.empty(n), 1.0
    for k, (p0, p1, p2, p3) in enumerate(p.T.tolist()):
        starts[k] = x
        x = (p2 + p3 * x) / (p0 + p1 * x)
    out, x = np.empty((SEGMENT, n)), starts
    for s, (a, b, c, d) in enumerate(steps):
        out[s] = x = (c + d * x) / (a + b * x)
    return out.T.ravel()[:size]


class Field:
    """The chain of labels clean (0) and toxic (1). Weights are log potentials against clean and clean-clean."""

    def __init__(self, telling: list[str]):
        self.traits = {t: i + 1 for i, t in enumerate(telling)}
        #: Of each trait, of the token itself, of the one before, of the one after; trait 0 is common to all.
        self.weights = np.zeros((3, len(telling) + 1))
        self.place = np.zeros(QUARTERS)
        self.step = np.zeros(3)  # clean to toxic, toxic to clean, toxic to toxic
        self.forget()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("traits", "weights", "place", "step")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.forget()

    def forget(self) -> None:
        self.memory, self.potentials, self.held = {}, array("d"), 0

    def seen(self, word: str) -> list[int]:
        return [0, *[i for t in traits(word) if (i := self.traits.get(t))]]

    def flat(self, words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """The traits of the words one after another, and where each word's begin."""
        seen = [self.seen(w) for w in words]
        counts = np.array([len(s) for s in seen])
        return np.array([i for s in seen for i in s], np.int32), np.cumsum(counts) - counts

    def ids(self, words: list[str]) -> np.ndarray:
        """Rows of `potentials`: what each word adds to its own, the next and the last token's potential."""
        memory = self.memory
        if new := [w for w in set(words) if w not in memory]:
            memory.update(zip(new, range(len(memory), len(memory) + len(new)), strict=True))
            self.held += sum(map(len, new)) + (ENTRY + 24) * len(new)
            flat, starts = self.flat(new)
            self.potentials.frombytes(np.add.reduceat(self.weights[:, flat], starts, axis=1).T.tobytes())
        return np.fromiter(map(memory.__getitem__, words), np.int64, len(words))

    @staticmethod
    def layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By token of documents of positive sizes: is it the first, is it the last, its quarter."""
        ends = np.cumsum(sizes)
        first, last = np.zeros(int(ends[-1]), bool), np.zeros(int(ends[-1]), bool)
        first[ends - sizes], last[ends - 1] = True, True
        at = np.arange(first.size) - np.repeat(ends - sizes, sizes)
        return first, last, at * QUARTERS // np.repeat(sizes, sizes)

    def emissions(self, own: np.ndarray, before: np.ndarray, after: np.ndarray, layout: tuple) -> np.ndarray:
        """exp of each token's log potential, from what tokens add to their own, the next and the last one's."""
        first, last, quarter = layout
        z = own + self.place[quarter]
        z[1:] += np.where(first[1:], 0.0, before[:-1])
        z[:-1] += np.where(last[:-1], 0.0, after[1:])
        return np.exp(np.clip(z, -30.0, 30.0))

    def marginals(self, e: np.ndarray, layout: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Of toxic, by token; and the expected numbers of the three transitions."""
        first, last, _ = layout
        up, down, stay = np.exp(self.step)
        one = np.ones(e.size)
        x = ratios(np.stack([one, np.where(first, 1.0, down), np.where(first, e, up * e), np.where(first, e, stay * e)]))
        # backward: the vector of a token comes from that of the next one, whose potential it takes along
        f = np.r_[e[1:], 1.0]
        y = ratios(np.stack([one, np.where(last, 1.0, up * f), np.where(last, 1.0, down), np.where(last, 1.0, stay * f)])[:, ::-1])[::-1]
        inner = np.flatnonzero(~last)
        a, m = x[inner], f[inner] * y[inner + 1]
        z = 1 + up * m + a * (down + stay * m)
        edges = np.array([(up * m / z).sum(), (a * down / z).sum(), (a * stay * m / z).sum()])
        return x * y / (1 + x * y), edges

    def fit(self, docs: list[list[str]], gold: list[np.ndarray]) -> Field:
        """Gradient ascent on the labels' likelihood with per-weight steps, over whole documents, some at a time."""
        kinds: dict[str, int] = {}
        chunks, held, size = [], [], 0
        for d, g in [x for x in zip(docs, gold, strict=True) if x[0]] + [([], None)]:
            if held and (g is None or size > CHUNK):
                ids, y = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
                chunks.append((ids, y, self.layout(np.array([x[0].size for x in held]))))
                held, size = [], 0
            if d:
                held.append((np.array([kinds.setdefault(w, len(kinds)) for w in d], np.int32), g.astype(np.float64)))
                size += len(d)
        if not chunks:
            return self
        flat, starts = self.flat(kinds)
        counts, total = np.diff(np.r_[starts, flat.size]), sum(x[2][0].sum() for x in chunks)
        width, square = self.weights.shape[1], 0.0
        for _ in range(STEPS):
            potentials, by_kind, rest = np.add.reduceat(self.weights[:, flat], starts, axis=1), np.zeros((3, len(kinds))), np.zeros(QUARTERS + 3)
            for ids, y, layout in chunks:
                inner = np.flatnonzero(~layout[1])
                p, edges = self.marginals(self.emissions(*potentials[:, ids], layout), layout)
                r, y0, y1 = y - p, y[inner], y[inner + 1]
                for i, (at, v) in enumerate(((ids, r), (ids[inner], r[inner + 1]), (ids[inner + 1], r[inner]))):
                    by_kind[i] += np.bincount(at, v, len(kinds))
                rest += np.r_[np.bincount(layout[2], r, QUARTERS), np.array([((1 - y0) * y1).sum(), (y0 * (1 - y1)).sum(), (y0 * y1).sum()]) - edges]
            g = np.concatenate([*[np.bincount(flat, np.repeat(k, counts), width) for k in by_kind], rest])
            w = np.concatenate([self.weights.ravel(), self.place, self.step])
            g = g / total - RIDGE * w
            square = 0.9 * square + 0.1 * g * g
            w += RATE * g / (np.sqrt(square) + 1e-8)
            self.weights, self.place, self.step = w[: 3 * width].reshape(3, width), w[3 * width : -3], w[-3:]
        self.forget()
        return self

    def tag(self, docs: list[list[str]]) -> list[np.ndarray]:
        """Marginals of toxic, by document and token."""
        sizes = np.array([len(d) for d in docs])
        full = np.flatnonzero(sizes)
        out = [np.empty(0)] * len(docs)
        if full.size:
            if self.held > REMEMBERED:
                self.forget()
            ids = self.ids([w for d in docs for w in d])
            layout = self.layout(sizes[full])
            potentials = np.array(self.potentials).reshape(-1, 3)[ids].T
            p, _ = self.marginals(self.emissions(*potentials, layout), layout)
            for i, part in zip(full, np.split(p, np.cumsum(sizes[full])[:-1]), strict=True):
                out[i] = part
        return out


def without_copies(texts: list[str], toxic: list[int]) -> tuple[list[str], list[int]]:
    """One text of each label and each group whose MinHash values agree in a band, so that the words of a text
    that was copied often do not pass for a habit of many texts."""
    bands = minhashes([shingler()(t) for t in texts]).reshape(len(texts), -1, ROWS)
    near = [0] * 0, [0] * 0
    for b in range(bands.shape[1]):
        _, first, of = np.unique(np.c_[bands[:, b], toxic], axis=0, return_index=True, return_inverse=True)
        near[0].extend(range(len(texts)))
        near[1].extend(first[of.ravel()].tolist())
    root = forest(len(texts), np.array(near[0]), np.array(near[1]))
    stay = [i for i, r in enumerate(root.tolist()) if i == r or not texts[i].strip()]
    return [texts[i] for i in stay], [toxic[i] for i in stay]


class Model:
    """A field, and the logistic function of (log(1 + best stretch), highest marginal). `odds` are those of toxic
    against clean documents where the model is used, if they differ from the sample's."""

    def __init__(self, texts: list[str], toxic: list[int], odds: float | None = None):
        self.field, self.weights, self.cost = None, None, 0.0
        self.share = float(np.mean(toxic)) if toxic else 0.0
        if len(set(toxic)) < 2:
            return
        texts, toxic = without_copies(texts, toxic)
        docs = [TOKEN.findall(t) for t in texts]
        signs, telling = told([set(d) for d in docs], toxic)
        if not any(docs):
            return  # nothing to learn from: no field, and so no spans
        self.field = Field(telling)
        known: dict[str, bool] = {}
        for w in {w for d in docs for w in d}:
            known[w] = any(u in signs for u in units(w.lower()))
        gold = [np.array([known[w] for w in d]) if y else np.zeros(len(d), bool) for d, y in zip(docs, toxic, strict=True)]
        self.field.fit(docs, gold)
        tagged = [p for lo in range(0, len(docs), 64) for p in self.field.tag(docs[lo : lo + 64])]
        self.cost = self._rate(tagged, toxic)
        x = np.array([self.summary(t) for t in tagged])
        self.weights = _logistic(np.c_[x, np.ones(len(x))], np.array(toxic, float))
        if odds:
            self.weights[-1] += math.log(odds * (len(toxic) - sum(toxic)) / sum(toxic))

    @staticmethod
    def _rate(tagged: list[np.ndarray], toxic: list[int]) -> float:
        """The marginals per token that tell stretches of clean and of toxic documents apart best."""
        total, size = [1.0, 1.0], [1, 1]
        for p, y in zip(tagged, toxic, strict=True):
            total[y] += float(p.sum())
            size[y] += p.size
        low, high = (a / n for a, n in zip(total, size, strict=True))
        return (high - low) / math.log(high / low) if high > low else low

    def summary(self, p: np.ndarray) -> list[float]:
        """Of all tokens' marginals; a stretch's worth is their sum less `cost` for each token."""
        if not p.size:
            return [0.0, 0.0]
        worth = np.cumsum(p - self.cost)
        least = np.minimum.accumulate(np.r_[0.0, worth[:-1]])
        return [math.log1p(max(0.0, float((worth - least).max()))), float(p.max())]

    def scores(self, texts: list[str]) -> list[tuple[float, list[tuple[int, int]]]]:
        """Per document its score, and the offsets of tokens that are more likely toxic than not."""
        if self.weights is None:
            return [(round(self.share, DECIMALS), [])] * len(texts)
        out = []
        for t, p in zip(texts, self.field.tag([TOKEN.findall(t) for t in texts]), strict=True):
            z = float(np.dot(self.weights, [*self.summary(p), 1.0]))
            bad = set(np.flatnonzero(p >= SPAN).tolist())
            spans = [m.span() for i, m in enumerate(TOKEN.finditer(t)) if i in bad] if bad else []
            out.append((round(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), DECIMALS), spans))
        return out

    def score(self, text: str) -> tuple[float, list[tuple[int, int]]]:
        return self.scores([text])[0]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = TRAIN_DOCS) -> Model:
    """Learns from `limit` documents of each label at most, chosen by a hash of their ids.

    The ids come from the labels alone; a threshold on the hash leaves about as many as are wanted, so that
    neither texts nor many ids move. Lengths are read before texts: should the chosen documents of a label hold
    more than `limit` * TRAIN_CHARS characters, those that no longer fit, in the hash's order, stay out.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.select(key, F.col(label).cast("int").alias("toxic_label")).distinct()
    counts = {r["toxic_label"]: r["count"] for r in known.groupBy("toxic_label").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col(key)), F.lit(1 << 30))
    chosen = []
    for value, n in sorted(counts.items()):
        few = known.where((F.col("toxic_label") == value) & (draw < int((1 << 30) * min(1.0, 1.1 * limit / n))))
        chosen += few.orderBy(draw, key).limit(limit).collect()
    spark, kind = docs.sparkSession, dict(known.dtypes)[key]
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key), F.col(text))
    of = lambda ids: texts.join(F.broadcast(spark.createDataFrame(ids, f"toxic_key {kind}, toxic_label int")), F.col(key) == F.col("toxic_key"))
    chars: dict = {}
    for r in of(chosen).groupBy("toxic_key").agg(F.sum(F.length(text)).alias("n")).collect():
        chars[r["toxic_key"]] = r["n"]
    room, kept = {value: limit * TRAIN_CHARS for value in counts}, []
    for k, value in chosen:
        if k in chars and chars[k] <= room[value]:
            room[value] -= chars[k]
            kept.append((k, value))
    rows = of(kept)
    got = sorted(((r[text], r["toxic_label"]) for r in rows.select(text, "toxic_label").collect()), key=lambda x: (x[1], x[0]))
    odds = counts[1] / counts[0] if len(counts) == 2 else None
    return Model([t for t, _ in got], [y for _, y in got], odds)


SCHEMA = {"score": pa.float64(), "predicted": pa.int32(), "toxic_spans": pa.string()}


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score, predicted and the offending offsets as `start:end`, comma-joined; narrow."""
    name = f"toxicity-{uuid.uuid4().hex}"

    def scored(texts: list[str]) -> dict[str, list]:
        rows = kept(name, lambda: model).scores(texts)
        return {"score": [s for s, _ in rows], "predicted": [int(s >= REJECT) for s, _ in rows], "toxic_spans": [",".join(f"{a}:{b}" for a, b in x) for _, x in rows]}

    return map_texts(df, scored, SCHEMA, text, keep)
