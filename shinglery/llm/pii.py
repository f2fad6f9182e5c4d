"""Personal data: high-recall generators propose overlapping spans, boosted trees judge them by format and
context, and calibrated thresholds select what is redacted. Spans of the base patterns always stay.

The trees learn from generated sentences with planted data and look-alikes of each form (order numbers written like
phones, hardware addresses and hex ids, dates, times, numbers with a wrong check digit), as the tables hold no labels;
thresholds are calibrated on other forms and other words than the trees have seen. Further kinds than the base
ones are social security numbers (ssn) and bank accounts (iban).

Defined cases: null and empty texts have no spans; positions are code points, ends exclusive; a further span
that overlaps a base span or a likelier one goes; redaction joins overlapping spans; other columns are kept.
"""

from __future__ import annotations

import ipaddress
import random
import re
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shinglery.llm.boosting import Boosted
from shinglery.llm.common import kept, map_texts, sha256_hex, spans_text

# The base kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: The base pattern; as a match ends with its digits, looking behind changes none and keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: All kinds: the base ones, then those that the method adds.
ALL = (*KINDS, "ssn", "iban")
DIGIT = re.compile(r"[0-9]")

#: Generators of further candidates: kind, a cheap test of the text, a pattern that starts at the start of a run.
GENERATORS = (
    ("email", lambda t: "@" in t, re.compile(r"(?<![\w.%+-])[\w.%+-]+ ?@ ?[\w-]+(?: ?\. ?[\w-]+)+")),
    ("email", lambda t: "(at)" in t or "[at]" in t or " dot " in t, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]+)+")),
    ("ip", lambda t: t.count(":") > 1, re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{3,39}(?![\w:])")),
    ("phone", lambda t: True, re.compile(r"(?<![\w.+-])\(?[0-9]{2,4}\)?(?:[ ./-]{1,2}[0-9]{2,5}){2,4}(?![\w-])")),
    ("phone", lambda t: True, re.compile(r"(?<![\w.+/)-])(?<![0-9][ ])[0-9]{3}[ .-][0-9]{4}(?![\w/-]|[ .][0-9])")),
    ("ssn", lambda t: "-" in t, re.compile(r"(?<![\w.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("iban", lambda t: True, re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("card", lambda t: True, re.compile(r"(?<![\w.-])[0-9]{4}(?:[ ._-]?[0-9]{4}){2}[ ._-]?[0-9]{1,7}(?![\w-])")),
)
CUES = {
    "email": ("mail", "contact", "write to", "reach"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "debit", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
    "ssn": ("ssn", "social security", "tax id"),
    "iban": ("iban", "account", "bank", "transfer"),
}
COUNTER_CUES = ("version", "order", "ticket", "isbn", "date", "invoice", "serial", "part", "page", "ratio", "time", "score")
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk")
LAST_WORD = re.compile(r"[a-z]+$")
#: Characters before and after a span that count as its context.
NEAR = 32
PRECISION, LEAST, ROUNDS, SAMPLE, SEED = 0.98, 0.5, 60, 5000, 7


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, by kind and then start.

    An address holds one @; its start is the run of local characters before it, but not inside the match
    before, so that looking at each @ finds what a scan from the left finds.
    """
    out, end = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            at = m.start()
            lo = at
            while lo > end and LOCAL.match(text[lo - 1]):
                lo -= 1
            if lo < at:
                out.append(("email", lo, m.end()))
                end = m.end()
    if not DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Further, possibly overlapping proposals."""
    digits = bool(DIGIT.search(text))
    out = []
    for kind, hint, pattern in GENERATORS:
        if (digits or kind == "email") and hint(text):
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return out


def is_ipv6(span: str) -> bool:
    try:
        ipaddress.IPv6Address(span)
    except ValueError:
        return False
    return True


def iban_sum(span: str) -> int:
    """The remainder of a bank account's check, 1 if it is right."""
    s = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def checked(span: str, kind: str, digits: str) -> bool:
    """Whether the span passes the check of its kind, where there is one."""
    if kind == "ip":
        return is_ipv6(span)
    if kind == "ssn":
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    if kind == "iban":
        return iban_sum(span) == 1
    return bool(digits) and luhn(digits)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - NEAR) : start].lower(), text[end : end + NEAR].lower()
    digits = only_digits(span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    near = before + " " + after
    return [
        float(ALL.index(kind)), float(len(span)), float(len(digits)), len(digits) / len(span), float(len(groups)),
        float(max(groups, default=0)), float(min(groups, default=0)), float(groups[-1] if groups else 0), float(checked(span, kind, digits)), float(len(set(digits))),
        float(span.count("-") + span.count(" ")), float(span.count(".")), float(span.count("/") + span.count(":")), float("(" in span),
        float(any(c in near for c in CUES[kind])), float(any(c in near for c in COUNTER_CUES)),
        float(before[-1:].isalnum() or after[:1].isalnum()), float("(at)" in span or "[at]" in span or " at " in span), float(bool(re.match(r"(?:19|20)[0-9]{2}\D", span + " "))),
        float(digits[:1] == "0"), float("::" in span), float((m := LAST_WORD.search(span.lower())) is not None and m[0] in DOMAINS),
    ]


class Forms:
    """Writers of personal data and of look-alikes, by random numbers. A form says its kind, whether it is personal, and
    whether it is held back: the trees learn from the others alone, and the thresholds are set on held ones."""

    def __init__(self, rng: random.Random):
        self.rng = rng

    def num(self, k: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(k))

    def hexes(self, n: int, k: int) -> str:
        made = ":".join("".join(self.rng.choice("0123456789abcdef") for _ in range(k)) for _ in range(n))
        return made.upper() if self.rng.random() < 0.3 else made

    def word(self) -> str:
        return "".join(self.rng.choice("abdeilmnorstu") for _ in range(self.rng.randint(3, 8)))

    def sep(self) -> str:
        return self.rng.choice(" .-")

    def three(self) -> str:
        s = self.sep()
        return f"{self.num(3)}{s}{self.num(3)}{s}{self.num(4)}"

    def pairs(self) -> str:
        return self.rng.choice(" .").join(["0" + self.rng.choice("1234567"), *[self.num(2) for _ in range(4)]])

    def card(self, valid: bool, size: int = 16) -> str:
        head = self.rng.choice("3456") + self.num(size - 2)
        tail = next(c for c in "0123456789" if luhn(head + c) == valid)
        return self.rng.choice(["", " ", "-", "."]).join((head + tail)[i : i + 4] for i in range(0, size, 4))

    def ssn(self, valid: bool) -> str:
        area = f"{self.rng.choice([x for x in range(1, 900) if x != 666]):03d}" if valid else self.rng.choice(["000", "666", f"9{self.num(2)}"])
        return f"{area}-{self.rng.randint(1, 99):02d}-{self.rng.randint(1, 9999):04d}"

    def iban(self, valid: bool, heads: str = "DE FR ES GB NL") -> str:
        head, rest = self.rng.choice(heads.split()), self.num(self.rng.choice([14, 16, 18, 20]))
        tail = 98 - iban_sum(f"{head}00{rest}")
        whole = f"{head}{tail if valid else (tail + self.rng.randint(1, 90)) % 97 + 1:02d}{rest}"
        if iban_sum(whole) == 1 and not valid:
            return self.iban(valid, heads)
        return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if self.rng.random() < 0.5 else whole

    def short_ip(self, tail: int) -> str:
        return ":".join(f"{self.rng.randrange(65536):x}" for _ in range(self.rng.randint(1, 4))) + "::" + ":".join(f"{self.rng.randrange(65536):x}" for _ in range(self.rng.randint(0, tail)))

    def other(self, held: bool) -> str:
        """A word that says that a number is something else; held sentences have words of their own."""
        return self.rng.choice(COUNTER_CUES[1::2] if held else COUNTER_CUES[::2])

    def made(self, held: bool) -> list[tuple[str, bool, Callable[[], str]]]:
        """(kind, is it personal, how it is written), each personal form beside look-alikes of the same form."""
        r, num, word, other = self.rng, self.num, self.word, lambda: self.other(held)
        if held:
            return [
                ("email", True, lambda: f"{word()}[at]{word()}[dot]{r.choice(DOMAINS)}"), ("email", True, lambda: f"{word()} @ {word()}.{r.choice(DOMAINS)}"),
                ("email", True, lambda: f"{word()}.{word()} at {word()} dot {r.choice(DOMAINS)}"), ("email", False, lambda: f"{word()} at {word()} dot {word()}"), ("email", False, lambda: f"{word()} @ {word()}.{word()}ly"),
                ("phone", True, lambda: f"({num(3)}){num(3)}-{num(4)}"), ("phone", True, lambda: f"{r.choice(CUES['phone'])} {self.three()}"), ("phone", True, lambda: f"{r.choice(CUES['phone'])} no. {num(3)} {num(4)}"), ("phone", True, self.pairs),
                *[("phone", False, lambda: f"{other()} {self.three()}")] * 2, ("phone", False, lambda: f"{other()} no. {num(3)}-{num(4)}"), ("phone", False, lambda: f"{other()} {self.pairs()}"), ("phone", False, lambda: f"{r.randint(10, 28)}.{r.randint(10, 12)}.{r.choice(['19', '20'])}{num(2)}"),
                ("phone", False, lambda: f"{num(3)}/{num(3)}/{num(3)}"), ("phone", False, lambda: self.card(False)), ("phone", False, lambda: f"{other()} ({num(3)}) {num(3)}-{num(4)}"),
                ("card", True, lambda: self.card(True, r.choice([14, 15, 16, 19]))), ("card", False, lambda: self.card(False, r.choice([14, 15, 16, 19]))), ("card", False, lambda: f"{other()} {self.card(False)}"),
                ("ip", True, lambda: self.hexes(8, 4)), ("ip", True, lambda: self.short_ip(2)), ("ip", True, lambda: f"fe80::{r.randrange(65536):x}:{r.randrange(65536):x}"),
                ("ip", False, lambda: self.hexes(6, 2)), ("ip", False, lambda: f"{other()} {self.hexes(r.choice([3, 4, 5, 7, 9]), 4)}"), ("ip", False, lambda: f"{num(2)}:{num(2)}:{num(2)}:{num(3)}"), ("ip", False, lambda: self.hexes(12, 2)),
                ("ssn", True, lambda: self.ssn(True)), ("ssn", True, lambda: f"{r.choice(CUES['ssn'])}: {self.ssn(True)}"), ("ssn", False, lambda: self.ssn(False)), ("ssn", False, lambda: f"{other()} {self.ssn(True)}"),
                ("iban", True, lambda: self.iban(True, "IT PL SE")), ("iban", False, lambda: self.iban(False, "IT PL SE")), ("iban", False, lambda: f"{other()} {self.iban(False)}"),
            ]
        return [
            ("email", True, lambda: f"{word()} {r.choice(['(at)', '[at]'])} {word()} {r.choice(['(dot)', '[dot]'])} {r.choice(DOMAINS)}"), ("email", True, lambda: f"{word()}@ {word()}.{r.choice(DOMAINS)}"),
            ("email", True, lambda: f"{word()} at {word()} dot {r.choice(DOMAINS)}"), ("email", False, lambda: f"{word()} at {word()} dot {word()}"), ("email", False, lambda: f"{word()}@ {word()}.{word()}"), ("email", False, lambda: f"{word()} (at) {word()}.{word()}"),
            ("phone", True, lambda: f"({num(3)}) {num(3)}{self.sep()}{num(4)}"), ("phone", True, self.three), ("phone", True, lambda: f"{r.choice(CUES['phone'])} {self.three()}"), ("phone", True, self.pairs), ("phone", True, lambda: f"{r.choice(CUES['phone'])} {num(3)}-{num(4)}"),
            ("phone", False, lambda: f"{other()} ({num(3)}) {num(3)}{self.sep()}{num(4)}"), *[("phone", False, lambda: f"{other()} {self.three()}")] * 2, ("phone", False, lambda: f"{other()} {self.pairs()}"), ("phone", False, lambda: f"{other()} {num(3)}{self.sep()}{num(4)}"),
            ("phone", False, lambda: f"{num(3)}{self.sep()}{num(4)}"), ("phone", False, lambda: f"{r.choice(['19', '20'])}{num(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}"), ("phone", False, lambda: f"{num(2)}.{num(2)}.{num(3)}"),
            ("phone", False, lambda: f"{num(2)} {num(2)} {num(2)} {num(2)}"), ("phone", False, lambda: f"{num(2)}/{num(2)}/{num(4)}"), ("phone", False, lambda: self.ssn(True)), ("phone", False, lambda: ".".join(num(r.randint(2, 3)) for _ in range(4))), ("phone", False, lambda: self.card(r.random() < 0.5)),
            ("card", True, lambda: self.card(True)), ("card", False, lambda: self.card(False)), ("card", False, lambda: f"{other()} {self.card(False)}"),
            ("ip", True, lambda: ":".join(f"{r.randrange(65536):x}" for _ in range(8))), ("ip", True, lambda: self.short_ip(3)), ("ip", True, lambda: r.choice(["::1", "fe80::1", f"2001:db8::{r.randrange(65536):x}"])),
            ("ip", False, lambda: self.hexes(r.choice([5, 6, 7]), 2)), ("ip", False, lambda: self.hexes(r.choice([3, 5, 6, 7]), 4)), ("ip", False, lambda: ":".join(num(2) for _ in range(r.choice([3, 5])))), ("ip", False, lambda: "::" + r.choice(["add", "bad", "face"]) + ":"), ("ip", False, lambda: f"{other()} {self.hexes(9, 2)}"),
            ("ssn", True, lambda: self.ssn(True)), ("ssn", True, lambda: f"{r.choice(CUES['ssn'])} {self.ssn(True)}"), ("ssn", False, lambda: self.ssn(False)), ("ssn", False, lambda: f"{other()} {self.ssn(True)}"),
            ("iban", True, lambda: self.iban(True)), ("iban", False, lambda: self.iban(False)), ("iban", False, lambda: f"{other()} {self.iban(False)}"),
        ]


def sentences(rng: random.Random, n: int, held: bool = False) -> list[tuple[str, str, bool]]:
    """(text, kind, whether the kind's candidates are personal): personal data and look-alikes in fillers."""
    forms = Forms(rng)
    made = forms.made(held)
    filler = lambda: " ".join(forms.word() for _ in range(rng.randint(2, 6)))
    out = []
    for _ in range(n):
        kind, good, build = rng.choice(made)
        cue = rng.choice(CUES[kind]) if rng.random() < (0.5 if good else 0.02) else forms.other(held) if not good and rng.random() < 0.3 else forms.word()
        out.append((f"{filler()} {cue} {build()} {filler()}.", kind, good))
    return out


class Judge:
    """Boosted trees and the threshold of each kind: on forms that training never saw, the least from which on PRECISION
    of what is taken is personal, but no less than LEAST."""

    def __init__(self, seed: int = SEED, sample: int = SAMPLE):
        rng = random.Random(seed)
        fit, held = ([(features(t, k, s, e), k, good) for t, kind, good in sentences(rng, sample, back) for k, s, e in candidates(t) if k == kind] for back in (False, True))
        self.trees = Boosted(rounds=ROUNDS).fit(np.array([r[0] for r in fit]), np.array([r[2] for r in fit], float))
        p = self.trees.probability(np.array([r[0] for r in held]))
        #: By kind: from which probability on a candidate is taken; what share of those taken is personal, and what share of
        #: the personal ones is taken, among held candidates.
        self.thresholds, self.precision, self.recall = {}, {}, {}
        for kind in ALL:
            mine = sorted(((q, r[2]) for q, r in zip(p, held, strict=True) if r[1] == kind), reverse=True)
            self.thresholds[kind], good = 1.1, 0
            for i, (q, label) in enumerate(mine, 1):
                good += label
                if good / i >= PRECISION and (i == len(mine) or mine[i][0] < q):
                    self.thresholds[kind] = max(LEAST, float(q))
            taken = [label for q, label in mine if q >= self.thresholds[kind]]
            self.precision[kind] = sum(taken) / len(taken) if taken else 1.0
            self.recall[kind] = sum(taken) / sum(label for _, label in mine)

    def further(self, text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Accepted candidates that overlap neither `taken` nor better ones."""
        if not (found := candidates(text)):
            return []
        covered = bytearray(len(text))
        for _, s, e in taken:
            covered[s:e] = b"\1" * (e - s)
        free = [c for c in found if covered.find(1, c[1], c[2]) < 0]
        if not free:
            return []
        p = self.trees.probability(np.array([features(text, *c) for c in free]))
        out: list[tuple[str, int, int]] = []
        for q, c in sorted(zip(p, free, strict=True), key=lambda x: (-x[0], x[1][1], x[1][2])):
            if q >= self.thresholds[c[0]] and covered.find(1, c[1], c[2]) < 0:
                covered[c[1] : c[2]] = b"\1" * (c[2] - c[1])
                out.append(c)
        return out


@cache
def judge() -> Judge:
    return Judge()


def find(text: str, judge_: Judge) -> tuple[list, list]:
    """(base spans, all spans), each by kind and then start."""
    base = base_spans(text)
    more = judge_.further(text, base) if DIGIT.search(text) or "@" in text or "at" in text else []
    return base, sorted(base + more, key=lambda x: (ALL.index(x[0]), x[1])) if more else base


SCHEMA = {**{f"n_{k}": pa.int64() for k in KINDS}, "base_sha256": pa.string(), "spans": pa.string(), "n_spans": pa.int64()}


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds counts and digests of the spans of each row; narrow."""
    model = judge()

    def scanned(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in SCHEMA}
        own = kept("personal data", lambda: model)
        for t in texts:
            base, spans = find(t, own)
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(sha256_hex(spans_text(base)))
            out["spans"].append(spans_text(spans))
            out["n_spans"].append(len(spans))
        return out

    return map_texts(df, scanned, SCHEMA, text, keep)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each stretch of overlapping spans becomes the name of its first kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `pii_text`, the text without its personal data (null stays null: see the caller)."""
    model = judge()
    own = lambda: kept("personal data", lambda: model)
    return map_texts(df, lambda texts: {"pii_text": [redacted(t, find(t, own())[1]) for t in texts]}, {"pii_text": pa.string()}, text, df.columns)
