"""The Merkle manifest and the filter audit against plain recomputation, with small blocks and forced collisions."""

import hashlib
import random
import zlib
from itertools import permutations

import brute
import numpy as np
import pytest
from sqlcheck import rows_of_frame, rows_of_sql

from shinglery.llm import filter_audit, merkle, registry

SF = "/root/testdata/sf0.001"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    values = (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def above(nodes):
    """For each node: [siblings before, after] on every level, and the top."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            lo = k - k % 8
            paths[i].append(("".join(nodes[lo:k]), "".join(nodes[k + 1 : lo + 8])))
            at[i] = k // 8
        nodes = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return paths, nodes[0]


def manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append((r["doc_id"], leaf(r, r["text"]), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for own in by.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    inner = {g: above([x[1] for x in by[g]]) for g in langs}
    across, root = above([inner[g][1] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for (key, own, r), path in zip(by[g], inner[g][0], strict=True):
            tampered = zlib.crc32(b"" if key is None else str(key).encode()) % 3 == 0
            text = r["text"]
            if tampered and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf(r, text)
            for before, after in path + across[k]:
                folded = sha(before, folded, after)
            out.append((key, own, inner[g][1], root, sha(*(b + a for b, a in path + across[k])), folded, folded == root))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Languages of one, a few and many rows, nulls, ties and repeated rows."""
    rng = random.Random(2)
    langs = [None, "a", "é", *[f"l{i}" for i in range(70)], *["big"] * 150]
    rows = [(rng.choice([None, *range(20)]), rng.choice([None, "A", "É"]), rng.choice(langs), rng.choice([None, 3]), rng.choice([None, "", "ABC é", "É Z"])) for _ in range(500)]
    path = str(tmp_path_factory.mktemp("many"))
    spark.createDataFrame(rows + rows[:40], "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("small", [False, True])
def test_manifest(spark, many, small, monkeypatch):
    if small:  # blocks of eight, and nothing meets at the driver
        monkeypatch.setattr(merkle, "DEPTH", 1)
        monkeypatch.setattr(merkle, "TOP", 0)
    rows = [r.asDict() for r in spark.read.parquet(f"{many}/documents.parquet").collect()]
    got = registry.op12_merkle_manifest(spark, many).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == manifest(rows)


def test_manifest_of_documents(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = registry.op12_merkle_manifest(spark, SF).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == manifest(rows)
    assert {r.verified for r in got} == {True, False} and len({r.root for r in got}) == 1


def test_single_leaf(spark, tmp_path):
    spark.createDataFrame([(7, None, None, None, "Ab")], "doc_id long, source string, lang string, n_chars long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    (r,) = registry.op12_merkle_manifest(spark, str(tmp_path)).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == sha() and r.folded_root in (r.root, leaf({"doc_id": 7, "source": None, "lang": None, "n_chars": None}, "ab"))


def failed(text):
    words = brute.re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(brute.re.findall("[A-Z]", text)) > 2 * len(text), brute.re.search(r"[#$%&*|]", text) is not None)
    return sum(x << i for i, x in enumerate(fails))


@pytest.mark.parametrize(("piece", "stretch", "collide"), [(1 << 20, 1 << 18, False), (64, 16, False), (1 << 20, 1 << 18, True)])
def test_scan_of_buffers(piece, stretch, collide, monkeypatch):
    monkeypatch.setattr(filter_audit, "PIECE", piece)
    monkeypatch.setattr(filter_audit, "STRETCH", stretch)
    if collide:
        monkeypatch.setattr(filter_audit, "word_hashes", lambda data, starts, stops: np.zeros(starts.size, np.uint64))
    rng = random.Random(1)
    parts = ["a", "B", " ", "\t", "é", "漢 ", "#", "x ", "yy ", "\x1f", "\xa0"]
    texts = ["".join(rng.choice(parts[: rng.choice([3, 4, 7, 11])]) for _ in range(rng.choice([0, 1, 5, 50, 900]))) for _ in range(200)] + ["w" * 700, "v " * 300, "Ä" * 99 + "AB"]
    data = [t.encode() for t in texts]
    ends = np.cumsum([0] + [len(x) for x in data])
    assert filter_audit.failures(np.frombuffer(b"".join(data), np.uint8), ends).tolist() == [failed(t) for t in texts]


def test_long_text(spark):
    text = "Wort " * 2_000_000 + "x" * 5_000_000
    docs = spark.createDataFrame([(1, "s", text), (2, "s", text)], "doc_id long, source string, text string")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    got = {(r["mask"], r["good"]): r["n"] for r in filter_audit.masked(docs, labels).collect()}
    assert got == {(failed(text), False): 1, (failed(text) | 16, True): 1}


def audit(docs, labels):
    """All orders by plain walks over every document."""
    first, good, toxic = {}, set(), set()
    for d, _, t in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    for d, q, x in labels:
        good |= {d} if q == 1 and d is not None else set()
        toxic |= {d} if x == 1 and d is not None else set()
    rows = [(s or "", failed(t or "") | (d is not None and d > first[t or ""]) << 4, d in good, d in toxic) for d, s, t in docs]
    out = {}
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone = [r for r in left if r[1] & bit]
                before = len(own) - len(left)
                left = [r for r in left if not r[1] & bit]
                shapley[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(bool(r[1] & bit) for r in own) - len(gone), sum(r[1] == bit for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                assert before + len(gone) + len(left) == len(own)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_audit(spark, odd):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    docs = [tuple(r) for r in spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "source", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{odd}/labels.parquet").collect()]
    got = registry.op13_filter_audit(spark, odd).collect()
    assert {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in got} == audit(docs, labels) and len(got) == 600 * 3


def test_audit_of_documents(spark):
    assert rows_of_frame(registry.op13_filter_audit(spark, SF)) == rows_of_sql(filter_audit.sql(), SF)
