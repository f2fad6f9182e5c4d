"""Every query against brute force or SQL, on a small table and on one of odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import conftest
import numpy as np
import pytest
from pyspark.sql import functions as F
from sqlcheck import rows_of_frame, rows_of_sql

import corpus_pipeline
from shinglery.llm import flac, jaccard_join, language_model, licences, mixing, packing, pii, registry, secrets, topk, toxicity

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries() | {"pipeline": corpus_pipeline.run}


def texts(spark, path):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]


def result(spark, path, name, *columns):
    return sorted((tuple(r) for r in QUERIES[name](spark, path).select(*columns).collect()), key=repr)


def mixtures(parts, n=2000, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(n)]


@pytest.fixture(params=["small", "odd"])
def table(request, spark):
    return SF if request.param == "small" else request.getfixturevalue("odd")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, table, name):
    assert rows_of_frame(QUERIES[name](spark, table)) == rows_of_sql(registry.oracle_sql()[name], table)


def test_licences(spark, table):
    got = QUERIES["op1_license_scan"](spark, table).collect()
    base = lambda r: (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
    assert sorted(map(base, got), key=repr) == sorted([(d, *brute.licences(t)) for d, t in texts(spark, table)], key=repr)
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    if table != SF:
        assert next(r.labels for r in got if r.doc_id == 12) == "epl-2.0,gpl,mit,zlib"


def test_licences_of_mixtures():
    for t in mixtures(["MIT", "mit ", "License", " ", "-", "license ", "Apache ", "general ", "public\n", "é", "GNU ", "SPDX-License-Identifier: ", "(", "0"]):
        got = licences.scan(t)
        assert tuple(got[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == brute.licences(t)


def test_personal_data(spark, table):
    want = []
    for d, t in texts(spark, table):
        spans = brute.personal(t)
        want.append((d, *[sum(s[0] == k for s in spans) for k in pii.KINDS], brute.sha(spans)))
    got = QUERIES["op2_pii"](spark, table).collect()
    assert sorted([(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got], key=repr) == sorted(want, key=repr)
    for r in got:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert len(spans) == r.n_spans >= r.n_email + r.n_ip + r.n_card + r.n_phone
        assert spans == sorted(spans, key=lambda s: (pii.ALL.index(s[0]), int(s[1])))


def test_personal_data_of_mixtures():
    for t in mixtures(["a", "1", "22", "4111 1111 1111 1111", "4111111111111111", ".", "@", "-", " ", "+", "(", ")", "é", "%", "255", "1.2.3.4", "a@b.c", "+1 555"]):
        base, spans = pii.find(t, pii.judge())
        assert base == brute.personal(t) and set(base) <= set(spans)


def test_secrets(spark, table):
    want = []
    for d, t in texts(spark, table):
        spans = brute.secrets(t)
        want.append((d, *[sum(s[0] == k for s in spans) for k in secrets.BASE], brute.sha(spans)))
    assert result(spark, table, "op6_secret_scan", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want, key=repr)


def test_secrets_of_mixtures():
    for t in mixtures(["token", "API_KEY", "apikey", "password", '"', "'", " ", ":", "=", "abcdef", "AKIA", "ABCDEFGH12345678", "deadbeef", "é", "ſecret", "/", "0"]):
        found = secrets.scan(t)
        assert [s for s in found if s[0] in secrets.BASE] == brute.secrets(t)
        assert found == sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_language_model(spark, table):
    docs = texts(spark, table)
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in docs]
    train = [t for (_, t), h in zip(docs, held, strict=True) if not h]
    total = sum(len(brute.tokens(t)) for t in train)
    want = sorted([(d, h, len(brute.tokens(t)), total, x) for (d, t), h, x in zip(docs, held, brute.kneser_ney(train, [t for _, t in docs], 2), strict=True)], key=repr)
    got = [(*r[:4], r[4:]) for r in result(spark, table, "op3_kneser_ney", "doc_id", "held_out", "n_tokens", "train_tokens", "n_known", "base_score", "score")]
    assert sorted(x[:4] for x in got if x[0]) == sorted(x[:4] for x in want if x[0])
    near = lambda a, b: a[0] == b[0] and all(x == pytest.approx(y, abs=2e-6) for x, y in zip(a[1:], b[1:], strict=True))
    by = defaultdict(list)
    for x in want:
        by[x[:4]].append(x[4])
    assert all(any(near(x[4], y) for y in by[x[:4]]) for x in got) and len(got) == len(want)


def test_media(spark, table):
    want = []
    for d, t in texts(spark, table):
        data = brute.payload(t)
        want.append((d, len(t.encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])))
    assert result(spark, table, "op4_flac_media", "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(want, key=repr)
    rows = QUERIES["op4_flac_media"](spark, table).collect()
    kinds = {(r.payload_sha256, r.media_bytes, r.media_sha256, r.feature) for r in rows}
    assert len(kinds) == len({r.payload_sha256 for r in rows})


def test_media_table_and_blocks(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text").where("doc_id IS NOT NULL AND doc_id <> 3")
    flac.store(docs).write.parquet(str(tmp_path / "media"))
    stored = spark.read.parquet(str(tmp_path / "media"))
    assert stored.columns == ["doc_id", "media", "n_bytes"]
    blocks = defaultdict(dict)
    for r in flac.pcm_blocks(stored.unionByName(spark.createDataFrame([(77, None, 0)], stored.schema))).collect():
        blocks[r.doc_id][r.sample_offset] = (r.byte_offset, bytes(r.pcm))
    media = {r.doc_id: bytes(r.media) for r in stored.collect()}
    for r in docs.collect():
        own = sorted(blocks[r.doc_id].items())
        data = brute.payload(r.text or "")
        assert b"".join(pcm for _, (_, pcm) in own) == data and all(flac.seek(media[r.doc_id], at, len(pcm)) == pcm for at, (_, pcm) in own[:3])
        assert all(media[r.doc_id][at : at + 2] == b"\xff\xf8" for _, (at, _) in own)
    assert set(blocks) == set(media)


def test_toxicity(spark, table):
    got = QUERIES["op7_toxicity"](spark, table).collect()
    docs = texts(spark, table)
    held = Counter((d, zlib.crc32(("" if d is None else str(d)).encode()) % 3 == 1) for d, _ in docs)
    assert Counter((r.doc_id, r.held_out) for r in got) == held
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    scores, by_text = defaultdict(set), dict(docs)
    for r in got:
        scores[by_text[r.doc_id]].add(r.score) if r.doc_id not in (3, None) else None
    assert all(len(s) == 1 for s in scores.values())


@pytest.mark.parametrize("small", [False, True])
def test_top_k(spark, table, small, monkeypatch):
    if small:
        monkeypatch.setattr(topk, "CANDIDATES", 16)
        monkeypatch.setattr(topk, "QUERIES", 2)
    assert rows_of_frame(QUERIES["op8_exact_topk"](spark, table)) == rows_of_sql(topk.sql(), table)


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_join(spark, table, small, monkeypatch):
    if small:
        monkeypatch.setattr(jaccard_join, "BUCKET", 8)
        monkeypatch.setattr(jaccard_join, "GROUP", 4)
    shingles = jaccard_join.Shingler()
    docs = texts(spark, table)
    sets = {i: set(shingles(t).tolist()) or {t} for i, (_, t) in enumerate(docs)}
    ids = [d for d, _ in docs]
    found = brute.classes(sets)
    least = defaultdict(list)
    for i, (root, _) in found.items():
        least[root].append(ids[i])
    least = {root: min(own, key=lambda d: (d is None, d)) for root, own in least.items()}
    want = sorted([(ids[i], least[root], n) for i, (root, n) in found.items()], key=repr)
    assert result(spark, table, "op9_jaccard_join", "doc_id", "class_id", "n_links") == want


def encoder():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    return lambda t: [*tokenizer.encode(t, add_special_tokens=False).ids, 1]


def whole_sequences(rows) -> int:
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for own in used.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 2048
    assert set(used) == set(range(len(used)))
    return len(used)


def test_packing(spark, table):
    encode = encoder()
    got = QUERIES["op10_packing"](spark, table).collect()
    want = sorted([(d, *p) for d, t in texts(spark, table) for p in brute.pieces(encode(t))], key=repr)
    assert sorted([tuple(r[:5]) for r in got], key=repr) == want
    n = whole_sequences(got)
    if table == SF:
        assert sum(r.length for r in got) > 0.97 * 2048 * n


def mixed_texts(con_rows, docs):
    """What the mix leaves of `(doc_id, text)`, by the query's SQL rows."""
    taken, out = defaultdict(list), []
    for d, n in con_rows:
        taken[d].append(n)
    for d, t in docs:
        words = brute.re.findall(mixing.WORD, t or "")
        left = taken[d].pop()
        while left > 0:
            out.append((d, t if left >= len(words) else brute.re.match(rf"(?:[\x20\x09-\x0D]*{mixing.WORD}){{{left}}}", t)[0]))
            left -= len(words)
    return out


def test_pipeline(spark, tmp_path, monkeypatch):
    """All stages by plain Python on their own input, against the rows of `run`; and the toxicity query with them, as they
    share a fitted model."""
    sf = "/root/testdata/sf0.01"  # the smallest table has too few labels to learn from
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    monkeypatch.setattr(toxicity, "train", lambda *rest, **named: model)
    rows = {r.doc_id: r for r in docs.collect()}
    scores = {d: model.score(r.text) for d, r in rows.items()}
    got = QUERIES["op7_toxicity"](spark, sf).collect()
    assert {r.doc_id: (r.score, r.toxic_spans) for r in got} == {d: (s, ",".join(f"{a}:{b}" for a, b in spans)) for d, (s, spans) in scores.items()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = Counter((labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels)
    assert held[1, 1] > 0.75 * (held[1, 0] + held[1, 1]) and held[0, 1] < 0.03 * (held[0, 0] + held[0, 1])
    kept = {d: r for d, r in rows.items() if scores[d][0] < 0.7}
    assert 0 < len(rows) - len(kept) < 0.2 * len(rows)
    shingles = jaccard_join.Shingler()
    groups = brute.classes({d: set(shingles(r.text).tolist()) or {r.text} for d, r in kept.items()})
    clean = [(d, pii.redacted(kept[d].text, pii.find(kept[d].text, pii.judge())[1]), kept[d].source) for d, (root, _) in groups.items() if d == root]
    assert len(clean) < len(kept)
    spark.createDataFrame(clean, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    names, taken = rows_of_sql(f"SELECT doc_id, taken FROM ({mixing.sql()})", str(tmp_path))
    encode = encoder()
    want = Counter((d, *p) for d, t in mixed_texts(taken, [c[:2] for c in clean]) for p in brute.pieces(encode(t)))
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter(tuple(r[:5]) for r in got) == want
    whole_sequences(got)


def test_stages_on_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, odd)
        assert got.columns == docs.columns and got.schema["text"].dataType == docs.schema["text"].dataType, name
    rows = lambda df: Counter(map(tuple, df.collect()))
    once = rows(corpus_pipeline.near_duplicates(spark, docs, odd))
    assert sum(once.values()) == len({i: None for i, t in enumerate(conftest.ODD) if t not in conftest.ODD[:i] and t != ""} | {"one two": None}) and max(once.values()) == 1
    mail = next(r.text for r in corpus_pipeline.personal_data(spark, docs, odd).where("doc_id = 13").collect())
    assert "[EMAIL]" in mail and "[CARD]" in mail and "[PHONE]" in mail and "@c.de" not in mail
    taken = {r.doc_id: r for r in QUERIES["op5_mix_sources"](spark, odd).where("doc_id IS NOT NULL AND doc_id <> 3").collect()}
    words = Counter()
    for r in corpus_pipeline.mixed(spark, docs, odd).collect():
        words[r.doc_id] += len(brute.re.findall(mixing.WORD, r.text or ""))
    assert all(words[d] == r.taken for d, r in taken.items())
