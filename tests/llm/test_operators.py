"""Parts of the operators, and paths that small tables do not reach."""

import glob
import hashlib
import math
import os
import random
import re
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sqlcheck import rows_of_sql

import corpus_pipeline
from shinglery.llm import boosting, common, components, flac, jaccard_join, language_model, licences, mixing, packing, pii, registry, secrets, topk, toxicity

SF = "/root/testdata/sf0.001"


def test_licence_expressions():
    assert licences.postfix("a or b and c with d".split()) == ["a", "b", "c", "d", "with", "and", "or"]
    assert licences.evaluate("mit or gpl-3.0".split()) == 0.1 and licences.evaluate("mit and gpl-3.0".split()) == 0.7
    assert all(licences.postfix(x.split()) is None for x in ("", "or a", "( a", "a )", "a b", "a and"))
    got = licences.scan("The MIT-License. SPDX-License-Identifier: (Apache-2.0 OR GPL-2.0) mit license")
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (15, 2, 1, 13)
    assert got["base_labels"] == "mit" and got["labels"] == "apache-2.0,gpl-2.0,mit"


def test_unlisted_licences():
    scan = lambda t: (lambda r: (r["labels"], r["score"]))(licences.scan(t))
    assert scan("SPDX-License-Identifier: EPL-2.0 OR Zlib\n") == ("epl-2.0,zlib", licences.UNKNOWN)
    assert scan("License-Expression: MIT AND (EPL-2.0 OR LicenseRef-Own)") == ("epl-2.0,licenseref-own,mit", licences.UNKNOWN)
    assert scan("SPDX-License-Identifier: DocumentRef-a:LicenseRef-b")[0] == "documentref-a:licenseref-b"
    assert scan("an SPDX-License-Identifier is a tag") == scan("licensed under certain terms") == ("", 0.0) and scan("licensed under MIT or certain terms") == ("mit", 0.1)


def test_personal_data():
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice("a1.@-% é") for _ in range(rng.randrange(30)))
        assert [s[1:] for s in pii.base_spans(t) if s[0] == "email"] == [m.span() for m in plain.finditer(t)]
    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(3000):
        t = "".join(rng.choice("1223..a") for _ in range(rng.randrange(30)))
        assert [s[1:] for s in pii.base_spans(t) if s[0] == "ip"] == [m.span() for m in plain.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    t = "mail a.b@c.de, 1.2.3.4 or 300.1.1.1, 4111 1111 1111 1111, +1 (555) 123-4567"
    assert [(k, t[a:b]) for k, a, b in pii.base_spans(t)] == [("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567")]
    judge, rng = pii.judge(), random.Random(99)
    for held in (False, True):
        right = [bool(pii.find(x, judge)[1]) == good for x, kind, good in pii.sentences(rng, 300, held)]
        assert sum(right) / len(right) > 0.85
    assert all(judge.thresholds[k] >= 0.5 and judge.precision[k] >= 0.98 and judge.recall[k] > 0.8 for k in pii.ALL)
    forms = pii.Forms(rng)
    taken = lambda make: sum(bool(pii.find(f"{forms.word()} {make()} {forms.word()}", judge)[1]) for _ in range(300)) / 300
    assert all(taken(lambda: f"{cue} {forms.num(3)}-{forms.num(3)}-{forms.num(4)}") < 0.05 for cue in ("order", "ticket", "serial", "part", "invoice"))  # noqa: B023
    assert taken(lambda: forms.hexes(6, 2)) < 0.05 and taken(lambda: f"call {forms.num(3)}-{forms.num(3)}-{forms.num(4)}") > 0.9 and taken(lambda: forms.hexes(8, 4)) > 0.9
    assert pii.redacted("a x@y.zz b", [("email", 2, 8), ("phone", 4, 6)]) == "a [EMAIL] b"


@pytest.mark.parametrize("part", ["a", "1", "1.", "@a", "a:", "eyJ", "eyJ-", "mit or ", "(mit) and ", "+1 ", "token ", "12 34 ", "(", "ab@c.de ", "4111 1111 1111 1111, ", "call (555) 123-4567 "])
def test_long_runs_take_linear_time(part):
    n = 300_000
    text = f"licensed under {part * (n // len(part))} @ (at) :// x@y.zz secret=abcdef"
    assert ("email", len(text) - 20, len(text) - 14) in pii.find(text, pii.judge())[1]
    assert secrets.scan(text)[-1] == ("assign", len(text) - 13, len(text))
    assert licences.scan(text)["n_words"] >= 4


def test_boosting_learns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    assert ((boosting.Boosted().fit(x, y).probability(x) > 0.5) == y).mean() > 0.95


def test_top_k_ties_and_copies():
    rng = np.random.default_rng(5)
    v = rng.integers(-9, 9, (300, 4))
    v[50:150] = v[7]
    lists = topk.Lists(np.arange(300), v)
    for own in (0, 7, 60, 299):
        want = sorted(((int(v[i] @ v[own]), i) for i in range(300) if i != own), key=lambda x: (-x[0], x[1]))[:5]
        assert lists.top(own, v[own], 5) == want


def test_top_k_visits_few_blocks_of_clustered_vectors(spark, monkeypatch):
    """Normalised vectors around 20 directions: results are exact, and fewer than half of the blocks are visited."""
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 2000)] + 0.15 * rng.normal(size=(2000, 16))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, q array<long>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 50 = 0")).collect()}
    scores = x[::50] @ x.T
    for k, row in enumerate(scores):
        best = sorted(((int(s), i) for i, s in enumerate(row) if i != 50 * k), key=lambda p: (-p[0], p[1]))[:5]
        assert [got[50 * k, r] for r in range(1, 6)] == [(i, s) for s, i in best]
    placed, blocks = topk.blocked(topk.slim(df))
    floors = np.sort(scores, axis=1)[:, -6]
    seen = blocks.visited(x[::50], False, floors)[0].size + len(scores)
    assert placed.count() == 2000 and len(blocks.keys) >= 32 and seen < 0.5 * len(scores) * len(blocks.keys)


def test_top_k_of_long_vectors_raises(spark, tmp_path):
    spark.createDataFrame([(0, [2.0**40, 1.0]), (1, [2.0**40, 0.0])], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    with pytest.raises(Exception, match="too long for 64-bit scores"):
        registry.op8_exact_topk(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="too long for 64-bit scores"):
        rows_of_sql(topk.sql(), str(tmp_path))


def test_stages_keep_columns_of_any_name(spark):
    names = ["score", "predicted", "toxic_spans", "pii_text", "own_hash", "stay_key", "node", "sig", "text_hash", "class_id", "root", "size", "toxic_key", "col_0", "mix_size", "a.b"]
    rows = [(i, t, 7 if t is None else len(t), "s", *[f"{n}{i}" for n in names]) for i, t in enumerate(["x a@b.cc y", "x a@b.cc y", None, ""])]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "n_chars long", "source string", *[f"`{n}` string" for n in names]]))
    got = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, got, SF)
        assert got.columns == docs.columns
    mixed = corpus_pipeline.mixed(spark, got, SF)
    assert mixed.columns == docs.columns and {r.mix_size for r in mixed.collect()} == {"mix_size0"}
    clean = {0: ("x [EMAIL] y", 11), 2: (None, None)}
    assert sorted(tuple(r) for r in got.collect()) == [(r[0], *clean[r[0]], *r[3:]) for r in rows if r[0] in clean]
    assert corpus_pipeline.packed(spark, docs, SF).count() == 4


def test_flac_round_trips():
    rng = random.Random(4)
    data = [flac.payload(x) for x in (b"", b"a" * 64, b"hello world " * 500, rng.randbytes(3000), bytes(i * i % 251 for i in range(5000)))]
    streams = flac.encode(data)
    assert flac.decode(streams) == data and flac.seek(streams[2], 700, 300) == data[2][700:1000]
    s = flac.Stream(streams[3])
    assert flac.decode([b"fLaC\x80" + streams[3][5:42] + streams[3][s.first :]]) == [data[3]]
    for at in (s.first + 3, s.first + 40, len(streams[3]) - 1):
        bad = bytearray(streams[3])
        bad[at] ^= 1
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


def test_flac_seek_points_are_thinned(monkeypatch):
    data = flac.payload(b"some words " * 2000)
    monkeypatch.setattr(flac, "POINTS", 5)
    (stream,) = flac.encode([data])
    points = flac.Stream(stream).points
    assert len(points) == 5 and points[1][0] % flac.BLOCK == 0 and points[1][0] > flac.BLOCK
    assert flac.decode([stream]) == [data] and flac.seek(stream, 9_000, 3_000) == data[9_000:12_000]
    (blocks,) = flac.blocks_of([stream])
    assert len(blocks) == 5 and b"".join(x for _, _, x in blocks) == data


@pytest.mark.parametrize("order", range(5))
def test_flac_of_another_writer_fixed(order):
    rng = random.Random(order)
    coef = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order]
    s = [int(60 * math.sin(i / 9)) + rng.randrange(-3, 4) for i in range(512)]
    ways = [dict(parts=0, ks=[3], method=0), dict(parts=3, ks=[0, 2, None, 5], method=0), dict(parts=2, ks=[17, 1], method=1), dict(parts=1, ks=[None, 0], method=1)]
    stream, pcm = brute.flac_stream([(s, dict(kind="fixed", order=order, coef=coef, shift=0, **w)) for w in ways])
    assert flac.decode([stream]) == [bytes(x ^ 128 for x in pcm)]


@pytest.mark.parametrize("order", [1, 2, 3, 8, 31, 32])
def test_flac_of_another_writer_lpc(order):
    rng = random.Random(order)
    s = [int(90 * math.sin(i / 5)) + rng.randrange(-9, 10) for i in range(320)]
    coef = [rng.randrange(-900, 900) // order for _ in range(order)]
    ways = [dict(parts=0, ks=[4], method=0), dict(parts=1, ks=[6, 2], method=1)]
    stream, pcm = brute.flac_stream([(s, dict(kind="lpc", order=order, coef=coef, shift=9, **w)) for w in ways])
    assert flac.decode([stream]) == [bytes(x ^ 128 for x in pcm)]


@pytest.mark.parametrize(("order", "part_bytes", "fan", "files"), [(2, 20_000, 3, 4), (3, 9_000, 1024, 1 << 16), (4, 30_000, 2, 100)])
def test_language_model_over_many_parts(spark, monkeypatch, order, part_bytes, fan, files):
    for name, value in (("FAN", fan), ("FILES", files), ("FLUSH", 5000), ("MAPS", 3), ("SHARE", 1.0)):
        monkeypatch.setattr(language_model, name, value)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if r.doc_id % 2]
    rows += [(1000, None), (1001, ""), (1002, "a a a a")] + [(2000 + i, "the same text again") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = language_model.fit(docs.where(~language_model.held_out(F.col("doc_id"))), order=order, part_bytes=part_bytes)
    assert model.parts > 1
    got = {r.doc_id: r for r in language_model.score(docs, model).collect()}
    want = brute.kneser_ney([t or "" for d, t in rows if zlib.crc32(str(d).encode()) % 10], [t or "" for _, t in rows], order)
    for (d, _), (known, base, score) in zip(rows, want, strict=True):
        assert (got[d].n_known, got[d].base_score, got[d].score) == (known, pytest.approx(base, abs=2e-6), pytest.approx(score, abs=2e-6))
    lost = sorted(glob.glob(f"{model.uri.removeprefix('file:').replace('//', '/')}/1/*"))[0]
    os.unlink(lost)
    with pytest.raises(FileNotFoundError):
        hashes = language_model.Hashes()
        model.score([hashes.of(t or "") for _, t in rows])


def test_language_model_counts_and_discounts():
    big = np.array([5_000_000_000, 3], np.uint64)
    words = [np.array([7, 9], np.uint64)]
    back, numbers = language_model.unpacked(language_model.packed(words, [big, np.array([1, 0], np.uint8)]))
    assert back[0].tolist() == [7, 9] and numbers[0].tolist() == big.tolist() and numbers[1].dtype == np.uint8
    for n in ([10, 5, 1, 100], [1, 100, 1, 1], [100, 1, 1, 1], [0, 0, 0, 0]):
        d = language_model.discounts(n)
        assert all(0 < d[k] < k for k in (1, 2, 3))


def test_ledger_scans_only_unseen_blobs(spark, monkeypatch, tmp_path):
    old = spark.createDataFrame([(1, 'token = "abcdef1"'), (2, "x"), (2, "x")], "doc_id long, text string")
    for bits in (1 << 10,):
        monkeypatch.setattr(secrets, "BITS", bits)
        first = secrets.update_ledger(old)
        both = old.unionByName(spark.createDataFrame([(3, "x"), (4, "AKIA" + "A" * 16), (5, None), (None, None), (None, "")], old.schema))
        more = secrets.update_ledger(both, ledger=first)
        assert (first.count(), more.count(), secrets.update_ledger(both, ledger=first.unionByName(more)).count()) == (2, 2, 0)
        assert secrets.update_ledger(both, ledger=first, rules="2").count() == 4
        found = [(r.doc_id, [tuple(x) for x in r.findings]) for r in secrets.findings_of_paths(both, first.unionByName(more)).collect()]
        assert sorted(found, key=repr) == sorted([(1, [("assign", 0, 16)]), (2, []), (2, []), (3, []), (4, [("access", 0, 20)]), (5, []), (None, []), (None, [])], key=repr)
        root = f"file://{tmp_path}/ledger-{bits}"
        increments = lambda: sorted(spark.read.parquet(x).count() for x in glob.glob(f"{tmp_path}/ledger-{bits}/*"))  # noqa: E731, B023
        results = [sorted(map(repr, secrets.scan_versions(x, root).collect())) for x in (old, both, both)]
        assert increments() == [0, 2, 2] and results[1] == results[2]
        monkeypatch.setattr(secrets, "MANY", 2)
        assert sorted(map(repr, secrets.scan_versions(both, root).collect())) == results[1] and increments() == [0, 4]
        monkeypatch.setattr(secrets, "MANY", 16)


def test_ledger_moves_texts_of_unseen_blobs_only(spark):
    """Of 3,000 blobs 40 are unseen: these texts pass the filter, and few others do. A filter of few bits passes more,
    and the increment is the same."""
    docs = spark.createDataFrame([(i, f"text {i} token=abcdef{i}") for i in range(3000)], "doc_id long, text string")
    ledger = secrets.update_ledger(docs.where("doc_id >= 40"))
    more = {bytes(r.blob): r.findings for r in secrets.update_ledger(docs, ledger=ledger).collect()}
    assert more == {hashlib.sha256(f"text {i} token=abcdef{i}".encode()).digest(): more[hashlib.sha256(f"text {i} token=abcdef{i}".encode()).digest()] for i in range(40)}
    place = F.concat(F.lit("="), F.col("doc_id").cast("string"))
    addressed = docs.select(place.alias("place"), "text", secrets.blob_id(F.col("text")).alias("blob"))
    unseen = addressed.where("place IN ({})".format(", ".join(f"'={i}'" for i in range(40)))).select(F.col("blob").alias("first_blob"), F.col("place").alias("first_place"))
    moved = {r.place for r in secrets.perhaps_unseen(addressed, unseen, 40).select("place").collect()}
    assert {f"={i}" for i in range(40)} <= moved and len(moved) < 140


def test_further_secrets():
    for kind, text in (("aws", "AWS_SECRET_ACCESS_KEY = \"" + "aB3/" * 10 + '"'), ("key", "sk-" + "a1B2" * 6), ("lab", "glpat-" + "x" * 20), ("bearer", "Authorization: Bearer " + "tok.en_" * 4)):
        assert kind in [s[0] for s in secrets.scan(f"see {text}.")], kind
    assert secrets.scan("a task-" + "z" * 30 + " bearer of news") == []


def test_expressions_end_with_their_line():
    labels = lambda t: licences.scan(t)["labels"]
    assert labels("SPDX-License-Identifier: MIT\nAnd then we import sys") == labels("SPDX-License-Identifier: MIT\r\nor not, who knows") == "mit"
    assert labels("SPDX-License-Identifier:\n\nimport os") == labels("spdx license identifier: the value is missing") == ""
    assert labels("# SPDX-License-Identifier: (EPL-2.0 OR\n#  0BSD) AND Zlib\nfoo") == "0bsd,epl-2.0,zlib"
    assert labels("/* SPDX-License-Identifier: EPL-2.0 OR Zlib */ int x;") == "epl-2.0,zlib" and labels('"license-expression": "WTFPL", "x"') == "wtfpl"
    assert labels("SPDX-License-Identifier: MIT applies, see EPL-2.0") == "mit" and labels("Licensed under\nthe terms of MIT or BSD-3-Clause.") == "bsd-3-clause,mit"


def test_memory_is_bounded_by_bytes():
    """50,000 words of 3,000 characters, as of texts without spaces, are not kept; short ones only up to the bound."""
    made = []
    memory = common.Memory(lambda w: made.append(w) or b"v" * len(w), 1 << 20)
    for i in range(50_000):
        assert len(memory[b"%07d" % i * 430]) == 3010
        memory = memory.aged()
    assert memory.held == 0 and not memory and not memory.old
    for i in range(50_000):
        memory[b"%07d" % i]
        memory = memory.aged()
        assert memory.held <= (1 << 20) + 200 and len(memory.old) <= 1 + (1 << 20) // common.ENTRY
    n = len(made)
    assert memory[b"%07d" % 49_999] == b"v" * 7 and len(made) == n


def test_long_words_leave_the_operators_small():
    words = ["".join(random.Random(i).choice("abcdefgh漢字") for _ in range(1000)) for i in range(300)]
    own, hashes, shingles = packing.Words(packing.vocabulary()), language_model.Hashes(), jaccard_join.Shingler()
    first = own.encode([" ".join(words)])
    hashes.of(" ".join(words)), shingles(" ".join(words))
    assert own.words.held == own.parts.held == hashes.words.held == shingles.words.held == 0
    assert own.encode([" ".join(words)]) == first


def test_rules_are_the_version(monkeypatch):
    assert secrets.rules_digest() == secrets.RULES_VERSION
    monkeypatch.setattr(secrets, "HEX", re.compile("[0-9a-f]{25,}"))
    assert secrets.rules_digest() != secrets.RULES_VERSION


def toxic_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdeilmnorst") for _ in range(5))
    return rng, lambda n, hits: " ".join("vilely" if i in range(4, 4 + 9 * hits, 9) else word() for i in range(n))


def test_toxicity_of_short_and_long_texts(spark):
    rng, make = toxic_texts(4)
    texts = [make(40, rng.choice([2, 3, 4]) if i % 4 == 0 else rng.random() < 0.1) for i in range(400)]
    model = toxicity.Model(texts, [int(i % 4 == 0) for i in range(400)])
    assert all((model.score(make(40, 3 * (i % 2)))[0] >= 0.7) == bool(i % 2) for i in range(60))
    scattered = " ".join(make(1000, 0) + " vilely" for _ in range(4))
    assert model.score(scattered)[0] < 0.7 <= model.score(f"{make(4000, 0)} {make(40, 4)} {make(4000, 0)}")[0]
    assert model.score("abc vilely abc")[1] == [(4, 10)]
    long = [(i, make(4000, 4 * (i % 2)), i % 2) for i in range(40)]
    docs, labels = spark.createDataFrame([x[:2] for x in long], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in long], "doc_id long, toxic int")
    assert toxicity.train(docs, labels).field.traits  # no short document to learn from


def test_toxicity_without_labels_or_with_one_kind():
    assert toxicity.Model([], []).scores(["x", ""]) == [(0.0, [])] * 2
    assert toxicity.Model(["", ""], [0, 1]).scores(["x y", ""]) == [(0.5, [])] * 2
    assert toxicity.Model(["a", "b"], [1, 1]).score("x") == (1.0, []) and toxicity.Model(["a"], [0]).score("") == (0.0, [])


def test_scores_come_from_all_tokens(spark):
    """The score of whole documents, in batches of any kind, from the plain recursions over every token."""
    _, make = toxic_texts(5)
    model = toxicity.Model([make(60, 3 * (i % 4 == 0)) for i in range(200)], [int(i % 4 == 0) for i in range(200)])
    texts = ["", "vilely", make(5000, 2), make(64, 0), make(65, 1), "?!", make(700, 40)]
    for t, (score, spans), alone in zip(texts, model.scores(texts), [model.score(t) for t in texts], strict=True):
        assert (score, spans) == alone
        words = toxicity.TOKEN.findall(t)
        p = brute.chain(model.field, words) if words else np.empty(0)
        best = max([sum(p[i:j] - model.cost) for i in range(len(p)) for j in range(i + 1, min(len(p), i + 120) + 1)], default=0.0) if len(p) < 100 else None
        assert best is None or model.summary(p)[0] == pytest.approx(math.log1p(max(best, 0.0)))
        z = float(np.dot(model.weights, [*model.summary(p), 1.0]))
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=2e-6)
        assert spans == [m.span() for m, x in zip(toxicity.TOKEN.finditer(t), p, strict=True) if x >= 0.5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.score for r in toxicity.score(docs, model).collect()} == {i: model.score(t)[0] for i, t in enumerate(texts)}


def test_field_marginals_agree_with_enumeration():
    f = toxicity.Field(["a", "<lower>"])
    f.weights, f.place, f.step = np.array([[-1.0, 2.0, 0.1], [0.3, -0.2, 0.0], [0.5, 0.7, -0.4]]), np.array([0.1, -0.2, 0.3, 0.4]), np.array([-0.5, 0.3, 1.1])
    steps = {(0, 0): 0.0, (0, 1): -0.5, (1, 0): 0.3, (1, 1): 1.1}
    docs = ["aBca", "b", "caaB1cc", ""]
    for words, got in zip(docs, f.tag([list(d) for d in docs]), strict=True):
        n, total, toxic = len(words), 0.0, np.zeros(len(words))
        if n:
            own, before, after = f.weights[:, :].dot(np.array([[i in f.seen(x) for x in words] for i in range(3)], float))
            z = own + f.place[np.arange(n) * 4 // n] + np.r_[0, before[:-1]] + np.r_[after[1:], 0]
            for y in np.ndindex(*[2] * n):
                w = math.exp(sum(z[i] for i in range(n) if y[i]) + sum(steps[p] for p in zip(y, y[1:], strict=False)))
                total += w
                toxic += w * np.array(y)
        assert got == pytest.approx(toxic / (total or 1))
    rng = random.Random(1)
    long = [[rng.choice("aBc1") for _ in range(n)] for n in (1000, 1, 333, 64, 65)]
    for words, got in zip(long, f.tag(long), strict=True):
        assert got == pytest.approx(brute.chain(f, words), abs=1e-12)


@pytest.mark.parametrize("small", [False, True])
def test_top_k_of_repeated_ids(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(topk, "CANDIDATES", 20)
        monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(6)
    rows = [(int(i), rng.integers(-9, 9, 3).tolist()) for i in rng.integers(0, 60, 150)]
    rows += rows[:50] + [(7, [9, 9, 9])] * 40
    table = spark.createDataFrame(rows, "vec_id long, q array<long>")
    want = []
    for q in {i for i, _ in rows}:
        best = {}
        for i, v in rows:
            if i != q:
                best[i] = max([int(np.dot(v, w)) for j, w in rows if j == q] + [best.get(i, -(10**9))])
        want += [(q, r, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5], 1)]
    assert sorted(map(tuple, topk.top_k(table, table).collect())) == sorted(want)


def test_top_k_visits_few_blocks(spark, monkeypatch):
    """Short vectors cannot beat long ones: their blocks are not visited."""
    monkeypatch.setattr(topk, "CANDIDATES", 10)
    rows = [(i, [100 if i < 20 else 1, i % 7]) for i in range(200)]
    table = spark.createDataFrame(rows, "vec_id long, q array<long>")
    seen = []
    whole = topk._search
    monkeypatch.setattr(topk, "_search", lambda c, q, *rest: seen.append(q.select("block", "id").distinct().count()) or whole(c, q, *rest))
    assert topk.top_k(table, table.where("vec_id < 5")).count() == 25
    assert seen[0] == 5 and seen[1] <= 10


@pytest.mark.parametrize(("bucket", "group"), [(256, 128), (16, 8)])
def test_jaccard_join_of_chains_and_groups(spark, monkeypatch, bucket, group):
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    rng, rows, words = random.Random(3), [], [f"w{i}" for i in range(60)]
    for i in range(60):  # a chain: every text changes a word of the one before
        rows.append((i, " ".join(words)))
        words[rng.randrange(60)] = f"new{i}"
    alike = [f"v{i}" for i in range(120)]
    for i in range(80):  # all alike
        rows.append((100 + i, " ".join(f"n{i}" if j == i else w for j, w in enumerate(alike))))
    rows += [(300, "!!!"), (301, "{} ;"), (302, "!!!"), (303, None), (304, ""), (None, "one two"), (305, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    shingles = jaccard_join.Shingler()
    want = brute.classes({d: set(shingles(t or "").tolist()) or {t or ""} for d, t in rows})
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(docs).collect()} == want
    assert want[101][1] == 79 and want[59][0] == 0


def test_chance_to_miss_a_pair():
    assert jaccard_join.missed() < 2e-5 and jaccard_join.missed(0.9) < 1e-8
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 32, (400, jaccard_join.FUNCTIONS), np.uint32)
    b = np.where(rng.random(a.shape) < 0.35, a, a + np.uint32(1))
    i, j, band = jaccard_join.surviving(a, b)
    same = (a == b).reshape(-1, jaccard_join.BANDS, jaccard_join.ROWS)
    for x, y, first in zip(i, j, band, strict=True):
        assert x == y and same[x, first].all() and not same[x, :first].all(1).any() and same[x].sum() >= jaccard_join.LEAST[48]
    hits = np.cumsum((a == b).reshape(400, 4, -1).sum(2), axis=1)
    assert set(i) == {x for x in range(400) if same[x].all(1).any() and all(hits[x, s] >= jaccard_join.LEAST[12 * s + 12] for s in range(4))}


def test_similar_pairs_by_matrix_and_by_pair():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, n, np.uint64)) for n in rng.integers(1, 80, 30)]
    i, j = np.triu_indices(30, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) >= 0.5 * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    assert jaccard_join.similar(sets, i, j, 0.5).tolist() == want
    assert [bool(jaccard_join.similar(sets, i[k : k + 1], j[k : k + 1], 0.5)[0]) for k in range(60)] == want[:60]


@pytest.mark.parametrize("kind", ["long", "binary"])
def test_components(spark, kind):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 330)]
    root = {x: x for e in edges for x in e}
    for a, b in edges:
        low, high = sorted((root[a], root[b]))
        root = {d: low if r == high else r for d, r in root.items()}
    made = (lambda x: x) if kind == "long" else (lambda x: bytearray(x.to_bytes(3, "big")))
    back = (lambda x: x) if kind == "long" else (lambda x: int.from_bytes(x, "big"))
    got = {back(r.node): back(r.root) for r in components.components(spark.createDataFrame([tuple(map(made, e)) for e in edges], f"a {kind}, b {kind}")).collect()}
    assert {d: got.get(d, d) for d in root} == root


def test_words_of_special_tokens_and_other_scripts():
    from tokenizers import Tokenizer

    tokenizer, words = Tokenizer.from_file(packing.vocabulary()), packing.Words(packing.vocabulary())
    rng, parts = random.Random(1), ["<|startoftext|>", "<|endoftext|>", "a", "Foo", " ", "\n", "<|", "|>", "é", "!", "x1", "<|ENDOFTEXT|>", "</w>", "\x1c", "\xa0", "\u3000", "İ", "ß", "Σ", "don't", "漢字"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(texts)] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert 49407 in np.frombuffer(words.encode(["<|endoftext|>"])[0], "<u4")


def test_patterns_hold_every_length():
    rng = random.Random(2)
    histogram = {rng.randrange(1, 2048): rng.randrange(1, 500) for _ in range(300)}
    found = packing.patterns(histogram)
    held = {}
    for count, lengths in found:
        assert sum(lengths) <= 2048
        for x in lengths:
            held[x] = held.get(x, 0) + count
    assert held == histogram


def test_equal_pieces_are_told_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(None, "same words")] * 300 + [(1, None)] * 20, "doc_id long, text string").repartition(3)
    for slots in (packing.SLOTS, 0):
        monkeypatch.setattr(packing, "SLOTS", slots)
        got = packing.pack_documents(docs).collect()
        assert len(got) == 320 and len({(r.sequence_id, r.offset) for r in got}) == 320


def test_mix_rows_follow_the_budget(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    keyed = mixing.keyed(docs, docs.columns)
    mixed = mixing.mix(keyed).cache()
    taken = {r.source: r for r in mixed.groupBy("source").agg(F.sum("mix_taken").alias("t"), F.first("mix_target").alias("g")).collect()}
    assert all(abs(r.t - r.g) <= 0.5 for r in taken.values())
    rows = mixing.take(keyed, mixed)
    assert rows.agg(F.sum("mix_words")).first()[0] == sum(r.t for r in taken.values())
    assert rows.where(mixing.word_count(F.col("text")) != F.col("mix_words")).count() == 0


def test_mix_of_equal_rows(spark):
    docs = spark.createDataFrame([(None, "a b c", "s")] * 200 + [(1, "d", None)] * 7, "doc_id long, text string, source string").repartition(3)
    keyed = mixing.keyed(docs, docs.columns)
    rows = mixing.mix(keyed).collect()
    assert sorted(r.mix_taken for r in rows if r.source == "s") == sorted(r.mix_taken for r in mixing.mix(keyed).collect() if r.source == "s")
    assert len(rows) == 207 and all(0 <= r.mix_taken <= 2 * r.mix_size for r in rows)
    assert mixing.take(keyed, mixing.mix(keyed)).agg(F.sum("mix_words")).first()[0] == sum(r.mix_taken for r in rows)


def test_shared_folder_and_discard(spark, monkeypatch):
    t = common.written(spark.range(3), "some")
    assert t.count() == 3 and common.exists(spark, t.shared_path)
    common.discard(t)
    assert not common.exists(spark, t.shared_path)

    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_new_parts_are_merged_at_once(monkeypatch):
    """Ids of texts of all Latin characters, special tokens and other scripts equal the tokenizer's, in batches, in runs of a long
    text and while memories forget; the model is asked for no part of up to 63 bytes."""
    from tokenizers import Tokenizer

    rng = random.Random(12)
    chars = [chr(c) for c in range(1, 0x180)] + list("'''sstrvemld dd  aeioun") * 20
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(120))) for _ in range(400)]
    texts += ["", " ", "x" * 63, "\0" * 64 + "\x7f" * 200, "y" * 64 + " " + "é" * 32, "It's <|endoftext|> <|ENDOFTEXT|>", "İ ſ ŉ ǅ Ⱥ – 漢字 don't", " ".join(texts)]
    tokenizer, words = Tokenizer.from_file(packing.vocabulary()), packing.Words(packing.vocabulary())
    monkeypatch.setattr(packing, "RUN", 500)
    monkeypatch.setattr(packing, "CHARS", 3000)
    words.parts.most = 20_000
    want = [packing._ids_bytes([*tokenizer.encode(t, add_special_tokens=False).ids, packing.END]) for t in texts]
    assert words.encode(texts) == want and words.encode(texts[::-1]) == want[::-1] and words.parts.held < 200_000
    asked, words = [], packing.Words(packing.vocabulary())
    words.parts.make = asked.append
    short = [t[:30].replace("İ", "i") for t in texts[:403]]
    assert words.encode(short) == [packing._ids_bytes([*tokenizer.encode(t, add_special_tokens=False).ids, packing.END]) for t in short] and not asked


def test_parts_are_looked_up_in_arrays(monkeypatch):
    """A memory of a megabyte holds 16,000 parts, so that a second pass merges none, and forgets beyond that; of a text with
    one other character the tokenizer is asked for that word alone; texts of a batch and runs of a long text stay apart."""
    from tokenizers import Tokenizer

    tokenizer, words = Tokenizer.from_file(packing.vocabulary()), packing.Words(packing.vocabulary())
    want = lambda texts: [packing._ids_bytes([*tokenizer.encode(t, add_special_tokens=False).ids, packing.END]) for t in texts]
    rng, asked, merged = random.Random(13), [], packing.Merges.ids
    monkeypatch.setattr(packing.Merges, "ids", lambda self, *a: asked.append(1) or merged(self, *a))
    words.parts.most = 1 << 20
    texts = [" ".join("".join(rng.choice("abdeilmnorst") for _ in range(6)) for _ in range(1000)) for _ in range(16)]
    first = [words.encode([t])[0] for t in texts]
    assert first == want(texts) and asked
    asked.clear()
    assert [words.encode([t])[0] for t in texts] == first and not asked
    words.parts.most = 1 << 18
    assert [words.encode([t])[0] for t in texts[::-1]] == first[::-1] and words.parts.held <= 1 << 18

    make = words.words.make
    words.words.make = lambda word: asked.append(word) or make(word)
    asked.clear()
    mixed = texts[0] + " “漢字’s " + texts[1]
    assert words.encode([mixed]) == want([mixed]) and asked == ["“漢字’s".encode()]

    small = ["'", "s", "re", "ve", "ll", "l", "r", "e", "d", " ", "a", "1", "½", "É", ".", "’", "İ", "\xa0", "\u0301", "<|endoftext|>", "<|"]
    odd = ["".join(rng.choice(small) for _ in range(rng.randrange(9))) for _ in range(5000)] + ["", "'", "s", "<|endof", "text|>"]
    assert words.encode(odd) == want(odd) and words.encode([""]) == want([""]) and words.encode([]) == []
    monkeypatch.setattr(packing, "CHARS", 300)
    monkeypatch.setattr(packing, "CELLS", 512)
    assert words.encode([*odd, " ".join(odd)]) == want([*odd, " ".join(odd)])
    with pytest.raises(UnicodeDecodeError):
        list(words.column(pa.array([b"ab \xc3 c"])))
