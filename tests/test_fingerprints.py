import importlib.util
import random
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sqlcheck import rows_of_frame, rows_of_sql

from shinglery.functions.murmur import murmur3_32, murmur3_windows, native_hash, seed_literal, u32
from shinglery.operators import buckets, partial, shingles, signature
from shinglery.plans.params import MinHashParams
from shinglery.plans.pipeline import minhash_pipeline
from shinglery.plans.queries import QUERIES, oracle
from shinglery.sources import corpus, synthetic
from shinglery.streaming.pipeline import stream_buckets

SF = "/root/testdata/sf0.001"
P = MinHashParams.canonical()


def test_vectors():
    assert murmur3_32(b"Hello, world!", 0x9747B28C) == 0x24884CBA
    assert murmur3_32(b"The quick brown fox jumps over the lazy dog", 0x9747B28C) == 0x2FA826CD
    assert [murmur3_32(b"", 0), murmur3_32(b"", 1), murmur3_32(b"abc", 0)] == [0, 1364076727, 3017643002]
    grams = murmur3_windows(np.frombuffer(b"Hello, world!", np.uint8), 4, 0x9747B28C)
    assert grams.tolist() == [3424803198, 1625100865, 1113189786, 1766920201, 4081722695, 679887730, 3842369833, 1983662204, 3286158315, 2917459206]
    assert [seed_literal(1), seed_literal(0x9747B28C)] == [-1910889132, 1699719390]


@given(st.binary(max_size=40), st.integers(1, 9), st.integers(0, 2**32 - 1))
@settings(max_examples=60, deadline=None)
def test_windows_equal_scalar(data, k, seed):
    got = murmur3_windows(np.frombuffer(data, np.uint8), k, seed).tolist()
    assert got == [murmur3_32(data[i : i + k], seed) for i in range(len(data) - k + 1)]


def test_native_hash(spark):
    words = [bytearray(random.Random(i).randbytes(4 * (i % 5))) for i in range(40)]
    got = spark.createDataFrame([(w,) for w in words], "b binary").select("b", u32(native_hash(__import__("pyspark.sql.functions").sql.functions.col("b"), 7)).alias("h")).collect()
    assert all(r.h == murmur3_32(bytes(r.b), 7) for r in got)


def test_goldens_and_equal_documents(spark):
    docs = corpus.in_memory(spark, b"hello" * 4, [5, 10, 15, 20])
    sig = signature.signature(docs, P).collect()
    assert all(r.sig[:8] == [3205353008, 1708612446, 3051388719, 2168467189, 907679822, 4183794054, 26821588, 17147628] for r in sig)
    assert all(r.sig[-2:] == [991778362, 953043535] and sum(r.sig) == 172073271073 for r in sig)
    got = {}
    for r in minhash_pipeline(docs, P).collect():
        got.setdefault(r.doc_id, {})[r.lane] = r.bucket
    assert len(got) == 4 and len({tuple(sorted(x.items())) for x in got.values()}) == 1
    assert [got[0][i] for i in (0, 1, 2, 3, 63)] == [2237701599, 2420324450, 3115614174, 3292967098, 2638199825]
    assert sum(got[0].values()) == 156001681644
    assert buckets.lane_matrix(minhash_pipeline(docs, P), 4).where("tile = 0 AND d0 = d3").count() == 64
    wide = buckets.lane_matrix(minhash_pipeline(docs, P), 3)
    assert wide.count() == 128 and wide.where("tile = 1 AND d0 IS NOT NULL AND d1 IS NULL").count() == 64


def test_short_empty_null(spark):
    df = spark.createDataFrame([(1, ""), (2, "abc"), (3, None), (None, "abcd")], "doc_id long, text string")
    merged = lambda df, p: partial.merged(partial.partial_signatures(partial.segments(df, p, 3), p))
    for route in (signature.signature, merged, lambda df, p: partial.split_signature(df, p, 2)):
        got = {r.doc_id: r.sig for r in route(df, P).collect()}
        assert set(got) == {1, 2, None} and set(got[1]) == set(got[2]) == {2**32 - 1} and got[None] != got[1]
    assert {r.bucket for r in minhash_pipeline(df.where("doc_id = 1"), P).collect()} == {2540302534}
    assert shingles.shingle_count(df.where("false"), 4).count() == minhash_pipeline(df.where("false"), P).count() == 0


def test_routes_agree_and_order_is_ignored(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aéß漢 b") for _ in range(rng.randrange(0, 300))) for _ in range(30)] + ["xyz " * 30000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a = {r.doc_id: r.sig for r in signature.signature(df, P).collect()}
    b = {r.doc_id: r.sig for r in signature.signature_from_hashes(shingles.shingle_hashes(df, P), P).collect()}
    assert a == b
    for size in (1 << 20, 1000, 7):
        cut = df.where("doc_id < 30") if size == 7 else df
        assert {r.doc_id: r.sig for r in partial.split_signature(cut.repartition(7), P, size).collect()} == {k: v for k, v in a.items() if size > 7 or k < 30}
    by_lane = {(r.doc_id, r.fn): r.minhash for r in signature.signature_rows(df, P).collect()}
    assert by_lane == {(d, i): x for d, sig in a.items() for i, x in enumerate(sig)}
    assert sorted(buckets.lane_buckets(signature.signature(df, P), P).collect()) == sorted(minhash_pipeline(df, P).collect())
    for k in (3, 5):
        p = MinHashParams(k=k)
        for r in shingles.shingle_hashes(df, p).collect():
            data = texts[r.doc_id].encode()[:50]
            assert [x & 0xFFFFFFFF for x in r.hs[: len(data) - k + 1]] == [murmur3_32(data[i : i + k], 1) for i in range(len(data) - k + 1)]


def test_lane_widths(spark):
    df = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    sig = signature.signature(df, P).first().sig
    for lanes in (128, 64, 32):
        p = MinHashParams.canonical(lanes=lanes)
        got = {r.lane: r.bucket for r in minhash_pipeline(df, p).collect()}
        raw = np.array(sig, np.uint32).tobytes()
        width = 4 * p.rows
        assert got == {i: murmur3_32(raw[i * width : (i + 1) * width], 1) for i in range(lanes)}


def test_whole_hash(spark):
    rng = random.Random(1)
    rows = [(i, bytearray(rng.randbytes(i % 37))) for i in range(200)] + [(200, bytearray(b"Hello, world!")), (201, None), (202, bytearray(70_001))]
    for seed in (0, 1, 0x9747B28C, 2**32 - 1):
        got = {r.doc_id: r.h for r in shingles.whole_hash(spark.createDataFrame(rows, "doc_id long, text binary"), seed).collect()}
        assert got == {i: murmur3_32(bytes(b), seed) for i, b in rows if b is not None}
    assert "MapInArrow" not in shingles.whole_hash(spark.createDataFrame(rows, "doc_id long, text binary"), 1)._jdf.queryExecution().toString()


def test_lane_rows(spark):
    docs = corpus.in_memory(spark, b"hello" * 4, [5, 10, 15, 20])
    found = minhash_pipeline(docs, P)
    rows = buckets.lane_rows(found, [0, 3, 9]).collect()
    assert len(rows) == 64 and rows[0].__fields__ == ["lane", "0", "3", "9"] and all(r["0"] == r["3"] and r["9"] is None for r in rows)
    with pytest.raises(ValueError):
        buckets.lane_rows(found, list(range(5)), most=4)


def test_default_family_is_seeded():
    assert MinHashParams() == MinHashParams.seeded() != P and all(x % 2 for x in MinHashParams().a)
    assert len(P.a) == 128 and sum(P.a) == 292279965056 and sum(P.b) == 270235163141


def test_params(tmp_path):
    f = tmp_path / "family"
    f.write_text("3 4\n5, 6\n")
    assert MinHashParams.from_file(str(f), lanes=1).a == (3, 5)
    assert MinHashParams.seeded(8, 1, lanes=4) == MinHashParams.seeded(8, 1, lanes=4)
    assert all(x % 2 for x in MinHashParams.seeded(8, lanes=4).a)
    for bad in ({"k": 0}, {"lanes": 60}, {"seed": -1}, {"a": (1,)}):
        with pytest.raises(ValueError):
            MinHashParams(**bad)
    assert corpus.unpack(*corpus.pack([b"ab", b"", b"c"])) == [(0, b"ab"), (1, b""), (2, b"c")]
    with pytest.raises(ValueError):
        corpus.unpack(b"ab", [3])


def test_synthetic(spark):
    assert [r.byte for r in synthetic.synthetic_text(spark, 8).orderBy("i").collect()] == [0, 2, 6, 12, 20, 30, 42, 56]
    assert synthetic.synthetic_hash_arrays(spark, 6).where("doc_id = 5").first().hs == [(5 * 197 + i) % 1024 for i in range(197)]
    doc = bytes(synthetic.synthetic_documents(spark, 3).where("doc_id = 2").first().text)
    assert doc == bytes((i * i + i) % 256 for i in range(400, 600))


def test_stream(spark, tmp_path):
    src = spark.read.parquet(f"{SF}/documents.parquet")
    src.write.parquet(str(tmp_path / "in"))
    schema = "doc_id long, text string"
    stream_buckets(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"), P).awaitTermination()
    want = rows_of_frame(minhash_pipeline(src, P))
    assert rows_of_frame(spark.read.parquet(str(tmp_path / "out"))) == want
    stream_buckets(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"), P).awaitTermination()
    assert rows_of_frame(spark.read.parquet(str(tmp_path / "out"))) == want  # nothing twice


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_sql(spark, name):
    assert rows_of_frame(QUERIES[name](spark, SF)) == rows_of_sql(oracle()[name], SF)


def test_entry_without_the_subpackage(monkeypatch):
    import __spark_entry__ as entry

    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *rest: None if name == "shinglery.llm" else find(name, *rest))
    assert entry.queries() == QUERIES and entry.oracle_sql() == oracle()
    if find("shinglery.llm"):
        monkeypatch.setattr(importlib.util, "find_spec", find)
        assert {"pipeline", "op1_license_scan"} < set(entry.queries()) and "op5_mix_sources" in entry.oracle_sql()
        monkeypatch.setitem(sys.modules, "shinglery.llm.registry", None)
        with pytest.raises(ImportError):
            entry.queries()


def test_shingle_totals_of_repeated_keys(spark):
    """Repeated rows, differing texts of a key and of no key, texts too short for a window; no window moves if keys are unique."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcé漢 ") for _ in range(rng.randrange(400))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (4, texts[9]), (5, "abc"), (None, texts[0]), (None, texts[1]), (90, "abcd"), (91, None), (92, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = {}
    for key, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - 4):
            want.setdefault(key, []).append(murmur3_32(data[i : i + 5], 1))
    found = shingles.shingle_totals(docs, MinHashParams(k=5))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((k, sum(h), len(set(h))) for k, h in want.items()), key=repr)


def test_k5_moves_a_row_for_each_document(spark):
    """The plan has no aggregate by document and hash over the whole table; only texts of keys that differ get there."""
    plan = QUERIES["shingle_hash_k5"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    hashed = [x for x in plan.splitlines() if "Aggregate [doc_id" in x and ", h#" in x.split("],")[0]]
    assert all("LeftSemi" in plan[plan.index(x) :] for x in hashed) and "max(distinct_h" in plan
