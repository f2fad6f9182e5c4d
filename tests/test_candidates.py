"""Split documents, joins of buckets, similarities, and packed corpora."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from shinglery.functions.murmur import murmur3_windows
from shinglery.operators import candidates, partial, signature, skew
from shinglery.plans.params import MinHashParams
from shinglery.plans.pipeline import minhash_pipeline
from shinglery.plans.queries import QUERIES
from shinglery.sources import lanes, packed
from shinglery.sources.tables import written

P = MinHashParams.canonical()


def test_one_long_document_is_the_work_of_many_tasks(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("aéß漢 b") for _ in range(30_000)) * 200
    df = spark.createDataFrame([(1, long), (1, long), (2, "short text"), (3, None), (None, long[:-5])], "doc_id long, text string")
    want = Counter((r.doc_id, tuple(r.sig)) for r in signature.signature(df, P).collect())
    assert Counter((r.doc_id, tuple(r.sig)) for r in partial.split_signature(df, P).collect()) == want and sum(want.values()) == 4
    cut = partial.segments(df, P).repartition("id.digest", "part")
    busy = cut.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(x > 0 for x in busy) >= 3 and sum(busy) == 3 * -(-(len(long.encode()) - 3) // (1 << 20)) + 1


@pytest.fixture(scope="module")
def hot(spark):
    """Half of the rows in one bucket, others in pairs or alone, a repeated row, nulls and a document without shingles."""
    rows = [(i, 0, 7) for i in range(4000)] + [(i, 1, i // 2) for i in range(3000)] + [(i, 2, i) for i in range(999)] + [(5, 0, 7), (None, 0, 7), (3, None, 7), (9, 3, 2540302534), (8, 3, 2540302534)]
    return written(spark.createDataFrame(rows, "doc_id long, lane long, bucket long"), "hot")


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        if r.lane is not None and r.bucket != 2540302534:
            by[r.lane, r.bucket].append(r.doc_id)
    full = {k: (min(x for x in v if x is not None), len(v)) for k, v in by.items() if len(v) > 1}
    return full, Counter((d, *k, *full[k]) for k, v in by.items() if k in full for d in v)


@pytest.mark.parametrize("share", [skew.SHARE, 20, 1])
def test_banded_join(spark, hot, share):
    full, want = expected(hot.collect())
    assert {(r.lane, r.bucket): (r.first_id, r.members) for r in candidates.bucket_classes(hot, P).collect()} == full
    joined = candidates.banded_join(hot, P, share=share)
    assert Counter(map(tuple, joined.collect())) == want
    pairs = Counter((r.first_id, r.doc_id, r.lanes) for r in candidates.candidate_pairs(joined).where("doc_id < 10").collect())
    assert pairs[(0, 1, 2)] == 1 and pairs[(0, 2, 1)] == 1 and pairs[(2, 3, 1)] == 1 and pairs[(0, 5, 1)] == 1


def test_a_hot_bucket_is_spread(spark, hot):
    """With shares of a twentieth the bucket of half of the rows is cut into ten pieces, which tasks share."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        joined = candidates.banded_join(hot, P, share=20).where("lane = 0")
        loads = [n for n in joined.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(loads) == 4002 and len(loads) >= 5 and max(loads) < 0.5 * sum(loads)


def test_split_join_of_odd_keys(spark):
    many = spark.createDataFrame([(None, 1), (1, 1), (1, 2), (2, None), (3, 3)], "k int, v int")
    one = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (4, "d")], "k int, x string")
    for share in (1, 2, 1000):
        assert sorted(map(tuple, skew.split_join(many, one, ["k"], "v", share).collect()), key=repr) == [(1, 1, "a"), (1, 2, "a"), (2, None, "b")]
    assert skew.split_join(many.where("false"), one, ["k"], "v").count() == 0


def test_similarity_is_near_jaccard(spark):
    """Over pairs of known similarity the estimate's error is that of 128 draws, and 95 % intervals hold most truths. The
    seeded family is used: its multipliers are odd."""
    params, rng = MinHashParams(), random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    docs, truth = [], {}
    for i in range(120):
        a = [word() for _ in range(80)]
        b = [w if rng.random() > i / 150 else word() for w in a]
        docs += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        x, y = ({*murmur3_windows(np.frombuffer(t.encode(), np.uint8), params.k, params.seed).tolist()} for _, t in docs[-2:])
        truth[2 * i] = len(x & y) / len(x | y)
    df = written(spark.createDataFrame([*docs, (900, "x")], "doc_id long, text string"), "docs")
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1, "kept") for i in range(120)] + [(0, 0, "own"), (0, 77_777, "none"), (None, 1, "null"), (900, 900, "short")], "a long, b long, note string")
    signatures = written(signature.signature(df, params), "signatures")
    rows = candidates.similarity(pairs, signatures, "a", "b", share=30).collect()
    assert Counter(r.note for r in rows) == {"kept": 120, "own": 1, "short": 1}
    assert all(r.similarity == 1.0 and r.high <= 1.0 + 1e-9 for r in rows if r.note != "kept")
    rows = [r for r in rows if r.note == "kept"]
    errors = np.array([r.similarity - truth[r.a] for r in rows])
    assert all(r.agree == round(r.similarity * 128) for r in rows)
    assert abs(errors.mean()) < 0.02 and np.sqrt((errors**2).mean()) < 0.05
    assert np.mean([r.low <= truth[r.a] <= r.high for r in rows]) > 0.88


@pytest.mark.parametrize("held", [0, 3, 6, 100])
def test_similarity_of_held_and_joined_signatures(spark, held):
    """Whether all, some or no signatures are held, the rows are those of the plain comparison; of a repeated key each row counts."""
    rng = random.Random(8)
    sigs = [(i % 11, [rng.randrange(3) for _ in range(128)]) for i in range(13)]
    pairs = [(i * i % 7 if i % 5 else None, i, f"p{i}") for i in range(40)] + [(50, 1, "none"), (0, 0, "own")]
    want = Counter((a, b, n, sum(p == q for p, q in zip(x, y, strict=True))) for a, b, n in pairs for i, x in sigs for j, y in sigs if i == a and j == b)
    df = written(spark.createDataFrame(sigs, "doc_id long, sig array<long>"), "signatures")
    listed = written(spark.createDataFrame(pairs, "a long, b long, note string"), "pairs")
    for own in (df, written(candidates.packed_signatures(df), "packed")):
        got = candidates.similarity(listed, own, "a", "b", share=5, held=held).collect()
        assert Counter((r.a, r.b, r.note, r.agree) for r in got) == want and len(want) > 8


def test_signatures_of_frequent_firsts_do_not_move(spark):
    """The registered query's plan joins one signature to each pair, not two, and counts lanes in one shuffle."""
    plan = QUERIES["signature_similarity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "sig_b" in plan and "sig_a" not in plan


def test_packed_round_trip(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice(["", "é", "a b", "漢字 " * rng.randrange(50)])) for i in range(500)] + [(7, "again"), (-1, "x" * 100_000), (None, "no id"), (3, None)]
    want = Counter((i, t.encode()) for i, t in rows if i is not None and t is not None)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, parts, size in (("one", 1, 8000), ("some", 3, 5000), ("default", 3, packed.RANGE)):
        path = str(tmp_path / name)
        packed.write_packed(df.repartition(parts), path)
        back = packed.read_packed(spark, path, range_bytes=size)
        assert Counter((r.doc_id, bytes(r.text)) for r in back.collect()) == want
        assert back.rdd.getNumPartitions() >= (15 if name != "default" else 1)
        assert Counter((r.doc_id, r.size) for r in packed.read_packed(spark, path, "size long, doc_id long").collect()) == Counter((i, len(t)) for i, t in want.elements())
    got = sorted(minhash_pipeline(back, P).collect())
    assert got == sorted(minhash_pipeline(df.where("doc_id IS NOT NULL"), P).collect())


def test_packed_reads_only_what_the_schema_names(spark, tmp_path):
    packed.write_packed(spark.createDataFrame([(1, "a"), (2, "bc")], "doc_id long, text string"), str(tmp_path))
    for f in tmp_path.glob("*.buffer"):
        f.unlink()
    assert sorted(r.doc_id for r in packed.read_packed(spark, str(tmp_path), "doc_id long").collect()) == [1, 2]
    with pytest.raises(Exception, match="no such columns"):
        packed.read_packed(spark, str(tmp_path), "lang string").collect()
    (tmp_path / "left.buffer").write_bytes(b"of a failed attempt")
    assert packed.read_packed(spark, str(tmp_path), "size long").count() == 2


def test_packed_empty(spark, tmp_path):
    packed.write_packed(spark.createDataFrame([(None, "a"), (1, None)], "doc_id long, text string"), str(tmp_path / "none"))
    assert packed.read_packed(spark, str(tmp_path / "none")).count() == 0
    packed.write_packed(spark.createDataFrame([(1, ""), (2, "")], "doc_id long, text string"), str(tmp_path / "empty"))
    assert sorted((r.doc_id, bytes(r.text)) for r in packed.read_packed(spark, str(tmp_path / "empty")).collect()) == [(1, b""), (2, b"")]


def test_lane_store(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, lane, rng.randrange(1 << 32)) for i in range(-50, 150) for lane in range(9)] + [(7, 3, 5), (None, 3, 5), (8, None, 5), (8, 3, None)]
    want = sorted(r for r in rows if None not in r)
    df = spark.createDataFrame(rows, "doc_id long, lane long, bucket long").repartition(3)
    path = str(tmp_path / "store")
    lanes.write_lanes(df, path)
    read = lambda **options: sorted(map(tuple, lanes.read_lanes(spark, path, **options).collect()))
    assert read() == want
    assert read(lanes=(2, 4)) == [r for r in want if 2 <= r[1] <= 4]
    assert read(lanes=(3, 3), ids=(0, 9)) == [r for r in want if r[1] == 3 and 0 <= r[0] <= 9]
    assert read(lanes=(20, 30)) == []
    assert sorted(lanes.read_lanes(spark, path, columns="bucket long").collect()) == sorted((r[2],) for r in want)
    whole, some = lanes.read_lanes(spark, path, task_rows=100), lanes.read_lanes(spark, path, lanes=(2, 4), task_rows=100)
    assert some.rdd.getNumPartitions() < 0.6 * whole.rdd.getNumPartitions()  # blocks of other lanes are not read
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = spark.read.format("lanes").option("push", "true").option("task_rows", 100).load(path).where("lane = 5 AND doc_id >= 100")
        assert sorted(map(tuple, pushed.collect())) == [r for r in want if r[1] == 5 and r[0] >= 100]
        assert pushed.rdd.getNumPartitions() < 0.3 * whole.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_lane_blocks_are_cut(tmp_path, monkeypatch):
    monkeypatch.setattr(lanes, "BLOCK", 4)
    batch = pa.record_batch({"lane": [1] * 9 + [2] * 3, "doc_id": list(range(12)), "bucket": [9] * 12})
    writer = lanes.Writer(str(tmp_path))
    writer.commit([writer.write(iter([batch.slice(0, 6), batch.slice(6)])), None])
    reader = lanes.Reader(str(tmp_path), ["doc_id", "lane"], {"lane": (0, 9), "doc_id": (0, 99)})
    parts = reader.partitions()
    assert [b[1:4] for p in parts for b in p.blocks] == [[1, 0, 4], [1, 48, 4], [1, 96, 1], [2, 108, 3]]
    assert [r for p in parts for x in reader.read(p) for r in x.column(0).to_pylist()] == list(range(12))
    writer.abort([writer.write(iter([batch]))])
    assert len([*tmp_path.glob("*.lanes")]) == 1
