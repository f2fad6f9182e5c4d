"""Classes of streams against those of tables, and the SQL surface."""

import datetime
import random
from collections import Counter

import pytest

from shinglery.functions import table
from shinglery.plans.params import MinHashParams
from shinglery.plans.pipeline import minhash_pipeline
from shinglery.streaming import classes

P = MinHashParams.seeded(8, lanes=4)
START = datetime.datetime(2024, 1, 1)
SCHEMA = "doc_id long, text string, at timestamp"
TEXTS = ["the first text", "another one here", "a third text, longer than others", "the first text!", "漢字 and more", ""]


def rows(n, seed):
    rng = random.Random(seed)
    made = [(i, rng.choice(TEXTS), START + datetime.timedelta(seconds=20 * i + rng.randrange(15))) for i in range(n)]
    return made + [(n, None, START), (n + 1, TEXTS[0], None)]


def run(spark, folder, out, name):
    classes.stream_classes(spark, str(folder), SCHEMA, str(out), f"{out}-{name}", "100 seconds", "60 seconds", P, files=1).awaitTermination()
    return Counter(map(tuple, spark.read.schema(classes.CLASS).parquet(str(out)).collect()))


def by_walking(spark, made):
    out = Counter()
    alive = {}
    df = spark.createDataFrame([r for r in made if r[2] is not None], SCHEMA)
    at = {r[0]: r[2] for r in made}
    for r in sorted(classes.timed_buckets(df, P).collect(), key=lambda r: (r.at, r.doc_id)):
        key = (r.lane, r.bucket)
        if key in alive and at[r.doc_id] <= alive[key][3]:
            first, n, begins, _ = alive[key]
            alive[key] = (first, n + 1, begins, at[r.doc_id] + datetime.timedelta(seconds=100))
        else:
            if key in alive:
                out[(*key, *alive[key])] += 1
            alive[key] = (r.doc_id, 1, at[r.doc_id], at[r.doc_id] + datetime.timedelta(seconds=100))
    for key, x in alive.items():
        out[(*key, *x)] += 1
    return out


@pytest.mark.parametrize("mixed", [False, True])
def test_stream_equals_table_in_any_order_of_files(spark, tmp_path, mixed):
    made = rows(40, 1)
    # a mixed file holds each other's rows of its neighbour, no further apart than the delay allows
    slices = [made[10 * i : 10 * i + 10] if i < 3 else made[30:] for i in range(4)]
    if mixed:
        for a, b in ((0, 1), (1, 2), (2, 3)):
            slices[a], slices[b] = slices[a][:-1] + slices[b][:1], slices[a][-1:] + slices[b][1:]
    last = [(999, "the end of it", START + datetime.timedelta(days=1))]
    for part in [*slices, last]:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = by_walking(spark, made)
    first = run(spark, tmp_path / "in", tmp_path / "out", "state")
    assert first == want
    batch = classes.session_classes(classes.timed_buckets(spark.createDataFrame(made, SCHEMA), P), "100 seconds")
    assert Counter(map(tuple, batch.collect())) == want
    assert run(spark, tmp_path / "in", tmp_path / "out", "state") == want  # a restart repeats nothing
    more = [(2000, TEXTS[0], START + datetime.timedelta(days=2)), (2001, TEXTS[0], START + datetime.timedelta(days=3))]
    spark.createDataFrame(more, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    later = run(spark, tmp_path / "in", tmp_path / "out", "state")
    assert later == by_walking(spark, [*made, *last, more[0]])


def test_novelty(spark):
    made = rows(40, 2)
    df = spark.createDataFrame(made, SCHEMA)
    found = classes.session_classes(classes.timed_buckets(df, P), "100 seconds")
    got = {r.doc_id: (r.leads, r.seen) for r in classes.novelty(df, found, P).collect()}
    led = Counter(x[2] for x in by_walking(spark, made))
    assert got == {r[0]: (led[r[0]], led[r[0]] < P.lanes) for r in made}
    assert {seen for _, seen in got.values()} == {True, False}


def test_table_function(spark):
    table.register(spark)
    rows_ = [(1, "some words here"), (2, ""), (3, None), (4, "漢字"), (1, "some words here")]
    spark.createDataFrame(rows_, "doc_id long, text string").createOrReplaceTempView("texts")
    canonical, seeded = MinHashParams.canonical(k=5, seed=3, lanes=32), MinHashParams.seeded(8, 7, lanes=4)
    for params, family in ((canonical, "CAST(NULL AS INT)"), (seeded, "7")):
        sql = f"SELECT t.doc_id, b.lane, b.bucket FROM texts t, LATERAL minhash_buckets(t.text, {params.k}, {params.seed}, {params.lanes}, {params.functions}, {family}) b"
        assert Counter(spark.sql(sql).collect()) == Counter(minhash_pipeline(spark.table("texts"), params).collect())
    one = spark.sql("SELECT count(DISTINCT bucket) AS n FROM minhash_buckets(X'00010203', 4, 1, 64, 128, CAST(NULL AS INT))").first().n
    assert one > 60
