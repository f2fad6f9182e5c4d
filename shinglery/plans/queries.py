"""Registered queries over the documents table, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shinglery.functions.murmur import C1, C2, FINAL_1, FINAL_2, STEP_ADD, STEP_MUL
from shinglery.functions.table import register
from shinglery.operators import buckets, candidates, partial, shingles, signature
from shinglery.plans.params import MinHashParams
from shinglery.plans.pipeline import minhash_pipeline
from shinglery.sources.corpus import read_documents
from shinglery.sources.lanes import read_lanes, write_lanes
from shinglery.sources.packed import read_packed, write_packed
from shinglery.sources.tables import shared_path, written
from shinglery.streaming.classes import CLASS, novelty, session_classes, stream_classes, timed_buckets

P = MinHashParams.canonical()
#: Documents side by side in a tile of the lane matrix.
TILE = 8
WHOLE_SEED = 0x9747B28C
ONE_ROW, WIDE = MinHashParams.canonical(lanes=128), MinHashParams.canonical(lanes=32)
TWO32 = 1 << 32


#: Windows of a segment, small enough that many documents of any table have several.
SEGMENT = 1 << 11


def _signature_hashes(spark, d):
    hs = shingles.shingle_hashes(read_documents(spark, d), P)
    return signature.signature_long(signature.signature_from_hashes(hs, P))


def _merged(spark, d):
    cut = partial.segments(read_documents(spark, d), P, SEGMENT)
    return signature.signature_long(partial.merged(partial.partial_signatures(cut, P)))


def _classes(spark, d):
    return candidates.bucket_classes(minhash_pipeline(read_documents(spark, d), P), P)


def _joined(spark, d):
    return candidates.banded_join(written(minhash_pipeline(read_documents(spark, d), P), "buckets"), P)


def _similarity(spark, d):
    signatures = written(signature.signature_bytes(read_documents(spark, d), P), "signatures")
    buckets_ = written(buckets.packed_buckets(signatures, P), "buckets")
    pairs = written(candidates.candidate_pairs(candidates.banded_join(buckets_, P)), "pairs")
    return candidates.similarity(pairs, signatures, "first_id", "doc_id")


def _packed(spark, d):
    path = shared_path(spark, "packed")
    write_packed(read_documents(spark, d), path)
    return shingles.whole_hash(read_packed(spark, path, range_bytes=1 << 20), WHOLE_SEED)


#: Lanes that are read back from the store.
LANES = (8, 15)


def _stored(spark, d):
    path = shared_path(spark, "lanes")
    write_lanes(minhash_pipeline(read_documents(spark, d), P), path)
    return read_lanes(spark, path, LANES)


def _by_sql(spark, d):
    """The pipeline as SQL text alone: the table function beside each row of a view."""
    register(spark)
    read_documents(spark, d).createOrReplaceTempView("shinglery_documents")
    return spark.sql(f"SELECT d.doc_id, b.lane, b.bucket FROM shinglery_documents d, LATERAL minhash_buckets(d.text, {P.k}, {P.seed}, {P.lanes}, {P.functions}, CAST(NULL AS INT)) b")


#: A document a minute, by id; a bucket is forgotten after GAP seconds, and files may come DELAY seconds late.
GAP, DELAY = 5430, 600


def _timed(spark, d):
    return read_documents(spark, d).withColumn("at", F.timestamp_seconds(F.col("doc_id") * 60))


def _streamed(spark, d):
    docs, out = shared_path(spark, "timed"), shared_path(spark, "classes")
    _timed(spark, d).write.parquet(docs)
    stream_classes(spark, docs, "doc_id long, text string, at timestamp", out, shared_path(spark, "checkpoint"), f"{GAP} seconds", f"{DELAY} seconds", P).awaitTermination()
    seconds = lambda c: F.unix_seconds(c).alias(c)
    return spark.read.schema(CLASS).parquet(out).select("lane", "bucket", "first_id", "members", seconds("begins"), seconds("ends"))


def _novelty(spark, d):
    classes = session_classes(timed_buckets(_timed(spark, d), P), f"{GAP} seconds")
    return novelty(read_documents(spark, d).where("text IS NOT NULL AND doc_id IS NOT NULL"), classes, P)


QUERIES = {
    "shingle_count": lambda s, d: shingles.shingle_count(read_documents(s, d), P.k),
    "shingle_hash": lambda s, d: shingles.shingle_long(read_documents(s, d), P),
    "shingle_hash_k5": lambda s, d: shingles.shingle_totals(read_documents(s, d), MinHashParams(k=5)),
    "minhash_signature": lambda s, d: signature.signature_rows(read_documents(s, d), P),
    "minhash_from_hashes": _signature_hashes,
    "minhash_native": _merged,
    "minhash_split": lambda s, d: signature.signature_long(partial.split_signature(read_documents(s, d), P, SEGMENT)),
    "lane_buckets": lambda s, d: buckets.lane_buckets(signature.signature(read_documents(s, d), P), P),
    "lane_buckets_one_row": lambda s, d: minhash_pipeline(read_documents(s, d), ONE_ROW),
    "lane_buckets_wide": lambda s, d: minhash_pipeline(read_documents(s, d), WIDE),
    "pipeline_buckets": lambda s, d: minhash_pipeline(read_documents(s, d), P),
    "lane_matrix": lambda s, d: buckets.lane_matrix(minhash_pipeline(read_documents(s, d), P), TILE),
    "murmur3_any_length": lambda s, d: shingles.whole_hash(read_documents(s, d), WHOLE_SEED),
    "bucket_classes": _classes,
    "banded_join": _joined,
    "candidate_pairs": lambda s, d: candidates.candidate_pairs(_joined(s, d)),
    "signature_similarity": _similarity,
    "packed_corpus": _packed,
    "lane_store": _stored,
    "buckets_by_sql": _by_sql,
    "stream_classes": _streamed,
    "document_novelty": _novelty,
}


def _murmur(source: str, words: list[str], tail: str | None, length: str, seed: int, keep: str, into: str) -> str:
    """CTEs for the hash of unsigned 32-bit `words` and a `tail` of the rows of `source`."""
    ctes, at = [], source

    def step(name: str, value: str, columns: str) -> None:
        nonlocal at
        ctes.append(f"{into}_{name} AS (SELECT {keep}, {columns}, {value} FROM {at})")
        at = f"{into}_{name}"

    state = f"{seed}::UBIGINT AS s"
    ins = [f"({w})::UBIGINT AS w{i}" for i, w in enumerate(words + ([tail] if tail else []))]
    step("in", state, ", ".join([*ins, f"({length})::UBIGINT AS n"]))
    names = [f"w{i}" for i in range(len(ins))]
    for i, w in enumerate(names):
        rest = ", ".join([*names[i + 1 :], "n"])
        step(f"a{i}", f"s, (({w} * {C1}) % {TWO32})::UBIGINT AS x", rest)
        step(f"b{i}", f"s, ((((x << 15) | (x >> 17)) % {TWO32}) * {C2} % {TWO32})::UBIGINT AS x", rest)
        step(f"c{i}", "xor(s, x)::UBIGINT AS s", rest)
        if not (tail and i == len(names) - 1):
            step(f"d{i}", f"(((((s << 13) | (s >> 19)) % {TWO32}) * {STEP_MUL} + {STEP_ADD}) % {TWO32})::UBIGINT AS s", rest)
    step("e", "xor(s, n)::UBIGINT AS s", "n")
    step("f", f"(xor(s, s >> 16)::UBIGINT * {FINAL_1} % {TWO32})::UBIGINT AS s", "n")
    step("g", f"(xor(s, s >> 13)::UBIGINT * {FINAL_2} % {TWO32})::UBIGINT AS s", "n")
    ctes.append(f"{into} AS (SELECT {keep}, xor(s, s >> 16)::BIGINT AS h FROM {at})")
    return ",\n".join(ctes)


def _little(hexed: str, width: int) -> str:
    """The little-endian value of `width` bytes given as hexadecimal digits; 0 if it has none."""
    digits = " || ".join(f"substr({hexed}, {2 * i + 1}, 2)" for i in reversed(range(width)))
    return f"('0x0' || {digits})::UBIGINT"


def _windows(k: int) -> str:
    return f"""docs AS (SELECT doc_id, encode(text) AS b FROM documents WHERE text IS NOT NULL),
spots AS (SELECT doc_id, b, unnest(range(octet_length(b) - {k - 1})) AS pos FROM docs WHERE octet_length(b) >= {k}),
wins AS (SELECT doc_id, pos, hex(b[pos + 1:pos + {k}]) AS hx FROM spots)"""


def _shingles(k: int) -> str:
    whole = [_little(f"substr(hx, {8 * i + 1}, 8)", 4) for i in range(k // 4)]
    tail = _little(f"substr(hx, {8 * (k // 4) + 1})", k % 4) if k % 4 else None
    return f"WITH {_windows(k)},\n" + _murmur("wins", whole, tail, str(k), P.seed, "doc_id, pos", "shs")


def _signatures() -> str:
    """CTEs up to `sigs`."""
    a, b = list(P.a), list(P.b)
    return f"""{_shingles(P.k)},
fam AS (SELECT unnest(range({len(a)})) AS fn, unnest({a}::UBIGINT[]) AS a, unnest({b}::UBIGINT[]) AS b),
hs AS (SELECT DISTINCT doc_id, h::UBIGINT AS h FROM shs),
mins AS (SELECT doc_id, fn, min((a * h + b) % {TWO32})::BIGINT AS m FROM hs, fam GROUP BY doc_id, fn),
sigs AS MATERIALIZED (SELECT d.doc_id, f.fn::BIGINT AS fn, coalesce(m, {TWO32 - 1}) AS minhash FROM docs d CROSS JOIN fam f LEFT JOIN mins ON mins.doc_id = d.doc_id AND mins.fn = f.fn)"""


def _buckets(params: MinHashParams = P) -> str:
    rows = range(params.rows)
    words = ", ".join(f"max(CASE WHEN fn % {params.rows} = {i} THEN minhash END) AS r{i}" for i in rows)
    lanes = f"lanes AS (SELECT doc_id, fn // {params.rows} AS lane, {words} FROM sigs GROUP BY doc_id, fn // {params.rows})"
    return f"{_signatures()},\n{lanes},\n" + _murmur("lanes", [f"r{i}" for i in rows], None, str(4 * params.rows), params.seed, "doc_id, lane", "bks")


def _any_length_sql() -> str:
    u = lambda x: f"{x}::UBIGINT"
    rotated = lambda x, r: f"((({x} << {r}) | ({x} >> {32 - r})) % {u(TWO32)})"
    mixed = lambda words: f"list_transform(list_transform({words}, lambda w: (w * {u(C1)}) % {u(TWO32)}), lambda x: ({rotated('x', 15)} * {u(C2)}) % {u(TWO32)})"
    whole = f"list_transform(list_transform(range(n // 4), lambda i: hex(b[4 * i + 1:4 * i + 4])), lambda v: {_little('v', 4)})"
    tail = f"list_transform([rpad(hex(b[n - n % 4 + 1:n]), 8, '0')], lambda v: {_little('v', 4)})"
    step = f"({rotated('xor(h, x)', 13)} * {u(STEP_MUL)} + {u(STEP_ADD)}) % {u(TWO32)}"
    return f"""WITH docs AS (SELECT doc_id, encode(text) AS b, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL),
words AS (SELECT doc_id, n, {mixed(whole)} AS ws, {mixed(tail)}[1] AS t FROM docs),
folded AS (SELECT doc_id, xor(xor(list_reduce(ws, lambda h, x: {step}, {u(WHOLE_SEED)}), t), {u('n')}) AS s FROM words),
one AS (SELECT doc_id, (xor(s, s >> 16) * {u(FINAL_1)}) % {u(TWO32)} AS s FROM folded),
two AS (SELECT doc_id, (xor(s, s >> 13) * {u(FINAL_2)}) % {u(TWO32)} AS s FROM one)
SELECT doc_id, xor(s, s >> 16)::BIGINT AS h FROM two"""


def oracle() -> dict[str, str]:
    sig = _signatures() + "\nSELECT doc_id, fn, minhash FROM sigs"
    found = lambda params: _buckets(params) + "\nSELECT doc_id, lane, h AS bucket FROM bks"
    shown = ", ".join(f"min(CASE WHEN doc_id % {TILE} = {k} THEN h END) AS d{k}" for k in range(TILE))
    classed = f"{_buckets()},\nbuckets AS MATERIALIZED (SELECT doc_id, lane, h AS bucket FROM bks WHERE h <> {buckets.empty_bucket(P)}),\nclasses AS (SELECT lane, bucket, min(doc_id) AS first_id, count(*) AS members FROM buckets GROUP BY lane, bucket HAVING count(*) > 1)"
    joined = classed + "\nSELECT b.doc_id, b.lane, b.bucket, first_id, members FROM buckets b JOIN classes c ON b.lane = c.lane AND b.bucket = c.bucket"
    pairs = "pairs AS (SELECT first_id, b.doc_id, count(DISTINCT b.lane) AS lanes FROM buckets b JOIN classes c ON b.lane = c.lane AND b.bucket = c.bucket WHERE b.doc_id <> first_id GROUP BY first_id, b.doc_id)"
    agreed = "agreed AS (SELECT first_id, p.doc_id, lanes, sum((x.minhash = y.minhash)::INT)::BIGINT AS agree FROM pairs p JOIN sigs x ON x.doc_id = p.first_id JOIN sigs y ON y.doc_id = p.doc_id AND x.fn = y.fn GROUP BY ALL)"
    similar = f"{classed},\n{pairs},\n{agreed}\nSELECT *, {candidates.interval_sql('agree', P.functions)} FROM agreed"
    marked = f"marked AS (SELECT *, CASE WHEN doc_id * 60 - lag(doc_id * 60) OVER w <= {GAP} THEN 0 ELSE 1 END AS new FROM buckets WHERE doc_id IS NOT NULL WINDOW w AS (PARTITION BY lane, bucket ORDER BY doc_id))"
    numbered = "numbered AS (SELECT *, sum(new) OVER (PARTITION BY lane, bucket ORDER BY doc_id) AS part FROM marked)"
    sessions = f"{classed},\n{marked},\n{numbered},\nalive AS (SELECT lane, bucket, min(doc_id) AS first_id, count(*) AS members, min(doc_id) * 60 AS begins, max(doc_id) * 60 + {GAP} AS ends FROM numbered GROUP BY lane, bucket, part)"
    return {
        "shingle_count": f"SELECT doc_id, greatest(octet_length(encode(text)) - {P.k - 1}, 0)::BIGINT AS shingles FROM documents WHERE text IS NOT NULL",
        "shingle_hash": _shingles(P.k) + "\nSELECT doc_id, pos, h FROM shs",
        "shingle_hash_k5": _shingles(5) + "\nSELECT doc_id, sum(h)::BIGINT AS sum_h, count(DISTINCT h) AS distinct_h FROM shs GROUP BY doc_id",
        "minhash_signature": sig,
        "minhash_from_hashes": sig,
        "minhash_native": sig,
        "lane_buckets": found(P),
        "lane_buckets_one_row": found(ONE_ROW),
        "lane_buckets_wide": found(WIDE),
        "pipeline_buckets": found(P),
        "lane_matrix": _buckets() + f"\nSELECT doc_id // {TILE} AS tile, lane, {shown} FROM bks GROUP BY doc_id // {TILE}, lane",
        "murmur3_any_length": _any_length_sql(),
        "minhash_split": sig,
        "bucket_classes": classed + "\nSELECT lane, bucket, first_id, members FROM classes",
        "banded_join": joined,
        "candidate_pairs": f"SELECT first_id, doc_id, count(DISTINCT lane) AS lanes FROM ({joined}) WHERE doc_id <> first_id GROUP BY first_id, doc_id",
        "signature_similarity": similar,
        "packed_corpus": _any_length_sql(),
        "lane_store": found(P) + f" WHERE lane BETWEEN {LANES[0]} AND {LANES[1]}",
        "buckets_by_sql": found(P),
        "stream_classes": f"{sessions}\nSELECT lane, bucket, first_id, members, begins, ends FROM alive WHERE ends <= (SELECT max(doc_id) * 60 - {DELAY} FROM documents)",
        "document_novelty": f"{sessions}\nSELECT doc_id, coalesce(n, 0) AS leads, coalesce(n, 0) < {P.lanes} AS seen FROM docs LEFT JOIN (SELECT first_id, count(*) AS n FROM alive GROUP BY first_id) ON doc_id = first_id WHERE doc_id IS NOT NULL",
    }
