"""Secret scans over an incremental blob ledger: every version is content-addressed, only unseen pairs of
blob and rule version are scanned, and findings join back to all paths.

The rule version is a digest of the rules themselves, so that a changed pattern is a new version. A ledger is a
folder of increments; each run appends what it scanned, and a run over known blobs scans and moves no text.

Defined cases: null text is the empty blob; null or repeated paths are paths like others; equal blobs have
equal findings however many paths hold them; a blob that two increments hold counts once; an empty table gives
no rows; of the input's columns only the path is kept.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shinglery.llm.common import children, discard, exists, map_texts, remove, shared_path, written

# The base kinds, their patterns and least lengths.
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20}
#: The keywords of `assign`, by a lower-case part that each of them holds.
HINTS = ("passw", "secret", "token", "apikey", "api_key")

#: Further kinds: a text that every match holds, as it is or in lower case, and the pattern.
FURTHER = {
    "pem": ("-----BEGIN", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")),
    "jwt": ("eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}")),
    "vcs": ("gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{30,}")),
    "chat": ("xox", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    "cloud": ("AIza", re.compile(r"AIza[A-Za-z0-9_-]{35}")),
    "aws": ("secret_access_key", re.compile(r"""(?ai:secret_access_key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+])""")),
    "key": ("sk-", re.compile(r"(?<![A-Za-z0-9_-])sk-[A-Za-z0-9_-]{20,}")),
    "lab": ("glpat-", re.compile(r"(?<![A-Za-z0-9_-])glpat-[A-Za-z0-9_-]{20,}")),
    "bearer": ("bearer ", re.compile(r"(?<![A-Za-z0-9_-])(?ai:bearer)\x20[A-Za-z0-9._~+/-]{20,}=*")),
    "url": ("://", re.compile(r"[a-z][a-z0-9+.-]{0,31}://[^\s/:@]+:[^\s/:@]+@[A-Za-z0-9.-]+")),
}
KINDS = (*BASE, *FURTHER)
FINDING = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
LEDGER = "blob binary, rules string, findings array<struct<kind: string, start: bigint, end: bigint>>"
#: The most bits of the filter that keeps texts of seen blobs in place (8 MB), and how many bits a blob sets.
BITS, HASHES = 1 << 26, 2
#: Increments of a ledger from which on it is compacted.
MANY = 16


def rules_digest() -> str:
    """The rule version: changes with any pattern, least length or hint."""
    rules = [ASSIGN.pattern, ACCESS.pattern, HEX.pattern, sorted(LEAST.items()), HINTS, [(k, h, p.pattern) for k, (h, p) in FURTHER.items()]]
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


RULES_VERSION = rules_digest()


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    for kind, (hint, pattern) in FURTHER.items():
        if hint in text or hint in low:
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan_blobs(blobs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text by its `findings`."""
    return map_texts(blobs, lambda texts: {"findings": [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in scan(t)] for t in texts]}, {"findings": pa.list_(FINDING)}, text)


def bit_of(i: int, bits: int) -> Column:
    """The i-th bit of a row's digest and place in a Bloom filter."""
    return F.pmod(F.xxhash64(F.lit(i), F.col("blob"), F.col("place")), F.lit(bits))


def perhaps_unseen(addressed: DataFrame, unseen: DataFrame, n: int) -> DataFrame:
    """The rows of `addressed` that a Bloom filter of the n unseen (digest, place) pairs lets pass, inside the JVM: texts
    of seen blobs stay where they are read. The filter has at most BITS bits, whatever n is; the fuller it gets, the
    more seen rows pass, which the join that follows sorts out."""
    spark = addressed.sparkSession
    bits = min(BITS, max(1 << 10, 1 << (16 * n).bit_length()))
    pairs = unseen.select(F.col("first_blob").alias("blob"), F.col("first_place").alias("place"))
    set_ = pairs.select(F.explode(F.array(*[bit_of(i, bits) for i in range(HASHES)])).alias("bit"))
    words = set_.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("set"))
    every = spark.range(bits // 64).join(words, F.col("id") == F.col("word"), "left").select("id", F.coalesce("set", F.lit(0).cast("long")).alias("set"))
    table = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "set"))), lambda x: x["set"])).scalar()
    for i in range(HASHES):
        at = bit_of(i, bits)
        addressed = addressed.where(F.get(table, F.floor(at / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))) != 0)
    return addressed


def update_ledger(versions: DataFrame, path: str = "doc_id", text: str = "text", ledger: DataFrame | None = None, rules: str = RULES_VERSION, to: str | None = None) -> DataFrame:
    """The ledger rows `(blob, rules, findings)` of blobs that `ledger` has not seen under these rules, written
    as an increment below the folder `to` (the shared folder, if None).

    Digests are grouped first, so that one path for each unseen blob brings its text along; a Bloom filter of these
    pairs keeps the other texts where they are. Repeated rows of one path and blob are reduced to one before they
    move and before they are scanned.
    """
    spark = versions.sparkSession
    place = F.coalesce(F.concat(F.lit("="), F.col(path).cast("string")), F.lit(""))  # never null, so that dealing by it serves the group and the join
    addressed = versions.select(place.alias("place"), F.col(text).alias("text"), blob_id(F.col(text)).alias("blob"))
    unseen = addressed.groupBy("blob").agg(F.min("place").alias("place"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rules") == rules).select("blob"), "blob", "left_anti")
    unseen = written(unseen.select(F.col("blob").alias("first_blob"), F.col("place").alias("first_place")), "unseen")
    n = unseen.count()
    at = f"{to}/{shared_path(spark, 'increment').rpartition('/')[2]}" if to else shared_path(spark, "ledger")
    if n:
        texts = (addressed if ledger is None else perhaps_unseen(addressed, unseen, n)).groupBy("blob", "place").agg(F.first("text").alias("text"))
        own = (F.col("blob") == F.col("first_blob")) & (F.col("place") == F.col("first_place"))
        found = scan_blobs(texts.join(unseen.hint("shuffle_hash"), own, "left_semi").select("blob", "text"), "text")
    else:
        found = scan_blobs(spark.createDataFrame([], "blob binary, text string"), "text")
    found.select("blob", F.lit(rules).alias("rules"), "findings").write.parquet(at)
    discard(unseen)
    return spark.read.parquet(at)


def findings_of_paths(versions: DataFrame, ledger: DataFrame, path: str = "doc_id", text: str = "text", rules: str = RULES_VERSION) -> DataFrame:
    """`(path, blob, findings)` of every row; a blob of very many paths is a skewed join, which is split."""
    paths = versions.select(F.col(path), blob_id(F.col(text)).alias("blob"))
    return paths.join(ledger.where(F.col("rules") == rules).select("blob", "findings"), "blob", "left")


def joined(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def compacted(spark: SparkSession, root: str) -> None:
    """Makes one increment of the ledger's increments, under all rules, if there are more than MANY. The old ones are
    removed after the new one is whole: who reads in between sees blobs twice, which counts once."""
    old = children(spark, root)
    if len(old) > MANY:
        whole = spark.read.schema(LEDGER).parquet(*old).groupBy("blob", "rules").agg(F.first("findings").alias("findings"))
        whole.write.parquet(f"{root}/{shared_path(spark, 'compacted').rpartition('/')[2]}")
        for at in old:
            remove(spark, at)


def scan_versions(versions: DataFrame, root: str, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Brings the ledger in the folder `root` up to date with `versions` and gives `(path, blob, findings)`.

    The ledger is read as it stood before, plus this run's increment; it is not rewritten, only what it holds of the
    versions' blobs is brought along, and a blob in several increments counts once. A ledger of many increments is
    compacted first, so read results of earlier runs, or write them, before the next.
    """
    spark = versions.sparkSession
    known = exists(spark, root)
    if known:
        compacted(spark, root)
    before = spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(root) if known else None
    more = update_ledger(versions, path, text, before, to=root)
    if before is None:
        return findings_of_paths(versions, more, path, text)
    asked = versions.select(blob_id(F.col(text)).alias("asked")).distinct()
    old = before.where(F.col("rules") == RULES_VERSION).join(asked.hint("shuffle_hash"), F.col("blob") == F.col("asked"), "left_semi")
    once = old.unionByName(more).groupBy("blob", "rules").agg(F.first("findings").alias("findings"))
    return findings_of_paths(versions, written(once, "ledger-asked"), path, text)
