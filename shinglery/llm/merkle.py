"""Merkle dataset manifest, in the broadcast upper-tree variant.

Rows are leaves, ordered by id within their language; eight consecutive nodes become one. Executors reduce large
aligned blocks of leaves (8^DEPTH of them) to one node each; what is left is a small top tree, which the driver
builds, over the blocks of each language and then over the languages. The suffix paths of the blocks, from a
block's node to the root, are broadcast, and executors finish proofs and folds row by row inside the blocks. Where
more than TOP nodes are left, the top is reduced by blocks in the same way (`climb`), and suffix paths are joined to
blocks instead of broadcast; the result is the same.

Defined cases: a null id comes first and its decimal is the empty text; rows of equal ids are ordered by their
leaves, equal rows are leaves of their own; a null language is a language, before all others; a lone leaf is
its language's root and a lone language's root is the root, without further hashing; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shinglery.llm.common import discard, written
from shinglery.llm.mixing import ranged, running

# Nodes that become one, columns of a leaf, and which rows are tampered with.
ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_EVERY = 3
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Levels that a block spans (8^4 = 4,096 leaves), and up to how many nodes meet at the driver.
DEPTH, TOP = 4, 4096

#: A node's siblings level by level: what stands before it in its run and what stands after it, as hex text.
PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
PATH_DDL = "array<struct<before: string, after: string>>"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def tower(nodes: list[str], levels: int | None = None) -> list[list[str]]:
    """All levels from `nodes` on: so many more, or until one node remains."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        own = out[-1]
        out.append([digest("".join(own[i : i + ARITY])) for i in range(0, len(own), ARITY)])
    return out


def siblings(level: list[str], i: int) -> tuple[str, str]:
    lo = i - i % ARITY
    return "".join(level[lo:i]), "".join(level[i + 1 : lo + ARITY])


def path_of(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """The siblings of node i of the lowest level, up to the last."""
    out = []
    for level in levels[:-1]:
        out.append(siblings(level, i))
        i //= ARITY
    return out


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        node = digest(before + node + after)
    return node


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """`(key, lang, leaf, tampered, row)`: digests as bytes; `tampered` is null where nothing is tampered with."""
    leaf = lambda text: F.unhex(F.sha2(F.concat(*[field(text if c == "text" else F.col(c)) for c in FIELDS]), 256))
    chosen = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % TAMPERED_EVERY == 0
    lower = F.translate("text", CAPITALS, CAPITALS.lower())
    return docs.select(F.col("doc_id").alias("key"), F.col("lang").alias("grp"), leaf(F.col("text")).alias("leaf"), F.when(chosen, leaf(lower)).alias("tampered"), F.monotonically_increasing_id().alias("row"))


def hexes(column: pa.ChunkedArray, order: list[int]) -> list[str | None]:
    values = column.to_pylist()
    return [None if values[i] is None else values[i].hex() for i in order]


def in_order(t: pa.Table) -> list[int]:
    idx = t.column("idx").to_numpy()
    return idx.argsort(kind="stable").tolist()


def heads(nodes: DataFrame) -> DataFrame:
    """`(grp, block, n, whole, part)` of blocks of `(grp, idx, node)`: their number of nodes, the root of the block as
    a tree of its own, and its node DEPTH levels up, as a part of a larger tree."""
    kind, depth = dict(nodes.dtypes)["grp"], DEPTH

    def reduced(key: tuple, t: pa.Table) -> pa.Table:
        own = hexes(t.column("node"), in_order(t))
        levels = tower(own, depth)
        whole = next(x[0] for x in levels if len(x) == 1)
        cols = [[key[0].as_py()], [key[1].as_py()], [len(own)], [bytes.fromhex(whole)], [bytes.fromhex(levels[-1][0])]]
        types = [t.column("grp").type, pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, x) for c, x in zip(cols, types, strict=True)], names=["grp", "block", "n", "whole", "part"])

    return nodes.select("grp", "idx", "node", block().alias("block")).groupBy("grp", "block").applyInArrow(reduced, f"grp {kind}, block long, n long, whole binary, part binary")


def block() -> Column:
    return F.floor(F.col("idx") / ARITY**DEPTH).cast("long")


def climb(found: DataFrame) -> DataFrame:
    """From `heads`: `(grp, block, single, path, top)`, whether a block is its group's only one, the path from its node
    to the group's root, and that root. Blocks of blocks are reduced until each group is in one."""
    kind, depth = dict(found.dtypes)["grp"], DEPTH
    size = written(found.groupBy("grp").agg(F.count("*").alias("blocks")).withColumnRenamed("grp", "sized"), "sizes")
    sized = found.join(size, F.col("grp").eqNullSafe(F.col("sized"))).drop("sized")
    alone = sized.where("blocks = 1").select("grp", "block", F.lit(True).alias("single"), F.lit(None).cast(PATH_DDL).alias("path"), F.col("whole").alias("top"))
    nodes = written(sized.where("blocks > 1").select("grp", F.col("block").alias("idx"), F.col("part").alias("node")), "nodes")
    if nodes.isEmpty():
        return alone
    upper = climb(written(heads(nodes), "heads"))

    def walked(left: pa.Table, right: pa.Table) -> pa.Table:
        order = in_order(left)
        own, above = hexes(left.column("node"), order), right.to_pylist()[0]
        levels = tower(own, None if above["single"] else depth)
        rest = [(x["before"], x["after"]) for x in above["path"] or []]
        paths = [[{"before": b, "after": a} for b, a in [*path_of(levels, i), *rest]] for i in range(len(own))]
        n = len(own)
        cols = [left.column("grp").combine_chunks().slice(0, n), left.column("idx").take(pa.array(order)), pa.array([False] * n), pa.array(paths, PATH), pa.array([above["top"]] * n, pa.binary())]
        return pa.table(cols, names=["grp", "block", "single", "path", "top"])

    left = nodes.withColumn("block", block())
    out = left.groupBy("grp", "block").cogroup(upper.groupBy("grp", "block")).applyInArrow(walked, f"grp {kind}, block long, single boolean, path {PATH_DDL}, top binary")
    return alone.unionByName(out)


def suffixes(found: DataFrame) -> DataFrame:
    """`(grp, block, single, path, subroot, root)` by `climb`, first over the blocks of each language, then over the
    languages; no node meets at the driver."""
    up = written(climb(found), "climbed")
    by_name = [F.col("grp").asc_nulls_first()]
    subroots = running(ranged(up.where("block = 0").select("grp", "top"), *by_name), by_name, {"rank": F.lit(1)}, [])
    nodes = written(subroots.select(F.lit(0).alias("grp"), F.col("mix_rank").cast("long").alias("idx"), F.col("top").alias("node"), F.col("grp").alias("lang")), "subroots")
    tops = written(heads(nodes), "heads")
    # the blocks of the languages as groups, then each language's own place in its block
    above = climb(tops)
    depth = DEPTH

    def walked(left: pa.Table, right: pa.Table) -> pa.Table:
        order = in_order(left)
        own, over = hexes(left.column("node"), order), right.to_pylist()[0]
        levels = tower(own, None if over["single"] else depth)
        rest = [(x["before"], x["after"]) for x in over["path"] or []]
        paths = [[{"before": b, "after": a} for b, a in [*path_of(levels, i), *rest]] for i in range(len(own))]
        return pa.table([left.column("lang").take(pa.array(order)), pa.array(paths, PATH), pa.array([over["top"]] * len(own), pa.binary())], names=["lang", "across", "root"])

    kind = dict(found.dtypes)["grp"]
    across = nodes.withColumn("block", block()).groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInArrow(walked, f"lang {kind}, across {PATH_DDL}, root binary")
    joined = up.join(written(across, "across"), F.col("grp").eqNullSafe(F.col("lang")))
    return joined.select("grp", "block", "single", F.concat(F.coalesce("path", F.array().cast(PATH_DDL)), "across").alias("path"), F.col("top").alias("subroot"), "root")


def top_tree(found: list) -> dict[tuple, tuple[bool, list[tuple[str, str]], str, str]]:
    """The same at the driver, from the few `heads`: (language, block) -> (single, path, subroot, root)."""
    by: dict[str | None, dict[int, dict]] = {}
    for r in found:
        by.setdefault(r["grp"], {})[r["block"]] = r
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tower([bytes(b["part"]).hex() for _, b in sorted(own.items())]) if len(own) > 1 else [[bytes(own[0]["whole"]).hex()]] for g, own in by.items()}
    across = tower([trees[g][-1][0] for g in names]) if names else []
    out = {}
    for k, g in enumerate(names):
        rest = path_of(across, k)
        for b in by[g]:
            out[g, b] = (len(by[g]) == 1, path_of(trees[g], b) + rest, trees[g][-1][0], across[-1][0])
    return out


RESULT = "doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, lang string, tampered boolean"


def finished(t: pa.Table, single: bool, suffix: list[tuple[str, str]], subroot: str, root: str, depth: int) -> pa.Table:
    """Proofs and folds of the rows of one block."""
    order = in_order(t)
    own, other = hexes(t.column("node"), order), hexes(t.column("tampered"), order)
    levels = tower(own, None if single else depth)
    pairs = [[siblings(level, i) for i in range(len(level))] for level in levels[:-1]]
    tail = "".join(b + a for b, a in suffix)
    proofs, folds = [], []
    for i, leaf in enumerate(own):
        at, path = i, []
        for level in pairs:
            path.append(level[at])
            at //= ARITY
        proofs.append(digest("".join([*[b + a for b, a in path], tail])))
        folds.append(fold(other[i] or leaf, path + suffix))
    n = len(own)
    take = lambda c: t.column(c).combine_chunks().take(pa.array(order))
    cols = [take("key"), pa.array(own), pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs), pa.array(folds), pa.array([f == root for f in folds]), take("grp"), pa.array([x is not None for x in other])]
    return pa.table(cols, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "lang", "tampered"])


def manifest(docs: DataFrame) -> DataFrame:
    """`(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, lang, tampered)`, a row for each row."""
    spark, depth = docs.sparkSession, DEPTH
    made = written(leaves(docs), "leaves")
    order = [F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("row")]
    parts = ranged(made, *order)
    ranked = running(parts, order[1:], {"rank": F.lit(1)}, ["grp"])
    rows = written(ranked.select("grp", "key", F.col("mix_rank").cast("long").alias("idx"), F.col("leaf").alias("node"), "tampered"), "ranked")
    discard(made, parts)
    found = written(heads(rows), "heads")
    grouped = rows.withColumn("block", block()).groupBy("grp", "block")
    schema = RESULT.format(kind=dict(docs.dtypes)["doc_id"])
    if found.count() <= TOP:
        paths = spark.sparkContext.broadcast(top_tree(found.collect()))

        def finish(key: tuple, t: pa.Table) -> pa.Table:
            return finished(t, *paths.value[key[0].as_py(), key[1].as_py()], depth)

        return grouped.applyInArrow(finish, schema)

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        r = right.to_pylist()[0]
        return finished(left, r["single"], [(x["before"], x["after"]) for x in r["path"]], r["subroot"].hex(), r["root"].hex(), depth)

    return grouped.cogroup(written(suffixes(found), "suffixes").groupBy("grp", "block")).applyInArrow(joined, schema)


def sql(levels: int = 8) -> str:
    """The same as one statement, for up to 8^levels rows of a language and as many languages."""
    bits = "flatten(list_transform(range(length(k)), lambda i: list_transform(range(8), lambda j: (ascii(k[i + 1]) >> j) & 1)))"
    step = "xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)"
    crc = f"CASE WHEN k = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, b: {step}), 4294967295) END"
    known = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    leaf = lambda text: f"sha256({' || '.join(known(text if c == 'text' else c) for c in FIELDS)})"
    lower = f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')"
    ctes = [
        f"docs AS (SELECT doc_id, lang, {leaf('text')} AS leaf, {leaf(lower)} AS other, coalesce(doc_id::VARCHAR, '') AS k FROM documents)",
        f"leaves AS MATERIALIZED (SELECT doc_id, leaf, CASE WHEN ({crc}) % {TAMPERED_EVERY} = 0 THEN other END AS other, lang, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM docs)",
        "a0 AS MATERIALIZED (SELECT g, r AS i, leaf AS node, count(*) OVER (PARTITION BY g) AS n FROM leaves)",
    ]

    def tree(a: str, top: str) -> None:
        for k in range(levels):
            run = f"PARTITION BY g, i // {ARITY} ORDER BY i ROWS BETWEEN"
            ctes.append(f"{a}{k}p AS MATERIALIZED (SELECT g, i, n, coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {a}{k})")
            ctes.append(f"{a}{k + 1} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM (SELECT g, i // {ARITY} AS i, CASE WHEN max(n) > 1 THEN sha256(string_agg(node, '' ORDER BY i)) ELSE any_value(node) END AS node FROM {a}{k} GROUP BY g, i // {ARITY}))")
        ctes.append(f"{top} AS MATERIALIZED (SELECT g, node FROM {a}{levels})")

    tree("a", "subroots")
    ctes.append("b0 AS MATERIALIZED (SELECT 0 AS g, g AS i, node, count(*) OVER () AS n FROM subroots)")
    tree("b", "roots")
    ctes.append("f0 AS (SELECT *, coalesce(other, leaf) AS f, '' AS proof FROM leaves)")
    at = "f0"
    for a, g, i in (("a", "x.g", "x.r"), ("b", "0", "x.g")):
        for k in range(levels):
            to = f"f{a}{k}"
            ctes.append(f"{to} AS (SELECT x.* EXCLUDE (f, proof), CASE WHEN p.n > 1 THEN sha256(p.before || x.f || p.after) ELSE x.f END AS f, CASE WHEN p.n > 1 THEN x.proof || p.before || p.after ELSE x.proof END AS proof FROM {at} x JOIN {a}{k}p p ON p.g = {g} AND p.i = {i} // {ARITY**k})")
            at = to
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, s.node AS subroot, r.node AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.node AS verified, lang, other IS NOT NULL AS tampered FROM {at} x JOIN subroots s ON s.g = x.g, roots r"
