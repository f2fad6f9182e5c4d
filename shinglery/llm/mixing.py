"""Mixing sources to target weights, with DataFrame operations only: hash-random keys, a range sort within
each source, distributed prefix sums of token counts, and a cut at each source's exact budget; epochs repeat
where a budget exceeds its source.

A row's size, random key and number are written once, so that the range sort, which reads its input twice, counts
no words twice; the sums then move numbers only, and texts move once, to what the mix takes of them.

Defined cases: null text has size 0 and is never taken; a null source is a source, last in order; repeated
rows are rows of their own, which their numbers keep apart; an empty table gives no rows; other columns are kept,
and names that begin with `mix_` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shinglery.llm.common import written

# Weights of the sources in order, the share of all sizes, the most epochs.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2
WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]*"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """The rows, range-partitioned by `order` and written once, with the partition's number `mix_part`."""
    return written(df.repartitionByRange(*order).withColumn("mix_part", F.spark_partition_id()), "mix")


def offsets(parts: DataFrame, sums: dict[str, Column], within: list[str]) -> DataFrame:
    """Per (within, mix_part): what the parts before hold of each sum. Few rows: one a part and group."""
    got = parts.groupBy(*within, "mix_part").agg(*[v.alias(f"mix_own_{k}") for k, v in sums.items()])
    before = Window.partitionBy(*within).orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1)
    return got.select(*within, "mix_part", *[F.coalesce(F.sum(f"mix_own_{k}").over(before), F.lit(0)).alias(f"mix_{k}") for k in sums])


def running(parts: DataFrame, order: list[Column], sums: dict[str, Column], within: list[str]) -> DataFrame:
    """Adds `mix_<name>`: the sum over the rows before, by a window inside each part plus its offset."""
    own = Window.partitionBy(*within, "mix_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = parts.select("*", *[F.coalesce(F.sum(v).over(own), F.lit(0)).alias(f"mix_in_{k}") for k, v in sums.items()])
    base = offsets(parts, {k: F.sum(v) for k, v in sums.items()}, within)
    base = base.select(*[F.col(c).alias(f"mix_key_{i}") for i, c in enumerate([*within, "mix_part"])], *[f"mix_{k}" for k in sums])
    same = F.lit(True)
    for i, c in enumerate([*within, "mix_part"]):
        same &= F.col(c).eqNullSafe(F.col(f"mix_key_{i}"))
    out = inside.join(base, same)
    return out.select(*parts.columns, *[(F.col(f"mix_in_{k}") + F.col(f"mix_{k}")).alias(f"mix_{k}") for k in sums])


def targets(sized: DataFrame, source: str = "source", size: str = "mix_size") -> DataFrame:
    """`(mix_source, mix_source_size, mix_target)`: shares by weight, none above EPOCHS times its source.

    Sharing an excess again and again ends where every target is min(cap, level * weight). In the order
    of cap / weight the sources below the level come first, so that prefix sums give the level. The
    prefix sums are distributed, as the sources may be many.
    """
    totals = sized.groupBy(F.col(source).alias("mix_source")).agg(F.sum(size).alias("mix_source_size"))
    by_name = [F.col("mix_source").asc_nulls_last()]
    ranks = running(ranged(totals, *by_name), by_name, {"rank": F.lit(1)}, [])
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("mix_rank") % len(WEIGHTS) + 1).cast("int"))
    sources = ranks.select("mix_source", "mix_source_size", weight.cast("long").alias("mix_weight")).withColumn("mix_ratio", EPOCHS * F.col("mix_source_size").cast("double") / F.col("mix_weight"))
    parts = ranged(sources, F.col("mix_ratio"), *by_name)
    both = parts.agg(F.sum("mix_source_size").alias("size"), F.sum("mix_weight").alias("weight")).first()
    size_all, weight_all = both["size"] or 0, both["weight"] or 0
    filled = running(parts, [F.col("mix_ratio"), *by_name], {"below": F.col("mix_source_size"), "lighter": F.col("mix_weight")}, [])
    level = (F.lit(SHARE * size_all) - EPOCHS * F.col("mix_below").cast("double")) / (F.lit(weight_all) - F.col("mix_lighter"))
    found = filled.where(level <= F.col("mix_ratio")).agg(F.min_by(level, F.struct("mix_ratio", F.col("mix_source").isNull(), "mix_source")).alias("level")).first()["level"]
    target = F.least(EPOCHS * F.col("mix_source_size").cast("double"), F.lit(float(found or 0.0)) * F.col("mix_weight"))
    return parts.select("mix_source", "mix_source_size", target.alias("mix_target"))


def keyed(docs: DataFrame, keep: list[str], text: str = "text", key: str = "doc_id", seed: str = "mix") -> DataFrame:
    """The columns `keep` with `mix_size`, a random key `mix_rand` from id and text, and the row's number
    `mix_row`, which is no order but keeps equal rows apart; written."""
    rand = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    return written(docs.select(*keep, word_count(F.col(text)).alias("mix_size"), rand.alias("mix_rand"), F.monotonically_increasing_id().alias("mix_row")), "keyed")


def mix(rows: DataFrame, source: str = "source", key: str = "doc_id") -> DataFrame:
    """`(key, source, mix_row, mix_size, mix_source_size, mix_target, mix_taken)` of `keyed` rows; mix_taken: words
    taken, repeats counted.

    A source's rows lie in the order of a random key over as many parts as the range sort makes, so that
    a source with most of the rows is spread; its offset per part carries its budget along.
    """
    slim = rows.select(key, source, "mix_size", "mix_rand", "mix_row")
    order = [F.col("mix_rand"), F.col(key), F.col("mix_size"), F.col("mix_row")]
    parts = ranged(slim, F.col(source), *order)
    goal = targets(parts, source)
    base = offsets(parts, {"before": F.sum("mix_size")}, [source])
    base = base.join(goal, F.col(source).eqNullSafe(F.col("mix_source"))).select("mix_source", F.col("mix_part").alias("mix_part_2"), "mix_source_size", "mix_target", "mix_before")
    own = Window.partitionBy(source, "mix_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = parts.withColumn("mix_in", F.coalesce(F.sum("mix_size").over(own), F.lit(0)))
    out = inside.join(base, F.col(source).eqNullSafe(F.col("mix_source")) & (F.col("mix_part") == F.col("mix_part_2")))
    budget = F.floor(F.col("mix_target") + 0.5)
    whole = F.when(F.col("mix_source_size") > 0, F.floor(budget / F.col("mix_source_size"))).otherwise(F.lit(0))
    rest = budget - whole * F.col("mix_source_size")
    taken = whole * F.col("mix_size") + F.greatest(F.lit(0), F.least(F.col("mix_size"), rest - F.col("mix_before") - F.col("mix_in")))
    return out.select(key, source, "mix_row", "mix_size", "mix_source_size", "mix_target", taken.cast("long").alias("mix_taken"))


def take(rows: DataFrame, mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself, of `keyed` rows with their texts: a row per epoch of each document, the last cut to the
    words that remain, and `mix_words`."""
    wanted = mixed.where("mix_taken > 0").select(F.col("mix_row").alias("mix_at"), "mix_taken")
    left = F.col("mix_taken") - F.col("mix_size") * F.col("mix_epoch")
    copies = F.ceil(F.col("mix_taken") / F.col("mix_size")).cast("int")
    epochs = rows.join(wanted.hint("shuffle_hash"), F.col("mix_row") == F.col("mix_at")).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), copies - 1)))
    # each word with the white space before it, so that a cut text is a prefix of the whole one
    words = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(f"({SPACE}{WORD})"), F.lit(1)), F.lit(1), left.cast("int")), "")
    cut = F.when(left < F.col("mix_size"), words).otherwise(F.col(text))
    keep = [c for c in rows.columns if not c.startswith("mix_")]
    return epochs.select(*[cut.alias(c) if c == text else F.col(c) for c in keep], F.least(left, F.col("mix_size")).alias("mix_words"))


def sql(seed: str = "mix") -> str:
    """The same as one statement."""
    w = ", ".join(map(str, WEIGHTS))
    return f"""WITH docs AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS r FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS s FROM docs GROUP BY source),
ranked AS (SELECT source, s, [{w}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::BIGINT AS w FROM totals),
ratio AS (SELECT *, {EPOCHS} * s::DOUBLE / w AS q, sum(s) OVER () AS s_all, sum(w) OVER () AS w_all FROM ranked),
filled AS (SELECT *, ({SHARE}::DOUBLE * s_all::DOUBLE - {EPOCHS} * coalesce(sum(s) OVER o, 0)::DOUBLE) / (w_all - coalesce(sum(w) OVER o, 0))::DOUBLE AS lv FROM ratio WINDOW o AS (ORDER BY q, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT source, s, least({EPOCHS} * s::DOUBLE, (SELECT lv FROM filled WHERE lv <= q ORDER BY q, source NULLS LAST LIMIT 1) * w) AS target FROM filled),
placed AS (SELECT d.*, g.s, g.target, floor(g.target + 0.5)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY r, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM docs d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
epochs AS (SELECT *, CASE WHEN s > 0 THEN budget // s ELSE 0 END AS e FROM placed)
SELECT doc_id, size, s AS source_size, target, (e * size + greatest(0, least(size, budget - e * s - before)))::BIGINT AS taken FROM epochs"""
