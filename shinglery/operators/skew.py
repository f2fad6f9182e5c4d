"""Equi-joins whose hot keys are split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many of all rows is hot; there are at most as many of them.
SHARE = 10_000


def split_join(many: DataFrame, one: DataFrame, on: list[str], spread: str, share: int = SHARE, counted: DataFrame | None = None) -> DataFrame:
    """`many` with the columns of `one`, which has a row for each key: an inner join on the columns `on`.

    A key of more than a `share`-th of all rows is cut into pieces of about that many rows, by the hash of `spread`,
    and one's row goes to each of them, so that no task gets more than a few such pieces of one key. Hot keys are
    fewer than `share` whatever the input, which bounds their broadcast. `many` is read three times: give a table, or
    with `counted` a table whose keys occur as often. Rows with a null in a key go. Column names that begin with `split_` are reserved.
    """
    counted = many if counted is None else counted
    total = counted.agg(F.count("*")).scalar()
    pieces = F.ceil(F.col("split_n") * share / total).cast("int")
    counts = counted.groupBy(*on).agg(F.count("*").alias("split_n")).where(F.col("split_n") * share > total)
    hot = counts.select(*[F.col(c).alias(f"split_{c}") for c in on], pieces.alias("split_pieces"))
    equal = [F.col(c) == F.col(f"split_{c}") for c in on]

    def cut(df: DataFrame) -> DataFrame:
        met = df.join(F.broadcast(hot), equal, "left")
        return met.drop(*[f"split_{c}" for c in on]).withColumn("split_pieces", F.coalesce("split_pieces", F.lit(1)))

    dealt = cut(many).withColumn("split_piece", F.pmod(F.xxhash64(spread), F.col("split_pieces").cast("long")).cast("int")).drop("split_pieces")
    copies = cut(one).withColumn("split_piece", F.explode(F.sequence(F.lit(0), F.col("split_pieces") - 1))).drop("split_pieces")
    joined = dealt.join(copies.hint("shuffle_hash"), [*on, "split_piece"])
    return joined.select(*many.columns, *[c for c in one.columns if c not in on])
