"""Per-key results where a few keys hold most rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds at least 1/HOT_SHARE of the rows; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000


def _names(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def hot_keys(counts: DataFrame, key: str | list[str], n: str, share: int = HOT_SHARE) -> DataFrame:
    """The key columns and ``salts`` of the keys that hold 1/share of the rows or more, at most ``share`` of them.

    ``counts`` has one row per key. A key gets as many salts as shares it holds, so no salted part exceeds about 1/share
    of the rows.
    """
    total = counts.groupBy().agg(F.sum(n).alias("total")).scalar()
    return counts.where(F.col(n) * share >= total).select(*_names(key), F.ceil(F.col(n) * share / total).cast("int").alias("salts"))


def salted_join(left: DataFrame, right: DataFrame, key: str | list[str], by: list[Column], hot: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` join ``right`` on ``key``, the left rows of a hot key spread over its salts by the hash of ``by``.

    Right rows of hot keys are repeated once per salt; all others meet once. ``hot`` comes from ``hot_keys`` and is
    broadcast: its size is bounded by the share. Left joins keep left rows with a null key.
    """
    names = _names(key)
    h = F.broadcast(hot.select(*[F.col(k).alias(f"_hot_{k}") for k in names], F.col("salts").alias("_salts")))
    extra = [*[f"_hot_{k}" for k in names], "_salts"]

    def marked(df: DataFrame) -> DataFrame:
        met = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_hot_{k}") for k in names])
        return df.join(h, met, "left")

    spread = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col("_salts"))).cast("int")
    l = marked(left).withColumn("_salt", spread).drop(*extra)
    r = marked(right).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop(*extra)
    return l.join(r, [*names, "_salt"], how).drop("_salt")


def key_states(rows: DataFrame, key: str, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """Compact state of each key: n (rows), and the named sums and maxima; map-side combined, so skew does not matter.

    Rows with a null key are left out, as they join nothing.
    """
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(c).alias(n) for n, c in (sums or {}).items()] + [F.max(c).alias(n) for n, c in (maxima or {}).items()]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def eager_join(left: DataFrame, right: DataFrame, key: str, left_sums: list[str], right_sums: list[str], how: str = "inner") -> DataFrame:
    """Aggregate of the join of two inputs per key, from their compact states alone.

    ``left`` and ``right`` come from ``key_states``. The joined rows of a key number n_left * n_right (``n_pairs``), and
    a sum over the joined rows is one side's sum times the other side's count. With ``how='left'`` a key without right
    rows counts as joined once to nulls. Maxima pass through. Column names must differ between the sides, apart from
    the key and n.
    """
    l, r = left.withColumnRenamed("n", "n_left"), right.withColumnRenamed("n", "n_right")
    j = l.join(r, key, how)
    times_right = F.greatest(F.coalesce("n_right", F.lit(0)), F.lit(1)) if how == "left" else F.col("n_right")
    keep = [c for c in j.columns if c not in {key, *left_sums, *right_sums}]
    return j.select(
        key, *keep,
        (F.col("n_left") * times_right).alias("n_pairs"),
        *[(F.col(c) * times_right).alias(c) for c in left_sums],
        *[(F.col(c) * F.col("n_left")).alias(c) for c in right_sums],
    )
