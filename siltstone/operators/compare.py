"""Differences between two copies of data, field by field.

Both copies are unpivoted to (key, field, value, sign) cells, one side positive and the other negative; one group per
(key, field) then shows which cells do not cancel. Rows are brought together by key before they are unpivoted, so the cells
are made and grouped where they are and never moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.files import TOLERANCE_NS
from siltstone.functions.keys import clean_key, with_clean_path

LEFT, RIGHT = 1, -1


def cell(field: str, sign: int, value: Column | None, kind: str = "number") -> Column:
    """A cell of one side: numbers travel in ``number``, anything else in ``text``; without a value it only says that the key is there."""
    number = value.cast("bigint") if value is not None and kind == "number" else F.lit(None).cast("bigint")
    text = value.cast("string") if value is not None and kind == "text" else F.lit(None).cast("string")
    return F.struct(F.lit(field).alias("field"), number.alias("number"), text.alias("text"), F.lit(sign).alias("sign"), F.lit(value is None).alias("presence"))


def unpivoted(rows: DataFrame, key: str, cells: Column) -> DataFrame:
    """(key, field, number, text, sign) of the rows' arrays of cells; a cell with a null value is none."""
    flat = rows.select(F.col(key).alias("key"), F.inline(cells))
    return flat.where("presence or number is not null or text is not null").select("key", "field", "number", "text", "sign")


def uncancelled(cells: DataFrame, tolerance: dict[str, int] | None = None) -> DataFrame:
    """Groups of cells that do not cancel: key, field, n_left, n_right, differs.

    ``differs`` is true when both sides have the cell and values differ (numbers by more than the field's tolerance), null
    when one side lacks it. Repeated cells of one side are compared with every cell of the other.
    """
    left, right = F.col("sign") == LEFT, F.col("sign") == RIGHT
    allowed = F.lit(0).cast("bigint")
    for field, most in (tolerance or {}).items():
        allowed = F.when(F.col("field") == field, F.lit(most).cast("bigint")).otherwise(allowed)
    wide = "decimal(20,0)"  # differences of extreme numbers do not fit a bigint
    grouped = cells.groupBy("key", "field").agg(
        F.count_if(left).alias("n_left"),
        F.count_if(right).alias("n_right"),
        *[f(F.when(side, F.col(v))).alias(f"{n}_{v}_{s}") for n, f in (("lo", F.min), ("hi", F.max)) for v in ("number", "text") for s, side in (("l", left), ("r", right))],
    )
    apart = F.greatest(
        F.col("hi_number_l").cast(wide) - F.col("lo_number_r").cast(wide), F.col("hi_number_r").cast(wide) - F.col("lo_number_l").cast(wide)
    ) > allowed
    spelled = (F.col("lo_text_l") != F.col("hi_text_r")) | (F.col("hi_text_l") != F.col("lo_text_r"))
    both = (F.col("n_left") > 0) & (F.col("n_right") > 0)
    out = grouped.select("key", "field", "n_left", "n_right", F.when(both, F.coalesce(apart, spelled, F.lit(False))).alias("differs"))
    return out.where("differs is null or differs")


def _tagged(rows: DataFrame, sign: int) -> DataFrame:
    """One side's rows, or the change list's (sign 0), in common columns; null and empty paths go."""
    own = [("size", "bigint"), ("mtime_ns", "bigint"), ("hash", "string"), ("recorded_at", "timestamp_ntz")]
    listed = [("left_size", "bigint"), ("right_size", "bigint")]
    there = own if sign else listed
    columns = [(F.col(c) if (c, kind) in there else F.lit(None)).cast(kind).alias(c) for c, kind in own + listed]
    return rows.where("path <> ''").select("path", F.lit(sign).alias("sign"), *columns).withColumn("hash", clean_key(F.col("hash")))


def pair_differences(left: DataFrame, right: DataFrame, changes: DataFrame) -> DataFrame:
    """path, field of every difference between the two sides, and between each side and the change list.

    ``missing_left`` / ``missing_right``: the path is on the other side only. ``size``, ``mtime`` (more than 2 s apart),
    ``hash``: on both sides with different values; a value missing on either side is not compared. ``left_size`` /
    ``right_size``: the change list's size differs from that side's own. Of a side's rows with one path the latest
    ``recorded_at`` holds. Paths null, empty or without a segment are ignored; empty inputs give the missing rows they
    imply. One shuffle, by path.
    """
    both = _tagged(left, LEFT).unionByName(_tagged(right, RIGHT)).unionByName(_tagged(changes, 0))
    rows = with_clean_path(both, "path").where("path <> ''").repartition("path")
    listed = [f(c).alias(f"{n}_{c}") for c in ("left_size", "right_size") for n, f in (("least", F.min), ("most", F.max))]
    held = rows.groupBy("path", "sign").agg(F.max(F.struct("recorded_at", "size", "mtime_ns", "hash")).alias("held"), *listed)

    def side(sign: int, own: str) -> Column:
        size = F.col("held.size")
        return F.array(cell("present", sign, None), cell("size", sign, size), cell("mtime", sign, F.col("held.mtime_ns")), cell("hash", sign, F.col("held.hash"), "text"), cell(own, sign, size))

    # the list's sizes stand against the side they are about; the least and the most of them tell whether any differs
    of_list = F.array(*[cell(c, -sign, F.col(f"{n}_{c}")) for c, sign in (("left_size", LEFT), ("right_size", RIGHT)) for n in ("least", "most")])
    cells = F.when(F.col("sign") == LEFT, side(LEFT, "left_size")).when(F.col("sign") == RIGHT, side(RIGHT, "right_size")).otherwise(of_list)
    open_cells = uncancelled(unpivoted(held.select("path", cells.alias("cells")), "path", F.col("cells")), {"mtime": TOLERANCE_NS})
    field = F.when(F.col("field") != "present", F.when(F.col("differs"), F.col("field"))).when(F.col("n_left") == 0, "missing_left").when(F.col("n_right") == 0, "missing_right")
    return open_cells.select(F.col("key").alias("path"), field.alias("field")).where("field is not null")
