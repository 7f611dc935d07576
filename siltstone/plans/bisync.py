"""Reconciling two folders that both changed since the last run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.files import unchanged

STRATEGIES = ("keep-both", "left-wins", "right-wins", "newer-wins")
#: The engine's own state file at the root of a side is never synchronised.
OWN_INDEX = ".bisync-index.db"


def four_way(left: DataFrame, right: DataFrame, left_was: DataFrame, right_was: DataFrame) -> DataFrame:
    """One row per path with the size and mtime_ns it has and had on either side, by one shuffle instead of three joins."""
    parts = [
        d.where(F.col("rel_path") != OWN_INDEX).select("rel_path", F.lit(tag).alias("tag"), "size", "mtime_ns")
        for tag, d in (("l", left), ("r", right), ("lw", left_was), ("rw", right_was))
    ]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    columns = []
    for tag in ("l", "r", "lw", "rw"):
        here = F.col("tag") == tag
        columns += [F.count_if(here).alias(f"{tag}_n"), F.max(F.when(here, F.col("size"))).alias(f"{tag}_size"), F.max(F.when(here, F.col("mtime_ns"))).alias(f"{tag}_mtime")]
    return both.groupBy("rel_path").agg(*columns)


def _change(side: str, compat_zero_size: bool) -> Column:
    now = F.col(f"{side}_n") > 0
    was = F.col(f"{side}w_n") > 0
    if compat_zero_size:
        was = was & (F.coalesce(f"{side}w_size", F.lit(0)) > 0)
    same = F.coalesce(unchanged(F.col(f"{side}_size"), F.col(f"{side}_mtime"), F.col(f"{side}w_size"), F.col(f"{side}w_mtime")), F.lit(False))
    return F.when(~now & was, "deleted").when(~now, "none").when(~was, "new").when(same, "none").otherwise("modified")


def bisync_changes(left: DataFrame, right: DataFrame, left_was: DataFrame, right_was: DataFrame, compat_zero_size: bool = False) -> DataFrame:
    """rel_path, left_change, right_change (none, new, modified, deleted), sizes and mtimes of every path known anywhere.

    ``compat_zero_size`` takes an empty file for one never recorded.
    """
    j = four_way(left, right, left_was, right_was)
    return j.select("rel_path", _change("l", compat_zero_size).alias("left_change"), _change("r", compat_zero_size).alias("right_change"), "l_size", "r_size", "l_mtime", "r_mtime", (F.col("l_n") > 0).alias("on_left"), (F.col("r_n") > 0).alias("on_right"))


def _kind() -> Column:
    l, r = F.col("left_change") != "none", F.col("right_change") != "none"
    return F.when(l & r, "conflict").when(l, "left").when(r, "right").otherwise("unchanged")


def bisync_actions(changes: DataFrame, strategy: str = "keep-both") -> DataFrame:
    """phase, op (copy, delete), from_side, to_side, rel_path, to_path, size; nothing for unchanged paths.

    Conflicts (both sides changed, even alike) are phase 0, plain copies 1, deletes 2. ``keep-both`` copies each side's
    file to the other under a ``.conflict-…`` name. A tie of mtimes under ``newer-wins`` goes to the right side.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown conflict strategy {strategy!r}")
    l, r = F.col("on_left"), F.col("on_right")

    def act(op: str, side: str, suffix: str = "") -> Column:
        other = "right" if side == "left" else "left"
        path = F.concat("rel_path", F.lit(suffix)) if suffix else F.col("rel_path")
        size = F.col(f"{side[0]}_size") if op == "copy" else F.lit(None).cast("bigint")
        return F.struct(F.lit(op).alias("op"), F.lit(side if op == "copy" else None).cast("string").alias("from_side"), F.lit(other if op == "copy" else side).alias("to_side"), path.alias("to_path"), size.alias("size"))

    none = F.array().cast("array<struct<op: string, from_side: string, to_side: string, to_path: string, size: bigint>>")
    to_right, to_left = F.array(act("copy", "left")), F.array(act("copy", "right"))
    del_right, del_left = F.array(act("delete", "right")), F.array(act("delete", "left"))
    gone_both = ~l & ~r
    if strategy == "keep-both":
        settled = F.concat(F.when(l, F.array(act("copy", "left", ".conflict-left"))).otherwise(none), F.when(r, F.array(act("copy", "right", ".conflict-right"))).otherwise(none))
    elif strategy == "left-wins":
        settled = F.when(gone_both, none).when(l, to_right).otherwise(del_right)
    elif strategy == "right-wins":
        settled = F.when(gone_both, none).when(r, to_left).otherwise(del_left)
    else:
        settled = F.when(~l | ~r, none).when(F.col("l_mtime") > F.col("r_mtime"), to_right).otherwise(to_left)
    kind = _kind()
    actions = (
        F.when(kind == "conflict", settled)
        .when(kind == "left", F.when(l, to_right).otherwise(del_right))
        .when(kind == "right", F.when(r, to_left).otherwise(del_left))
        .otherwise(none)
    )
    flat = changes.select("rel_path", kind.alias("kind"), F.inline(actions))
    phase = F.when(F.col("kind") == "conflict", 0).when(F.col("op") == "copy", 1).otherwise(2)
    return flat.select(phase.alias("phase"), "op", "from_side", "to_side", "rel_path", "to_path", "size")


def bisync_stats(changes: DataFrame) -> DataFrame:
    """One row: unchanged, left_to_right, right_to_left, conflicts, deleted_left, deleted_right, bytes_copied (plain copies)."""
    kind, l, r = _kind(), F.col("on_left"), F.col("on_right")
    to_right, to_left = (kind == "left") & l, (kind == "right") & r
    return changes.agg(
        F.count_if(kind == "unchanged").alias("unchanged"), F.count_if(to_right).alias("left_to_right"), F.count_if(to_left).alias("right_to_left"),
        F.count_if(kind == "conflict").alias("conflicts"), F.count_if((kind == "right") & ~r).alias("deleted_left"), F.count_if((kind == "left") & ~l).alias("deleted_right"),
        F.coalesce(F.sum(F.when(to_right, F.col("l_size")).when(to_left, F.col("r_size"))), F.lit(0)).alias("bytes_copied"),
    )


def final_state(side: str, changes: DataFrame, actions: DataFrame) -> DataFrame:
    """rel_path, size, mtime_ns to record for a side: its own files, incoming copies with their source's values, without deletes.

    Conflict copies count as well, so a settled conflict does not come back on the next run.
    """
    own = changes.where(F.col(f"on_{side}")).select("rel_path", F.col(f"{side[0]}_size").alias("size"), F.col(f"{side[0]}_mtime").alias("mtime_ns"))
    other = "r" if side == "left" else "l"
    incoming = actions.where((F.col("op") == "copy") & (F.col("to_side") == side)).select("rel_path", "to_path")
    source = changes.select("rel_path", F.col(f"{other}_size").alias("size"), F.col(f"{other}_mtime").alias("mtime_ns"))
    arrived = incoming.join(source, "rel_path").select(F.col("to_path").alias("rel_path"), "size", "mtime_ns")
    gone = actions.where((F.col("op") == "delete") & (F.col("to_side") == side)).select("rel_path")
    kept = own.join(gone.unionByName(arrived.select("rel_path")), "rel_path", "left_anti")
    return kept.unionByName(arrived)
