from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltstone import catalog
from siltstone.plans import bisync, dedup, sync, upkeep
from tests.conftest import rows

S = 1_000_000_000
M = "rel_path string, size long, mtime_ns long, object_key string"
OBJ = "object_key string, size long, ref_count int, stored_at timestamp_ntz, orphaned boolean"
OPS = "rel_path string, old_object_key string, object_key string, size long"
F4 = "rel_path string, size long, mtime_ns long"


def test_sync_actions(spark):
    index = spark.createDataFrame([("same", 1, 0, "a"), ("tol", 1, 2 * S, "a"), ("moved", 1, 3 * S, "a"), ("nokey", 1, 0, ""), ("other", 1, 0, "b"), ("size", 2, 0, "a"), ("bad", 1, 9 * S, "a")], M)
    manifest = spark.createDataFrame([(p, 1, 0, "a") for p in ("same", "tol", "moved", "nokey", "other", "size", "new")] + [("bad", 1, 0, None)], M)
    fast = {r["rel_path"]: r["action"] for r in sync.sync_plan(manifest, index).collect()}
    assert fast == {"same": "skip", "tol": "skip", "moved": "touch", "nokey": "copy", "other": "skip", "size": "copy", "new": "copy", "bad": "skip_error"}
    strict = {r["rel_path"]: r["action"] for r in sync.sync_plan(manifest, index, False).collect()}
    assert strict == {"same": "copy", "tol": "copy", "moved": "touch", "nokey": "copy", "other": "copy", "size": "copy", "new": "copy", "bad": "skip_error"}
    assert sync.sync_plan(manifest.where("false"), index).count() == 0


def test_sync_report_and_space(spark):
    objects = spark.createDataFrame([("old", 100, 1, None, False)], OBJ)
    plan = spark.createDataFrame([("a", 100, 0, "old", None, "copy"), ("b", 200, 0, "n", None, "copy"), ("c", 200, 0, "n", None, "copy"), ("d", 300, 0, "m", None, "copy"), ("e", 1, 0, "m", "m", "skip")], M + ", old_object_key string, action string")
    assert tuple(sync.sync_report(plan, objects).first()) == (4, 1, 0, 800, 300)
    copies = plan.where("action = 'copy'")
    assert sync.space_hardlink(copies, objects).first()[0] == 500
    sizes = spark.createDataFrame([("a", 50, 0, "1"), ("b", 500, 0, "2"), ("c", 200, 0, "3")], M)
    assert sync.space_copy(sizes, 8).first()[0] == 4000 and sync.space_hardlink(sizes, objects).first()[0] == 750
    assert sync.space_copy(sizes.where("false")).first()[0] == 0


def test_later_source_wins(spark):
    a, b = (spark.createDataFrame([("x", n)], "rel_path string, size long") for n in (1, 2))
    assert rows(sync.union_sources([(a, "d"), (b, "\\d\\")]).select("rel_path", "size")) == [("d/x", 2)]


def test_refcounts(spark):
    objects = spark.createDataFrame([("old", 5, 1, None, False), ("dead", 0, 0, None, True)], OBJ)
    ops = spark.createDataFrame([("a", "old", "new", 7), ("b", None, "fresh", 3), ("c", "same", "same", 1), ("d", "unknown", "dead", 9), ("e", None, "fresh", 3)], OPS)
    got = {r["object_key"]: (r["size"], r["ref_count"], r["orphaned"], r["stored_at"] is not None) for r in sync.merge_refcounts(objects, ops).collect()}
    assert got == {"old": (5, 0, True, False), "new": (7, 1, False, True), "fresh": (3, 2, False, True), "dead": (9, 1, False, True), "unknown": (0, 0, True, False)}
    assert rows(sync.merge_refcounts(objects, ops.where("false")).select("object_key", "ref_count")) == [("dead", 0), ("old", 1)]


def test_conflicts(spark):
    plan = spark.createDataFrame([("a", 1, 0, "n", "o", "copy"), ("b", 1, 0, "n", "o", "copy"), ("c", 1, 0, "n", None, "copy"), ("d", 1, 0, "n", None, "copy")], M + ", old_object_key string, action string")
    target = spark.createDataFrame([("a", "o"), ("b", "x"), ("c", "n"), ("d", "y")], "rel_path string, object_key string")
    assert rows(sync.conflicts(plan, target)) == [("a", "o", False), ("b", "x", True), ("d", "y", True)]
    assert rows(sync.conflicts(plan, target, literal=True))[0] == ("a", "o", True)


def test_dedup(spark):
    df = spark.createDataFrame([(f"{i}", 10, "x") for i in range(3)] + [("p", 5, "y"), ("q", 5, "y"), ("r", 7, "z"), ("e1", 0, "e"), ("e2", 0, "e"), ("n1", 4, None), ("n2", 4, None)], "rel_path string, size long, hash string")
    groups = dedup.duplicate_groups(df)
    assert rows(groups) == [(0, "e", 2, "e1"), (10, "x", 3, "0"), (5, "y", 2, "p")]
    assert tuple(dedup.dedup_stats(groups, df).first()) == (10, 3, 4, 25)
    assert {r["rel_path"] for r in dedup.link_plan(df, groups).collect()} == {"1", "2", "q", "e2"}
    inode = df.withColumn("dev", F.lit(1)).withColumn("ino", F.when(F.col("size") == 10, 7).otherwise(F.crc32("rel_path")))
    assert {r["rel_path"] for r in dedup.link_plan(inode, groups).collect()} == {"q", "e2"}
    assert dedup.duplicate_groups(df.where("false")).count() == 0
    many = spark.createDataFrame([(f"{g}-{i}", g, str(g)) for g in range(10) for i in range(10)], "rel_path string, size long, hash string")
    assert dedup.duplicate_groups(many).count() == 10


def test_incremental_dedup(spark):
    st = "rel_path string, size long, mtime_ns long, hash string"
    states = spark.createDataFrame([("a", 1, 0, "x"), ("b", 1, 0, ""), ("c", 2, 0, "x"), ("gone", 1, 0, "x")], st)
    files = spark.createDataFrame([("a", 1, S, "never read"), ("b", 1, 0, "x"), ("c", 1, 0, "x"), ("d", 1, 0, "x")], st)
    assert {r[0] for r in dedup.to_hash(files.drop("hash"), states).select("rel_path").collect()} == {"b", "c", "d"}
    assert rows(dedup.deleted_paths(files, states)) == [("gone",)]
    assert rows(dedup.duplicate_groups(dedup.next_states(files, states))) == [(1, "x", 4, "a")]


@pytest.fixture
def sides(spark):
    f = lambda *r: spark.createDataFrame(list(r), F4)
    left = f(("new", 1, 0), ("mod", 2, 0), ("both", 2, 9 * S), ("tie", 2, 0), ("rdel", 1, 0), ("same", 1, 0), ("dm", 3, 0), ("zero", 0, 0), (bisync.OWN_INDEX, 1, 0))
    right = f(("mod", 1, 0), ("both", 3, 8 * S), ("tie", 3, 0), ("ldel", 1, 0), ("same", 1, 2 * S), ("zero", 0, 0))
    was = f(("mod", 1, 0), ("both", 1, 0), ("tie", 1, 0), ("rdel", 1, 0), ("ldel", 1, 0), ("same", 1, 0), ("dm", 1, 0), ("gone", 1, 0), ("zero", 0, 0))
    return left, right, was, was


def test_bisync_changes(sides):
    got = {r["rel_path"]: (r["left_change"], r["right_change"]) for r in bisync.bisync_changes(*sides).collect()}
    assert got == {
        "new": ("new", "none"), "mod": ("modified", "none"), "both": ("modified", "modified"), "tie": ("modified", "modified"), "rdel": ("none", "deleted"), "ldel": ("deleted", "none"),
        "same": ("none", "none"), "dm": ("modified", "deleted"), "gone": ("deleted", "deleted"), "zero": ("none", "none"),
    }
    compat = {r["rel_path"]: r["left_change"] for r in bisync.bisync_changes(*sides, compat_zero_size=True).collect()}
    assert compat["zero"] == "new"
    stats = bisync.bisync_stats(bisync.bisync_changes(*sides)).first().asDict()
    assert stats == {"unchanged": 2, "left_to_right": 2, "right_to_left": 0, "conflicts": 4, "deleted_left": 1, "deleted_right": 1, "bytes_copied": 3}


@pytest.mark.parametrize("strategy, conflicts", [
    ("keep-both", {("copy", "right", "both.conflict-left"), ("copy", "left", "both.conflict-right"), ("copy", "right", "tie.conflict-left"), ("copy", "left", "tie.conflict-right"), ("copy", "right", "dm.conflict-left")}),
    ("left-wins", {("copy", "right", "both"), ("copy", "right", "tie"), ("copy", "right", "dm")}),
    ("right-wins", {("copy", "left", "both"), ("copy", "left", "tie"), ("delete", "left", "dm")}),
    ("newer-wins", {("copy", "right", "both"), ("copy", "left", "tie")}),
])
def test_bisync_strategies(sides, strategy, conflicts):
    changes = bisync.bisync_changes(*sides)
    actions = bisync.bisync_actions(changes, strategy)
    assert {(r["op"], r["to_side"], r["to_path"]) for r in actions.where("phase = 0").collect()} == conflicts
    rest = {(r["phase"], r["op"], r["to_side"], r["to_path"]) for r in actions.where("phase > 0").collect()}
    assert rest == {(1, "copy", "right", "new"), (1, "copy", "right", "mod"), (2, "delete", "left", "rdel"), (2, "delete", "right", "ldel")}
    left, right = (bisync.final_state(s, changes, actions).cache() for s in ("left", "right"))
    again = bisync.bisync_changes(left, right, left, right)
    assert again.where("left_change <> 'none' or right_change <> 'none'").count() == 0
    paths = [r["rel_path"] for r in left.collect()]
    assert len(paths) == len(set(paths))


def test_unknown_strategy(sides):
    with pytest.raises(ValueError):
        bisync.bisync_actions(bisync.bisync_changes(*sides), "coin")


def test_upkeep(spark):
    index = spark.createDataFrame([("ok", "a"), ("wrong", "a"), ("lost", "a"), ("../out", "a"), ("broken", "a")], "rel_path string, object_key string")
    target = spark.createDataFrame([("ok", "a"), ("wrong", "b"), ("broken", None), ("extra", "c"), ("../out", "a")], "rel_path string, object_key string")
    report = upkeep.verify_report(index, target)
    assert dict(rows(report)) == {"ok": "ok", "wrong": "mismatch", "lost": "missing", "../out": "escape", "broken": "read_error"}
    assert tuple(upkeep.verify_stats(report).first()) == (5, 1, 3)
    assert rows(upkeep.unindexed(index, target)) == [("extra",)]
    objects = spark.createDataFrame([("live", 10, 2, None, False), ("dead", 4, 0, None, True)], OBJ)
    physical = spark.createDataFrame([("live",), ("stray",), ("stray",)], "object_key string")
    plan = upkeep.prune_plan(objects, physical)
    assert rows(plan) == [("dead", "orphan"), ("stray", "unindexed")]
    assert tuple(upkeep.prune_stats(objects, plan).first()) == (2, 2)
    files = spark.createDataFrame([("x", 10), ("y", 10)], "rel_path string, size long")
    assert tuple(upkeep.status(files, objects).first()) == (2, 2, 20, 20, 10, 10)
    assert tuple(upkeep.status(files.where("false"), objects.where("false")).first()) == (0, 0, 0, 0, 0, 0)


def test_reindex(spark):
    t = spark.createDataFrame([("a", 1, 0, None, 1, 10), ("b", 1, 0, "k2", 1, 11), (".siltstone/index/x", 1, 0, "k3", 1, 12), ("c", 1, 0, None, 2, 10)], "rel_path string, size long, mtime_ns long, object_key string, dev long, ino long")
    objects = spark.createDataFrame([("k1", 1, 10)], "object_key string, dev long, ino long")
    files = upkeep.reindex_files(t, objects)
    assert rows(files.select("rel_path", "object_key", "linked")) == [("a", "k1", True), ("b", "k2", False), ("c", None, False)]
    assert rows(upkeep.reindex_objects(files).select("object_key", "ref_count")) == [("k1", 1), ("k2", 1)]


def test_last_of_key(spark):
    t = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), (None, 9)], "object_key string, seq long")
    assert rows(sync.last_of_key(t)) == [("a", 1, False), ("a", 3, True), ("b", 2, True), (None, 9, False)]


def test_seen_before(spark):
    plan = spark.createDataFrame([(f"{i:02}", 1, 0, "hot", None, "copy") for i in range(40)] + [("x", 1, 0, "old", None, "copy")], M + ", old_object_key string, action string")
    known = {r["rel_path"]: r["known"] for r in sync.seen_before(plan, spark.createDataFrame([("old",)], "object_key string")).collect()}
    assert known == {f"{i:02}": i > 0 for i in range(40)} | {"x": True}


def test_dedup_groups_by_xxh3(spark, tmp_path):
    texts = ["one", "two", "one", None, "", "été", "été", "e\u0301t\u00e9"]
    docs = spark.createDataFrame([(i, t, "s", "l") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["dedup_groups_xxh3"](spark, str(tmp_path))
    want = catalog.QUERIES["dedup_groups"](spark, str(tmp_path))
    assert got.columns == want.columns
    assert rows(got.drop("hash")) == rows(want.drop("hash")) == [(0, 2, "s/l/3.txt"), (3, 2, "s/l/0.txt"), (5, 2, "s/l/5.txt")]
    assert {r["hash"] for r in got.where("size = 0").collect()} == {"h3:99aa06d3014798d86001c324468d497f"}


def test_sync_plan_over_held_rows(spark, tmp_path):
    schema = "path string, size long, mtime_ns long, hash string, recorded_at int"
    left = [("a/./x", 1, 0, " AA ", 2), ("a/x", 9, 9, "old", 1), ("b", 2, 5_000_000_000, "h3:bb", 1), ("c", None, 0, "cc", 1), ("d", 4, 0, "", 1), (None, 1, 0, "aa", 1), ("", 1, 0, "aa", 1)]
    right = [("a/x", 1, 1, "h3:aa", 1), ("b", 2, 0, "BB", 1), ("c", 3, 0, "cc", 1), ("gone", 1, 0, "aa", 1), ("./gone", 1, 0, "aa", 0)]
    for name, data in (("left_states", left), ("right_states", right)):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    plan = catalog.QUERIES["sync_plan_held"](spark, str(tmp_path))
    assert rows(plan.select("rel_path", "action")) == [("a/x", "skip"), ("b", "touch"), ("c", "copy"), ("d", "skip_error")]
    assert rows(catalog.QUERIES["sync_source_deleted_held"](spark, str(tmp_path))) == [("gone",)]
