from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import compare, references, skew, snapshots, tasks
from tests.conftest import rows

T0 = dt.datetime(2023, 1, 1)
STATES = "snapshot_no int, taken_at timestamp_ntz, root string, path string, size long, mtime_ns long, hash string, recorded_at timestamp_ntz"
SIDE = "path string, size long, mtime_ns long, hash string, recorded_at timestamp_ntz"
CHANGES = "path string, left_change string, right_change string, left_size long, right_size long"
FILES = "rel_path string, size long, mtime_ns long, object_key string, synced_at timestamp_ntz"
TASKS = "task_id long, rel_path string, src_abs string, dest_abs string, object_key string, old_object_key string, size long, mtime_ns long, queued_at timestamp_ntz"
OBJECTS = "object_key string, size long, ref_count int, stored_at timestamp_ntz, orphaned boolean, recorded_at timestamp_ntz"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def state(no, root, path, size=1, mtime=0, hash_="aa", hours=0):
    return (no, T0, root, path, size, mtime, hash_, at(hours))


def test_snapshot_changes(spark):
    df = spark.createDataFrame([
        state(1, "r", "/a"), state(1, "r", "/b"), state(1, "r", "/c"), state(1, "r", "/n"), state(1, "r", "/k"), state(1, "r", "/gone"),
        state(3, "r", "/./a"), state(3, "r", "/b", size=2), state(3, "r", "/c", mtime=2_000_000_000), state(3, "r", "/n", size=None, mtime=None, hash_=""),
        state(3, "r", "/k", hash_=" H3:AA\t"), state(3, "r", "/fresh"), state(3, "r", None), state(3, "r", ""),
        state(4, "r", "/c", mtime=4_000_000_001), state(4, "r", "/c", mtime=2_000_000_000, hours=-1), state(4, "r", "/k", hash_="bb"), state(4, "r", "/k", hash_="bb"),
        state(2, "other", "/only"), state(5, None, "/x"), state(6, None, "/y"),
    ], STATES).withColumn("shard", F.lit("clash")).withColumn("ordinal", F.lit("clash"))
    want = [
        (None, 6, "/x", "deleted"), (None, 6, "/y", "new"),
        ("r", 3, "/b", "modified"), ("r", 3, "/fresh", "new"), ("r", 3, "/gone", "deleted"),
        ("r", 4, "/a", "deleted"), ("r", 4, "/b", "deleted"), ("r", 4, "/c", "modified"), ("r", 4, "/fresh", "deleted"), ("r", 4, "/k", "modified"), ("r", 4, "/n", "deleted"),
    ]
    got = snapshots.snapshot_changes(df)
    assert got.dtypes == [("root", "string"), ("snapshot_no", "int"), ("path", "string"), ("change_kind", "string")]
    assert sorted(rows(got), key=str) == sorted(want, key=str)
    assert snapshots.snapshot_changes(df.where("false")).count() == 0


def test_ordinals_persist(spark):
    df = spark.createDataFrame([state(1, "r", f"/{i}") for i in range(50)], STATES)
    first = snapshots.dictionary(snapshots.with_ordinals(snapshots.held_listings(df, 8))).cache()
    more = df.unionByName(spark.createDataFrame([state(2, "r", f"/{i}") for i in range(40, 70)], STATES))
    second = snapshots.dictionary(snapshots.with_ordinals(snapshots.held_listings(more, 8), first))
    old, new = set(map(tuple, first.collect())), set(map(tuple, second.collect()))
    assert not old & new and len(old | new) == 70
    assert len({(s, o) for s, _, _, o in old | new}) == 70


def test_deliveries_equal_the_whole(spark, tmp_path):
    rng = random.Random(3)
    data = []
    for root in ("r", "q", None):
        for no in range(1, 9):
            if root == "q" and no in (3, 4, 7):
                continue
            data += [state(no, root, f"/{i}", size=rng.choice([1, 2, None]), mtime=rng.choice([0, 5_000_000_000, None]), hash_=rng.choice(["aa", "bb", None])) for i in range(60) if rng.random() < (0.05 if no == 5 else 0.7)]
    df = spark.createDataFrame(data, STATES)
    want = sorted(rows(snapshots.snapshot_changes(df, 8)), key=str)
    assert len(want) > 300
    got = []
    for low, high in ((1, 2), (3, 3), (4, 6), (7, 8)):
        listings = snapshots.Listings(spark, str(tmp_path / "l"), 8)  # opened anew
        part = df.where(f"snapshot_no between {low} and {high}")
        got += rows(listings.deliver(part))
    assert sorted(got, key=str) == want
    assert listings.deliver(df.where("snapshot_no = 6")).count() == 0 and listings.deliver(df.where("false")).count() == 0
    ids = rows(listings.state.read("ordinals").select("shard", "ordinal"))
    assert len(ids) == len(set(ids)) == 180
    assert rows(listings.state.read("roots").select("root", "snapshot_no")) == [("q", 8), ("r", 8), (None, 8)]


def test_pair_differences(spark):
    def f(path, size=1, mtime=0, hash_="aa", hours=0):
        return (path, size, mtime, hash_, at(hours))

    left = spark.createDataFrame([f("a"), f("b"), f("c"), f("d", size=None), f("x\\y"), f("z", size=9, hours=-1), f("z"), f("big", mtime=-(1 << 63)), f("two")], SIDE)
    right = spark.createDataFrame([f("a", size=2, mtime=2_000_000_001, hash_="bb"), f("./b", mtime=2_000_000_000), f("d"), f("x/y"), f("z"), f("q"), f("big", mtime=(1 << 63) - 1), f("two")], SIDE)
    changes = spark.createDataFrame([("b", None, None, 5, 1), ("b", None, None, 5, 1), ("d", None, None, 7, None), ("nowhere", None, None, 1, 2), ("q", None, None, 3, 1), ("two", None, None, 1, 1), ("two", None, None, 2, None)], CHANGES)
    want = [("a", "hash"), ("a", "mtime"), ("a", "size"), ("b", "left_size"), ("big", "mtime"), ("c", "missing_right"), ("q", "missing_left"), ("two", "left_size")]
    assert rows(compare.pair_differences(left, right, changes)) == want
    none = left.where("false")
    assert compare.pair_differences(none, none, changes.where("false")).count() == 0
    assert rows(compare.pair_differences(none, right.where("path = 'q'"), changes)) == [("q", "missing_left")]


@pytest.fixture
def referring(spark):
    files = spark.createDataFrame([
        ("ok", 1, 0, "k1", at(5)), ("lost", 1, 0, "K9", at(5)), ("lost", 1, 0, "k1", at(4)), ("freed", 1, 0, "k2", None), ("early", 1, 0, "k1", at(1)), ("none", 1, 0, "", at(1)), (None, 1, 0, "k9", at(1)),
    ], FILES)
    tasks_ = spark.createDataFrame([(1, "p", None, None, "k9", "k3", 1, 0, at(800)), (1, "p", None, None, " k9", "k3", 1, 0, at(800)), (2, "p", None, None, "md5:k1", None, 1, 0, None)], TASKS)
    objects = spark.createDataFrame([("k1", 1, 1, at(2), False, at(9)), ("h3:k1", 1, 0, at(2), True, at(8)), ("k2", 1, 0, at(0), None, at(1)), ("K3", None, None, None, True, at(1)), ("k4", 1, None, None, None, at(1))], OBJECTS)
    return files, tasks_, objects


def test_orphan_references(spark, referring):
    want = [
        ("copy_tasks", "1", "object_key", "missing", "2023-02"), ("copy_tasks", "1", "old_object_key", "deleted", "2023-02"), ("copy_tasks", "2", "object_key", "missing", "unknown"),
        ("files_index", "early", "object_key", "late", "2023-01"), ("files_index", "freed", "object_key", "deleted", "unknown"), ("files_index", "lost", "object_key", "missing", "2023-01"),
    ]
    assert rows(references.orphan_references(*referring)) == want
    assert rows(references.orphan_references(*referring, share=1)) == want
    f, t, o = referring
    assert references.orphan_references(f.where("false"), t.where("false"), o).count() == 0
    assert references.orphan_references(f, t, o.where("false")).where("reason = 'missing'").count() == 7


def test_counts_follow_deltas(spark, referring):
    files, tasks_, objects = referring
    refs = references.file_references(files).unionByName(references.task_references(tasks_))
    state = references.merge_counts(references.reference_deltas(refs))
    state = references.merge_counts(state, references.object_deltas(references.held_objects(objects)))
    assert rows(references.orphan_keys(state)) == [("h3:k2", 1, "deleted"), ("h3:k3", 1, "deleted"), ("h3:k9", 2, "missing"), ("md5:k1", 1, "missing")]
    gone = references.merge_counts(state, references.reference_deltas(refs.where("object_key = 'h3:k9'"), -1))
    assert "h3:k9" not in {r[0] for r in references.orphan_keys(gone).collect()}
    back = references.merge_counts(state, references.object_deltas(spark.createDataFrame([("md5:k1", False, None)], "object_key string, released boolean, stored_at timestamp_ntz")))
    assert "md5:k1" not in {r[0] for r in references.orphan_keys(back).collect()}


def test_task_totals(spark):
    data = [(i, "p", None, None, "hot" if i % 2 else f"k{i}", None, i if i != 7 else None, 0, at(i) if i != 9 else None) for i in range(300)]
    data += [(i, "p", None, None, " H3:HOT", None, i, 0, at(i)) for i in range(1, 9, 2)] + [(900, "p", None, None, "", None, 5, 0, at(1)), (901, "p", None, None, None, None, 5, 0, None), (None, "p", None, None, "hot", None, 5, 0, None)]
    df = spark.createDataFrame(data, TASKS).withColumn("n", F.lit(1))
    got = {r["object_key"]: r for r in tasks.task_totals(df).collect()}
    assert got["h3:hot"]["n_tasks"] == 150 and got["h3:hot"]["total_size"] == sum(range(1, 300, 2)) and got["h3:hot"]["last_queued_at"] == at(299)
    assert len(got) == 151
    assert rows(tasks.heavy_keys(tasks.task_totals(df))) == [("h3:hot",)]
    objects = spark.createDataFrame([("HOT",), ("hot",), ("hot",), ("k2",), (None,)], "object_key string")
    joined = tasks.task_object_totals(df, objects)
    assert rows(tasks.heavy_joined_keys(joined)) == [("h3:hot",)]
    assert tasks.heavy_joined_keys(joined)._jdf.queryExecution().optimizedPlan().toString().count("Join") >= 1
    assert tasks.heavy_joined_keys(tasks.task_object_totals(df.where("false"), objects)).count() == 0
    assert tasks.task_totals(df.where("false")).count() == tasks.heavy_keys(tasks.task_totals(df.where("false"))).count() == 0


def test_eager_join_equals_the_join(spark):
    l = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), ("c", None), (None, 3)], "k string, x long")
    r = spark.createDataFrame([("a", 10), ("a", 20), ("a", None), ("c", 4), (None, 1)], "k string, y long")
    for how in ("inner", "left"):
        want = l.join(r, "k", how).where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))
        got = skew.eager_join(skew.key_states(l, "k", {"x": F.col("x")}), skew.key_states(r, "k", {"y": F.col("y")}), "k", ["x"], ["y"], how)
        assert rows(got.select("k", "n_pairs", "x", "y")) == rows(want)


def test_salted_join_is_the_join(spark):
    l = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, 7)], "k string, i long")
    r = spark.createDataFrame([("hot", 1), ("k3", 2), ("k3", 3), (None, 4)], "k string, y long")
    hot = skew.hot_keys(l.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k", "n", 20)
    assert [x["k"] for x in hot.collect()] == ["hot"]
    for how in ("inner", "left"):
        assert rows(skew.salted_join(l, r, "k", [F.col("i")], hot, how)) == rows(l.join(r, "k", how))
