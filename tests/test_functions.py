from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import files, glob
from siltstone.functions.bitmap import Bitmap
from siltstone.functions.hashing import content_key
from siltstone.functions.keys import clean_key, latest, with_clean_path
from tests.conftest import rows

S = 1_000_000_000


def test_clean_key(spark):
    given_ = ["h3:AB", " h3:ab\t", "ab", "md5:X", "", "  ", None, "H3:aB"]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in given_], "k string").select(clean_key(F.col("k"))).collect()]
    assert got == ["h3:ab", "h3:ab", "h3:ab", "md5:x", None, None, None, "h3:ab"]


def test_clean_path(spark):
    cases = {
        "a/b": "a/b", "/a//b/": "/a/b", "./a/./b": "a/b", "a/tmp/../b": "a/b", "a\\b\\..\\c": "a/c", "../a": "a", "/..": "/", "": "", "./": "",
        "café/x": "café/x", "A/b": "A/b", "a/..b/...": "a/..b/...", "x/" * 3000 + "y": "x/" * 3000 + "y",
    }
    df = with_clean_path(spark.createDataFrame([(k,) for k in cases], "p string"), "p", "q")
    assert {r["p"]: r["q"] for r in df.collect()} == cases
    assert with_clean_path(spark.createDataFrame([(None,)], "p string"), "p").first()[0] is None


def test_latest_takes_nulls_as_earliest_and_ties_by_value(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 5, 3), ("b", None, None)], "k string, t int, v int")
    assert rows(latest(df, ["k"], "t", ["v"])) == [("a", 5, 3), ("b", None, None)]


@pytest.mark.parametrize("gap, close", [(0, True), (S, True), (2 * S, True), (2 * S + 1, False), (10 * S, False), (-3 * S // 2, True), (-5 * S, False)])
def test_mtime_close(spark, gap, close):
    assert spark.range(1).select(files.mtime_close(F.lit(10 * S), F.lit(10 * S + gap))).first()[0] is close


def test_unchanged_ignores_nothing_but_hash(spark):
    df = spark.createDataFrame([(1, 0, 1, 0), (1, 0, 2, 0), (1, 0, 1, 5 * S), (1, 0, 1, S)], "a long, b long, c long, d long")
    assert [r[0] for r in df.select(files.unchanged(*(F.col(c) for c in "abcd"))).collect()] == [True, False, False, True]


def test_should_verify(spark):
    mib = 1 << 20
    cases = [(False, True, 100, True), (False, False, 100, False), (True, False, 100, True), (False, True, mib + 1, False), (True, True, mib + 1, True), (False, True, mib, True)]
    df = spark.createDataFrame(cases, "v boolean, s boolean, n long, want boolean")
    assert df.where(files.should_verify(F.col("n"), F.col("v"), F.col("s")) != F.col("want")).count() == 0


def test_buckets_and_paths(spark):
    cases = [("h3:a1b2c3d4", "a1", "a1b2"), ("h3:abcd", "ab", "abcd"), ("a1b2c3d4", "a1", "a1b2"), ("h3:abc", "", ""), ("", "", ""), ("h3:../../etc", "", ""), ("h3:ab/cd", "", ""), ("h3:A1B2C3D4", "A1", "A1B2")]
    df = spark.createDataFrame(cases, "k string, two string, four string")
    k = F.col("k")
    assert df.where((files.object_bucket(k, "h3:", 2) != F.col("two")) | (files.object_bucket(k, "h3:", 4) != F.col("four"))).count() == 0
    assert spark.range(1).select(files.object_path("objects", F.lit("h3:a1b2c3d4"), "h3:")).first()[0] == "objects/a1/a1b2/a1b2c3d4"


def test_names_and_bytes(spark):
    names = [r[0] for r in spark.createDataFrame([("path/with/slashes",), ("a" * 300,), ("ü" * 100,), (None,)], "n string").select(files.sanitized(F.col("n"))).collect()]
    assert names[0] == "path_with_slashes" and len(names[1]) == 150 and names[1][141] == "_" and "_" in names[2] and names[3] is None
    sizes = {0: "0 B", 512: "512 B", 1024: "1.0 KiB", 1280: "1.2 KiB", 1536: "1.5 KiB", 1 << 20: "1.0 MiB", 1 << 30: "1.0 GiB"}
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", files.human_bytes(F.col("n"))).collect()
    assert {r[0]: r[1] for r in got} == sizes


def test_escapes_root(spark):
    cases = {"a/b": False, "..": True, "a/../../b": True, "a/../b": False, "/etc": True, "./a": False, "a/b/../../..": True}
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", files.escapes_root(F.col("p"))).collect()
    assert {r[0]: r[1] for r in got} == cases


def test_content_key_of_nothing(spark):
    df = spark.createDataFrame([(bytearray(b""),), (None,)], "b binary").select(content_key("b"))
    assert [r[0] for r in df.collect()] == ["h3:99aa06d3014798d86001c324468d497f", None]


@pytest.mark.parametrize("pattern, path, yes", [
    ("**/.git/**", ".git/config", True), ("**/.git/**", "a/.git/x/y", True), ("**/*.tmp", "data.tmp", True), ("**/*.tmp", "a/b.tmp", True), ("*.tmp", "a/b.tmp", False),
    ("a/**/z", "a/z", True), ("a/**/z", "a/b/c/z", True), ("a/?", "a/bc", False), ("{a,b{c,d}}/x", "bd/x", True), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("a.b", "aXb", False),
    ("\\*", "*", True), ("**/.GIT/**", ".git/config", True), ("node_modules/**", "node_modules", True),
])
def test_glob(spark, pattern, path, yes):
    assert spark.range(1).select(glob.excluded(F.lit(path), [pattern])).first()[0] is yes


def test_bad_glob_matches_nothing(spark):
    df = spark.createDataFrame([("keep.txt",), (".GIT/config",), ("data.tmp",), ("node_modules/pkg/index.js",)], "p string")
    got = df.where(~glob.excluded(F.col("p"), ["[", "{a", "**/.git/**", "**/node_modules/**", "**/*.tmp"])).collect()
    assert [r[0] for r in got] == ["keep.txt"]
    assert spark.range(1).select(glob.excluded(F.lit("a"), ["["])).first()[0] is False


ordinals = st.lists(st.integers(0, 200_000), max_size=300)


@settings(max_examples=60, deadline=None)
@given(ordinals, ordinals, st.booleans())
def test_bitmap_is_a_set(a, b, dense):
    if dense:
        a = a + list(range(0, 30_000, 2))
        b = b + list(range(10_000, 25_000))
    x, y = Bitmap.of(np.array(a, dtype=np.uint32)), Bitmap.of(np.array(b, dtype=np.uint32))
    assert x.and_not(y).ordinals().tolist() == sorted(set(a) - set(b))
    assert x.and_(y).ordinals().tolist() == sorted(set(a) & set(b))
    assert Bitmap.from_bytes(x.to_bytes()).ordinals().tolist() == sorted(set(a))
    assert len(x) == len(set(a))
