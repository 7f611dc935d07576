from __future__ import annotations

import os
import threading

import pytest

from siltstone.cli import main
from siltstone.effects import commands, links, store
from siltstone.effects.lock import Lock, Locked
from siltstone.effects.report import human
from siltstone.operators.references import orphan_keys
from siltstone.sources import config as cf
from siltstone.sources.scan import files_of, folders_of, scan
from siltstone.streaming.counts import COUNTS_SCHEMA, follow
from siltstone.streaming import state as st
from siltstone.streaming.state import DELTAS, Snapshots
from tests.conftest import rows


def write(root, files):
    for rel, data in files.items():
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(data)


def test_scan(spark, tmp_path):
    write(tmp_path, {"a.txt": "hello", "b.txt": "world", "sub/c.txt": "deep", "empty.txt": "", ".GIT/config": "x", ".dot": "y"})
    (tmp_path / "hollow/inner").mkdir(parents=True)
    (tmp_path / "sub/loop").symlink_to(tmp_path)
    (tmp_path / "link.txt").symlink_to(tmp_path / "a.txt")
    listing = scan(spark, str(tmp_path), ["**/.git/**"])
    assert {(r["rel_path"], r["size"]) for r in files_of(listing).collect()} == {("a.txt", 5), ("b.txt", 5), ("sub/c.txt", 4), ("empty.txt", 0), (".dot", 1)}
    assert {r[0] for r in folders_of(listing).collect()} == {"sub", "hollow", "hollow/inner"}
    assert files_of(listing).where("rel_path = 'a.txt'").first()["mtime_ns"] == os.stat(tmp_path / "a.txt").st_mtime_ns


def settings(tmp_path, **more):
    return cf.Config(target_root=str(tmp_path / "T"), workers=2, sources=[cf.Source(str(tmp_path / "A"), "A")], **more)


def test_lifecycle(spark, tmp_path):
    write(tmp_path / "A", {"a": "one", "b": "two", "c": "three", "d": "three", "sub/e": ""})
    (tmp_path / "A/hollow").mkdir()
    c = settings(tmp_path)
    assert commands.sync(spark, c, dry_run=True)["copied"] == 0 and not (tmp_path / "T").exists()
    r = commands.sync(spark, c)
    assert (r["copied"], r["failed"], r["dedup_saved"]) == (5, 0, 5) and (tmp_path / "T/A/hollow").is_dir()
    assert (tmp_path / "T/A/c").read_text() == "three" and abs(os.stat(tmp_path / "T/A/a").st_mtime_ns - os.stat(tmp_path / "A/a").st_mtime_ns) < 2_000
    again = commands.sync(spark, c)
    assert (again["copied"], again["skipped"]) == (0, 5)
    write(tmp_path / "A", {"a": "one more"})
    assert commands.sync(spark, c)["copied"] == 1
    assert not (tmp_path / "T/.siltstone/conflict").exists()
    v = commands.verify(spark, c.target_root)
    assert (v["checked"], v["missing"], v["failed"], v["errors"]) == (5, 0, 0, []) and v["verdicts"].count() == 5
    objects = {r["object_key"]: r["ref_count"] for r in commands.index_of(spark, c.target_root).objects.read().collect()}
    assert sorted(objects.values()) == [0, 1, 1, 1, 2]
    s = commands.status(spark, c.target_root)
    assert s["n_files"] == 5 and s["saved_bytes"] == 5
    assert commands.prune(spark, c.target_root, dry_run=True)["deleted"] == 1
    assert commands.prune(spark, c.target_root)["deleted"] == 1 and commands.prune(spark, c.target_root)["deleted"] == 0
    assert commands.reindex(spark, c.target_root) == {"files": 5, "objects": 4, "failed": 0}
    os.unlink(tmp_path / "T/A/b")
    (tmp_path / "T/A/d").unlink()
    (tmp_path / "T/A/d").write_text("xxxxx")
    v = commands.verify(spark, c.target_root)
    assert (v["missing"], v["failed"]) == (1, 1) and main(["verify", "--target", c.target_root], spark) == 1


def test_mtime_only_is_no_copy(spark, tmp_path):
    write(tmp_path / "A", {"a": "one"})
    c = settings(tmp_path)
    commands.sync(spark, c)
    s = os.stat(tmp_path / "A/a")
    os.utime(tmp_path / "A/a", ns=(s.st_mtime_ns, s.st_mtime_ns + 3_000_000_000))
    r = commands.sync(spark, c)
    assert (r["copied"], r["skipped"]) == (0, 1)
    assert commands.index_of(spark, c.target_root).files.read().first()["mtime_ns"] == s.st_mtime_ns + 3_000_000_000


def test_conflict_is_set_aside(spark, tmp_path):
    write(tmp_path, {"A/a": "mine", "T/A/a": "theirs"})
    assert commands.sync(spark, settings(tmp_path))["copied"] == 1
    aside = [p for p in (tmp_path / "T/.siltstone/conflict").rglob("*") if p.is_file()]
    assert [p.read_text() for p in aside] == ["theirs"] and (tmp_path / "T/A/a").read_text() == "mine"


def test_copy_mode_and_changed_source(tmp_path):
    write(tmp_path, {"src": "now longer"})
    task = {"rel_path": "d/x", "abs_path": str(tmp_path / "src"), "object_key": "h3:" + "0" * 32, "old_object_key": None, "size": 1, "mtime_ns": 0}
    r = store.copy_one(task, str(tmp_path / "T"), store.COPY, True, "now")
    assert r["status"] == "copied" and r["size"] == 10 and r["object_key"] != task["object_key"]
    store.remove_temporary(str(tmp_path / "T/.siltstone/objects"), r["object_key"], store.COPY)
    store.delete_object(str(tmp_path / "T/.siltstone/objects"), r["object_key"])
    assert (tmp_path / "T/d/x").read_text() == "now longer"
    assert store.copy_one(task | {"abs_path": "/nowhere"}, str(tmp_path / "T"), store.COPY, True, "now")["status"] == "failed"
    assert store.copy_one(task | {"rel_path": "../x"}, str(tmp_path / "T"), store.COPY, True, "now")["status"] == "failed"


def test_dedup(spark, tmp_path):
    write(tmp_path / "D", {"a": "dup", "b": "dup", "c": "dup", "u": "uniq!", "e1": "", "e2": ""})
    st = str(tmp_path / "state")
    dry = commands.dedup(spark, str(tmp_path / "D"), state_folder=st, dry_run=True)
    assert (dry["scanned"], dry["n_groups"], dry["deduped_files"]) == (6, 2, 0) and not os.path.exists(st)
    r = commands.dedup(spark, str(tmp_path / "D"), state_folder=st)
    assert (r["n_groups"], r["duplicate_files"], r["deduped_files"], r["linked_bytes"]) == (2, 3, 3, 6)
    assert os.stat(tmp_path / "D/a").st_ino == os.stat(tmp_path / "D/c").st_ino
    assert Snapshots(spark, st, commands.STATES, "rel_path").read().where("hash is not null").count() == 6
    again = commands.dedup(spark, str(tmp_path / "D"), state_folder=st)
    assert (again["n_groups"], again["deduped_files"]) == (2, 0)
    os.unlink(tmp_path / "D/c")
    assert commands.dedup(spark, str(tmp_path / "D"), state_folder=st)["duplicate_files"] == 2
    assert commands.dedup(spark, str(tmp_path / "D"))["n_groups"] == 2


def test_link_failure_rolls_back(tmp_path, monkeypatch):
    write(tmp_path, {"a": "x", "b": "x"})
    monkeypatch.setattr(os, "link", lambda *_, **__: (_ for _ in ()).throw(OSError(1, "no")))
    a, b = seen(tmp_path / "a"), seen(tmp_path / "b")
    r = links.link_group(a, [b])
    assert r["linked"] == [] and len(r["errors"]) == 1 and sorted(os.listdir(tmp_path)) == ["a", "b"]
    assert len(links.link_group(a._replace(path=str(tmp_path / "gone")), [b])["errors"]) == 1


def seen(path):
    s = os.stat(path)
    return links.Seen(str(path), s.st_size, s.st_mtime_ns)


def test_files_changed_since_the_scan_are_left_alone(tmp_path):
    write(tmp_path, {n: "same" for n in "abcd"})
    a, b, c, d = (seen(tmp_path / n) for n in "abcd")
    (tmp_path / "b").write_text("other content")
    (tmp_path / "c").unlink()
    (tmp_path / "c").symlink_to(tmp_path / "b")
    r = links.link_group(a, [b, c, d])
    assert r["linked"] == [d.path] and len(r["errors"]) == 2
    assert (tmp_path / "b").read_text() == (tmp_path / "c").read_text() == "other content" and (tmp_path / "c").is_symlink()
    (tmp_path / "e").write_text("same")
    e = seen(tmp_path / "e")
    (tmp_path / "a").write_text("news")
    os.utime(tmp_path / "a", ns=(1, 1))
    assert links.link_group(a, [e])["linked"] == [] and (tmp_path / "e").read_text() == "same"
    assert sorted(os.listdir(tmp_path)) == list("abcde")


def test_sync_is_one_commit(spark, tmp_path, monkeypatch):
    write(tmp_path / "A", {"a": "one", "b": "two"})
    c = settings(tmp_path)
    text = st.new_text
    monkeypatch.setattr(st, "new_text", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        commands.sync(spark, c)
    monkeypatch.setattr(st, "new_text", text)
    i = commands.index_of(spark, c.target_root)
    assert i.files.read().count() == i.objects.read().count() == 0
    assert commands.sync(spark, c)["copied"] == 2
    assert i.files.read().count() == i.objects.read().count() == 2 and commands.prune(spark, c.target_root)["deleted"] == 0
    before = rows(i.objects.read())
    monkeypatch.setattr(st, "new_text", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        commands.reindex(spark, c.target_root)
    assert rows(i.objects.read()) == before and i.files.read().count() == 2


def test_sync_can_be_stopped(spark, tmp_path):
    write(tmp_path / "A", {n: n for n in "abcde"})
    c, stop, events = settings(tmp_path), threading.Event(), []
    stop.set()
    r = commands.sync(spark, c, stop=stop)
    assert (r["copied"], r["skipped"], r["cancelled"], r["failed"]) == (0, 5, 5, 0)
    stop.clear()
    r = commands.sync(spark, c, stop=stop, on_event=events.append)
    assert (r["copied"], r["skipped"]) == (5, 0) and sorted(e["rel_path"] for e in events) == [f"A/{n}" for n in "abcde"]
    assert not [n for n in os.listdir(tmp_path / "T/.siltstone") if n.startswith("run-")]


def test_failures_are_told_and_the_rest_goes_on(spark, tmp_path):
    write(tmp_path, {"A/a": "one", "A/b": "two", "T/A/b/inside": "in the way"})
    events = []
    r = commands.sync(spark, settings(tmp_path), on_event=events.append)
    assert (r["copied"], r["failed"]) == (1, 1) and r["errors"][0][0] == "A/b"
    assert {e["rel_path"]: e["status"] for e in events} == {"A/a": "copied", "A/b": "failed"}


@pytest.mark.parametrize("strategy", ["keep-both", "newer-wins"])
def test_bisync(spark, tmp_path, strategy):
    write(tmp_path, {"L/a": "left", "L/both": "l", "R/both": "rr", "R/z": ""})
    for p in ("L/both", "R/both"):
        os.utime(tmp_path / p, ns=(0, 5_000_000_000 if p[0] == "L" else 0))
    run = lambda **k: commands.bisync(spark, str(tmp_path / "L"), str(tmp_path / "R"), str(tmp_path / "S"), strategy, **k)
    assert run(dry_run=True)["left_to_right"] == 1 and not (tmp_path / "R/a").exists()
    r = run()
    assert (r["left_to_right"], r["right_to_left"], r["conflicts"], r["errors"]) == (1, 1, 1, [])
    assert (tmp_path / "R/a").read_text() == "left" and (tmp_path / "L/z").exists()
    if strategy == "keep-both":
        assert (tmp_path / "R/both.conflict-left").read_text() == "l" and (tmp_path / "L/both.conflict-right").read_text() == "rr"
    else:
        assert (tmp_path / "R/both").read_text() == "l"
        assert run()["unchanged"] == 3
        os.unlink(tmp_path / "L/z")
        assert run()["deleted_right"] == 1 and not (tmp_path / "R/z").exists()
        assert run()["conflicts"] == 0


def test_lock(tmp_path):
    with Lock(str(tmp_path)):
        with pytest.raises(Locked):
            Lock(str(tmp_path)).acquire()
    (tmp_path / "lock").write_text("999999999")
    Lock(str(tmp_path)).acquire().release()
    (tmp_path / "lock").write_text("???")
    with pytest.raises(Locked):
        Lock(str(tmp_path)).acquire()


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"), "k string, v int", "k")
    assert s.read().count() == 0
    s.overwrite(spark.createDataFrame([("keep", 1), ("old", 2)], "k string, v int"))
    s.merge(spark.createDataFrame([("new", 3), ("keep", 4)], "k string, v int"), spark.createDataFrame([("old",)], "k string"))
    assert rows(s.read()) == [("keep", 4), ("new", 3)]
    v = s.version
    s.merge()
    assert s.version == v and rows(s.get("new")) == [("new", 3)]
    for i in range(DELTAS + 2):
        s.merge(spark.createDataFrame([("new", i), (f"k{i}", i), (None, i)], "k string, v int"), spark.createDataFrame([(f"k{i - 1}",), (None,)], "k string"))
    assert rows(s.read()) == [("k9", 9), ("keep", 4), ("new", 9)]
    head = s.state.head()
    assert len(head["tables"]["rows"]) <= DELTAS and len(os.listdir(tmp_path / "s/rows")) <= DELTAS + 2 and len([n for n in os.listdir(tmp_path / "s/commits") if n.endswith("json")]) == 2


def test_counts_stream(spark, tmp_path):
    deltas = spark.createDataFrame([("k", 1, 0, 0, None, None), ("k", 2, 1, 1, None, None), ("gone", 1, 0, 0, None, None), (None, 1, 0, 0, None, None)], COUNTS_SCHEMA)
    counts = Snapshots(spark, str(tmp_path / "state"), COUNTS_SCHEMA, "object_key")
    deltas.write.parquet(str(tmp_path / "in/1"))
    for n in range(3):
        stream = spark.readStream.schema(deltas.schema).parquet(str(tmp_path / "in/*"))
        follow(stream, counts, str(tmp_path / "cp")).awaitTermination()
        if n == 0:
            spark.createDataFrame([("other", 4, 0, 0, None, None), ("gone", -1, 0, 0, None, None)], COUNTS_SCHEMA).write.parquet(str(tmp_path / "in/2"))
    assert rows(counts.read().select("object_key", "n_refs", "n_exists")) == [("k", 3, 1), ("other", 4, 0)]
    assert rows(orphan_keys(counts.read())) == [("other", 4, "missing")]
    assert counts.state.marks()["batch"] == 1


GOOD = """
target_root: "/mnt/T"   # where
sources:
  - src: "/a"
    dest: "X\\\\Y"
  - src: '/b'
    dest: z
exclude:
  - "**/.git/**"
"""


FLOW = """
target_root: /mnt/T
mode: bisync
bisync:
  left: /l
  right: '/it''s'   # here
  conflict: newer-wins
sources: [{src: /a, dest: "x#y"}, {src: /b,
  dest: z}]
exclude: ["**/.git/**", "**/*.tmp"]
"""


def test_inline_settings(spark, tmp_path):
    c = cf.load(FLOW)
    assert c.exclude == ["**/.git/**", "**/*.tmp"] and c.bisync == cf.Pair("/l", "/it's", "newer-wins") and c.mode == "bisync"
    assert [(s.src, s.dest) for s in c.sources] == [("/a", "x#y"), ("/b", "z")]
    write(tmp_path, {"a.txt": "a", "docs/b.tmp": "b", "docs/c": "c"})
    assert {r["rel_path"] for r in files_of(scan(spark, str(tmp_path), c.exclude)).collect()} == {"a.txt", "docs/c"}


@pytest.mark.parametrize("line", ["exclude: '*.tmp'", "exclude: [**/a]", "exclude: [[a]]", "workers: many", "verify: 3", "note: |\n  x", "\tnote: 1", "note: [1, 2", 'note: "x', "note: 1\n  b: 2", "bisync: 3", "note", "note: b: c", "workers: 1\nworkers: 2"])
def test_settings_that_are_refused(line):
    with pytest.raises(ValueError):
        cf.load(GOOD + line)


def test_config():
    c = cf.load(GOOD)
    assert c.workers == 8 and c.on("verify") and c.exclude == ["**/.git/**"]
    assert [(s.src, s.dest) for s in c.sources] == [("/a", "X/Y"), ("/b", "z")]
    c.override_verify(True, True)
    assert not c.on("verify")


@pytest.mark.parametrize("text", ["", "target_root: rel\n", 'target_root: "/t"\n', GOOD.replace("/a", "a"), GOOD.replace("dest: z", "dest: ../z"), GOOD.replace("dest: z", 'dest: ""'), GOOD + "workers: -1\n"])
def test_bad_config(text):
    with pytest.raises(ValueError):
        cf.load(text)


def test_human():
    assert [human(n) for n in (0, 512, 1024, 1536, 1 << 20, 1 << 30)] == ["0 B", "512 B", "1.0 KiB", "1.5 KiB", "1.0 MiB", "1.0 GiB"]
