"""What changed between full snapshots of a table.

Keys get ordinals within hash shards, which persist in a dictionary. A snapshot of a root is then, per shard, a compressed
bitmap of the ordinals present and column vectors aligned with its set bits: AND-NOT of consecutive bitmaps gives additions
and removals, and the vectors at the ordinals common to both expose changed values. The dictionary and each root's last
bitmaps and vectors are kept between deliveries, so a delivery is compared without reading earlier ones again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.bitmap import Bitmap
from siltstone.functions.files import TOLERANCE_NS
from siltstone.functions.keys import clean_key, latest, with_clean_path
from siltstone.session import new_folder, written
from siltstone.streaming.state import State

#: Input bytes that a shard should hold; a shard is handled by one task at a time.
SHARD_BYTES = 2 << 20

CHANGES = "root string, snapshot_no int, path string, change_kind string"
_VECTORS = "bitmap binary, sizes array<bigint>, mtimes array<bigint>, hashes array<string>"
#: Rows of a compared shard: cases, whose path is null where only the dictionary knows it, and the state of the last snapshots.
_COMPARED = f"{CHANGES}, shard int, ordinal int, {_VECTORS}"
_LAST = "#last"


def shard_count(df: DataFrame, shard_bytes: int = SHARD_BYTES) -> int:
    """Shards for a table of this size, from the planner's size estimate (no job runs); a power of two, so that shards can be split."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 1 << max(3, min(size // shard_bytes, 1 << 30).bit_length())


def held_listings(states: DataFrame, shards: int) -> DataFrame:
    """Rows of ``file_states`` that hold, with clean keys and their shard.

    Null and empty paths are ignored; of rows with one (root, snapshot_no, clean path) the latest ``recorded_at``
    holds. A null root is a root of its own. Columns beyond the known ones are ignored.
    """
    rows = states.select("root", "snapshot_no", "path", "size", "mtime_ns", clean_key(F.col("hash")).alias("hash"), "recorded_at")
    rows = with_clean_path(rows.where("path is not null and path <> '' and snapshot_no is not null"), "path").where("path <> ''")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("root", "path"), F.lit(shards)).cast("int"))
    return latest(rows, ["shard", "root", "path", "snapshot_no"], "recorded_at", ["size", "mtime_ns", "hash"])


def with_ordinals(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``rows`` with the ordinal of their (root, path) within the shard, and ``is_new`` for keys that ``known`` has not.

    ``known`` (shard, root, path, ordinal) is the dictionary of earlier deliveries, made with the same number of shards:
    its ordinals stay, and new keys are numbered after the largest one of their shard.
    """
    if known is None:
        w = Window.partitionBy("shard").orderBy("root", "path")
        return rows.select("*", (F.dense_rank().over(w) - 1).alias("ordinal"), F.lit(True).alias("is_new"))
    k = known.select("shard", F.col("root").alias("_root"), F.col("path").alias("_path"), F.col("ordinal").alias("_known"))
    top = known.groupBy("shard").agg((F.max("ordinal") + 1).alias("_top"))
    joined = (
        rows.alias("r")
        .join(k.alias("k"), (F.col("r.shard") == F.col("k.shard")) & F.col("r.root").eqNullSafe(F.col("k._root")) & (F.col("r.path") == F.col("k._path")), "left")
        .select("r.*", "_known")
        .join(top, "shard", "left")
    )
    w = Window.partitionBy("shard").orderBy(F.col("_known").isNotNull(), "root", "path")
    fresh = F.dense_rank().over(w) - 1 + F.coalesce("_top", F.lit(0))
    return joined.select(*rows.columns, F.coalesce("_known", fresh).cast("int").alias("ordinal"), F.col("_known").isNull().alias("is_new"))


def dictionary(rows: DataFrame) -> DataFrame:
    """The (shard, root, path, ordinal) rows of the keys that are new in ``rows``."""
    return rows.where("is_new").select("shard", "root", "path", "ordinal").distinct()


class Vectors:
    """One snapshot of one root within a shard: its bitmap, and values aligned with the bitmap's set bits."""

    def __init__(self, ordinals: np.ndarray, columns: dict[str, np.ndarray], known: dict[str, np.ndarray]):
        order = np.argsort(ordinals, kind="stable")
        self.at = ordinals[order].astype(np.uint32)
        self.bitmap = Bitmap.of(self.at)
        self.columns = {c: v[order] for c, v in columns.items()}
        self.known = {c: v[order] for c, v in known.items()}

    def take(self, ordinals: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        i = np.searchsorted(self.at, ordinals)
        return {c: v[i] for c, v in self.columns.items()}, {c: v[i] for c, v in self.known.items()}

    def kept(self, hashes: list[str]) -> dict:
        """Bitmap and values, null where unknown, to keep for the next delivery."""
        values = {c: [x if k else None for x, k in zip(self.columns[c].tolist(), self.known[c].tolist(), strict=True)] for c in self.columns}
        return {"bitmap": self.bitmap.to_bytes(), "sizes": values["size"], "mtimes": values["mtime_ns"], "hashes": [None if v is None else hashes[v] for v in values["hash"]]}


def _far_apart(a: np.ndarray, b: np.ndarray, tolerance: int) -> np.ndarray:
    """|a - b| > tolerance without overflow."""
    hi, lo = np.maximum(a, b), np.minimum(a, b)
    return (hi.astype(np.uint64) - lo.astype(np.uint64)) > np.uint64(tolerance)


def _changed(before: Vectors, after: Vectors, common: np.ndarray) -> np.ndarray:
    (a, ka), (b, kb) = before.take(common), after.take(common)
    differs = (a["size"] != b["size"]) & ka["size"] & kb["size"]
    differs |= _far_apart(a["mtime_ns"], b["mtime_ns"], TOLERANCE_NS) & ka["mtime_ns"] & kb["mtime_ns"]
    differs |= (a["hash"] != b["hash"]) & ka["hash"] & kb["hash"]
    return common[differs]


def _integers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    known = column.is_valid().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False), known


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """Integer codes of a string column (-1: null) and what they stand for."""
    coded = column.dictionary_encode().unify_dictionaries().combine_chunks()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.chunk(0) if coded.num_chunks else pa.array([], pa.string()).dictionary_encode()
    return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def _diff_shard(rows: pa.Table, roots: pa.Table) -> pa.Table:
    """Cases of one shard and its last snapshots' state; ``roots`` has the snapshots of each of its roots and what is kept of the last one before."""
    ordinal = rows["ordinal"].to_numpy()
    snapshot = rows["snapshot_no"].to_numpy()
    code, spelled = _codes(rows["root"])
    hash_code, hashes = _codes(rows["hash"])
    size, size_known = _integers(rows["size"])
    mtime, mtime_known = _integers(rows["mtime_ns"])
    shard = (rows["shard"] if len(ordinal) else roots["at_shard"])[0].as_py()
    order = np.lexsort((snapshot, code))
    cuts = np.flatnonzero((np.diff(code[order]) != 0) | (np.diff(snapshot[order]) != 0)) + 1
    vectors = {}
    for at in np.split(order, cuts):
        if len(at):
            root = spelled[code[at[0]]] if code[at[0]] >= 0 else None
            vectors[root, int(snapshot[at[0]])] = Vectors(
                ordinal[at],
                {"size": size[at], "mtime_ns": mtime[at], "hash": hash_code[at]},
                {"size": size_known[at], "mtime_ns": mtime_known[at], "hash": hash_code[at] >= 0},
            )
    codes = {h: i for i, h in enumerate(hashes)}
    none = np.zeros(0, dtype=np.int64)
    empty = Vectors(none, {c: none for c in ("size", "mtime_ns", "hash")}, {c: none == 0 for c in ("size", "mtime_ns", "hash")})
    found: list[tuple[str | None, np.ndarray, int, str]] = []
    state = []
    for r in roots.to_pylist():
        root, numbers = r["of_root"], [n for n in r["snapshots"] if r["last_no"] is None or n > r["last_no"]]
        if r["last_no"] is not None:
            numbers.insert(0, r["last_no"])
            if r["bitmap"] is not None:
                vectors[root, r["last_no"]] = _kept(r, codes, hashes)
        for earlier, later in zip(numbers, numbers[1:], strict=False):
            found += [(root, *case) for case in _cases(vectors.get((root, earlier), empty), vectors.get((root, later), empty), later)]
        last = vectors.get((root, numbers[-1]), empty)
        if len(last.at):
            state.append({"root": root, "snapshot_no": numbers[-1], "change_kind": _LAST, "shard": shard} | last.kept(hashes))
    first = np.full(int(max([0, *(o.max() for _, o, _, _ in found), *ordinal.tolist()])) + 1, -1, dtype=np.int64)
    first[ordinal] = np.arange(len(ordinal))  # a row of each ordinal, to spell its path
    lengths = [len(o) for _, o, _, _ in found]
    ordinals = np.concatenate([o for _, o, _, _ in found]).astype(np.int32) if found else np.zeros(0, dtype=np.int32)
    at = first[ordinals]

    def each(values: list, kind: pa.DataType) -> pa.Array:
        return pa.array(np.repeat(np.array(values, dtype=object), lengths), kind) if found else pa.array([], kind)

    paths = rows["path"].combine_chunks() if len(ordinal) else pa.array([], pa.string())
    cases = pa.table({
        "root": each([r for r, _, _, _ in found], pa.string()),
        "snapshot_no": each([n for _, _, n, _ in found], pa.int32()),
        "path": paths.take(pa.array(at, mask=at < 0)).cast(pa.string()) if len(ordinal) else pa.nulls(len(at), pa.string()),
        "change_kind": each([k for _, _, _, k in found], pa.string()),
        "shard": pa.array(np.full(len(at), shard, dtype=np.int32)),
        "ordinal": pa.array(ordinals),
    })
    schema = pa.schema([
        ("root", pa.string()), ("snapshot_no", pa.int32()), ("path", pa.string()), ("change_kind", pa.string()), ("shard", pa.int32()), ("ordinal", pa.int32()),
        ("bitmap", pa.binary()), ("sizes", pa.list_(pa.int64())), ("mtimes", pa.list_(pa.int64())), ("hashes", pa.list_(pa.string())),
    ])
    cases = pa.table([cases[f.name] if f.name in cases.column_names else pa.nulls(len(at), f.type) for f in schema], schema=schema)
    return pa.concat_tables([cases, pa.Table.from_pylist(state, schema=schema)])


def _kept(r: dict, codes: dict[str, int], hashes: list[str]) -> Vectors:
    """The vectors kept of an earlier snapshot; hashes that are new here get further codes."""
    for h in r["hashes"]:
        if h is not None and h not in codes:
            codes[h] = len(hashes)
            hashes.append(h)
    known = {"size": np.array([v is not None for v in r["sizes"]], dtype=bool), "mtime_ns": np.array([v is not None for v in r["mtimes"]], dtype=bool), "hash": np.array([v is not None for v in r["hashes"]], dtype=bool)}
    columns = {
        "size": np.array([v or 0 for v in r["sizes"]], dtype=np.int64), "mtime_ns": np.array([v or 0 for v in r["mtimes"]], dtype=np.int64),
        "hash": np.array([-1 if v is None else codes[v] for v in r["hashes"]], dtype=np.int64),
    }
    return Vectors(Bitmap.from_bytes(r["bitmap"]).ordinals(), columns, known)


def _cases(before: Vectors, now: Vectors, no: int) -> Iterator[tuple[np.ndarray, int, str]]:
    for kind, ordinals in (
        ("new", now.bitmap.and_not(before.bitmap).ordinals()),
        ("deleted", before.bitmap.and_not(now.bitmap).ordinals()),
        ("modified", _changed(before, now, now.bitmap.and_(before.bitmap).ordinals())),
    ):
        if len(ordinals):
            yield ordinals, no, kind


class Listings:
    """Snapshots delivered to a folder, which keeps the dictionary of ordinals and the last snapshot of each root.

    The number of shards is fixed by the first delivery. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, shards: int | None = None):
        self.spark, self.shards = spark, shards
        self.state = State(spark, folder or new_folder(spark), {
            "ordinals": ("id bigint, shard int, root string, path string, ordinal int", "id"),
            "last": (f"id string, shard int, root string, snapshot_no int, {_VECTORS}", "id"),
            "roots": ("id string, root string, snapshot_no int", "id"),
        })

    @staticmethod
    def _id(*columns: Column) -> Column:
        """A key of columns of which the last may be null."""
        return F.concat(*[c.cast("string") for c in columns[:-1]], F.coalesce(F.concat(F.lit("/"), columns[-1]), F.lit("")))

    def deliver(self, states: DataFrame) -> DataFrame:
        """Paths added, removed and modified in each snapshot of ``states``, compared with the root's snapshot before it.

        Result: root, snapshot_no (the later one), path (clean), change_kind (``new``, ``deleted``, ``modified``); nothing
        for a root's first snapshot and for an empty delivery. Rules for values: sizes differ, mtimes more than 2 s apart,
        clean hashes differ; a value missing on either side is not compared. A delivery holds whole snapshots; those not after
        the last one known of their root are ignored. ``states`` is read once.
        """
        before = self.state.head()
        self.shards = before["marks"].get("shards") or self.shards or shard_count(states)
        known = self.state.read("ordinals") if before["number"] else None
        seen, last = self.state.read("roots"), self.state.read("last")
        rows = written(with_ordinals(held_listings(states, self.shards), known).select("shard", "root", "path", "snapshot_no", "ordinal", "size", "mtime_ns", "hash", "is_new"))
        held = rows.groupBy("root", "shard").agg(F.collect_set("snapshot_no").alias("numbers"))
        numbers = held.groupBy("root").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("numbers")))).alias("snapshots"))
        by_root = F.col("a.root").eqNullSafe(F.col("b.root"))
        numbers = numbers.alias("a").join(seen.alias("b"), by_root, "left").select("a.root", "snapshots", F.col("b.snapshot_no").alias("last_no"))
        pairs = held.select("shard", "root").unionByName(last.select("shard", "root")).distinct()
        roots = (
            pairs.alias("a").join(numbers.alias("b"), by_root).select("a.shard", "a.root", "snapshots", "last_no").alias("a")
            .join(last.alias("b"), by_root & (F.col("a.shard") == F.col("b.shard")), "left")
            .select(F.col("a.shard").alias("at_shard"), F.col("a.root").alias("of_root"), "snapshots", "last_no", "bitmap", "sizes", "mtimes", "hashes")
        )
        left = rows.drop("is_new").groupBy("shard").cogroup(roots.groupBy("at_shard"))
        out = written(left.applyInArrow(_diff_shard, _COMPARED))
        kept = out.where(F.col("change_kind") == _LAST)
        self.state.commit(
            puts={
                "ordinals": dictionary(rows).select(F.expr("shiftleft(CAST(shard AS BIGINT), 32) | ordinal").alias("id"), "shard", "root", "path", "ordinal"),
                "last": kept.select(self._id(F.col("shard"), F.col("root")).alias("id"), "shard", "root", "snapshot_no", "bitmap", "sizes", "mtimes", "hashes"),
                "roots": numbers.select(self._id(F.lit("root"), F.col("root")).alias("id"), "root", F.greatest(F.element_at("snapshots", -1), "last_no").alias("snapshot_no")),
            },
            # shards that a delivered root has left
            deletes={"last": pairs.alias("a").join(numbers.alias("b"), by_root).select("a.shard", "a.root").exceptAll(kept.select("shard", "root")).select(self._id(F.col("shard"), F.col("root")).alias("id"))},
            marks={"shards": self.shards},
        )
        cases = out.where(F.col("change_kind") != _LAST)
        spelled = cases.where("path is not null").select("root", "snapshot_no", "path", "change_kind")
        if known is None:
            return spelled
        gone = cases.where("path is null").select("root", "snapshot_no", "shard", "ordinal", "change_kind")
        return spelled.unionByName(gone.join(known.select("shard", "ordinal", "path"), ["shard", "ordinal"]).select("root", "snapshot_no", "path", "change_kind"))


def snapshot_changes(states: DataFrame, shards: int | None = None) -> DataFrame:
    """The changes of all snapshots in ``states``, as one delivery to a folder of its own; see ``Listings.deliver``."""
    return Listings(states.sparkSession, shards=shards).deliver(states)
