"""Deduplicating new batches of posts against everything accepted before.

A store keeps, of accepted posts only, their own words, their fingerprints and one block table per rotation. A batch is
fingerprinted, looks up exact block matches, counts differing bits of the candidates and compares the words of what is
left; unmatched posts are accepted and appended. History is read by the lookup alone and never fingerprinted again; it lies
in buckets by block, so the lookup moves the batch's rows only.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import fingerprints as fp
from siltstone.llm.owntext import own_words
from siltstone.operators.skew import hot_keys, salted_join
from siltstone.session import discard, drop_folder, get_text, names_in, new_folder, new_text, written

#: Posts with fewer own words are never judged.
LEAST_WORDS = 12
#: A repeat differs in at most 1/PART of the longer post's words.
PART = 4
#: Posts that differ in at most 1/TIGHT of their words' number of bits need not both be compared with later posts of a block in
#: the same round.
TIGHT = 8
#: Rows of a block that one task compares with one another; a block with more is split.
BLOCK_ROWS = 20_000
#: A block is hot with more than 1/HOT_POSTS of a batch's posts (and more than BLOCK_ROWS), so this times the blocks bounds the hot ones.
HOT_POSTS = 1000
#: Groups up to this size are compared pair by pair, larger ones by their heads.
SMALL = 64
#: Buckets of a new store's tables, by block and by doc_id.
STORE_BUCKETS = 32

BITS = [f"w{i}" for i in range(fp.WIDTH)]
_BITS_SQL = ", ".join(f"{w} bigint" for w in BITS)
PRINTS = f"doc_id bigint, n_words int, {_BITS_SQL}, blocks array<bigint>"
PAYLOAD = ["doc_id", "n_words", *BITS]
_WORDS_SQL = "doc_id bigint, words string"


def post_words(posts: DataFrame) -> DataFrame:
    """doc_id, words (own words joined by blanks), digest of every post that is judged; null authors are fine."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, text, author in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                w = own_words(text, author)
                if len(w) >= LEAST_WORDS:
                    ids.append(i)
                    out.append(" ".join(w))
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "words": pa.array(out, pa.string())})

    own = posts.select("doc_id", "text", "author").where("doc_id is not null and text is not null").mapInArrow(run, _WORDS_SQL)
    return own.select("doc_id", "words", F.unhex(F.md5("words")).alias("digest"))


def frequent_words(words: DataFrame) -> DataFrame:
    """word, part of the posts that have it, for words in at least 1/RARE_PART of all posts (a bounded number)."""
    each = words.select(F.explode(F.array_distinct(F.split("words", " "))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    posts = words.groupBy().agg(F.count(F.lit(1)).alias("n")).scalar()
    return each.where(F.col("n") * fp.RARE_PART >= posts).select("word", (F.col("n") / posts).alias("part"))


def fingerprinted(words: DataFrame, frequent: dict[str, float]) -> DataFrame:
    known = words.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = fp.Fingerprinter(known.value)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                posts = [w.split(" ") for w in part.column(1).to_pylist()]
                blocks, bits = make(posts)
                yield pa.record_batch({
                    "doc_id": part.column(0),
                    "n_words": pa.array([len(w) for w in posts], pa.int32()),
                    **{w: pa.array(np.ascontiguousarray(bits[:, i])) for i, w in enumerate(BITS)},
                    "blocks": pa.FixedSizeListArray.from_arrays(pa.array(blocks.reshape(-1)), fp.BLOCKS).cast(pa.list_(pa.int64())),
                })

    return words.select("doc_id", "words").mapInArrow(run, PRINTS)


def block_rows(prints: DataFrame) -> DataFrame:
    """The rotated tables in one: a row per post and block; the block's number is part of its key."""
    return prints.select(F.explode("blocks").alias("block"), *PAYLOAD)


def may_repeat(n: str, bits: list[str], m: str, other: list[str]) -> Column:
    """Whether lengths and bits allow a repeat. The distance is at least the lengths' difference and half the bits that differ."""
    most = F.floor(F.greatest(n, m) / PART)
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(bits, other, strict=True)])
    return (F.abs(F.col(n) - F.col(m)) <= most) & (apart <= 2 * most)


def hot_blocks(rows: DataFrame) -> DataFrame | None:
    """block, salts of the blocks that one task should not take alone, each part at most about BLOCK_ROWS or 1/HOT_POSTS of the posts.

    None if there are none. There are at most HOT_POSTS times BLOCKS, whatever the batch.
    """
    counts = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    size = F.greatest(F.lit(BLOCK_ROWS), F.ceil(total / fp.BLOCKS / HOT_POSTS))
    hot = counts.where(F.col("n") > BLOCK_ROWS).where(F.col("n") > size).select("block", F.ceil(F.col("n") / size).cast("int").alias("salts")).collect()
    return rows.sparkSession.createDataFrame(hot, "block bigint, salts int") if hot else None


def _lookup(rows: DataFrame, old: DataFrame, hot: DataFrame | None) -> DataFrame:
    """doc_id_a, doc_id_b: ``rows`` (block rows of new posts) with the earlier posts of ``old`` that share a block and may be repeated."""
    o = old.select("block", *[F.col(c).alias(f"old_{c}") for c in PAYLOAD])
    fits = (F.col("old_doc_id") < F.col("doc_id")) & may_repeat("n_words", BITS, "old_n_words", [f"old_{w}" for w in BITS])
    pair = [F.col("old_doc_id").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b")]
    if hot is None:
        return rows.join(o, "block").where(fits).select(*pair)
    h = F.broadcast(hot.select("block"))
    cold = rows.join(h, "block", "left_anti").join(o, "block").where(fits).select(*pair)
    split = salted_join(rows.join(h, "block", "left_semi"), o.join(h, "block", "left_semi"), "block", [F.col("doc_id")], hot)
    return cold.unionByName(split.where(fits).select(*pair))


def history_pairs(prints: DataFrame, blocks: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """doc_id_a, doc_id_b: posts of ``prints`` and earlier posts of the block table ``blocks`` with a common block and few differing bits.

    ``blocks`` is not moved where it lies in buckets by block. The ``hot`` blocks of the posts meet it in salted parts.
    """
    return _lookup(block_rows(prints), blocks, hot).distinct()


def _compare(n: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of row numbers that may be repeats, and whether each is tight."""
    longer = np.maximum(n[i], n[j])
    keep = np.abs(n[i] - n[j]) <= longer // PART
    i, j, longer = i[keep], j[keep], longer[keep]
    apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
    keep = apart <= 2 * (longer // PART)
    return i[keep], j[keep], apart[keep] * TIGHT <= longer[keep]


def _small_groups(place: np.ndarray, size: np.ndarray, n: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs within groups of few rows; ``place`` is a row's number in its group. All groups move by one distance at a time."""
    left = np.arange(len(n))
    for d in range(1, SMALL):
        left = left[place[left] + d < size[left]]
        if not len(left):
            return
        for at in range(0, len(left), 1 << 16):
            i = left[at : at + (1 << 16)]
            yield _compare(n, bits, i, i + d)


def _large_group(n: np.ndarray, bits: np.ndarray) -> tuple[list, np.ndarray]:
    """Pairs of one group, each row with the heads before it, and which rows are heads (tight to no row before them)."""
    heads, found = np.zeros(0, dtype=np.int64), []
    step = 256
    for at in range(0, len(n), step):
        rows = np.arange(at, min(at + step, len(n)))
        k, l = np.triu_indices(len(rows), 1)
        inner = _compare(n, bits, rows[k], rows[l])
        loose = np.zeros(len(rows), dtype=bool)
        loose[inner[1][inner[2]] - at] = True
        parts = [inner]
        for h in range(0, len(heads), 1024):
            some = heads[h : h + 1024]
            near = _compare(n, bits, np.tile(some, len(rows)), np.repeat(rows, len(some)))
            loose[near[1][near[2]] - at] = True
            parts.append(near)
        found += parts
        heads = np.concatenate([heads, rows[~loose]])
    return found, heads


_NEAR = f"doc_id_a bigint, doc_id_b bigint, tight boolean, block bigint, {', '.join(f'{c} {k}' for c, k in [('doc_id', 'bigint'), ('n_words', 'int')] + [(w, 'bigint') for w in BITS])}"


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within groups; rows sorted by (block, part, doc_id). Of groups with ``split`` the heads come out as rows too.

    A group stays in memory until its last row has come; splitting bounds it. A post tight to an earlier one of its group is
    compared with no later one there.
    """
    kept: list[pa.RecordBatch] = []

    def pairs_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, n = t["doc_id"].to_numpy(), t["n_words"].to_numpy().astype(np.int64)
        bits = np.stack([t[w].to_numpy() for w in BITS], axis=1).view(np.uint64)
        block, part, split = t["block"].to_numpy(), t["part"].to_numpy(), t["split"].to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (part[1:] != part[:-1])])
        sizes = np.diff(np.r_[first, len(ids)])
        small = np.repeat(sizes <= SMALL, sizes)
        size, place = np.repeat(sizes, sizes), np.arange(len(ids)) - np.repeat(first, sizes)
        found = list(_small_groups(place, np.where(small, size, 0), n, bits))
        i, j, tight = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in range(3))
        loose = np.zeros(len(ids), dtype=bool)
        loose[j[tight.astype(bool)]] = True
        out = [(i, j, tight)]
        for at, count in zip(first[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            more, heads = _large_group(n[at : at + count], bits[at : at + count])
            out += [(a + at, b + at, c) for a, b, c in more]
            loose[at : at + count] = True
            loose[at + heads] = False
        i, j, tight = (np.concatenate([f[k] for f in out]) for k in range(3))
        keep = ~loose[i]
        i, j, tight = i[keep], j[keep], tight[keep].astype(bool)
        none = pa.nulls(len(i), pa.int64())
        for at in range(0, len(i), 1 << 16):
            k = slice(at, at + (1 << 16))
            none = pa.nulls(len(i[k]), pa.int64())
            yield pa.record_batch({"doc_id_a": pa.array(ids[i[k]]), "doc_id_b": pa.array(ids[j[k]]), "tight": pa.array(tight[k]), "block": none, "doc_id": none, "n_words": none.cast(pa.int32()), **dict.fromkeys(BITS, none)})
        heads = np.flatnonzero(split & ~loose)
        if len(heads):
            rows = t.take(pa.array(heads)).combine_chunks()
            none = pa.nulls(len(heads), pa.int64())
            yield pa.record_batch({"doc_id_a": none, "doc_id_b": none, "tight": none.cast(pa.bool_()), **{c: rows[c].combine_chunks() if isinstance(rows[c], pa.ChunkedArray) else rows[c] for c in ["block", *PAYLOAD]}})

    for b in batches:
        if not b.num_rows:
            continue
        last = (b["block"][b.num_rows - 1].as_py(), b["part"][b.num_rows - 1].as_py())
        begun = pc.and_(pc.equal(b["block"], last[0]), pc.equal(b["part"], last[1])).to_numpy(zero_copy_only=False)
        cut = int(begun.argmax())
        if cut or (kept and (kept[0]["block"][0].as_py(), kept[0]["part"][0].as_py()) != last):
            yield from pairs_of(pa.Table.from_batches([*kept, b.slice(0, cut)]))
            kept = []
        kept.append(b.slice(cut))
    if kept:
        yield from pairs_of(pa.Table.from_batches(kept))


def _within(rows: DataFrame) -> DataFrame:
    """``_near`` over groups of (block, part)."""
    rows = rows.select("block", "part", "split", *PAYLOAD)
    return rows.repartition("block", "part").sortWithinPartitions("block", "part", "doc_id").mapInArrow(_near, _NEAR)


def batch_pairs(prints: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """doc_id_a < doc_id_b, tight: posts of one batch with a common block and few differing bits.

    A hot block is split into parts by the hash of doc_id; what is left of near-copies in each part (its heads) meets again,
    every two parts in a task of their own. A post that is tight to an earlier one of a block may lack comparisons within
    that block.
    """
    rows = block_rows(prints)
    if hot is None:
        near = _within(rows.select("*", F.lit(0).alias("part"), F.lit(False).alias("split")))
    else:
        marked = rows.join(F.broadcast(hot), "block", "left")
        part = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("salts"))).cast("int")
        near = written(_within(marked.select("*", part.alias("part"), F.col("salts").isNotNull().alias("split"))))
        heads = near.where("doc_id is not null").select("block", *PAYLOAD)
        again = heads.groupBy("block").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.lit(1)).cast("int").alias("salts"))
        part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("salts")).cast("int")
        placed = heads.join(F.broadcast(again), "block").withColumn("own", part)
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        two = F.least("own", "other") * F.col("salts") + F.greatest("own", "other")
        near = near.unionByName(_within(placed.select("*", two.alias("part"), F.lit(False).alias("split"))))
    return near.where("doc_id_a is not null").groupBy("doc_id_a", "doc_id_b").agg(F.max("tight").alias("tight"))


def pairs_with(some: DataFrame, prints: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """doc_id_a < doc_id_b: the posts of ``some`` (prints) with every post that shares a block and may be a repeat."""
    rows = block_rows(prints)
    one = block_rows(some)
    met = one.select("block", *[F.col(c).alias(f"old_{c}") for c in PAYLOAD])
    both = salted_join(rows, met, "block", [F.col("doc_id")], hot) if hot is not None else rows.join(met, "block")
    both = both.where((F.col("doc_id") != F.col("old_doc_id")) & may_repeat("n_words", BITS, "old_n_words", [f"old_{w}" for w in BITS]))
    return both.select(F.least("doc_id", "old_doc_id").alias("doc_id_a"), F.greatest("doc_id", "old_doc_id").alias("doc_id_b")).distinct()


def verified(pairs: DataFrame, words_a: DataFrame, words_b: DataFrame) -> DataFrame:
    """doc_id_a, doc_id_b, distance of the pairs whose words really repeat. A post in many pairs is spread over salts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fp.repeats(x.split(" "), y.split(" "), PART) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            ok = pa.array([f is not None for f in found], pa.bool_())
            out = pa.record_batch({"doc_id_a": b.column(0), "doc_id_b": b.column(1), "distance": pa.array(found, pa.int32())})
            yield out.filter(ok)

    a = words_a.select(F.col("doc_id").alias("doc_id_a"), F.col("words").alias("words_a"))
    b = words_b.select(F.col("doc_id").alias("doc_id_b"), F.col("words").alias("words_b"))
    a = a.join(pairs.select("doc_id_a").distinct(), "doc_id_a", "left_semi")
    b = b.join(pairs.select("doc_id_b").distinct(), "doc_id_b", "left_semi")
    hot = hot_keys(pairs.groupBy("doc_id_a").agg(F.count(F.lit(1)).alias("n")), "doc_id_a", "n")
    both = salted_join(pairs, a, "doc_id_a", [F.col("doc_id_b")], hot).join(b, "doc_id_b")
    return both.select("doc_id_a", "doc_id_b", "words_a", "words_b").mapInArrow(run, "doc_id_a bigint, doc_id_b bigint, distance int")


def _nearest(edges: DataFrame) -> DataFrame:
    best = edges.groupBy("doc_id_b").agg(F.min(F.struct("distance", "doc_id_a")).alias("best"))
    return best.select(F.col("best.doc_id_a").alias("doc_id_a"), "doc_id_b")


def settle(edges: DataFrame) -> DataFrame:
    """doc_id_a, doc_id_b of the repeats when posts are taken in order of doc_id; ``edges`` are all pairs that fit.

    Posts that are no later end of an open edge are accepted, which makes repeats of their partners and closes the
    partners' edges. The first open post is always settled, so the rounds end; there are as many as repeats of repeats
    follow one another.
    """
    repeats, left = None, edges
    while True:
        later = left.select(F.col("doc_id_b").alias("doc_id_a")).distinct()
        found = written(left.join(later, "doc_id_a", "left_anti").select("doc_id_b").distinct())
        if found.isEmpty():
            break
        repeats = found if repeats is None else repeats.unionByName(found)
        before = left
        left = written(left.join(found, "doc_id_b", "left_anti").join(found.withColumnRenamed("doc_id_b", "doc_id_a"), "doc_id_a", "left_anti"))
        if before is not edges:
            discard(before)
        if left.isEmpty():
            break
    if repeats is None:
        return edges.select("doc_id_a", "doc_id_b")
    return _nearest(edges.join(repeats.withColumnRenamed("doc_id_b", "doc_id_a"), "doc_id_a", "left_anti"))


def resolve(prints: DataFrame, words: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """doc_id_a, doc_id_b of the repeats within one batch.

    Posts tight to another were not compared with all. Those of them that turn out as accepted are compared with every
    post that shares a block, and the batch is settled again, until no such post is left.
    """
    pairs = written(batch_pairs(prints, hot))
    edges = written(verified(pairs.select("doc_id_a", "doc_id_b"), words, words))
    tight = pairs.where("tight").select(F.col("doc_id_b").alias("doc_id")).distinct()
    while True:
        repeats = written(settle(edges))
        unsure = tight.join(repeats.select(F.col("doc_id_b").alias("doc_id")), "doc_id", "left_anti")
        if unsure.isEmpty():
            return repeats
        unsure = written(unsure)
        some = prints.join(unsure, "doc_id", "left_semi")
        more = pairs_with(some, prints, hot).join(pairs, ["doc_id_a", "doc_id_b"], "left_anti")
        before = edges
        edges = written(edges.unionByName(verified(written(more), words, words)).distinct())
        discard(before)
        tight = written(tight.join(unsure, "doc_id", "left_anti"))


class Store:
    """Accepted posts in a folder: ``frequent`` (fixed at the first batch), ``words`` and ``blocks`` (one part a batch).

    ``blocks`` lies in buckets by block and ``words`` in buckets by doc_id, so lookups move only a batch's rows. A commit
    names the parts that count; one follows the other, and each is made after its parts. A store opened on a folder goes on
    from its last commit; parts that no commit names are of a delivery that failed and are removed. One writer at a time.
    """

    _TABLES = {"words": (_WORDS_SQL, "doc_id"), "blocks": (f"block bigint, doc_id bigint, n_words int, {_BITS_SQL}", "block")}

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = STORE_BUCKETS):
        self.spark, self.folder = spark, folder or new_folder(spark)
        self.buckets = self._head().get("buckets", buckets)

    def _head(self) -> dict:
        """The last commit: number, parts, buckets; read anew each time."""
        numbers = sorted(n for n in names_in(self.spark, f"{self.folder}/commits") if n.endswith(".json") and n[0].isdigit())
        return json.loads(get_text(self.spark, f"{self.folder}/commits/{numbers[-1]}")) if numbers else {"number": 0, "parts": []}

    def committed(self) -> list[int]:
        """Numbers of the parts that count."""
        return self._head()["parts"]

    def _name(self, table: str) -> str:
        """The table's name in the session's catalog, where it is entered if it is not there yet."""
        columns, key = self._TABLES[table]
        name = f"siltstone_{table}_{hashlib.md5(self.folder.encode()).hexdigest()[:16]}"
        if not self.spark.catalog.tableExists(name):
            at = f"{self.folder}/{table}".replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} ({columns}, batch int) USING parquet PARTITIONED BY (batch) CLUSTERED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{at}'")
        return name

    def _table(self, table: str, parts: list[int]) -> DataFrame:
        name = self._name(table)
        self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        return self.spark.table(name).where(F.col("batch").isin(parts)).drop("batch")

    def _add(self, table: str, part: int, rows: DataFrame) -> None:
        name, (columns, key) = self._name(table), self._TABLES[table]
        self.spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (batch = {part})")
        drop_folder(self.spark, f"{self.folder}/{table}/batch={part}")
        names = [c.split(" ")[0] for c in columns.split(", ")]
        rows.select(*names, F.lit(part).alias("batch")).repartition(self.buckets, key).write.insertInto(name)

    def _commit(self, head: dict, parts: list[int]) -> None:
        number = head["number"] + 1
        commit = {"number": number, "parts": parts, "buckets": self.buckets}
        if not new_text(self.spark, f"{self.folder}/commits/{number:09d}.json", json.dumps(commit)):
            raise RuntimeError(f"commit {number} of {self.folder} was made by another writer")

    def compact(self) -> None:
        """Puts all parts into one, so that lookups open few files. The old parts stay for readers until the next ``compact``."""
        head = self._head()
        if len(head["parts"]) < 2:
            return
        part = head["parts"][-1] + 1
        for table in self._TABLES:
            self._add(table, part, self._table(table, head["parts"]))
        self._commit(head, [part])
        for table in self._TABLES:
            for name in names_in(self.spark, f"{self.folder}/{table}"):
                if name.startswith("batch=") and int(name[6:]) < head["parts"][0]:
                    drop_folder(self.spark, f"{self.folder}/{table}/{name}")

    def append(self, posts: DataFrame, keep: bool = True) -> DataFrame:
        """doc_id_a, doc_id_b for every post b of the batch that repeats an accepted post a; the rest is accepted.

        Posts of a batch follow those of earlier batches in doc_id. Posts with fewer than LEAST_WORDS own words (null, empty
        and blank ones too) are not judged and not kept. Of several accepted posts that fit, the nearest counts, then
        the one with the smaller id. Exact copies are settled by their digest. ``keep=False`` leaves the store as it is,
        for a batch after which nothing comes.
        """
        words = written(post_words(posts))
        groups = words.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")
        copies = salted_join(words.select("doc_id", "digest"), groups.select("digest", "first"), "digest", [F.col("doc_id")], hot_keys(groups, "digest", "n"))
        copies = written(copies.where("doc_id <> first").select("doc_id", "first"))
        own = words.join(copies, "doc_id", "left_anti")
        head = self._head()
        parts = head["parts"]
        weighed = frequent_words(words) if not parts else self.spark.read.parquet(f"{self.folder}/frequent")
        if keep and not parts:  # nothing committed was fingerprinted with what a failed first batch may have left
            weighed = written(weighed, f"{self.folder}/frequent")
        frequent = {r["word"]: r["part"] for r in weighed.collect()}
        prints = written(fingerprinted(own, frequent))
        hot = hot_blocks(block_rows(prints))
        if not parts:
            repeats = resolve(prints, words, hot)
            accepted = prints.join(repeats.select(F.col("doc_id_b").alias("doc_id")), "doc_id", "left_anti")
        else:
            edges = written(verified(written(history_pairs(prints, self._table("blocks", parts), hot)), self._table("words", parts), words))
            met = edges.select(F.col("doc_id_b").alias("doc_id")).distinct()
            fresh = prints.join(met, "doc_id", "left_anti")
            more = resolve(fresh, words, hot)
            accepted = fresh.join(more.select(F.col("doc_id_b").alias("doc_id")), "doc_id", "left_anti")
            # a post that repeats history may be nearer to one that its own batch brought
            pairs = written(history_pairs(prints.join(met, "doc_id", "left_semi"), block_rows(accepted), hot))
            repeats = written(_nearest(edges.unionByName(verified(pairs, words, words))).unionByName(more))
        if keep:
            part = parts[-1] + 1 if parts else 0
            self._add("words", part, words.join(accepted.select("doc_id"), "doc_id", "left_semi"))
            self._add("blocks", part, block_rows(accepted))
            self._commit(head, [*parts, part])
        of_copies = salted_join(
            copies, repeats.select(F.col("doc_id_b").alias("first"), "doc_id_a"), "first", [F.col("doc_id")],
            hot_keys(copies.groupBy("first").agg(F.count(F.lit(1)).alias("n")), "first", "n"), "left",
        )
        of_copies = of_copies.select(F.coalesce("doc_id_a", "first").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"))
        return repeats.unionByName(of_copies)
