"""Filling fixed-capacity containers with items by bin completion.

Items matter only by size, so the search runs over the histogram of sizes, which a capacity bounds whatever the number of
items. Around the largest size left, undominated fillings are enumerated, least waste first, each when it is asked for; the
first is applied as often as the counts allow. Branch and bound over all of these choices is pruned by the waste still
affordable, with best fit as first incumbent. Items then find their container from their rank within their size, without
being gathered anywhere.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import bpe
from siltstone.llm.tokens import token_counts
from siltstone.session import written

#: Steps that the branch and bound may take, looked-at fillings included. They bound the driver's work, not the items: where they run out the best solution so
#: far holds, and ``least_containers`` of the summary shows how far it may be from the best.
NODES = 50_000
#: Parts into which the items of one size are split for ranking.
SALTS = 1024

Pattern = tuple[tuple[int, int], ...]  # (size, copies)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over the histogram: each container takes the largest item that still fits."""
    left, sizes, out = dict(counts), sorted(counts, reverse=True), []
    while sizes:
        room, pattern = capacity, []
        for s in sizes:
            if s <= room:
                n = min(left[s], room // s)
                pattern.append((s, n))
                room -= n * s
                if not room:
                    break
        times = min(left[s] // n for s, n in pattern)
        out.append((tuple(pattern), times))
        for s, n in pattern:
            left[s] -= n * times
        sizes = [s for s in sizes if left[s]]
    return out


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Containers that any solution needs: the volume, or items above the rest of a threshold, which go into one each, plus what those above the
    half leave no room for."""
    sizes = sorted(s for s, n in counts.items() if n)
    total = sum(s * counts[s] for s in sizes)
    best = -(-total // capacity)
    for k in [0, *[s for s in sizes if 2 * s <= capacity]]:
        huge = sum(counts[s] for s in sizes if s > capacity - k)
        large = [s for s in sizes if capacity - k >= s and 2 * s > capacity]
        rest = sum(s * counts[s] for s in sizes if k <= s and 2 * s <= capacity)
        n_large = sum(counts[s] for s in large)
        room = n_large * capacity - sum(s * counts[s] for s in large)
        best = max(best, huge + n_large + max(0, -(-(rest - room) // capacity)))
    return best


def _dominated(chosen: dict[int, int], spare: dict[int, int], sizes: list[int], waste: int) -> bool:
    """Whether swapping some of the items (or none) for one unused item fills the container no less and leaves no more over.

    ``chosen`` are the items beside the largest. Sums of at least one and of at least two of them are kept as bit sets.
    """
    one, two = 0, 0
    for s, n in chosen.items():
        for _ in range(n):
            two |= two << s | one << s
            one |= one << s | 1 << s
    for x in sizes:
        if spare[x] <= chosen.get(x, 0):
            continue
        if x <= waste:
            return True
        low = x - waste
        if waste and one >> low & ((1 << waste) - 1) or two >> x & 1:
            return True
    return False


class Steps:
    """What is left of the steps of a search."""

    def __init__(self, n: int):
        self.left = n

    def take(self) -> None:
        self.left -= 1
        if self.left < 0:
            raise OutOfSteps


class OutOfSteps(Exception):
    pass


def fillings(left: dict[int, int], sizes: list[int], capacity: int, steps: Steps) -> Iterator[tuple[int, Pattern]]:
    """(waste, pattern) of all undominated fillings around the largest size, least waste first, each found when asked for.

    ``sizes`` has the sizes left, descending. Each filling looked at is a step. Sums that can still be reached are kept as bit sets, so nothing is tried in vain.
    """
    top = sizes[0]
    room = capacity - top
    spare = dict(left)
    spare[top] -= 1
    fits = [s for s in sizes if s <= room and spare[s]]
    mask = (1 << (room + 1)) - 1
    reach = [1] * (len(fits) + 1)
    for i in range(len(fits) - 1, -1, -1):
        r, n, k = reach[i + 1], min(spare[fits[i]], room // fits[i]), 1
        while n:
            t = min(k, n)
            r |= r << (fits[i] * t) & mask
            n, k = n - t, 2 * k
        reach[i] = r

    def sums(i: int, target: int) -> Iterator[tuple[tuple[int, int], ...]]:
        if not target:
            yield ()
            return
        for j in range(i, len(fits)):
            if not reach[j] >> target & 1:
                return
            s = fits[j]
            for n in range(min(spare[s], target // s), 0, -1):
                if reach[j + 1] >> (target - n * s) & 1:
                    for rest in sums(j + 1, target - n * s):
                        yield ((s, n), *rest)

    for waste in range(room + 1):
        if reach[0] >> (room - waste) & 1:
            for chosen in sums(0, room - waste):
                steps.take()
                taken = dict(chosen)
                if not _dominated(taken, spare, fits, waste):
                    taken[top] = taken.get(top, 0) + 1
                    yield waste, tuple(sorted(taken.items(), reverse=True))


class _Choices:
    """The choices at one state of the search: fillings as often as the counts allow, then the same fewer times.

    Fillings are found in growing portions and what finding them needs is not kept, so a deep search stays small.
    """

    def __init__(self):
        self.seen, self.portion, self.waiting, self.over = 0, 1, [], False

    def next(self, left: dict[int, int], sizes: list[int], capacity: int, most: int, steps: Steps) -> tuple[int, Pattern, int] | None:
        """The next choice whose filling wastes at most ``most``."""
        while True:
            if not self.waiting:
                if self.over:
                    return None
                found = list(islice(fillings(left, sizes, capacity, steps), self.seen, self.seen + self.portion))
                self.over = len(found) < self.portion or found[-1][0] > most
                self.seen += len(found)
                self.portion *= 8
                often = [(w, p, min(left[s] // n for s, n in p)) for w, p in found if w <= most]
                self.waiting = [(w, p, t) for w, p, m in reversed(often) for t in range(1, m)] + often[::-1]
                continue
            step = self.waiting.pop()
            if step[0] <= most:
                return step


def plan(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is filled; every item of the histogram is used exactly once.

    Sizes lie between 1 and the capacity. The solution is optimal when it meets ``lower_bound`` or when the search ends
    within ``nodes`` steps; otherwise it is the best one found. Never more containers than best_fit.
    """
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return []
    total = sum(s * n for s, n in counts.items())
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    bins = sum(t for _, t in best)
    left, sizes = dict(counts), sorted(counts, reverse=True)
    # states are known by sums of random numbers of 128 bits; a state met again with as many containers leads nowhere new
    rng = random.Random(7)
    code = {s: rng.getrandbits(128) for s in counts}
    state, met = 0, {}

    def use(p: Pattern, times: int) -> None:
        nonlocal sizes, state
        for s, n in p:
            left[s] -= n * times
            state += n * times * code[s]
        sizes = [s for s in sizes if left[s]] if times > 0 else sorted((s for s, n in left.items() if n), reverse=True)

    stack, done, used, waste, steps = [_Choices()], [], 0, 0, Steps(nodes)
    while stack and bins > bound:
        try:
            steps.take()
            step = stack[-1].next(left, sizes, capacity, (bins - 1) * capacity - total - waste, steps)
        except OutOfSteps:
            break
        if step is None:
            stack.pop()
            if done:
                p, times, w = done.pop()
                use(p, -times)
                used, waste = used - times, waste - w * times
            continue
        w, p, times = step
        if waste + w * times > (bins - 1) * capacity - total:
            continue
        use(p, times)
        used, waste = used + times, waste + w * times
        if not sizes and used < bins:
            best, bins = [*((q, t) for q, t, _ in done), (p, times)], used
        if sizes and met.get(state, bins) > used:
            met[state] = used
            done.append((p, times, w))
            stack.append(_Choices())
        else:
            use(p, -times)
            used, waste = used - times, waste - w * times
    return best


def steps(solution: list[tuple[Pattern, int]]) -> dict[int, list[tuple[int, int, int]]]:
    """Per size (first rank, first container, copies per container), by rank; containers count from 1."""
    used: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int]]] = {}
    container = 1
    for pattern, times in solution:
        for s, n in pattern:
            at = used.get(s, 0)
            out.setdefault(s, []).append((at, container, n))
            used[s] = at + n * times
        container += times
    return out


def _cut(n: Column, pack: int, capacity: int) -> Column:
    """The pieces of an item of n tokens: structs of pack_no, piece_no, size."""
    def piece(k: Column) -> Column:
        size = F.least(n - (k - 1) * capacity, F.lit(capacity)).cast("int")
        return F.struct(F.lit(pack).cast("int").alias("pack_no"), k.alias("piece_no"), size.alias("size"))

    return F.transform(F.sequence(F.lit(1), F.greatest(F.ceil(n / capacity), F.lit(1)).cast("int")), piece)


def packed(items: DataFrame, capacities: list[tuple[int, int]], nodes: int = NODES) -> DataFrame:
    """pack_no, container_no, doc_id, piece_no, n_tokens: every item in a container of each capacity.

    ``items`` has doc_id and n_tokens and must be stable (a written table); ``capacities`` lists (pack_no, capacity). An
    item larger than the capacity is cut into pieces of the capacity and a rest, numbered from 1; any other is one piece.
    Items without tokens (0 or null) take no room and lie in container 1. The histogram brought to the driver has at most
    ``capacity`` rows per pack.
    """
    n = F.coalesce("n_tokens", F.lit(0))
    each = [_cut(n, pack, capacity) for pack, capacity in capacities]
    if not each:
        return items.where("false").selectExpr("0 AS pack_no", "0L AS container_no", "doc_id", "0 AS piece_no", "0 AS n_tokens")
    pieces = items.select("doc_id", F.inline(F.concat(*each)))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(SALTS)).cast("int"))
    counts = pieces.where("size > 0").groupBy("pack_no", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram: dict[int, dict[int, int]] = {}
    for r in counts.groupBy("pack_no", "size").agg(F.sum("n").alias("n")).collect():
        histogram.setdefault(r["pack_no"], {})[r["size"]] = r["n"]
    rows = [
        (pack, size, [tuple(s) for s in at])
        for pack, capacity in capacities
        for size, at in steps(plan(histogram.get(pack, {}), capacity, nodes)).items()
    ]
    found = items.sparkSession.createDataFrame(rows, "pack_no int, size int, steps array<struct<rank: bigint, container: bigint, copies: bigint>>")
    upto = Window.partitionBy("pack_no", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pack_no", "size", "salt", "n", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset"))
    # each part of a size keeps the steps that its ranks lie in
    later = F.filter("steps", lambda s: (s["rank"] > F.col("offset")) & (s["rank"] < F.col("offset") + F.col("n")))
    at = F.element_at(F.filter("steps", lambda s: s["rank"] <= F.col("offset")), -1)
    offsets = offsets.join(found, ["pack_no", "size"]).select("pack_no", "size", "salt", "offset", F.concat(F.array(at), later).alias("steps"))
    within = Window.partitionBy("pack_no", "size", "salt").orderBy("doc_id", "piece_no")
    ranked = pieces.where("size > 0").withColumn("nth", F.row_number().over(within) - 1).join(offsets, ["pack_no", "size", "salt"])
    placed = ranked.withColumn("rank", F.col("nth") + F.col("offset"))
    step = F.element_at(F.filter("steps", lambda s: s["rank"] <= F.col("rank")), -1)
    placed = placed.withColumn("step", step)
    container = (F.col("step.container") + F.floor((F.col("rank") - F.col("step.rank")) / F.col("step.copies"))).cast("bigint")
    out = placed.select("pack_no", container.alias("container_no"), "doc_id", "piece_no", F.col("size").alias("n_tokens"))
    nothing = pieces.where("size = 0").select("pack_no", F.lit(1).cast("bigint").alias("container_no"), "doc_id", "piece_no", F.col("size").alias("n_tokens"))
    return out.unionByName(nothing)


def packed_documents(docs: DataFrame, packs: DataFrame, name: str = "byte_bpe_50k", folder: str = bpe.TOKENIZERS) -> DataFrame:
    """Containers of every document for each row of ``packs`` (pack_no, capacity_tokens; a small fixed table)."""
    sizes = [(r["pack_no"], r["capacity_tokens"]) for r in packs.select("pack_no", "capacity_tokens").distinct().collect()]
    return packed(written(token_counts(docs, name, folder)), sorted(sizes))


def packing_summary(filled: DataFrame, packs: DataFrame) -> DataFrame:
    """pack_no, capacity_tokens, n_containers, least_containers (volume bound), n_pieces, n_tokens, unused_tokens."""
    per = filled.groupBy("pack_no", "container_no").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    all_ = per.groupBy("pack_no").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("t").alias("n_tokens"))
    j = all_.join(packs.select("pack_no", "capacity_tokens"), "pack_no")
    least = F.ceil(F.col("n_tokens") / F.col("capacity_tokens"))
    return j.select("pack_no", "capacity_tokens", "n_containers", least.alias("least_containers"), "n_pieces", "n_tokens", (F.col("n_containers") * F.col("capacity_tokens") - F.col("n_tokens")).alias("unused_tokens"))
