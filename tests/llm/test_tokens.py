from __future__ import annotations

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import bpe, packing, tokens
from tests.conftest import rows

if not os.path.exists(os.path.join(bpe.TOKENIZERS, "byte_bpe_50k.tiktoken")):
    pytest.skip("no vocabularies here", allow_module_level=True)
tiktoken = pytest.importorskip("tiktoken")

M = bpe.load()
REFERENCE = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=M.ranks, special_tokens={})
WORDS = st.sampled_from(["the ", "don't", " ", "  ", "\n\n", "1234", "héllo", "日本語", "👨‍👩‍👧", "!!!", "'re", "a" * 40, "\t", "ß", "<|endoftext|>", "नमस्ते", "‮"])


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=200), st.lists(WORDS, max_size=40).map("".join)), st.integers(1, 50))
def test_any_chunking_gives_the_reference_ids(text, chunk):
    text = text.encode("utf-8", "ignore").decode()
    want = REFERENCE.encode_ordinary(text)
    assert bpe.encode(text, M, chunk) == want
    assert "".join(bpe.decode(want, M)) == text


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 20_000 + " x", "7" * 9000, " " * 30_000 + "x", "\n" * 3000 + " a", "'" * 300 + "re", "é" * 2000, "!?" * 3000 + " don't", "Donaudampfschiff" * 900])
def test_endless_pieces(text):
    assert bpe.encode(text, M, 1000) == bpe.encode(text, M) == REFERENCE.encode_ordinary(text)


def test_memory_does_not_grow_with_a_piece():
    t = bpe.TextEncoder(M, 1024)
    most, ids = 0, []
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh") for _ in range(60_000))
    for i in range(0, len(text), 512):
        ids += t.feed(text[i : i + 512])
        most = max(most, len(t.rest) + (len(t.open.data) if t.open else 0))
    assert ids + t.finish() == REFERENCE.encode_ordinary(text)
    assert most < 4096


def test_corpus(spark):
    data = [(1, "Hello  world", "en"), (2, "", "en"), (3, None, None), (4, "x" * 100_000, "de"), (5, "<|endoftext|>", "en")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").selectExpr("*", "doc_id AS ids")
    got = {r["doc_id"]: r["ids"] for r in tokens.encoded(df).collect()}
    assert got == {i: REFERENCE.encode_ordinary(t or "") for i, t, _ in data}
    assert {r[0]: r[1] for r in tokens.token_counts(df).collect()} == {i: len(v) for i, v in got.items()}
    assert all(r["n_broken"] == 0 for r in tokens.round_trip(df).collect())
    assert tokens.encoded(df.where("false")).count() == 0


def least(items, capacity):
    """Fewest containers, by trying everything."""
    best, bound = [len(items)], -(-sum(items) // capacity)

    def go(k, bins):
        if len(bins) >= best[0] or best[0] == bound:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for room in {capacity - b for b in bins if b + items[k] <= capacity}:
            i = bins.index(capacity - room)
            bins[i] += items[k]
            go(k + 1, bins)
            bins[i] -= items[k]
        bins.append(items[k])
        go(k + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def containers(items, capacity):
    counts = {s: items.count(s) for s in items}
    assert packing.lower_bound(counts, capacity) <= least(sorted(items, reverse=True), capacity)
    return sum(t for _, t in packing.plan(counts, capacity))


def test_every_filling_counts():
    assert sum(t for _, t in packing.plan({i: 1 for i in range(20, 60)}, 100, nodes=0)) == sum(t for _, t in packing.best_fit({i: 1 for i in range(20, 60)}, 100))
    assert containers([20, 22, 28, 28, 30, 34, 41, 45, 50], 100) == 3


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(5, 60), min_size=8, max_size=13))
def test_plan_is_optimal_for_larger_capacities(items):
    assert containers(items, 100) == least(sorted(items, reverse=True), 100)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9))
def test_fillings_dominate_all_others(items):
    counts = {s: items.count(s) for s in items}
    sizes = sorted(counts, reverse=True)
    got = [dict(p) for _, p in packing.fillings(counts, sizes, 30, packing.Steps(10**9))]
    rest = sorted(items, reverse=True)[1:]
    for k in range(1 << len(rest)):  # any feasible set is dominated by one that came out: its items fit into that one's
        some = [x for i, x in enumerate(rest) if k >> i & 1]
        if sizes[0] + sum(some) <= 30:
            assert any(fits_into(some, [s for s, n in {**p, sizes[0]: p[sizes[0]] - 1}.items() for _ in range(n)]) for p in got)
    assert len({tuple(sorted(p.items())) for p in got}) == len(got)


def fits_into(items, rooms):
    """Whether the items can be put into the rooms, any number in each."""
    if not items:
        return True
    return any(r >= items[0] and fits_into(items[1:], [*rooms[:i], r - items[0], *rooms[i + 1 :]]) for i, r in enumerate(rooms))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_plan_is_optimal_on_small_inputs(items):
    counts: dict[int, int] = {}
    for i in items:
        counts[i] = counts.get(i, 0) + 1
    plan = packing.plan(counts, 20)
    used: dict[int, int] = {}
    for pattern, times in plan:
        assert sum(s * n for s, n in pattern) <= 20
        for s, n in pattern:
            used[s] = used.get(s, 0) + n * times
    assert used == counts
    assert sum(t for _, t in plan) == least(sorted(items, reverse=True), 20)


def test_packed(spark):
    rng = random.Random(3)
    data = [(i, rng.randint(0, 30)) for i in range(400)] + [(1000 + i, 7) for i in range(300)] + [(2000, 95), (2001, None), (2002, 40), (2003, 20)]
    df = spark.createDataFrame(data, "doc_id long, n_tokens long").selectExpr("*", "doc_id AS salt", "n_tokens AS size")
    got = packing.packed(df, [(1, 20), (2, 64)]).collect()
    for pack, capacity in ((1, 20), (2, 64)):
        mine = [r for r in got if r["pack_no"] == pack]
        fill: dict[int, int] = {}
        of_doc: dict[int, list] = {}
        for r in mine:
            fill[r["container_no"]] = fill.get(r["container_no"], 0) + r["n_tokens"]
            of_doc.setdefault(r["doc_id"], []).append((r["piece_no"], r["n_tokens"]))
        sizes: dict[int, int] = {}
        for r in mine:
            if r["n_tokens"]:
                sizes[r["n_tokens"]] = sizes.get(r["n_tokens"], 0) + 1
        assert max(fill.values()) <= capacity and len(fill) == max(fill)
        assert len(fill) <= sum(t for _, t in packing.best_fit(sizes, capacity))
        for i, n in data:
            pieces = sorted(of_doc[i])
            assert sum(x for _, x in pieces) == (n or 0) and len(pieces) == max(1, -(-(n or 0) // capacity))
            assert [p for p, _ in pieces] == list(range(1, len(pieces) + 1))
    assert packing.packed(df.where("false"), [(1, 20)]).count() == 0
    assert rows(packing.packed(df.where("doc_id = 2001"), [(1, 20)])) == [(1, 1, 2001, 1, 0)]
    assert packing.packed(df, []).count() == 0
