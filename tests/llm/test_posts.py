from __future__ import annotations

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import dedup
from siltstone.llm import fingerprints as fp
from siltstone.llm import problems
from siltstone.llm import subjects as sub
from siltstone.llm.owntext import own_text, own_words, sentences_of
from tests.conftest import rows


@pytest.mark.parametrize("text, words", [
    (None, ""), ("", ""), ("&nbsp;", ""), ("A<b>b</b> &quot;c&quot;", "ab c"), ("one<br>two<br />three", "one two three"),
    ("> quoted\n>> more\nmine", "mine"), ("@bob_1 said\n| quoted\nmine", "mine"), ("On 01/02/23, bob wrote:\n> q\nmine", "mine"), ("bob a écrit le 2023-01-01 10:11 :\n>q\nmien", "mien"),
    ("[quote=a][quote=b]deep[/quote]\nouter[/quote]\nmine", "mine"), ("[quote=a]never closed. [...]\nmine too", "mine too"), ("<blockquote><p>q</p></blockquote>mine", "mine"),
    ("mine\n-- \nsig one\nsig two", "mine"), ("mine\n[sig]Sent from my X 1", "mine"), ("mine\n<hr>\nsig", "mine"), ("mine\n______\nsig", "mine"),
    ("mine\n\nCheers, bob12", "mine"), ("mine\nLove, bob", "mine"), ("a­b c​d ‮ef‬", "ab cd ef"), ("été", "été"), ("[url=http://x.y/z]link[/url] [i]i[/i]", "link i"), ("Ab-C d1", "ab c d1"),
])
def test_own_words(text, words):
    assert " ".join(own_words(text, "bob")) == words


@pytest.mark.parametrize("text, words", [
    (f"a [url=http://x.y/{'p' * 5000}]b[/url] <a href='{'q' * 5000}'>c</a>", "a b c"), ("a <!-- " + "x " * 500 + "--> b <!-- c", "a b c"),
    ("a&#" + "0" * 50 + "65;b &#x41; &" + "n" * 60 + "; &#" + "9" * 5000 + ";c", "aab a " + "n" * 60 + " c"), ("x <b y <i>z", "x b y z"),
])
def test_markup_of_any_length(text, words):
    assert " ".join(own_words(text)) == words


@pytest.mark.parametrize("part", ["<!--", "<a ", "[url=", "&#1", "[quote=", "<b [i="])
def test_own_text_is_linear(part):
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        own_text(part * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_long_text_is_taken_whole():
    assert len(own_words("word " * 200_000)) == 200_000


def test_sentences():
    assert sentences_of("One two 3.5 three. Four five! ¿Six? \"Seven.\" and\neight\n\nnine") == ["One two 3.5 three.", "Four five!", "¿Six?", "\"Seven.\" and eight", "nine"]


WORDS = [f"w{i}" for i in range(60)]


def slow_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14), st.integers(0, 14))
def test_word_distance(a, b, most):
    want = slow_distance(a, b)
    assert fp.word_distance(a, b, most) == (want if want <= most else None)
    part = max(len(a), len(b)) // 4
    assert fp.repeats(a, b) == (want if want <= part else None)


@pytest.mark.parametrize("part, least", [(6, 0.995), (4, 0.95)])
def test_edits_by_rare_words_are_met(part, least):
    rng = random.Random(part)
    frequent = {f"c{i}": 0.5 / (i + 1) for i in range(300)}
    make, posts, n = fp.Fingerprinter(frequent), [], 400
    for k in range(n):
        post = rng.choices(list(frequent), [1 / (i + 5) for i in range(300)], k=160) + [f"w{k}x{i}" for i in range(40)]
        rng.shuffle(post)
        other = list(post)
        for at in rng.sample(range(200), 200 // part):
            other[at] = f"q{rng.randrange(10**9)}"
        posts += [post, other]
    blocks, bits = make(posts)
    apart = np.bitwise_count((bits[::2] ^ bits[1::2]).view(np.uint64)).sum(axis=1)
    assert (apart <= 2 * (200 // part)).all()
    met = (blocks[::2] == blocks[1::2]).any(axis=1).sum()
    assert met >= least * n, met / n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(WORDS), min_size=1, max_size=40), st.lists(st.sampled_from(WORDS), min_size=1, max_size=40))
def test_bits_never_drop_a_repeat(a, b):
    _, bits = fp.Fingerprinter({})([a, b])
    assert np.bitwise_count((bits[0] ^ bits[1]).view(np.uint64)).sum() <= 2 * slow_distance(a, b)


def test_long_posts_are_fingerprinted_in_parts(monkeypatch):
    rng = random.Random(9)
    posts = [[f"w{rng.randrange(500)}" for _ in range(rng.choice([1, 12, 300, 2000]))] for _ in range(40)]
    whole = fp.Fingerprinter({"w1": 0.3})(posts)
    monkeypatch.setattr(fp, "_WORDS", 50)
    monkeypatch.setattr(fp, "_SEEN_WORDS", 100)
    parts = fp.Fingerprinter({"w1": 0.3})(posts)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


POSTS = "doc_id long, text string, author string"


def corpus(n=120, seed=5):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(30)]
    made, out = [], []
    for i in range(n):
        kind = rng.random()
        if made and kind < 0.45:
            w = list(rng.choice(made))
            for _ in range(rng.randint(0, len(w) // 6)):
                at = rng.randrange(len(w))
                op = rng.random()
                if op < 0.4:
                    w[at] = f"x{rng.randrange(10**6)}"
                elif op < 0.7 and len(w) > 13:
                    w.pop(at)
                else:
                    w.insert(at, rng.choice(common))
        else:
            w = [rng.choice(common) if rng.random() < 0.6 else f"w{rng.randrange(10**5)}" for _ in range(rng.choice([5, 13, 20, 40, 60, 300]))]
        made.append(w)
        out.append((i * 3 + 1, " ".join(w), None))
    return out


def brute(posts):
    accepted, found = {}, {}
    for i, t, a in sorted(posts):
        w = own_words(t, a)
        if len(w) < dedup.LEAST_WORDS:
            continue
        near = [(d, j) for j, v in accepted.items() if (d := fp.repeats(v, w)) is not None]
        if near:
            found[i] = min(near)[1]
        else:
            accepted[i] = w
    return found


def test_batches_equal_brute_force_and_one_delivery(spark):
    posts = corpus()
    posts += [(10_000, posts[3][1], "someone"), (10_001, posts[3][1], None), (10_002, None, "x"), (10_003, "", None)]
    want = brute(posts)
    df = spark.createDataFrame(posts, POSTS).selectExpr("*", "doc_id AS block", "doc_id AS words")
    whole = {r["doc_id_b"]: r["doc_id_a"] for r in dedup.Store(spark).append(df, keep=False).collect()}
    assert whole == want
    store = dedup.Store(spark)
    parts = {}
    for low, high in ((0, 200), (200, 400), (400, 10**9)):
        got = store.append(df.where(f"doc_id >= {low} and doc_id < {high}")).collect()
        parts |= {r["doc_id_b"]: r["doc_id_a"] for r in got}
    assert set(parts) == set(want)
    assert sum(parts[b] != a for b, a in want.items()) == 0
    assert dedup.Store(spark).append(df.where("false")).count() == 0


def test_store_is_opened_again(spark, tmp_path):
    posts = corpus()
    want = brute(posts)
    df = spark.createDataFrame(posts, POSTS)
    folder, parts = f"file://{tmp_path}/store", {}
    for low, high in ((0, 200), (200, 300), (300, 10**9)):
        for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("siltstone_")]:
            spark.sql(f"DROP TABLE {name}")  # as in another session
        store = dedup.Store(spark, folder, 8 if low else 4)
        assert store.buckets == 4
        if low == 200:
            store.append(df.where("doc_id < 50"), keep=False)
        before = {k: rows(spark.read.parquet(f"{folder}/{k}/*")) for k in ("words", "blocks")} if low else {}
        frequent = rows(spark.read.parquet(f"{folder}/frequent")) if low else []
        if low == 200:  # what a failed delivery leaves
            df.selectExpr("doc_id", "text AS words").write.parquet(f"{folder}/words/batch=1")
        got = store.append(df.where(f"doc_id >= {low} and doc_id < {high}")).collect()
        parts |= {r["doc_id_b"]: r["doc_id_a"] for r in got}
        for k, held in before.items():
            assert set(held) < set(rows(spark.read.parquet(f"{folder}/{k}/*")))
        assert not low or rows(spark.read.parquet(f"{folder}/frequent")) == frequent
    assert parts == want
    store = dedup.Store(spark, folder)
    assert store.committed() == [0, 1, 2]
    plan = dedup.history_pairs(spark.createDataFrame([], dedup.PRINTS), store._table("blocks", [0, 1, 2]))
    held = rows(store._table("blocks", [0, 1, 2]))
    for _ in range(2):
        store.compact()
    assert store.committed() == [3] and rows(store._table("blocks", [3])) == held and plan.count() == 0
    again = df.where("doc_id >= 300").withColumn("doc_id", F.col("doc_id") + 10**6)
    assert {r["doc_id_b"] for r in store.append(again, keep=False).collect()} == {i + 10**6 for i, t, a in posts if i >= 300 and len(own_words(t, a)) >= dedup.LEAST_WORDS}
    assert sorted(r[0] for r in rows(store._table("words", [3]))) == sorted(i for i, t, a in posts if i not in want and len(own_words(t, a)) >= dedup.LEAST_WORDS)


def documents(spark, folder, posts):
    df = spark.createDataFrame(posts, POSTS + ", batch_no int")
    df.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_queries_look_up_stored_batches(spark, tmp_path, monkeypatch):
    posts = corpus()
    base = [f"v{i}" for i in range(40)]
    near = [f"z{i}" for i in range(7)] + base[7:]
    # 9,002 repeats 9,000 of an earlier batch, but is nearer to 9,001 of its own
    posts += [(9_000, " ".join(base), None), (9_001, " ".join([f"u{i}" for i in range(11)] + base[11:]), None), (9_002, " ".join([f"u{i}" for i in range(9)] + base[9:]), None), (9_003, " ".join(near), None)]
    want = brute(posts)
    assert want[9_002] == 9_001 and want[9_003] == 9_000
    sf = documents(spark, tmp_path, [(*p, 3 if p[0] > 9_000 else min(p[0] // 150, 2)) for p in posts])
    looked_up = []
    pairs = dedup.history_pairs
    monkeypatch.setattr(dedup, "history_pairs", lambda *a: looked_up.append(1) or pairs(*a))
    assert {r["doc_id_b"]: r["doc_id_a"] for r in problems.p5_found(spark, sf).collect()} == want
    assert looked_up
    assert {r["doc_id_b"]: r["doc_id_a"] for r in problems.p5_last_batch(spark, sf).collect()} == {b: a for b, a in want.items() if b > 9_000}


def test_posts_without_batch_no(spark, tmp_path):
    words = [f"w{i}" for i in range(20)]
    text = [" ".join(words), " ".join(["x", *words]), " ".join(words[::-1]), " ".join([*words[::-1], "y"])]
    posts = [(1, text[0], None, None), (2, text[2], None, 0), (3, text[1], None, 0), (4, "short", None, 1), (5, text[3], None, None), (6, text[0], None, 1)]
    assert rows(problems.p5_last_batch(spark, documents(spark, tmp_path / "some", posts))) == [(1, 6), (2, 5)]
    none = documents(spark, tmp_path / "none", [(*p[:3], None) for p in posts])
    assert rows(problems.p5_last_batch(spark, none)) == rows(problems.p5_found(spark, none)) == [(1, 3), (1, 6), (2, 5)]


def test_many_copies_and_near_copies_of_one_post(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    posts = [(1, " ".join(base), None)]
    for i in range(2, 200):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(60)] = f"y{rng.randrange(10**6)}"
        posts.append((i, " ".join(w), None))
    want = brute(posts)
    got = {r["doc_id_b"]: r["doc_id_a"] for r in dedup.Store(spark).append(spark.createDataFrame(posts, POSTS), keep=False).collect()}
    assert got == want and len(got) == 199 - 1


def test_hot_blocks_are_split(spark, monkeypatch):
    rng = random.Random(4)
    posts = []
    for k in range(3):
        base = [f"b{k}x{i}" for i in range(30)]
        for i in range(120):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(30)] = f"y{rng.randrange(10**6)}"
            posts.append((len(posts) + 1, " ".join(w), None))
    rng.shuffle(posts)
    want = brute(posts)
    df = spark.createDataFrame(posts, POSTS)
    for size in (7, 70):
        monkeypatch.setattr(dedup, "BLOCK_ROWS", size)
        monkeypatch.setattr(dedup, "SMALL", 5)
        store = dedup.Store(spark)
        got = store.append(df.where("doc_id <= 150")).collect() if size == 70 else []
        got += store.append(df.where("doc_id > 150") if size == 70 else df, keep=False).collect()
        assert {r["doc_id_b"]: r["doc_id_a"] for r in got} == want


def test_lookup_does_not_move_history(spark, tmp_path):
    df = spark.createDataFrame(corpus(40), POSTS)
    store = dedup.Store(spark, f"file://{tmp_path}/s", 4)
    store.append(df)
    prints = dedup.fingerprinted(dedup.post_words(df), {})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = dedup._lookup(dedup.block_rows(prints), store._table("blocks", [0]), None)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_settle_follows_the_order(spark):
    edges = spark.createDataFrame([(1, 2, 3), (2, 3, 1), (3, 4, 1), (1, 5, 2), (3, 5, 1)], "doc_id_a long, doc_id_b long, distance int")
    assert rows(dedup.settle(edges)) == [(1, 2), (3, 4), (3, 5)]
    assert dedup.settle(edges.where("false")).count() == 0


def labelled_corpus(n, seed):
    rng = random.Random(seed)
    lexicon = {s: [f"{s}{k}word" for k in range(12)] for s in ("law", "music", "sport")}
    fill = ["the", "a", "and", "so", "then", "very", "table", "window", "basket"]
    docs, truth = [], {}
    for i in range(n):
        about = rng.sample(list(lexicon), rng.choice([0, 1, 1, 2]))
        passing = rng.choice([s for s in lexicon if s not in about])
        s = [" ".join(rng.choices(fill, k=6) + rng.sample(lexicon[a], 2)) for a in about for _ in range(rng.randint(2, 3))]
        s += [" ".join(rng.choices(fill, k=8)) for _ in range(2)] + [" ".join(rng.choices(fill, k=6) + rng.sample(lexicon[passing], 1))]
        rng.shuffle(s)
        docs.append((i, " ".join(x.capitalize() + "." for x in s), None))
        truth[i] = set(about)
    return docs, truth


def test_subjects_on_held_out_posts(spark):
    docs, truth = labelled_corpus(700, 2)
    df = spark.createDataFrame([*docs, (5000, None, None), (5001, "", None), (5002, "thanks!", None)], POSTS)
    labels = [(i, (s.upper() + "?") if i % 5 == 0 else s) for i in range(450) for s in truth[i]] + [(i, None) for i in range(450) if not truth[i]] + [(99_999, "law"), (None, "law"), (3, "nonsense")]
    names = spark.createDataFrame([("law", "x"), ("music", "x"), ("sport", "x")], "subject string, about string")
    got: dict[int, set] = {}
    for r in sub.subjects_of(df, spark.createDataFrame(labels, "doc_id long, subject string"), names).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    hit = sum(len(got.get(i, set()) & truth[i]) for i in range(450, 700))
    given = sum(len(got.get(i, set())) for i in range(450, 700))
    there = sum(len(truth[i]) for i in range(450, 700))
    print(f"held-out precision {hit / given:.3f}, recall {hit / there:.3f}")
    assert hit / given > 0.9 and hit / there > 0.9
    assert not {5000, 5001, 5002} & set(got)


def test_scores_are_second_highest_sentences(monkeypatch):
    rng = np.random.default_rng(1)
    m = sub.Model(["a", "b"])
    m.table = rng.normal(size=m.table.shape).astype(np.float32)
    m.out = rng.normal(size=m.out.shape).astype(np.float32)
    words = [f"word{i}" for i in range(50)] + ["7", "a"]
    posts = [[list(rng.choice(words, rng.integers(3, 9))) for _ in range(k)] for k in rng.integers(0, 6, 60)]
    posts.append([["same", "word", "here"]] * 3)

    def word(w):
        ids = sub.Features()(w)
        return sub.SCALE * ((m.table[ids[0]] + (m.table[ids[1:]].mean(axis=0) if len(ids) > 1 else 0)) @ m.out)

    want = [np.sort(np.stack([np.mean([word(w) for w in s], axis=0) for s in p]), axis=0)[-2] + m.bias for p in posts if len(p) > 1]
    got, long = sub.Scorer(m).posts(posts)
    assert long == [i for i, p in enumerate(posts) if len(p) > 1] and np.allclose(got, want, rtol=1e-3, atol=1e-3)


def test_thresholds_bear_missing_ratings():
    rng = np.random.default_rng(2)
    truth = rng.random((4000, 2)) < 0.15
    z = np.where(truth, rng.normal(2, 0.8, truth.shape), rng.normal(-3, 0.8, truth.shape))
    rated = truth & (rng.random(truth.shape) < 0.5)
    for k, t in enumerate(sub.chosen_thresholds(z, rated.astype(float))):
        assert (z[truth[:, k], k] > t).mean() > 0.95 and (z[~truth[:, k], k] > t).mean() < 0.02
    assert (sub.chosen_thresholds(z, 0 * rated) == np.float32(sub.THRESHOLD)).all()
    assert (sub.chosen_thresholds(z[:0], rated[:0].astype(float)) == np.float32(sub.THRESHOLD)).all()


def test_subjects_without_any_label(spark):
    df = spark.createDataFrame([(1, "Some words here. Some other words there.", None)], POSTS)
    labels = spark.createDataFrame([], "doc_id long, subject string")
    names = spark.createDataFrame([("law",)], "subject string")
    assert sub.subjects_of(df, labels, names).columns == ["doc_id", "subject"]
    assert sub.subjects_of(df.where("false"), labels, names).count() == 0
