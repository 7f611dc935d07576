"""Subject areas of posts.

A sentence is the average of its words' embeddings, a word the sum of its own embedding and the mean of its subwords'; one
logistic output per subject, independent of the others. A post is about a subject when two of its sentences are, so the
post's output is its second highest sentence output, in training as in scoring. Partitions train on their own rows and
synchronise through the driver after every pass: the changes of a parameter are averaged over the partitions that touched it.
(Gradients are thus synchronised as the sum of a pass's steps. To exchange them after every step would send the touched rows of
the table, megabytes, some hundred times a pass through the driver, for rated rows that FIT_ROWS bounds.) A part of the rated
posts takes no part in training; on it each subject's threshold is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.owntext import own_text, sentences_of, words_of
from siltstone.session import written

BUCKETS, SIZE = 1 << 16, 16
GRAMS = (3, 4, 5)
#: Labelled posts that the classifier is fitted on, at most; taken by the hash of their id.
FIT_ROWS = 20_000
PASSES, WARM_PASSES, BATCH = 16, 4, 32
#: Rated posts that one task trains on.
PART_ROWS = 2000
#: Of so many rated posts one is held out to choose thresholds.
HELD_OUT = 6
RATE = 0.6
#: Part of the words left out at random in training, so that names do not explain a rating.
DROPPED = 0.2
#: A subject is given above this output where no held-out post is rated with it. Ratings are incomplete, so trained outputs lie low.
THRESHOLD = -1.25
#: So many held-out ratings of a subject weigh as much as THRESHOLD in its own one.
PRIOR = 15
#: Values of the thresholds' measure from this part of the highest on count as good as it.
NEARLY = 0.98
#: Factor of the averages before the outputs, so that one telling word among many can decide.
SCALE = 10.0
SEED = 20240607

_CACHE = 200_000


class Features:
    """Rows of the embedding table for a word: its own first, then those of its subwords."""

    def __init__(self):
        self.seen: dict[str, np.ndarray] = {}

    def __call__(self, word: str) -> np.ndarray:
        at = self.seen.get(word)
        if at is None:
            if word.isdigit():
                ids = [xxhash.xxh32_intdigest(b"#number") % BUCKETS]
            else:
                w = f"<{word}>"
                ids = [xxhash.xxh32_intdigest(w.encode()) % BUCKETS]
                grams = {w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)} - {w}
                ids += sorted(BUCKETS + xxhash.xxh32_intdigest(g.encode()) % BUCKETS for g in grams)
            at = np.array(ids, dtype=np.int64)
            if len(self.seen) >= _CACHE:
                self.seen.clear()
            self.seen[word] = at
        return at


class Model:
    def __init__(self, subjects: list[str]):
        rng = np.random.default_rng(SEED)
        k = len(subjects)
        self.subjects = subjects
        self.table = ((rng.random((2 * BUCKETS, SIZE), dtype=np.float32) - 0.5) / SIZE).astype(np.float32)
        self.history = np.zeros(2 * BUCKETS, dtype=np.float32)
        self.out = np.zeros((SIZE, k), dtype=np.float32)
        self.out[:] = rng.normal(0, 0.3, (SIZE, k))
        self.out_history = np.zeros((SIZE, k), dtype=np.float32)
        self.bias = np.full(k, -2.0, dtype=np.float32)
        self.threshold = np.full(k, THRESHOLD, dtype=np.float32)


def sentence_words(text: str | None, author: str | None) -> list[list[str]]:
    """Words of each sentence of the own text; sentences of fewer than three words say nothing and are left out."""
    out = []
    for s in sentences_of(own_text(text, author)):
        w = words_of(s)
        if len(w) >= 3:
            out.append(w)
    return out


def _sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the value rows that share a target row, for n target rows."""
    out = np.zeros((n, values.shape[1]), dtype=np.float32)
    order = np.argsort(rows, kind="stable")
    r = rows[order]
    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    out[r[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


def _step(m: Model, docs: list[list[list[str]]], targets: np.ndarray, features: Features, warm: bool, rate: float) -> np.ndarray:
    """One update from a few posts; returns the rows of the table it touched."""
    vocab: dict[str, int] = {}
    flat, lengths, owner = [], [], []
    for d, sentences in enumerate(docs):
        for s in sentences:
            flat += [vocab.setdefault(w, len(vocab)) for w in s]
            lengths.append(len(s))
            owner.append(d)
    words, lengths, owner = np.array(flat), np.array(lengths), np.array(owner)
    ids = [features(w) for w in vocab]
    n_ids = np.array([len(i) for i in ids])
    rows, of_word = np.concatenate(ids), np.repeat(np.arange(len(ids)), n_ids)
    heads = np.r_[0, np.cumsum(n_ids)[:-1]]
    share = np.repeat(1.0 / np.maximum(n_ids - 1, 1), n_ids).astype(np.float32)
    share[heads] = 1.0
    vectors = _sums(m.table[rows] * share[:, None], of_word, len(ids))
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    sentence = np.add.reduceat(vectors[words], starts, axis=0) * (SCALE / lengths[:, None].astype(np.float32))
    z = sentence @ m.out + m.bias
    error = np.zeros_like(z)
    first = np.searchsorted(owner, np.arange(len(docs)))
    last = np.searchsorted(owner, np.arange(len(docs)), side="right")
    for d in range(len(docs)):
        zd, y = z[first[d] : last[d]], targets[d]
        n = len(zd)
        if warm:
            p = 1 / (1 + np.exp(-zd.mean(axis=0)))
            error[first[d] : last[d]] += (p - y) / n
            continue
        if n < 2:
            continue
        top = np.argpartition(-zd, 1, axis=0)[:2]
        k = np.arange(zd.shape[1])
        high = np.take_along_axis(zd, top, axis=0)
        p = 1 / (1 + np.exp(-high))
        # both sentences that carry a subject learn from its presence, only the second from its absence
        pull = (p - y) * np.stack([np.where(y > 0, 1.0, 0.0), 1.0 + 0.0 * y])
        error[first[d] + top[0], k] += pull[0]
        error[first[d] + top[1], k] += pull[1]
    g_out, g_bias = sentence.T @ error, error.sum(axis=0)
    g_sentence = (error @ m.out.T) * (SCALE / lengths[:, None].astype(np.float32))
    g_words = _sums(np.repeat(g_sentence, lengths, axis=0), words, len(ids))
    touched, back = np.unique(rows, return_inverse=True)
    g_table = _sums(g_words[of_word] * share[:, None], back, len(touched))
    m.history[touched] += (g_table**2).mean(axis=1)
    m.table[touched] -= rate * g_table / np.sqrt(m.history[touched] + 1e-8)[:, None]
    m.out_history += g_out**2
    m.out -= 0.3 * rate * g_out / np.sqrt(m.out_history + 1e-6)
    m.bias -= 0.05 * rate * g_bias
    return touched


PASS = "rows binary, table binary, history binary, out binary, out_history binary, bias binary"


def _passes(model, number: int, rate: float, warm: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, targets = [], []
        for b in batches:
            docs += [[s.split(" ") for s in d] for d in b.column(0).to_pylist()]
            targets += b.column(1).to_pylist()
        keep = [i for i, d in enumerate(docs) if d]
        if not keep:
            return
        base: Model = model.value
        m = Model(base.subjects)
        for a in ("table", "history", "out", "out_history", "bias"):
            setattr(m, a, getattr(base, a).copy())
        y = np.array(targets, dtype=np.float32)
        features, touched = Features(), np.zeros(2 * BUCKETS, dtype=bool)
        rng = np.random.default_rng(SEED + number)
        order = rng.permutation(keep)
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            thinned = [[[w for w in s if rng.random() > DROPPED] or s for s in docs[i]] for i in part]
            touched[_step(m, thinned, y[part], features, warm, rate)] = True
        rows = np.flatnonzero(touched)
        delta = {"rows": rows.tobytes(), "table": (m.table[rows] - base.table[rows]).tobytes(), "history": (m.history[rows] - base.history[rows]).tobytes()}
        delta |= {a: (getattr(m, a) - getattr(base, a)).tobytes() for a in ("out", "out_history", "bias")}
        yield pa.record_batch({k: pa.array([v], pa.binary()) for k, v in delta.items()})

    return run


def _synchronise(m: Model, deltas: list) -> None:
    count = np.zeros(2 * BUCKETS, dtype=np.float32)
    table, history = np.zeros_like(m.table), np.zeros_like(m.history)
    for d in deltas:
        rows = np.frombuffer(d["rows"], dtype=np.int64)
        table[rows] += np.frombuffer(d["table"], dtype=np.float32).reshape(-1, SIZE)
        history[rows] += np.frombuffer(d["history"], dtype=np.float32)
        count[rows] += 1
    at = np.flatnonzero(count)
    m.table[at] += table[at] / count[at][:, None]
    m.history[at] += history[at] / count[at]
    for a in ("out", "out_history", "bias"):
        v = getattr(m, a)
        v += np.mean([np.frombuffer(d[a], dtype=np.float32).reshape(v.shape) for d in deltas], axis=0)


def labelled(docs: DataFrame, labels: DataFrame, subjects: list[str], fit_rows: int = FIT_ROWS) -> DataFrame:
    """sentences, target, held_out of at most ``fit_rows`` rated posts (a fixed choice by the hash of doc_id).

    Subjects are compared without case, outer blanks and question marks; unknown ones are ignored. A subject's target is 1
    when some rating names it, less by the part of ratings that say "none found". Ratings of posts that are not there
    are dropped.
    """
    name = F.lower(F.trim(F.col("subject"), F.lit(" \t\n\r?!.")))
    rated = labels.where("doc_id is not null").select("doc_id", name.alias("subject"))
    per = rated.groupBy("doc_id").agg(
        *[F.max(F.coalesce((F.col("subject") == s).cast("float"), F.lit(0.0).cast("float"))).alias(f"s{i}") for i, s in enumerate(subjects)],
        F.avg(F.col("subject").isNull().cast("float")).alias("none"),
    )
    per = per.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    target = F.array(*[(F.col(f"s{i}") * (1 - F.col("none"))).cast("float") for i in range(len(subjects))])
    held_out = F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(HELD_OUT)) == 0
    rows = docs.join(per, "doc_id").select("text", "author", target.alias("target"), held_out.alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, authors = b.column(0).to_pylist(), b.column(1).to_pylist()
            own = [[" ".join(w) for w in sentence_words(t, a)] for t, a in zip(texts, authors, strict=True)]
            yield pa.record_batch({"sentences": pa.array(own, pa.list_(pa.string())), "target": b.column(2), "held_out": b.column(3)})

    return rows.mapInArrow(run, "sentences array<string>, target array<float>, held_out boolean")


def chosen_thresholds(outputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """A threshold per subject from outputs and targets of held-out posts.

    Ratings miss subjects at random, so precision can't be read off them, but the square of the recall divided by the part of
    posts above the threshold rises and falls with precision times recall whatever is missed. The threshold lies in the middle
    of the outputs where it is nearly highest; subjects with few ratings are drawn to THRESHOLD.
    """
    best = np.full(targets.shape[1], THRESHOLD, dtype=np.float32)
    for k in range(targets.shape[1]):
        order = np.argsort(-outputs[:, k], kind="stable")
        z, hits = outputs[order, k], np.cumsum(targets[order, k])
        if not len(z) or hits[-1] <= 0:
            continue
        last = np.r_[z[1:] != z[:-1], True]
        gain = np.where(last, (hits / hits[-1]) ** 2 / np.arange(1, len(z) + 1), 0)
        near = np.flatnonzero(gain >= NEARLY * gain.max())
        below = z[near[-1] + 1] if near[-1] + 1 < len(z) else z[near[-1]] - 1
        own = (z[near[0]] + below) / 2
        n = hits[-1]
        best[k] = (n * own + PRIOR * THRESHOLD) / (n + PRIOR)
    return best


def fit(docs: DataFrame, labels: DataFrame, subjects: list[str], fit_rows: int = FIT_ROWS, passes: int = PASSES) -> Model:
    """A model trained on the rated posts; the untrained one if there are none.

    The held-out posts' outputs are the only other rows brought to the driver, at most ``fit_rows`` / HELD_OUT of about.
    """
    rows = written(labelled(docs, labels, subjects, fit_rows))
    m, spark = Model(subjects), docs.sparkSession
    parts = max(1, -(-rows.count() // PART_ROWS))
    train = written(rows.where("not held_out").select("sentences", "target").repartition(parts))
    for k in range(passes):
        shared = spark.sparkContext.broadcast(m)
        run = _passes(shared, k, RATE * (1 - k / passes), k < WARM_PASSES)
        deltas = train.coalesce(parts).mapInArrow(run, PASS).collect()  # at most ``parts`` rows
        shared.destroy()
        if not deltas:
            break
        _synchronise(m, deltas)
    shared = spark.sparkContext.broadcast(m)

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for b in batches:
            posts = [[s.split(" ") for s in d] for d in b.column(0).to_pylist()]
            z, long = score.posts(posts)
            yield pa.record_batch({"z": pa.array(list(z), pa.list_(pa.float32())), "target": b.column(1).take(pa.array(long))})

    checked = rows.where("held_out").select("sentences", "target").mapInArrow(outputs, "z array<float>, target array<float>").collect()
    if checked:
        m.threshold = chosen_thresholds(np.array([r["z"] for r in checked]), np.array([r["target"] for r in checked]))
    shared.destroy()
    return m


class Scorer:
    """Post outputs from cached outputs of single words."""

    def __init__(self, m: Model):
        self.m, self.features = m, Features()
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.words = np.zeros((1024, len(self.m.subjects)), dtype=np.float32)

    def _rows(self, flat: list[str]) -> np.ndarray:
        if len(self.row) > _CACHE:
            self._forget()
        row, m = self.row, self.m
        new = [w for w in dict.fromkeys(flat) if w not in row]
        if new:
            start, end = len(row), len(row) + len(new)
            if end > len(self.words):
                self.words = np.concatenate([self.words, np.zeros((max(end, 2 * len(self.words)) - len(self.words), self.words.shape[1]), dtype=np.float32)])
            ids = [self.features(w) for w in new]
            n = np.array([len(i) for i in ids])
            heads = np.r_[0, np.cumsum(n)[:-1]]
            vectors = m.table[np.concatenate(ids)]
            own = vectors[heads].copy()
            vectors[heads] = 0
            vectors = own + np.add.reduceat(vectors, heads, axis=0) / np.maximum(n - 1, 1)[:, None]
            self.words[start:end] = SCALE * (vectors @ m.out)
            row.update(zip(new, range(start, end), strict=True))
        return np.array([row[w] for w in flat], dtype=np.int64)

    def posts(self, posts: list[list[list[str]]]) -> tuple[np.ndarray, list[int]]:
        """Second highest output over the sentences, per subject, of the posts with two sentences or more, and which these are."""
        long = [i for i, p in enumerate(posts) if len(p) > 1]
        outputs = np.zeros((len(long), len(self.m.subjects)), dtype=np.float32)
        at = 0
        while at < len(long):
            some, n = [], 0
            while at + len(some) < len(long) and (not some or n < 100_000):
                some.append(posts[long[at + len(some)]])
                n += sum(map(len, some[-1]))
            lengths = np.array([len(s) for p in some for s in p])
            rows = self._rows([w for p in some for s in p for w in s])
            starts = np.r_[0, np.cumsum(lengths)[:-1]]
            z = np.concatenate([np.add.reduceat(self.words[rows[a:b]], starts[i:j] - a, axis=0) for a, b, i, j in _portions(starts, len(rows))]) / lengths[:, None]
            first = np.r_[0, np.cumsum([len(p) for p in some])[:-1]]
            top = np.maximum.reduceat(z, first, axis=0)
            owner = np.repeat(np.arange(len(some)), [len(p) for p in some])
            # the first sentence at the top is taken out once
            at_top = z == top[owner]
            place = np.where(at_top, np.arange(len(z))[:, None], len(z))
            taken = np.minimum.reduceat(place, first, axis=0)
            z[taken, np.arange(z.shape[1])] = -np.inf
            outputs[at : at + len(some)] = np.maximum.reduceat(z, first, axis=0) + self.m.bias
            at += len(some)
        return outputs, long


def _portions(starts: np.ndarray, n: int, size: int = 1 << 18) -> Iterator[tuple[int, int, int, int]]:
    """(from, to, first sentence, sentence after the last) so that about ``size`` words are gathered at a time."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + size)))
        yield int(starts[i]), int(starts[j]) if j < len(starts) else n, i, j
        i = j


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, subject of every post with two sentences about the subject; one pass, no shuffle.

    Null, empty and blank texts, and posts with fewer than two sentences of their own, have no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, m = Scorer(shared.value), shared.value
        names = np.array(m.subjects, dtype=object)
        for b in batches:
            texts, authors = b.column(1).to_pylist(), b.column(2).to_pylist()
            z, long = score.posts([sentence_words(t, a) for t, a in zip(texts, authors, strict=True)])
            post, subject = np.nonzero(z > m.threshold)
            yield pa.record_batch({"doc_id": b.column(0).take(pa.array(np.array(long, dtype=np.int64)[post])), "subject": pa.array(names[subject], pa.string())})

    return docs.select("doc_id", "text", "author").mapInArrow(run, "doc_id bigint, subject string")


def subjects_of(docs: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """Trains on the rated posts and scores every post. ``subjects`` is the small fixed table of names."""
    names = sorted(r["subject"] for r in subjects.select("subject").where("subject is not null").distinct().collect())
    return scored(docs, fit(docs, labels, names))
