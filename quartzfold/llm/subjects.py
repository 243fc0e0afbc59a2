"""Problem 8: the subject areas of each document.

A term model scores the sentences of a post's own prose; it is trained on hand labels of whole posts, which say that some
of a post's sentences are about a subject, not which. A chain of classifiers over the sentences' scores, the source and
the structure of the post, each link seeing the subjects decided before it, then gives calibrated probabilities of label
combinations, and beam search finds the likeliest one. The chain learns from the hand labels what share of a post's
sentences a subject needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzfold.llm.prose import CODE, LINK, QUOTE, Reader, Sentences, own_prose

CAPITAL = regex.compile(r"\p{Lu}")


@dataclass(frozen=True)
class Subjects:
    """``label_rows`` bounds the labelled rows used for training (chosen by a hash of their id), ``label_words`` the words
    of a post used for it: longer posts teach nothing, but are classified whole. ``terms`` is the size of the hashed
    vocabulary. A subject counts from ``share`` of the sentences that bear on any; a sentence bears on its best subject
    from ``sure``. ``beam`` combinations are kept while decoding. A round of training makes at least ``steps`` steps of
    ``batch`` sentences, and sees each sentence at least once."""

    label_rows: int = 20_000
    label_words: int = 5_000
    terms: int = 1 << 18
    share: float = 0.25
    sure: float = 0.5
    doubt: float = 0.03
    rounds: int = 3
    steps: int = 20
    batch: int = 512
    beam: int = 4
    sources: int = 8


def word_terms(word: str, size: int) -> list[int]:
    """The hashed word and, if it is long, its runs of four letters, which typing errors and endings leave alone."""
    runs = {f"#{r}" for i in range(len(word) - 1) if (r := f"<{word}>"[i : i + 4])} if len(word) > 3 else set()
    return [zlib.crc32(t.encode("utf-8", "replace")) % size for t in [word, *sorted(runs)]]


def _pairs(heads: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed pairs of neighbouring words of each sentence, and the sentence of each."""
    inside = np.ones(len(heads), bool)
    inside[starts[1:][starts[1:] > 0] - 1] = False  # the last word of a sentence starts no pair
    a = np.flatnonzero(inside)
    sentence = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[a]
    return (heads[a] * 31 + heads[np.minimum(a + 1, len(heads) - 1)] * 17 + 7) % size, sentence


def structure(text: str, prose: str, found: int) -> list[float]:
    """What a post looks like, apart from its words."""
    marked, signs = "[" in text or "<" in text, max(len(prose), 1)
    return [
        float(np.log1p(found)), float(np.log1p(len(text))), len(prose) / max(len(text), 1), float((marked and QUOTE.search(text) is not None) or "\n>" in text),
        float(("[" in text or "```" in text) and CODE.search(text) is not None), float(LINK.search(text) is not None), len(CAPITAL.findall(prose)) / signs, prose.count("!") / (found + 1),
    ]


N_STRUCTURE = 8
PRIOR = 0.1  # scale of what is known besides the evidence, which the ridge thus holds back more


class TermModel:
    """A softmax over subjects for the terms of a sentence (words, parts of words, pairs of neighbours, as often as they
    occur); terms that tell nothing leave all subjects alike."""

    def __init__(self, how: Subjects, k: int) -> None:
        self.how, self.k = how, k
        self.place = np.full(how.terms, -1, np.int32)

    def _train(self, state: dict, target: np.ndarray, rows: np.ndarray, epochs: int, units: np.ndarray, starts: np.ndarray, terms: np.ndarray, unit_starts: np.ndarray, size: np.ndarray, rate: float = 0.5) -> None:
        """Adaptive gradient descent over mini-batches of sentences, in a fixed random order, going on from ``state``."""
        weights, seen, bias, rarity = state["weights"], state["seen"], state["bias"], self.rarity
        lengths = np.diff(starts)
        rows = rows[lengths[rows] > 0]
        for _ in range(epochs):
            order = state["random"].permutation(rows)
            for i in range(0, len(order), self.how.batch):
                j = order[i : i + self.how.batch]
                n = lengths[j]
                first = np.cumsum(n) - n
                own, inverse = np.unique(units[np.arange(n.sum()) + np.repeat(starts[j] - first, n)], return_inverse=True)
                m = unit_starts[own + 1] - unit_starts[own]
                begin = np.cumsum(m) - m
                t = terms[np.arange(m.sum()) + np.repeat(unit_starts[own] - begin, m)]
                value = rarity[t][:, None]
                by_unit = np.add.reduceat(weights[t] * value, begin, axis=0)
                scale = 1 / size[j][:, None]
                off = _softmax(np.add.reduceat(by_unit[inverse], first, axis=0) * scale + bias) - target[j]
                by = np.argsort(inverse, kind="stable")
                heads = np.flatnonzero(np.r_[True, np.diff(inverse[by]) != 0])
                slope = np.add.reduceat(np.repeat(off * scale, n, axis=0)[by], heads, axis=0)
                slope = np.repeat(slope, m, axis=0) * value
                by = np.argsort(t, kind="stable")
                heads = np.flatnonzero(np.r_[True, np.diff(t[by]) != 0])
                slope, t = np.add.reduceat(slope[by], heads, axis=0), t[by][heads]
                seen[t] += slope * slope
                weights[t] -= rate * slope / np.sqrt(seen[t])
                bias -= 0.01 * off.mean(axis=0)

    def _fresh(self, seed: int) -> dict:
        n = (self.n_terms, self.k)
        return {"weights": np.zeros(n, np.float32), "seen": np.full(n, 1e-2, np.float32), "bias": np.zeros(self.k, np.float32), "random": np.random.default_rng(seed)}

    def fit(self, names: list[str], found: Sentences, allowed: np.ndarray) -> np.ndarray:
        """Train on sentences of posts, where ``allowed`` (posts x subjects) has the labels; ``names`` are the words.

        Starts from the label of the post for each of its sentences; after each round the sentences get what a model
        trained on the other half of the posts says of them, within their post's labels and some doubt. Sentences that
        look alike under all labels, and those of posts labelled as without subject, teach that nothing is said.
        Returns the probabilities of each sentence by the model of the other half.
        """
        how, n = self.how, len(found.post)
        each = [word_terms(w, how.terms) for w in names]
        word_terms_of = np.fromiter(chain.from_iterable(each), np.int64)
        word_starts = np.concatenate([[0], np.cumsum([len(t) for t in each])]).astype(np.int64)
        heads = word_terms_of[word_starts[:-1]]
        pair, pair_of = _pairs(heads[found.words], found.starts, how.terms) if n else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        uses = np.bincount(found.words, minlength=len(names))
        count = np.bincount(word_terms_of, np.repeat(uses, np.diff(word_starts)), how.terms) + np.bincount(pair, minlength=how.terms)
        kept = np.flatnonzero(count >= 2)
        self.n_terms = max(len(kept), 1)
        self.place[kept] = np.arange(len(kept))
        self.rarity = np.maximum(np.log(max(n, 2) / np.maximum(count[kept], 1)) / np.log(max(n, 2)), 0.02).astype(np.float32) if len(kept) else np.ones(1, np.float32)
        # units: the words, then one for each kept term as a pair
        ok = self.place[word_terms_of] >= 0
        terms = np.concatenate([self.place[word_terms_of[ok]], np.arange(self.n_terms)]).astype(np.int64)
        held = np.add.reduceat(ok, word_starts[:-1]) if len(names) else np.zeros(0, np.int64)
        unit_starts = np.concatenate([[0], np.cumsum(np.concatenate([held, np.ones(self.n_terms, np.int64)]))]).astype(np.int64)
        known = self.place[pair] >= 0
        sentence = np.concatenate([np.repeat(np.arange(n), np.diff(found.starts)), pair_of[known]])
        units = np.concatenate([found.words, len(names) + self.place[pair[known]]]).astype(np.int64)
        some = unit_starts[units + 1] > unit_starts[units]
        sentence, units = sentence[some], units[some]
        by = np.argsort(sentence, kind="stable")
        units, starts = units[by], np.concatenate([[0], np.cumsum(np.bincount(sentence, minlength=n))]).astype(np.int64)
        square = np.concatenate([[0], np.cumsum(self.rarity[terms].astype(float) ** 2)])
        square = square[unit_starts[1:]] - square[unit_starts[:-1]]
        size = np.sqrt(np.maximum(np.bincount(sentence, square[units[np.argsort(by)]] if len(by) else None, n), 1e-9)).astype(np.float32)
        given = (units, starts, terms, unit_starts, size)
        may = np.where(allowed[found.post] > 0, 1.0, how.doubt)
        none = allowed[found.post].sum(axis=1) == 0
        flat = np.full(self.k, 1 / self.k)
        half, every, target = found.post % 2, np.arange(n), may / may.sum(axis=1, keepdims=True)
        target[none] = flat
        said = np.tile(flat, (n, 1))
        states = [self._fresh(0), self._fresh(1)]
        epochs = max(1, round(2 * how.steps * how.batch / max(n, 1)))
        for _ in range(how.rounds if n else 0):
            for h, state in enumerate(states):
                self._train(state, target.astype(np.float32), every[half != h], epochs, *given)
                self.weights, self.bias = state["weights"], state["bias"]
                said[half == h] = Scorer(self).predict(names, found)[half == h]
            target = said * may
            target /= target.sum(axis=1, keepdims=True)
            target[(said.max(axis=1) < how.sure - 0.1) | none] = flat
        state = self._fresh(2)
        self._train(state, target.astype(np.float32), every, epochs + 1, *given)
        self.weights, self.bias = state["weights"], state["bias"]
        return said


class Scorer:
    """A term model at work on the words of one reader. What the terms of a word add to a score is summed once, so a
    sentence costs one row per word and pair."""

    def __init__(self, model: TermModel) -> None:
        self.model = model
        self._added, self._heads = np.zeros((0, model.k + 1), np.float32), np.zeros(0, np.int64)

    def _learn(self, names: list[str]) -> None:
        """Sum up what each new word adds: its terms' weights, and the square of its length."""
        m = self.model
        each = [[m.place[t] for t in terms if m.place[t] >= 0] for terms in (word_terms(w, m.how.terms) for w in names)]
        added = np.zeros((len(names), m.k + 1), np.float32)
        n = np.array([len(t) for t in each], np.int64)
        some = np.flatnonzero(n)
        if len(some):
            t = np.fromiter(chain.from_iterable(each), np.int64)
            rare = m.rarity[t][:, None]
            added[some] = np.add.reduceat(np.concatenate([m.weights[t] * rare, rare * rare], axis=1), (np.cumsum(n) - n)[some], axis=0)
        self._added = np.concatenate([self._added, added])
        self._heads = np.concatenate([self._heads, np.array([zlib.crc32(w.encode("utf-8", "replace")) % m.how.terms for w in names], np.int64)])

    def predict(self, names: list[str], found: Sentences) -> np.ndarray:
        """The probabilities of each sentence. ``names`` may only grow from call to call."""
        m, n = self.model, len(found.post)
        if len(names) > len(self._added):
            self._learn(names[len(self._added) :])
        if not n:
            return np.zeros((0, m.k), np.float32)
        total = np.add.reduceat(self._added[found.words], found.starts[:-1], axis=0)
        pair, of = _pairs(self._heads[found.words], found.starts, m.how.terms)
        t = m.place[pair]
        t, of = t[t >= 0], of[t >= 0]
        if len(t):
            rare = m.rarity[t][:, None]
            first = np.flatnonzero(np.r_[True, np.diff(of) != 0])
            total[of[first]] += np.add.reduceat(np.concatenate([m.weights[t] * rare, rare * rare], axis=1), first, axis=0)
        return _softmax(total[:, :-1] / np.sqrt(np.maximum(total[:, -1:], 1e-9)) + m.bias)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def evidence(said: np.ndarray, post: np.ndarray, n: int, sure: float) -> np.ndarray:
    """Per post and subject: share of bearing sentences, their number, the mean and the highest probability, and the share of the probabilities of bearing sentences; (n, k, 5)."""
    k = said.shape[1]
    out = np.zeros((n, k, 5))
    best, certain = said.argmax(axis=1), said.max(axis=1) >= sure
    out[:, :, 1] = np.bincount(post[certain] * k + best[certain], minlength=n * k).reshape(n, k)
    bearing = out[:, :, 1].sum(axis=1, keepdims=True)
    out[:, :, 0] = out[:, :, 1] / np.maximum(bearing, 1)
    for c in range(k):
        out[:, c, 2] = np.bincount(post[certain], said[certain, c], n)
    out[:, :, 4] = out[:, :, 2] / np.maximum(out[:, :, 2].sum(axis=1, keepdims=True), 1e-9)
    out[:, :, 2] /= np.maximum(bearing, 1)
    first = np.flatnonzero(np.r_[True, np.diff(post) != 0]) if len(post) else np.zeros(0, np.int64)
    if len(first):
        out[post[first], :, 3] = np.maximum.reduceat(said, first, axis=0)
    return out


class Chain:
    """Logistic classifiers in order of frequency; each sees its subject's evidence, the post and the labels before it."""

    def __init__(self, how: Subjects) -> None:
        self.how = how

    def _inputs(self, j: int, seen: np.ndarray, about: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Rows for subject ``j``; ``before`` has the labels decided so far, others 0."""
        e = seen[:, j]
        rival = np.delete(seen[:, :, 0], j, axis=1).max(axis=1, keepdims=True) if seen.shape[1] > 1 else np.zeros((len(e), 1))
        return np.concatenate([np.ones((len(e), 1)), e[:, :1], np.log1p(e[:, 1:2]), e[:, 2:], rival, PRIOR * about, PRIOR * before, PRIOR * before.sum(axis=1, keepdims=True)], axis=1)

    def fit(self, seen: np.ndarray, about: np.ndarray, labels: np.ndarray) -> None:
        """Train on ``labels`` (posts x subjects): 1 for yes, 0 for no, NaN for unknown.

        A first round leaves unknown labels out; what it says of them stands in for them among the labels before a
        subject in the second. Only known labels are ever learnt. As a yes is known for some of a post's subjects only,
        each stands for its share of the unknown ones too.
        """
        n, k, _ = seen.shape
        named = np.maximum((labels == 1).sum(axis=1), 1)
        weight = (named + np.isnan(labels).sum(axis=1)) / named
        self.order = np.argsort(-np.nansum(labels, axis=0), kind="stable")
        half = np.arange(n) % 2 == 0
        decided = np.nan_to_num(labels)
        for last in (False, True):
            self.weights, self.scale = {}, {}
            before = np.zeros((n, k))
            for j in self.order:
                x, known = self._inputs(j, seen, about, before), ~np.isnan(labels[:, j])
                y = labels[known, j]
                worth = np.where(labels[:, j] == 1, weight, 1.0)
                self.weights[j], self.scale[j] = _logistic(x[known], y, 0.1, worth[known]), np.array([0.0, 1.0])
                if last and 0 < y.sum() < len(y):
                    # calibration: slope and offset for the scores of the half that a model has not seen
                    sides = [_logistic(x[known & side], labels[known & side, j], 0.1, worth[known & side]) for side in (~half, half)]
                    scores = np.where(half, x @ sides[0], x @ sides[1])[known]
                    self.scale[j] = _logistic(np.stack([np.ones(len(y)), scores], axis=1), y, 1e-3, worth[known])
                sure = self.scale[j][0] + self.scale[j][1] * (x @ self.weights[j])
                decided[:, j] = np.where(known, np.nan_to_num(labels[:, j]), sure > 0)
                before[:, j] = decided[:, j]

    def predict(self, seen: np.ndarray, about: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest label combination of each post (n, k) and its probability, by beam search along the chain."""
        n, k, _ = seen.shape
        labels, score = np.zeros((n, 1, k)), np.zeros((n, 1))
        for j in self.order:
            width = labels.shape[1]
            flat = labels.reshape(n * width, k)
            z = self._inputs(j, np.repeat(seen, width, axis=0), np.repeat(about, width, axis=0), flat) @ self.weights[j]
            z = np.clip(self.scale[j][0] + self.scale[j][1] * z, -30, 30).reshape(n, width)
            yes = labels.copy()
            yes[:, :, j] = 1
            labels, score = np.concatenate([labels, yes], axis=1), np.concatenate([score - np.logaddexp(0, z), score - np.logaddexp(0, -z)], axis=1)
            if labels.shape[1] > self.how.beam:
                top = np.argsort(-score, axis=1, kind="stable")[:, : self.how.beam]
                labels, score = np.take_along_axis(labels, top[:, :, None], axis=1), np.take_along_axis(score, top, axis=1)
        best = np.argmax(score, axis=1)
        return labels[np.arange(n), best], np.exp(score[np.arange(n), best])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, worth: np.ndarray | float = 1.0) -> np.ndarray:
    """Weights of a logistic regression with a ridge, rows counting as ``worth``, by Newton's method; steps that don't lower the loss are halved.

    Nearly separable labels make full steps overshoot for good, which would lose a subject.
    """
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((worth * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * (w @ w))

    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (worth * p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (worth * (y - p)) - ridge * w)
        size = 1.0
        while size > 1e-6 and (then := loss(w + size * step)) > now:
            size /= 2
        if size <= 1e-6:
            break
        w, gained, now = w + size * step, now - then, then
        if gained < 1e-6 * (1 + now):
            break
    return w


@dataclass
class SubjectModel:
    names: list[str]
    terms: TermModel
    chain: Chain
    how: Subjects


def _source(source: str | None, buckets: int) -> list[float]:
    out = [0.0] * buckets
    out[zlib.crc32((source or "").encode("utf-8", "replace")) % buckets] = 1.0
    return out


def _read(reader: Reader, texts: list[str | None], sources: list[str | None], how: Subjects) -> tuple[Sentences, np.ndarray]:
    """The sentences of the posts' own prose, and what is known about each post."""
    prose = [own_prose(t or "") for t in texts]
    found = reader.read(prose)
    n = np.bincount(found.post, minlength=len(texts))
    about = [structure(t or "", p, int(m)) + _source(s, how.sources) for t, p, m, s in zip(texts, prose, n, sources, strict=True)]
    return found, np.array(about).reshape(len(texts), N_STRUCTURE + how.sources)


def fit_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, how: Subjects = Subjects()) -> SubjectModel:
    """Train on at most ``label_rows`` rows of ``labels`` (label_id, doc_id, subject) and the posts they belong to.

    Subjects are compared without case and outer blanks; a null subject says that a post has none; labels of unknown
    subjects or lost posts are left out. Sentences are found in Spark tasks; only the words of the bounded sample come to
    the driver.

    A label row names one subject of a post, which may have others. So the chain takes a labelled subject as a yes, one
    that fewer than ``share`` of the bearing sentences are about as a no, and any other one as unknown.
    """
    names = sorted(r[0] for r in areas.where("subject is not null").select("subject").distinct().collect())
    number = {s.strip().lower(): i for i, s in enumerate(names)}
    known = F.lower(F.trim("subject"))
    rows = labels.where(F.col("subject").isNull() | known.isin(list(number))).where("doc_id is not null")
    rows = rows.select("label_id", "doc_id", known.alias("subject")).orderBy(F.xxhash64("label_id"), "label_id").limit(how.label_rows)
    labelled = rows.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))  # at most label_rows rows
    posts = documents.select("doc_id", "text", "source").where("text is not null").join(F.broadcast(labelled), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            found, about = _read(reader, batch.column(1).to_pylist(), batch.column(2).to_pylist(), how)
            known, n = reader.names, np.bincount(found.post, minlength=batch.num_rows)
            sized = np.bincount(found.post, np.diff(found.starts), batch.num_rows)
            said = np.array([" ".join([known[w] for w in found.words[a:b]]) for a, b in zip(found.starts[:-1], found.starts[1:])], object)
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(about.tolist(), pa.list_(pa.float64())), pa.array([said[e - m : e].tolist() if w <= how.label_words else None for e, m, w in zip(ends, n, sized)], pa.list_(pa.string()))],
                ["doc_id", "subjects", "about", "said"],
            )

    got = posts.mapInArrow(run, "doc_id bigint, subjects array<string>, about array<double>, said array<string>").where("said is not null").toArrow().sort_by("doc_id")
    n = got.num_rows
    allowed = np.zeros((n, len(names)))
    for i, found in enumerate(got["subjects"].to_pylist()):
        for s in found:
            allowed[i, number[s]] = 1
    each = got["said"].to_pylist()
    words: dict[str, int] = {}
    flat = np.fromiter((words.setdefault(w, len(words)) for s in chain.from_iterable(each) for w in s.split(" ")), np.int64)
    starts = np.concatenate([[0], np.cumsum([s.count(" ") + 1 for s in chain.from_iterable(each)])]).astype(np.int64)
    post = np.repeat(np.arange(n), [len(s) for s in each]).astype(np.int64)
    about = np.array(got["about"].to_pylist()).reshape(n, N_STRUCTURE + how.sources)
    terms = TermModel(how, len(names))
    said = terms.fit(list(words), Sentences(flat, starts, post), allowed)
    seen = evidence(said, post, n, how.sure)
    labels = np.where(allowed > 0, 1.0, np.where(seen[:, :, 0] >= how.share, np.nan, 0.0))
    chain_model = Chain(how)
    chain_model.fit(seen, about, labels)
    return SubjectModel(names, terms, chain_model, how)


def subjects_of(documents: DataFrame, model: SubjectModel) -> DataFrame:
    """``doc_id``, ``subject`` and ``probability`` (of the post's whole label combination) for each subject of each post.

    Null, empty and blank texts, and posts without prose of their own, have none. Repeated posts are labelled alike.
    Posts are classified where they are read; the model, of bounded size, is broadcast.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, reader = sent.value, Reader()
        scorer = Scorer(m.terms)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                if len(reader.words) > 500_000:
                    reader, scorer = Reader(), Scorer(m.terms)
                found, about = _read(reader, batch.column(1).to_pylist(), batch.column(2).to_pylist(), m.how)
                seen = evidence(scorer.predict(reader.names, found), found.post, batch.num_rows, m.how.sure)
                labels, sure = m.chain.predict(seen, about)
                labels[seen[:, :, 1] == 0] = 0  # a subject no sentence is about
                i, j = np.nonzero(labels)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array([m.names[x] for x in j], pa.string()), pa.array(sure[i])], ["doc_id", "subject", "probability"])

    return documents.select("doc_id", "text", "source").mapInArrow(run, "doc_id bigint, subject string, probability double")


def subject_shares(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Posts of each subject, and their share among all posts."""
    total = documents.agg(F.count(F.lit(1)).alias("n_all"))
    return found.groupBy("subject").agg(F.count_distinct("doc_id").alias("n_posts")).crossJoin(F.broadcast(total)).select("subject", "n_posts", (F.col("n_posts") / F.col("n_all")).alias("share"))
