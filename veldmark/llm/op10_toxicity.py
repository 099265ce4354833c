"""Toxicity by a subsequence string kernel with Nyström landmarks and a support vector machine.

Each word is a string ``^word$``. Its features are the ordered triples of characters that span at most
``SPAN`` characters, each weighing ``DECAY`` for every character that it skips, so "i.d.i.o.t" and
"idxiot" share most of their triples with "idiot". The kernel of two words is the product of their
features. A machine with squared hinge loss is fitted on Nyström features (kernels with the
landmarks, whitened by the landmarks' own kernel matrix). As that kernel is a product, the fitted
function folds, without approximation, into one weight for each triple that occurs in a landmark
(triples are numbered by a hash of 20 bits, so two may share a weight), so scoring costs one look-up a triple and not one kernel a landmark.

Training sentences are words of labelled documents: what toxic documents repeat and clean ones
lack, against words of clean documents. Then two rounds add the clean words that score worst and drop the toxic ones that
score as clean. A document's score comes from its two most toxic words by a logistic fit.
Only the text is ever an input; labels are used in fitting alone.

At most ``max_docs`` labelled documents of each class, the first by a hash of doc_id, are used in the fit;
all documents are scored over their whole texts. Null and empty texts get the score of a text without
words. Without labels of both classes every score is 0. Repeated rows get equal scores; of several rows with one doc_id the smallest text is
learned from. An empty table stays empty, and further columns stay, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.llm import common

BITS, SPAN, DECAY, LONGEST = 20, 5, 0.6, 32
#: Distances of the second and third character from the first.
STEPS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
_SPELT = re.compile(r"(?:(?<=\s)|^)(?:\w\s){3,}\w(?=\s|$)")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, triple number, weight) of all words, weights scaled to length one for each word."""
    text = "".join(f"^{w}$" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    ends = np.cumsum([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    left = ends[owner] - np.arange(len(codes))
    rows, ids, weights = [], [], []
    for i, j in STEPS:
        at = np.flatnonzero(left > j)
        key = codes[at] * np.uint64(0x9E3779B97F4A7C15) + codes[at + i] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[at + j] * np.uint64(0x165667B19E3779F9)
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        rows.append(owner[at])
        ids.append((key >> np.uint64(64 - BITS)).astype(np.int64))
        weights.append(np.full(len(at), DECAY ** (j - 2)))
    rows, ids, weights = map(np.concatenate, (rows, ids, weights))
    norm = np.sqrt(np.bincount(rows, weights**2, minlength=len(words)))
    return rows, ids, weights / norm[rows]


class Kernel:
    """Kernels of words with fixed landmarks."""

    def __init__(self, landmarks: list[str]):
        rows, ids, weights = features(landmarks)
        self.known, place = np.unique(ids, return_inverse=True)
        self.matrix = np.zeros((len(self.known) + 1, len(landmarks)))
        np.add.at(self.matrix, (place, rows), weights)
        values, vectors = np.linalg.eigh(self.with_landmarks(landmarks))
        keep = values > 1e-6 * values.max()
        self.whiten = vectors[:, keep] / np.sqrt(values[keep])

    def with_landmarks(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.matrix.shape[1]))
        for a in range(0, len(words), 400):
            rows, ids, weights = features(words[a : a + 400])
            place = np.searchsorted(self.known, ids).clip(max=len(self.known) - 1)
            hit = self.known[place] == ids
            np.add.at(out, a + rows[hit], weights[hit, None] * self.matrix[place[hit]])
        return out

    def features(self, words: list[str]) -> np.ndarray:
        return self.with_landmarks(words) @ self.whiten


def fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Squared-hinge machine by Newton steps; the last entry is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    active = np.ones(len(y), bool)
    for _ in range(rounds):
        xa, c = x[active], cost[active, None]
        w = np.linalg.solve(ridge + xa.T @ (c * xa), xa.T @ (c[:, 0] * y[active]))
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


def tokens(text: str) -> set[str]:
    """White-space separated words in lower case; spelt-out words ("i d i o t") are joined."""
    text = text.lower()
    found = set(text.split())
    if len(found) < len(text):
        found.update(re.sub(r"\s", "", m[0]) for m in _SPELT.finditer(text))
    return found


def parts(token: str) -> list[str]:
    """A token without the marks around it, and without those inside if it has any; a long one as overlapping pieces."""
    token = _EDGE.sub("", token)
    if not token.isalnum() and token.isprintable() and (bare := re.sub(r"[\W_]+", "", token)) != token:
        return [*_pieces(token), *_pieces(bare)]
    return _pieces(token)


def _pieces(token: str) -> list[str]:
    if len(token) <= LONGEST:
        return [token] if len(token) > 1 else []
    return [token[i : i + LONGEST] for i in range(0, len(token) - LONGEST // 2, LONGEST // 2)]


class Model:
    """One weight for each triple, the bias, and the logistic fit from word margins to a document's score."""

    def __init__(self, kernel: Kernel, w: np.ndarray):
        beta = kernel.whiten @ w[:-1]
        self.table = np.zeros(1 << BITS, "float32")
        self.table[kernel.known] = kernel.matrix[:-1] @ beta
        self.bias, self.logit = float(w[-1]), np.array([-4.0, 0.0, 0.0])

    def margins(self, words: list[str]) -> np.ndarray:
        out = [np.zeros(0)]
        for a in range(0, len(words), 4000):
            block = words[a : a + 4000]
            rows, ids, weights = features(block)
            out.append(np.bincount(rows, weights * self.table[ids], minlength=len(block)) + self.bias)
        return np.concatenate(out)

    def learn_words(self, new: list[str], cache: dict[str, float]) -> None:
        for a in range(0, len(new), 4000):
            block = [(t, parts(t)) for t in new[a : a + 4000]]
            flat = [p for _, ps in block for p in ps]
            m, at = self.margins(flat), 0
            for t, ps in block:
                cache[t] = float(m[at : at + len(ps)].max()) if ps else -2.0
                at += len(ps)

    def best_two(self, texts: list[str], cache: dict[str, float], limit: int = 200_000) -> np.ndarray:
        """The two largest margins of words of each text."""
        return self.best_of([tokens(t) for t in texts], cache, limit)

    def best_of(self, sets: list[set[str]], cache: dict[str, float], limit: int = 200_000) -> np.ndarray:
        if len(cache) > limit:
            cache.clear()
        self.learn_words(list(set().union(*sets) - cache.keys()), cache)
        out = np.full((len(sets), 2), -2.0)
        for i, s in enumerate(sets):
            two = sorted([cache[t] for t in s], reverse=True)[:2]
            out[i, : len(two)] = two
        return out.clip(-2, 2)

    def score(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(best @ self.logit[1:] + self.logit[0])))


class Bags:
    """The `tokens` of texts, as numbers of a vocabulary: four bytes a token, and each distinct one once."""

    def __init__(self, texts=()):
        self.numbers, self.vocabulary, self.rows = {}, [], []
        for t in texts:
            self.add(t)

    def add(self, text: str) -> None:
        found = tokens(text)
        for t in found:
            if t not in self.numbers:
                self.numbers[t] = len(self.vocabulary)
                self.vocabulary.append(t)
        self.rows.append(np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found)))

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> list[str]:
        if i >= len(self.rows):
            raise IndexError(i)
        return [self.vocabulary[j] for j in self.rows[i]]


def fit(texts: list[str] | Bags, labels: np.ndarray, n_landmarks: int = 192, seed: int = 7) -> Model | None:
    """Fit on labelled texts, or on their `Bags` (1 is toxic)."""
    texts = texts if isinstance(texts, Bags) else Bags(texts)
    rng, order = np.random.default_rng(seed), np.argsort(-labels, kind="stable")
    bad, good, seen = Counter(), Counter(), set()
    for i in order:
        words = {p for t in texts[i] for p in parts(t)}
        if labels[i]:
            low = [min((hash_of(w, k) for w in words), default=k) for k in range(20)]
            marks = {tuple(low[k::4]) + (k,) for k in range(4)}
            if marks & seen:  # a near copy of a text that counts already
                continue
            seen |= marks
        (bad if labels[i] else good).update(words)
    n_bad, n_good = int(labels.sum()), int((1 - labels).sum())
    if not n_bad or not n_good:
        return None
    ratio = max(1.0, n_bad / n_good)
    share = n_bad / (n_bad + n_good)
    for chance in (1e-4, 1e-2, 1):  # that a word of clean texts is only seen in toxic ones
        toxic = [w for w, n in bad.items() if n >= 9 * ratio * good[w] and share**n <= chance]
        if len(toxic) >= 3:
            break
    toxic = sorted(toxic, key=lambda w: (-bad[w], w))[:3000]
    clean = [w for w, n in good.items() if 4 * bad[w] <= n * max(1.0, n_bad / n_good) + 2]
    if not toxic or not clean:
        return None
    clean = sorted(clean, key=lambda w: (-good[w], w))
    common_words, rest = clean[:3000], clean[3000:]
    negatives = common_words + [rest[i] for i in rng.permutation(len(rest))[:6000]]
    weight = np.array([min(bad[w], 20) for w in toxic], float)
    model = None
    for _ in range(3):
        p = weight / weight.sum()
        k = min(len(toxic), n_landmarks * 2 // 3)
        landmarks = [toxic[i] for i in np.argsort(-weight, kind="stable")[: k // 2]]
        landmarks = list(dict.fromkeys(landmarks + [toxic[i] for i in rng.choice(len(toxic), k - len(landmarks), replace=False, p=p)]))
        landmarks += [negatives[i] for i in rng.permutation(len(negatives))[: n_landmarks - len(landmarks)]]
        kernel = Kernel(landmarks)
        words = toxic + negatives
        y = np.r_[np.ones(len(toxic)), -np.ones(len(negatives))]
        cost = np.r_[weight / weight.sum() * len(negatives) * 0.5, np.ones(len(negatives))]
        model = Model(kernel, fit_svm(kernel.features(words), y, cost))
        margin = model.margins(toxic)
        keep = margin > -0.2
        if keep.any():
            toxic, weight = [w for w, x in zip(toxic, keep) if x], weight[keep]
        hard = model.margins(clean)
        worst = [clean[i] for i in np.argsort(-hard, kind="stable")[:3000]]
        negatives = list(dict.fromkeys(negatives + worst))
    cache: dict[str, float] = {}
    best = np.concatenate([model.best_of([texts[i] for i in range(a, min(a + 200, len(texts)))], cache, 50_000) for a in range(0, len(texts), 200)])
    x = np.hstack([np.ones((len(best), 1)), best])
    w = np.array([0.0, 1.0, 0.0])
    share = np.ones(len(labels))
    for _ in range(50):  # Newton steps with a weak ridge, so that separable labels end too
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (share * (p - labels)) + 0.1 * w
        h = (x * (share * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    model.logit = w
    return model


def hash_of(word: str, seed: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, seed)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 3000) -> Model | None:
    """Fit on at most ``max_docs`` labelled documents of each class, the first by a hash of doc_id."""
    named = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    base, words, classes = docs.select("doc_id", "text"), Bags(), []
    for value in (0, 1):
        ids = named.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
        rows = base.join(F.broadcast(ids.select("doc_id")), "doc_id").where("text is not null").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id")
        for r in rows.toLocalIterator():  # a partition of texts at a time; their distinct words are kept
            words.add(r["text"])
            classes.append(value)
    model = fit(words, np.array(classes, float)) if classes else None
    del words
    common.give_back()
    return model


def score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """``docs`` (with a column text) and the score as a column ``name``, which replaces one of that name."""
    docs = common.lean(docs.drop(name))
    held = docs.sparkSession.sparkContext.broadcast(model)  # a table of 4 MB

    def run(frames):
        m, cache = held.value, {}
        for pdf in common.batches(frames):
            out = np.zeros(len(pdf))
            if m is not None:
                texts = pdf["text"].fillna("").tolist()
                for a in range(0, len(texts), 500):
                    out[a : a + 500] = m.score(m.best_two(texts[a : a + 500], cache))
            yield pdf.assign(**{name: out})

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInPandas(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


HELD_OUT = "crc32(coalesce(cast(doc_id as string), '')) % 5 = 0"


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs.where(f"not ({HELD_OUT})"), common.table(spark, sf_dir, "labels").where(f"not ({HELD_OUT})"))
    scored = score(docs, model)
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", F.expr("if(score >= 0.5, 1, 0)").alias("predicted"))
