"""Toxicity by a convolutional text classifier, trained and run in numpy.

A word (letters and digits, in lower case) has the sum of hashed vectors: two of the word
itself, so that a rare word shares both with hardly any other, and one of each of its
beginnings of 3 to 7 letters. Filters of several widths run over the word vectors; of each
filter the largest and the third largest response over the whole text are kept (max
pooling that also tells one hit from several) and feed a logistic layer. The vectors start
from the log odds of their buckets, then everything is trained by gradient steps on a
bounded sample of labelled documents.

Thresholds are calibrated by language on a part of the sample that takes no gradient
steps: the language is guessed from the text by word counts, and a score is shifted so
that the best threshold of its language becomes `THRESHOLD`.

Defined results: null and empty texts are one blank position and get a score like any other.
Without labelled rows of both kinds every score is 0. Repeated rows get equal scores.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, tuned
from .samples import labelled

#: Documents per label that the classifier is fitted on.
SAMPLE = 3_000
THRESHOLD = 0.7
BUCKETS, SIZE = 1 << 17, 8
WIDTHS, FILTERS = (1, 2, 3), 6
RANKS = (0, 2)
BEGINNINGS = (3, 4, 5, 6, 7)
PARTS = 2 + len(BEGINNINGS)
EPOCHS, BATCH, RATE = 4, 16, 0.01
#: Share of the sample that calibrates, and the fewest texts of either label that give a language its own threshold.
CALIBRATION, FEWEST = 0.25, 6
#: Raw words whose vectors a worker remembers; beyond, it starts again.
REMEMBERED = 200_000
EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def parts_of(raw: bytes) -> list[int]:
    """Buckets of a raw word: twice of the word, then of its beginnings; bucket 0 is blank."""
    word = EDGE.sub("", raw.decode("utf-8", "replace").lower())
    if not word:
        return [0] * PARTS
    h = xxhash.xxh64_intdigest(word, 7)
    short = [xxhash.xxh64_intdigest(word[:k], k) % (BUCKETS - 1) + 1 if len(word) >= k else 0 for k in BEGINNINGS]
    return [h % (BUCKETS - 1) + 1, (h >> 32) % (BUCKETS - 1) + 1, *short]


class Words(dict):
    """Numbers of raw words in the order in which they came."""

    def __missing__(self, raw: bytes) -> int:
        self[raw] = found = len(self)
        return found


@dataclass
class Net:
    """Vectors of buckets, filters by width, and the logistic layer."""

    table: np.ndarray
    filters: list = field(default_factory=list)
    bias: list = field(default_factory=list)
    out: np.ndarray | None = None
    shift: float = 0.0
    languages: list = field(default_factory=list)
    language_odds: np.ndarray | None = None
    offset: dict = field(default_factory=dict)

    def flat(self) -> np.ndarray:
        return np.concatenate([w.transpose(1, 0, 2).reshape(SIZE, -1) for w in self.filters], axis=1)

    def responses(self, products: np.ndarray) -> list[np.ndarray]:
        """(positions, filters) of each width from word vectors times filters; blanks stand before and after the text."""
        out, at = [], 0
        pad = np.zeros((max(WIDTHS) - 1, products.shape[1]), dtype=products.dtype)
        wide = np.concatenate([pad, products, pad])
        for k, b in zip(WIDTHS, self.bias, strict=True):
            n = len(wide) - k + 1
            out.append(sum(wide[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS] for j in range(k)) + b)
            at += k * FILTERS
        return out


def pooled(response: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest and third largest response of each filter (zero where there is none, or below), and where it stands."""
    n = len(response)
    most = max(RANKS) + 1
    if n > most:
        top = np.argpartition(-response, most - 1, axis=0)[:most]
    else:
        top = np.tile(np.arange(n)[:, None], (1, response.shape[1]))
    value = np.take_along_axis(response, top, axis=0)
    order = np.argsort(-value, axis=0)
    top, value = np.take_along_axis(top, order, axis=0), np.take_along_axis(value, order, axis=0)
    values, where = np.zeros((len(RANKS), response.shape[1])), np.full((len(RANKS), response.shape[1]), -1)
    for i, r in enumerate(RANKS):
        if r < n:
            values[i], where[i] = np.maximum(value[r], 0), np.where(value[r] > 0, top[r], -1)
    return values, where


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def start(buckets: np.ndarray, texts, labels: np.ndarray, rng) -> Net:
    """Vectors whose first number is the shrunken log odds of the bucket; a filter of width one reads it."""
    yes, no = max(1, labels.sum()), max(1, (1 - labels).sum())
    counts = np.zeros((2, BUCKETS))
    for t, y in zip(texts, labels, strict=True):
        counts[y, np.unique(buckets[t])] += 1
    odds = np.log((counts[1] + 0.5) / (yes + 1)) - np.log((counts[0] + 0.5) / (no + 1))
    table = rng.normal(0, 0.03, (BUCKETS, SIZE))
    table[:, 0] = np.clip(odds, -3, 3) * (1 - np.exp(-counts.sum(axis=0) / 3)) / PARTS
    table[0] = 0
    net = Net(table)
    for k in WIDTHS:
        w = rng.normal(0, 0.2, (k, SIZE, FILTERS))
        w[:, 0, 0] += 1.0 / k
        w[0, 0, 1] += 1.0
        net.filters.append(w)
        net.bias.append(np.full(FILTERS, -0.5))
    net.out = np.full(len(WIDTHS) * len(RANKS) * FILTERS, 0.1)
    net.shift = -1.0
    return net


class Adam:
    def __init__(self, rate: float):
        self.rate, self.state = rate, {}

    def step(self, name, value: np.ndarray, grad: np.ndarray, rows=None) -> None:
        """Moves value, or only some rows of it, against the gradient."""
        if name not in self.state:
            self.state[name] = [np.zeros_like(value), np.zeros_like(value)]
        m, v = self.state[name]
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        value[at] -= self.rate * m[at] * 3 / (np.sqrt(v[at]) + 1e-4)


def train(buckets: np.ndarray, texts, labels: np.ndarray, seed: int = 5, epochs: int = EPOCHS) -> Net:
    """Net from the buckets of numbered words, word numbers per text, and labels 0/1, which weigh the same in total."""
    rng = np.random.default_rng(seed)
    net = start(buckets, texts, labels, rng)
    weight = np.where(labels == 1, 0.5 / max(1e-9, labels.mean()), 0.5 / max(1e-9, 1 - labels.mean()))
    adam, blank = Adam(RATE), max(WIDTHS) - 1
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // BATCH)):
            flat = net.flat()
            grad_f = [np.zeros_like(w) for w in net.filters]
            grad_b = [np.zeros_like(b) for b in net.bias]
            grad_out, grad_shift, rows, grads = np.zeros_like(net.out), 0.0, [], []
            for i in batch:
                parts_at = buckets[texts[i]]
                x = net.table[parts_at].sum(axis=1)
                parts = [pooled(r) for r in net.responses(x @ flat)]
                hidden = np.concatenate([v.ravel() for v, _ in parts])
                d = weight[i] * (sigmoid(hidden @ net.out + net.shift) - labels[i]) / len(batch)
                grad_out += d * hidden
                grad_shift += d
                back = (d * net.out).reshape(len(WIDTHS), len(RANKS), FILTERS)
                for w, (k, (_, where)) in enumerate(zip(WIDTHS, parts, strict=True)):
                    rank, f = np.nonzero(where >= 0)
                    g = back[w][rank, f]
                    np.add.at(grad_b[w], f, g)
                    for j in range(k):
                        at = where[rank, f] + j - blank
                        inside = (at >= 0) & (at < len(x))
                        np.add.at(grad_f[w][j].T, f[inside], g[inside, None] * x[at[inside]])
                        rows.append(parts_at[at[inside]])
                        grads.append(g[inside, None] * net.filters[w][j].T[f[inside]])
            for w in range(len(WIDTHS)):
                adam.step(("f", w), net.filters[w], grad_f[w] + 1e-4 * net.filters[w])
                adam.step(("b", w), net.bias[w], grad_b[w])
            adam.step("out", net.out, grad_out + 1e-4 * net.out)
            net.shift -= RATE * grad_shift * 5
            if rows:
                r, g = np.concatenate(rows), np.concatenate(grads)
                at, inverse = np.unique(r.ravel(), return_inverse=True)
                total = np.zeros((len(at), SIZE))
                np.add.at(total, inverse, np.repeat(g, PARTS, axis=0))
                total[at == 0] = 0
                adam.step("table", net.table, total, at)
    return net


class Scorer:
    """A trained net beside what it makes of words: filter responses and language odds in one row per word."""

    def __init__(self, net: Net):
        self.net = net
        rows = [net.table.astype(np.float32) @ net.flat().astype(np.float32)]
        if net.languages:
            # the odds stand in the rows of the words themselves, not of their beginnings
            rows.append(net.language_odds.T)
        self.rows = np.concatenate(rows, axis=1)
        self.filters = rows[0].shape[1]
        self.known, self.seen = Words(), np.zeros((REMEMBERED, self.rows.shape[1]), dtype=np.float32)

    def learn(self, words: list[bytes]) -> np.ndarray:
        """Rows of the words of a text; new words are looked up together."""
        before = len(self.known)
        at = [self.known[w] for w in words]
        if len(self.known) > REMEMBERED:
            self.known.clear()
            before, at = 0, [self.known[w] for w in words]
            if len(self.known) > len(self.seen):
                self.seen = np.zeros((len(self.known), self.seen.shape[1]), dtype=np.float32)
        if len(self.known) > before:
            new = np.array([parts_of(w) for w in list(islice(reversed(self.known), len(self.known) - before))[::-1]])
            rows = self.rows[new[:, 0]]
            rows[:, : self.filters] += self.rows[new[:, 1:], : self.filters].sum(axis=1)
            self.seen[before : len(self.known)] = rows
        return self.seen[at]

    def judge(self, text: bytes) -> tuple[float, str | None]:
        """Logit, and the language whose word counts fit best (None without words)."""
        words = text.split()
        rows = self.learn(words) if words else np.zeros((0, self.rows.shape[1]), dtype=np.float32)
        hidden = [pooled(r)[0].ravel() for r in self.net.responses(rows[:, : self.filters])]
        lang = self.net.languages[int(rows[:, self.filters :].sum(axis=0).argmax())] if self.net.languages and words else None
        return float(np.concatenate(hidden) @ self.net.out + self.net.shift), lang

    def score(self, text: bytes) -> float:
        logit, lang = self.judge(text)
        return float(sigmoid(logit + self.net.offset.get(lang, self.net.offset.get(None, 0.0))))


def learn_languages(net: Net, buckets: np.ndarray, texts, langs) -> None:
    """Log probabilities of word buckets by language, from the sample's own column; scores see only the text."""
    net.languages = sorted({x for x in langs if x})
    counts = np.full((len(net.languages), BUCKETS), 0.1)
    for t, lang in zip(texts, langs, strict=True):
        if lang:
            np.add.at(counts[net.languages.index(lang)], buckets[t, 0], 1)
    if net.languages:
        net.language_odds = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """Middle of the gap at which F1 is best; of equal ones the middle."""
    order = np.argsort(-logits)
    x, y = logits[order], labels[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    i = best[len(best) // 2]
    return float((x[i] + x[i + 1]) / 2) if i + 1 < len(x) else float(x[i] - 1)


def calibrate(net: Net, texts: list[bytes], labels: np.ndarray) -> None:
    """Offsets that move the best cut of each language, guessed from the text, to the threshold."""
    scorer = Scorer(net)
    judged = [scorer.judge(t) for t in texts]
    logits, langs = np.array([x for x, _ in judged]), np.array([lang or "" for _, lang in judged])
    target = float(np.log(THRESHOLD / (1 - THRESHOLD)))
    if 0 < labels.sum() < len(labels):
        net.offset[None] = target - best_cut(logits, labels)
    for lang in net.languages:
        mine = langs == lang
        if min(labels[mine].sum(), (1 - labels[mine]).sum()) >= FEWEST:
            net.offset[lang] = target - best_cut(logits[mine], labels[mine])


def fit_rows(rows: list) -> Net | None:
    """The classifier from rows (label, text, lang)."""
    if len({r[0] for r in rows}) < 2:
        return None
    raw, words = [(r[1] or "").encode() for r in rows], Words()
    texts = [np.array([words[w] for w in t.split()], dtype=np.int64) for t in raw]
    buckets = np.fromiter((p for w in words or [b""] for p in parts_of(w)), dtype=np.int32).reshape(-1, PARTS)
    y = np.array([r[0] for r in rows])
    apart = np.random.default_rng(3).random(len(rows)) < CALIBRATION
    used = np.flatnonzero(~apart)
    net = train(buckets, [texts[i] for i in used], y[used])
    learn_languages(net, buckets, [texts[i] for i in used], [rows[i][2] for i in used])
    calibrate(net, [raw[i] for i in np.flatnonzero(apart)], y[apart])
    net.table = net.table.astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, where=None) -> Net | None:
    """The classifier learned from a bounded sample; `where` restricts the labelled ids that may be used."""
    return fit_rows(labelled(docs, labels, "toxic", per_class, where, ("text", "lang")))


def score(text: Column, net: Net | None, spark) -> Column:
    """Score of a text between 0 and 1."""
    if net is None:
        return F.lit(0.0)
    load = ship(spark, net)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(load())
        for column in batches:
            yield pd.Series([scorer.score(b"" if x is None else x.encode()) for x in column], dtype=float)

    return run(text)


def scored(docs: DataFrame, net: Net | None, text: str = "text", name: str = "score") -> DataFrame:
    """All columns and the score."""
    return docs.withColumn(name, score(F.col(text), net, tuned(docs.sparkSession)))
