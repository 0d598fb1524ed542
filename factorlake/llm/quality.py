"""Quality rules over lines labelled by a linear-chain conditional random field.

Every line of a text is content or boilerplate. Its features are binned shares of
symbols, capitals and digits, lengths, repetition inside the line and of earlier
lines; a weight per bin and weights for neighbouring labels are learned with
numpy from a bounded sample of labelled documents, whose quality is taken as the
label of all their lines. Viterbi decoding finds the best labels of a whole text, and
the share of its words in content lines decides whether it is kept.

Defined results: null and empty texts have no words and fail the base rules. Without labelled
rows of both kinds every line is content, so the base rules alone decide. Repeated
rows get equal results; null ids and further columns do not matter.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tuned
from .samples import labelled

#: Documents per label that the field is fitted on.
SAMPLE = 1_500
#: A text is kept if content lines hold this share of its words.
CONTENT = 0.5
MIN_WORDS = 50
#: Counted by n_symbols. Fixed by the definition of the base rules.
SYMBOLS = b"#*$%&|<>"
STEPS = 120

#: Upper borders of the bins of each line feature.
BINS = {
    "words": [0, 1, 2, 5, 12, 40],
    "word_length": [1.5, 3, 4, 5, 6, 8, 12],
    "symbols": [0.0, 0.01, 0.03, 0.08, 0.15, 0.3],
    "capitals": [0.0, 0.02, 0.06, 0.15, 0.4],
    "digits": [0.0, 0.02, 0.08, 0.2],
    "marks": [0.0, 0.02, 0.05, 0.1, 0.2],
    "distinct": [0.1, 0.25, 0.5, 0.75, 0.9],
    "repeated": [0.5],
    "stop": [0.5],
}
WIDTHS = [len(b) + 1 for b in BINS.values()]
OFFSETS = np.concatenate([[0], np.cumsum(WIDTHS)[:-1]])
N_WEIGHTS = sum(WIDTHS)


def byte_table(*which: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    for chars in which:
        table[list(chars)] = 1
    return table


IS_SYMBOL = byte_table(SYMBOLS)
IS_LINE_SYMBOL = byte_table(SYMBOLS, b"={}[]\\/~^_@")
IS_CAPITAL = byte_table(bytes(range(65, 91)))
IS_DIGIT = byte_table(b"0123456789")
IS_MARK = byte_table(b".,;:!?\"'()-")
#: First bytes of characters that are no white space.
IS_WORD_CHAR = np.array([b & 0xC0 != 0x80 and b not in b" \t\n\r\x0b\x0c" for b in range(256)], dtype=np.uint8)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more in the text."""
    if len(words) < 4:
        return 0
    place = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(place) == len(words):
        return 0
    at = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))
    v = len(place)
    pair = at[:-1] * v + at[1:]
    if v >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    _, inverse, counts = np.unique(pair[:-1] * v + at[2:], return_inverse=True, return_counts=True)
    hit = counts[inverse] > 1
    inside = np.zeros(len(words), dtype=bool)
    for j in range(3):
        inside[j : j + len(hit)] |= hit
    return int(inside.sum())


def measure(texts: list[bytes]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Base numbers per text; per line: bins of features, words, and how many lines each text has."""
    joined = b"\n".join(texts)
    raw = np.frombuffer(joined + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    lines = joined.split(b"\n")
    n_lines = np.array([t.count(b"\n") + 1 for t in texts])
    per_line = lambda table: np.add.reduceat(table[raw], starts, dtype=np.int64)
    chars, symbols = per_line(IS_WORD_CHAR), per_line(IS_SYMBOL)
    split = [line.split() for line in lines]
    words = np.array([len(w) for w in split])
    distinct = np.array([len(set(w)) for w in split])
    repeated = np.zeros(len(lines), dtype=np.int64)
    repeats, first = [], np.concatenate([[0], np.cumsum(n_lines)])
    for text, i, j in zip(texts, first, first[1:], strict=False):
        seen = set()
        for k in range(i, j):
            if words[k]:
                if lines[k] in seen:
                    repeated[k] = 1
                seen.add(lines[k])
        repeats.append(repeated_words(text.split()))
    per_text = lambda x: np.add.reduceat(x, first[:-1])
    base = pd.DataFrame({
        "n_words": per_text(words), "word_chars": per_text(chars), "n_symbols": per_text(symbols), "n_dup_lines": per_text(repeated),
        "n_repeat_words": np.array(repeats, dtype=np.int64),
    })
    size = np.maximum(chars, 1)
    last = np.array([line.rstrip()[-1:] in (b".", b"!", b"?") for line in lines])
    values = [
        words, chars / np.maximum(words, 1), per_line(IS_LINE_SYMBOL) / size, per_line(IS_CAPITAL) / size, per_line(IS_DIGIT) / size,
        per_line(IS_MARK) / size, distinct / np.maximum(words, 1), repeated, last,
    ]
    bins = np.stack([np.searchsorted(b, x) + o for b, x, o in zip(BINS.values(), values, OFFSETS, strict=True)], axis=1)
    return base, bins, words, n_lines


class Field:
    """The random field: label 1 is boilerplate; `weights` of bins speak for it, `chain` for neighbouring labels."""

    def __init__(self):
        self.weights = np.zeros(N_WEIGHTS)
        self.chain = np.zeros((2, 2))

    def emissions(self, bins: np.ndarray) -> np.ndarray:
        return self.weights[bins].sum(axis=1)

    def padded(self, values: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(steps, texts) from line values, longest text first, and the order taken."""
        order = np.argsort(-n_lines, kind="stable")
        first = np.concatenate([[0], np.cumsum(n_lines)[:-1]])
        out = np.zeros((n_lines.max(), len(n_lines)))
        for column, i in enumerate(order):
            out[: n_lines[i], column] = values[first[i] : first[i] + n_lines[i]]
        return out, order

    def viterbi(self, bins: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        """Best label of every line."""
        score, order = self.padded(self.emissions(bins), n_lines)
        steps, active = len(score), np.array([(n_lines > t).sum() for t in range(len(score))])
        best = np.zeros((2, len(n_lines)))
        best[1] = score[0]
        back = np.zeros((steps, 2, len(n_lines)), dtype=bool)
        for t in range(1, steps):
            a = active[t]
            for to in (0, 1):
                stay, move = best[0, :a] + self.chain[0, to], best[1, :a] + self.chain[1, to]
                back[t, to, :a] = move > stay
            new = [np.where(back[t, to, :a], best[1, :a] + self.chain[1, to], best[0, :a] + self.chain[0, to]) for to in (0, 1)]
            best[0, :a], best[1, :a] = new[0], new[1] + score[t, :a]
        label = best[1] > best[0]
        out = np.empty(len(bins), dtype=bool)
        first = np.concatenate([[0], np.cumsum(n_lines)[:-1]])[order]
        size = n_lines[order]
        for t in range(steps - 1, -1, -1):
            a = active[t]
            out[first[:a] + t] = label[:a]
            if t:
                label[:a] = np.where(label[:a], back[t, 1, :a], back[t, 0, :a])
        assert len(out) == size.sum()
        return out

    def fit(self, bins: np.ndarray, n_lines: np.ndarray, label: np.ndarray, steps: int = STEPS) -> "Field":
        """Gradient ascent (Adam) on the penalised likelihood of the line labels."""
        y, order = self.padded(label.astype(float), n_lines)
        active = np.array([(n_lines > t).sum() for t in range(len(y))])
        theta = np.zeros(N_WEIGHTS + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        first = np.concatenate([[0], np.cumsum(n_lines)[:-1]])[order]
        at = np.concatenate([first[:a] + t for t, a in enumerate(active)])
        y0 = y.astype(int)
        seen = np.zeros((2, 2))
        for t in range(1, len(y)):
            a = active[t]
            np.add.at(seen, (y0[t - 1, :a], y0[t, :a]), 1)
        n = max(1, len(bins))
        for step in range(1, steps + 1):
            self.weights, self.chain = theta[:N_WEIGHTS], theta[N_WEIGHTS:].reshape(2, 2)
            p1, moves = self.marginals(self.padded(self.emissions(bins), n_lines)[0], active)
            wrong = np.concatenate([y[t, :a] - p1[t, :a] for t, a in enumerate(active)])
            grad = np.zeros(N_WEIGHTS)
            for column in bins[at].T:
                grad += np.bincount(column, weights=wrong, minlength=N_WEIGHTS)
            g = np.concatenate([grad, (seen - moves).ravel()]) / n - 1e-4 * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        self.weights, self.chain = theta[:N_WEIGHTS], theta[N_WEIGHTS:].reshape(2, 2)
        return self

    def marginals(self, score: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(label 1) per line and expected label moves, by the forward-backward recursion."""
        steps, texts = score.shape
        move = np.exp(self.chain - self.chain.max())
        emit = np.stack([np.ones_like(score), np.exp(np.clip(score, -30, 30))], axis=1)
        emit /= emit.sum(axis=1, keepdims=True)
        ahead, behind = np.zeros((steps, 2, texts)), np.ones((steps, 2, texts))
        ahead[0] = emit[0]
        for t in range(1, steps):
            a = active[t]
            ahead[t, :, :a] = emit[t, :, :a] * (move.T @ ahead[t - 1, :, :a])
            ahead[t, :, :a] /= ahead[t, :, :a].sum(axis=0)
        moves = np.zeros((2, 2))
        for t in range(steps - 1, 0, -1):
            a = active[t]
            later = emit[t, :, :a] * behind[t, :, :a]
            both = ahead[t - 1, :, None, :a] * move[:, :, None] * later[None]
            moves += (both / both.sum(axis=(0, 1))).sum(axis=2)
            behind[t - 1, :, :a] = move @ later
            behind[t - 1, :, :a] /= behind[t - 1, :, :a].sum(axis=0)
        joint = ahead * behind
        return joint[:, 1] / np.maximum(joint.sum(axis=1), 1e-300), moves


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Field:
    """The field learned from a bounded sample; all lines are content where there is nothing to learn from."""
    rows = labelled(docs, labels, "quality", per_class)
    field = Field()
    if len({r[0] for r in rows}) < 2:
        return field
    _, bins, _, n_lines = measure([(r[1] or "").encode() for r in rows])
    return field.fit(bins, n_lines, np.repeat([1 - r[0] for r in rows], n_lines))


def judge(field: Field, texts: list[bytes], content: float = CONTENT) -> pd.DataFrame:
    """Base numbers, base_failed, content_share and kept of every text."""
    base, bins, words, n_lines = measure(texts)
    good = words * ~field.viterbi(bins, n_lines)
    share = np.add.reduceat(good, np.concatenate([[0], np.cumsum(n_lines)[:-1]])) / np.maximum(base["n_words"], 1)
    failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
    return base.assign(base_failed=failed, content_share=share, kept=~failed & (share >= content))


def verdict(text: Column, field: Field, content: float = CONTENT) -> Column:
    """Struct column with the base numbers, base_failed, content_share and kept of a text."""

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")
    def run(column: pd.Series) -> pd.DataFrame:
        if len(column) == 0:
            return judge(field, [b""], content).iloc[:0]
        return judge(field, [b"" if x is None else x.encode() for x in column], content)

    return run(text)


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", name: str = "verdict") -> DataFrame:
    """All columns and the verdict."""
    tuned(docs.sparkSession)
    return docs.withColumn(name, verdict(F.col(text), fit(docs, labels)))
