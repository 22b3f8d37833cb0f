"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate.

Every line with a word is one position of the chain. Its features are a handful of bins (words,
share of symbols, of capitals, of digits, separators, sentence punctuation, licence words, whether
an earlier line of the text equals it, repetition inside), and the field's Viterbi path marks
each line. The share of a text's words that stand in content lines decides whether it is kept.

Training: labelled documents give each of their lines their own quality, but for lines that repeat
an earlier line or speak of licences, which are boilerplate everywhere. The field is fitted by
gradient ascent of the conditional log-likelihood on about SAMPLE documents, chosen by a hash of
the id, and on LINES lines of each at most. One in HELD of them, by a hash of the id, is kept from
the field; the share is chosen on these (on all, if either part lacks one of the kinds).

Defined cases: null text has no words and fails the base rules; a document that is labelled twice
counts by its lowest label; without labels of both kinds every line is content; very long
texts are marked whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_PY, read, share, taken

#: Labelled documents, about, and lines of each that the field is fitted on.
SAMPLE, LINES, HELD = 3000, 2000, 4
LEAST_WORDS, REPEATED_PERCENT = 50, 50
ITERATIONS, RATE, RIDGE, PIECE = 60, 0.5, 1e-3, 512
_WORD = re.compile(WORD_PY)
_SYMBOL = re.compile(r"[#*$%&|<>]")
_LICENCE = re.compile(r"licen[cs]e|copyright|all rights reserved|terms of use|privacy policy|cookie", re.I)
#: Upper edges of the bins of each measure.
WORDS_EDGES = (1, 2, 4, 8, 16, 32, 64)
SHARE_EDGES = (0.0, 0.05, 0.15, 0.3, 0.6)
#: Features: a constant, then one column for each bin or flag.
N_SHARES = 5
WIDTH = 1 + (len(WORDS_EDGES) + 1) + N_SHARES * (len(SHARE_EDGES) + 1) + 3


def base(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = len(_SYMBOL.findall(text))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif _WORD.search(line):
            seen.add(line)
    repeated = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            count = Counter(windows)
            upto = -1  # the last word that counts already
            for i, w in enumerate(windows):
                if count[w] > 1:
                    repeated += i + 3 - max(i, upto + 1)
                    upto = i + 2
    return n, chars, symbols, dup, repeated


def lines(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a word: features, number of words, and whether it is boilerplate anywhere."""
    rows, sizes, anywhere = [], [], []
    seen: set[str] = set()
    for line in (text or "").split("\n"):
        words = _WORD.findall(line)
        if not words:
            continue
        n, m = len(words), sum(map(len, words))
        letters = sum(map(str.isalpha, line))
        marked = sum(1 for w in words if not w[-1].isalnum() and not w[-1] in ".,;:!?\"')" or w[-2:] == "!!")
        shares = (
            len(_SYMBOL.findall(line)) / m,
            sum(map(str.isupper, line)) / max(1, letters),
            sum(map(str.isdigit, line)) / m,
            marked / n,
            1 - len(set(words)) / n,
        )
        again, licence = line in seen, bool(_LICENCE.search(line))
        seen.add(line)
        x = [0] + [1 + sum(n > e for e in WORDS_EDGES)]
        at = 2 + len(WORDS_EDGES)
        for s in shares:
            x.append(at + sum(s > e for e in SHARE_EDGES))
            at += len(SHARE_EDGES) + 1
        row = np.zeros(WIDTH)
        row[x] = 1
        row[at : at + 3] = again, licence, line.rstrip()[-1:] in ".!?\"')"
        rows.append(row)
        sizes.append(n)
        anywhere.append(again or licence)
    return np.array(rows).reshape(-1, WIDTH), np.array(sizes, np.int64), np.array(anywhere, bool)


class Field:
    """Two labels, 0 boilerplate and 1 content. emit: weight of label 1 per feature; move: 2 x 2."""

    def __init__(self):
        self.emit, self.move, self.share = np.zeros(WIDTH), np.zeros((2, 2)), 0.5
        self.fitted = False

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.emit
        back = np.zeros((len(z), 2), np.int8)
        a, b = 0.0, float(z[0])
        (m00, m01), (m10, m11) = self.move.tolist()
        for t, e in enumerate(z.tolist()[1:], 1):
            p, q, r, s = a + m00, b + m10, a + m01, b + m11
            back[t] = q > p, s > r
            a, b = max(p, q), max(r, s) + e
        out = np.zeros(len(z), np.int8)
        k = int(b > a)
        for t in range(len(z) - 1, -1, -1):
            out[t] = k
            k = int(back[t, k])
        return out

    def content(self, text: str | None) -> float:
        """The share of words in content lines; 0 without words."""
        x, n, _ = lines(text)
        if not len(n):
            return 0.0
        return float(n[self.viterbi(x) == 1].sum() / n.sum()) if self.fitted else 1.0

    def fit(self, chains: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Gradient ascent (adaptive steps) over all chains at once, line by line; chains (features,
        labels) are cut every PIECE lines for this."""
        chains = [(x[i : i + PIECE], y[i : i + PIECE]) for x, y in chains for i in range(0, len(y), PIECE)]
        chains.sort(key=lambda c: -len(c[1]))
        if not chains:
            return
        size = np.array([len(y) for _, y in chains])
        x, y = np.concatenate([c[0] for c in chains]).astype(np.float32), np.concatenate([c[1] for c in chains])
        off, n = np.cumsum(size) - size, len(y)
        steps = [off[: int((size > t).sum())] + t for t in range(int(size[0]))]  # the t-th lines
        later = np.setdiff1d(np.arange(n), off)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[later - 1], y[later]), 1)
        v_e, v_m = np.zeros(WIDTH), np.zeros((2, 2))
        for _ in range(ITERATIONS):
            m = np.exp(self.move)
            e = np.stack((np.ones(n), np.exp(np.clip(x @ self.emit, -30, 30))), 1)
            f, g = e / e.sum(1, keepdims=True), np.ones((n, 2))
            for r in steps[1:]:
                a = (f[r - 1] @ m) * e[r]
                f[r] = a / a.sum(1, keepdims=True)
            for r in reversed(steps[1:]):
                a = (e[r] * g[r]) @ m.T
                g[r - 1] = a / a.sum(1, keepdims=True)
            p = f * g
            p = p[:, 1] / p.sum(1)
            q = f[later - 1][:, :, None] * m[None] * (e[later] * g[later])[:, None, :]
            moves = (q / q.sum((1, 2), keepdims=True)).sum(0)
            ge = x.T @ (y - p) / n - RIDGE * self.emit
            gm = (seen - moves) / n - RIDGE * self.move
            v_e, v_m = v_e + ge**2, v_m + gm**2
            self.emit = self.emit + RATE * ge / np.sqrt(v_e + 1e-8)
            self.move = self.move + RATE * gm / np.sqrt(v_m + 1e-8)
        self.fitted = True


def cut(held: np.ndarray, good: np.ndarray) -> float:
    """The share that loses the fewest good documents and finds the most junk: the middle of the
    widest gap between the documents' shares, of those that do best; 0 keeps all."""
    edges = np.unique(np.concatenate(([0.0], held, [1.0])))
    tries = [(0.0, 0.0), *((float(a + b) / 2, float(b - a)) for a, b in zip(edges, edges[1:]))]
    return max(tries, key=lambda c: (int((good == (held >= c[0])).sum()) - 3 * int((good & (held < c[0])).sum()), c[1]))[0]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """The field, from at most sample labelled rows."""
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("quality"))
    some = F.broadcast(marks.filter(taken(F.col("_id"), share(marks.count(), sample))))  # about sample rows
    rows = docs.select("doc_id", "text").join(some, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "quality", F.xxhash64("doc_id", "text").alias("h"))
    rows = rows.dropDuplicates(["h"]).select("doc_id", "text", "quality")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for d, t, q in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                x, n, anywhere = (v[:LINES] for v in lines(t.as_py()))
                if len(n):
                    y = np.where(anywhere, 0, 1 if q else 0).astype(np.uint8)
                    out.append((d, int(q or 0), y.tobytes(), np.packbits(x.astype(bool), axis=1).tobytes(), n.astype("<i4").tobytes()))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "quality", "y", "x", "n"])

    got = rows.mapInArrow(describe, "doc_id long, quality int, y binary, x binary, n binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.x))
    chains, sizes = [], []
    for r in got:
        x = np.unpackbits(np.frombuffer(r.x, np.uint8).reshape(-1, (WIDTH + 7) // 8), axis=1)[:, :WIDTH].astype(float)
        chains.append((x, np.frombuffer(r.y, np.uint8).astype(np.int64)))
        sizes.append(np.frombuffer(r.n, "<i4"))
    good = np.array([r.quality for r in got], bool)
    out = np.array([zlib.crc32(str(r.doc_id).encode()) % HELD == 0 for r in got], bool)
    field = Field()
    if 0 < good.sum() < len(good):
        if any(good[m].all() or not good[m].any() for m in (out, ~out)):  # an empty part has neither kind
            out[:] = True
            field.fit(chains)
        else:
            field.fit([c for c, o in zip(chains, out) if not o])
        held = np.array([n[field.viterbi(x) == 1].sum() / n.sum() for (x, _), n, o in zip(chains, sizes, out) if o])
        field.share = cut(held, good[out])
    return field


def judge(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, the base measures, content_share, base_failed, kept; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            got = np.array([base(t) for t in texts], np.int64).reshape(-1, 5)
            failed = (got[:, 0] < LEAST_WORDS) | (100 * got[:, 4] > REPEATED_PERCENT * got[:, 0])
            held = np.array([f.content(t) for t in texts])
            cols = [b.column(0), *(pa.array(got[:, i]) for i in range(5)), pa.array(held, pa.float64()), pa.array(failed, pa.bool_()), pa.array(~failed & (held >= f.share), pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *longs, "content_share", "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{x} long" for x in longs) + ", content_share double, base_failed boolean, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return judge(docs, fit(docs, read(spark, sf_dir, "labels")))
