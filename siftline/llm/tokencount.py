"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the mark that SentencePiece puts before words. Its token count is that
of its most probable split into pieces (ties: the fewer tokens). The best score of a prefix does not
depend on what follows, so the pre-tokens of a batch that are not known yet go into a trie, level by
level, and each node, one distinct prefix, gets its forward score and token count once: the best
over all pieces that end there, added to the node above the piece. Terminal nodes give the counts,
which a worker remembers between batches.

Pieces come from a public SentencePiece file; their probabilities follow Zipf's law in the order of
the file, -ln((id + 1) * H). A character that no piece holds costs one token for each UTF-8 byte, each
as improbable as the last piece.

Nothing is shuffled: the trie is local to a batch and bounded by it, the memory of counts by
REMEMBERED words (it is emptied when full). Defined cases: null text and text without words have
no tokens; a word longer than DEEP characters runs through the same recurrence alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_PY, read

REMEMBERED = 1_000_000
DEEP = 48
MARK = "▁"
_WORD = re.compile(WORD_PY)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0xD6E8FEB86659FD93)


class Unigram:
    """Pieces with scores, and the counts of words so far."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        h = sum(1 / (i + 1) for i in range(n))
        self.score = {sp.id_to_piece(i): -math.log((i + 1) * h) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        self.worst = -math.log(n * h)
        self.longest = max(map(len, self.score))
        self.chars = {p for p in self.score if len(p) == 1}
        self.table = []
        for k in range(1, self.longest + 1):
            mine = [p for p in self.score if len(p) == k]
            cp = np.array([list(map(ord, p)) for p in mine], np.uint64).reshape(-1, k)
            key = np.zeros(len(mine), np.uint64)
            for j in range(k):
                key = key * _BASE + _mix(cp[:, j])
            order = np.argsort(key)
            self.table.append((key[order], np.array([self.score[p] for p in mine])[order]))
        self.known: dict[str, int] = {}

    def alone(self, word: str) -> int:
        """The recurrence for one word, also what tests compare the trie with."""
        s = MARK + word
        best, count = [0.0], [0]
        for i in range(1, len(s) + 1):
            b, c = -math.inf, 0
            if s[i - 1] not in self.chars:
                n = len(s[i - 1].encode("utf-8", "surrogatepass"))
                b, c = best[i - 1] + n * self.worst, count[i - 1] + n
            for k in range(1, min(i, self.longest) + 1):
                v = self.score.get(s[i - k : i])
                if v is not None and (best[i - k] + v, -count[i - k] - 1) > (b, -c):
                    b, c = best[i - k] + v, count[i - k] + 1
            best.append(b)
            count.append(c)
        return count[-1]

    def learn(self, words: list[str]) -> None:
        """Counts of new words, through one trie."""
        for w in words:
            if len(w) >= DEEP:
                self.known[w] = self.alone(w)
        words = sorted(w for w in words if len(w) < DEEP)
        if not words:
            return
        size = np.array([len(w) + 1 for w in words])
        flat = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
        off = np.cumsum(size) - size
        K = self.longest
        node = np.zeros(len(words), np.int64)  # of each word, at the level above
        score, count = [np.zeros(1)], [np.zeros(1, np.int64)]
        above = np.full((1, K), -1)
        above[0, 0] = 0  # ancestors by distance; column k is k + 1 characters before the next level
        suffix = np.zeros((1, K), np.uint64)  # hash of the last k characters
        first = 0  # number of the level's first node
        total = 1
        all_score, all_count = score[0], count[0]
        for level in range(int(size.max())):
            live = np.flatnonzero(size > level)
            c = flat[off[live] + level].astype(np.int64)
            edge, mine = np.unique(((node[live] - first) << 21) | c, return_inverse=True)
            up, c = edge >> 21, edge & 0x1FFFFF
            h = np.empty((len(edge), K), np.uint64)
            m = _mix(c)
            h[:, 0] = m
            if K > 1:
                h[:, 1:] = suffix[up, : K - 1] * _BASE + m[:, None]
            anc = above[up]
            letters = np.array([chr(x) in self.chars for x in c.tolist()], bool)
            nb = np.array([1 if x < 0x80 else 2 if x < 0x800 else 3 if x < 0x10000 else 4 for x in c.tolist()])
            b = np.where(letters, -np.inf, all_score[anc[:, 0]] + nb * self.worst)
            n = np.where(letters, 0, all_count[anc[:, 0]] + nb)
            for k in range(min(level + 1, K)):
                keys, values = self.table[k]
                if not len(keys):
                    continue
                at = np.searchsorted(keys, h[:, k])
                at[at == len(keys)] = 0
                hit = np.flatnonzero(keys[at] == h[:, k])
                a = anc[hit, k]
                s, q = all_score[a] + values[at[hit]], all_count[a] + 1
                better = (s > b[hit]) | ((s == b[hit]) & (q < n[hit]))
                b[hit[better]], n[hit[better]] = s[better], q[better]
            all_score, all_count = np.concatenate((all_score, b)), np.concatenate((all_count, n))
            first = total
            own = np.arange(first, first + len(edge))
            total += len(edge)
            above = np.concatenate((own[:, None], anc[:, : K - 1]), axis=1)
            suffix = h
            node[live] = first + mine
        self.known.update(zip(words, all_count[node].tolist()))

    def counts(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = [_WORD.findall(t or "") for t in texts]
        new = {w for s in split for w in s if w not in self.known}
        self.learn(list(new))
        ask = self.known.__getitem__
        return [(len(s), sum(map(ask, s))) for s in split]


_models: dict[str, Unigram] = {}


def model(path: str) -> Unigram:
    """One for each Python worker."""
    if path not in _models:
        _models[path] = Unigram(path)
    return _models[path]


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of each row."""
    import public_tokenizers

    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            got = m.counts(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))
