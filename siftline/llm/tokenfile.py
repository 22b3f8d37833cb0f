"""Token ids in grammar-compressed binary files.

Documents are range-partitioned by doc_id; every partition is cut into shards of bounded size,
and every shard is compressed by Re-Pair: frequent id pairs become nonterminals, pass after pass,
until no pair of the shard is frequent (LEAST times) any more, and the shard stores its rules with
their expansion lengths. No pair crosses the end of a document, so each document begins at a symbol
of its own and can be decoded alone. A pass replaces all frequent pairs at once (left to right where
they overlap). Pairs inside the pieces that texts are made of are replaced first, on the distinct
pieces, each counted as often as it occurs; then pairs on the whole shard, across pieces.

A shard is one row (part, shard, n_docs, n_ids, payload) of a Parquet table in the shared folder:
Spark's commit protocol makes the files whole or absent if an executor is lost, and any file
system that Spark knows will do. payload, little-endian:

    magic "SLG2", n_docs, n_rules, n_terminals, n_symbols, width (uint32)
    doc_id int64 and null flag uint8 per document
    tokens uint32 per document, symbols uint32 per document
    the ids that the shard uses, ascending, uint32: its symbols 0 to n_terminals - 1
    left, right per rule (symbols of width bytes), expansion length uint32 per rule
    symbols of width bytes; zlib.crc32 of all before (uint32)

Symbols are two bytes wide where the shard has at most 65,536 of them and four bytes elsewhere, so ids
may be any unsigned 32-bit number.

Defined cases: null text is empty and encodes to the end id alone; null ids come first; repeated
ids stay separate documents, ordered by their place in the input; an empty table writes no shard and reads
back empty; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stash, read, remembered

MAGIC = b"SLG2"
#: Ids of a shard before compression, at most (but for one document that is longer by itself).
SHARD_IDS = 1 << 20
#: A pair is frequent in a shard if it stands there so often.
LEAST = 12
#: Encoded pieces that a worker holds in each of its two generations.
REMEMBERED = 800_000
#: Characters that are cut into pieces at once, but for one text that is longer by itself.
BATCH = 4_000_000
END = 0

SHARDS = "part int, shard int, n_docs long, n_ids long, payload binary"


def _disjoint(at: np.ndarray) -> np.ndarray:
    """Of ascending positions, which to take: of adjacent ones every other one, from the left."""
    if not len(at):
        return np.zeros(0, bool)
    new = np.empty(len(at), bool)
    new[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=new[1:])
    i = np.arange(len(at))
    return (i - np.maximum.accumulate(np.where(new, i, 0))) % 2 == 0


def _gather(flat: np.ndarray, off: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The pieces of flat that begin at off and are n long, one after another."""
    upto = np.cumsum(n)
    return flat[np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(off - (upto - n), n)]


def _slot(code: np.ndarray) -> np.ndarray:
    """20 bits of a hash of uint32 or uint64 codes."""
    return code * np.uint32(2654435761) >> np.uint32(12) if code.dtype == np.uint32 else code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)


def _sorted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """codes in order, and the order; uint32 codes are sorted with their places below them, which is faster."""
    if code.dtype != np.uint32:
        return code[order := np.argsort(code)], order
    both = np.sort((code.astype(np.uint64) << np.uint64(32)) | np.arange(len(code), dtype=np.uint64))
    return (both >> np.uint64(32)).astype(np.uint32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, place of each among them, how often each) of numbers from 0, by a table where that is small."""
    if not len(x) or int(x.max()) >= 1 << 23:
        return np.unique(x, return_inverse=True, return_counts=True)
    times = np.bincount(x)
    which = np.flatnonzero(times)
    table = np.empty(len(times), np.int32)
    table[which] = np.arange(len(which))
    return which, table[x], times[which]


def replace(sym: np.ndarray, joins: np.ndarray, made: int, weight: np.ndarray | None, least: int):
    """Replace pairs until none is frequent: (symbols, rules [n, 2], which of the places are left).

    joins: whether a place may be joined with the next. weight: how often each place counts. made:
    symbols that exist already. All occurrences of a pass's pairs vanish in it, replaced or cut by a
    replacement beside them, so that later passes need only look at pairs with a symbol just made.
    """
    rules: list[np.ndarray] = []
    left = np.arange(len(sym))
    since = 0
    while len(sym) > 1:
        at = np.flatnonzero(joins[:-1] & ((sym[:-1] >= since) | (sym[1:] >= since)) if since else joins[:-1])
        if not len(at):
            break
        kind, shift = (np.uint32, np.uint32(16)) if made <= 1 << 16 else (np.uint64, np.uint64(32))
        code = (sym[at].astype(kind) << shift) | sym[at + 1].astype(kind)
        if weight is None:
            ordered, w = np.sort(code), None
        else:
            ordered, order = _sorted(code)
            w = weight[at][order]
        edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        count = np.diff(np.append(edge, len(ordered))) if w is None else np.add.reduceat(w, edge)
        chosen = ordered[edge[count >= least]]
        if not len(chosen):
            break
        maybe = np.zeros(1 << 20, bool)  # most places hold no chosen pair
        maybe[_slot(chosen)] = True
        some = np.flatnonzero(maybe[_slot(code)])
        code = code[some]
        which = np.searchsorted(chosen, code)
        which[which == len(chosen)] = 0
        real = chosen[which] == code
        at, which = at[some[real]], which[real]
        own = _disjoint(at)
        take, which = at[own], which[own]
        rules.append(np.stack((chosen >> shift, chosen & ((kind(1) << shift) - kind(1))), axis=1).astype(np.uint32))
        sym[take] = made + which
        joins[take] = joins[take + 1]
        stay = np.ones(len(sym), bool)
        stay[take + 1] = False
        sym, joins, left = sym[stay], joins[stay], left[stay]
        weight = None if weight is None else weight[stay]
        since = made
        made += len(chosen)
    return sym, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), left


def compress(numbers: np.ndarray, flat: np.ndarray, off: np.ndarray, n: np.ndarray, least: int = LEAST):
    """(ids used, symbols, symbols per document, rules [n, 2]) of a shard.

    numbers: the shard's pieces in order, 0 after each document; piece k is flat[off[k]:off[k] + n[k]].
    """
    which, place, times = _distinct(numbers)
    size = n[which]
    used, sym, _ = _distinct(_gather(flat, off[which], size))
    sym = sym.astype(np.uint32)
    ends = np.cumsum(size)
    joins = np.ones(len(sym), bool)
    joins[ends - 1] = False
    sym, inner, left = replace(sym, joins, len(used), np.repeat(times, size), least)
    edge = np.searchsorted(left, ends)
    size = np.diff(edge, prepend=0)
    begin = edge - size
    whole = _gather(sym, begin[place], size[place])
    joins = np.ones(len(whole), bool)
    ends = np.cumsum(size[place])[numbers == 0]
    joins[ends - 1] = False
    whole, outer, left = replace(whole, joins, len(used) + len(inner), None, least)
    return used, whole, np.diff(np.searchsorted(left, ends), prepend=0), np.concatenate((inner, outer))


def expanded(rules: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray]:
    """(what all rules stand for, one after another; their lengths), in symbols below terminals."""
    flat = rules.reshape(-1).astype(np.int64)
    n = np.full(len(rules), 2, np.int64)
    while len(deep := np.flatnonzero(flat >= terminals)):
        wide = np.ones(len(flat), np.int64)
        wide[deep] = 2
        owner = np.repeat(np.arange(len(rules)), n)
        at = np.cumsum(wide) - wide
        grown = np.repeat(flat, wide)
        pair = rules[flat[deep] - terminals]
        grown[at[deep]], grown[at[deep] + 1] = pair[:, 0], pair[:, 1]
        n = np.bincount(owner, wide, len(rules)).astype(np.int64)
        flat = grown
    return flat, n


def pack(doc_ids: list[int | None], tokens: np.ndarray, numbers: np.ndarray, flat: np.ndarray, off: np.ndarray, n: np.ndarray) -> bytes:
    """A shard's payload. tokens: ids of each document; the rest as in compress()."""
    used, sym, per, rules = compress(numbers, flat, off, n)
    length = expanded(rules, len(used))[1]
    width = 2 if len(used) + len(rules) <= 1 << 16 else 4
    kind = f"<u{width}"
    body = b"".join((
        MAGIC, struct.pack("<5I", len(doc_ids), len(rules), len(used), len(sym), width),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes(),
        tokens.astype("<u4").tobytes(), per.astype("<u4").tobytes(), used.astype("<u4").tobytes(), rules.astype(kind).tobytes(), length.astype("<u4").tobytes(), sym.astype(kind).tobytes(),
    ))
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """A payload, opened for reading."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC or zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
            raise ValueError("not a whole shard")
        n, rules, terminals, symbols, width = struct.unpack_from("<5I", payload, 4)
        at = 24

        def part(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, count, at)
            at += out.nbytes
            return out

        ids, null = part("<i8", n), part("u1", n)
        self.doc_ids = [None if x else int(i) for i, x in zip(ids, null)]
        self.tokens, self.per, self.used = part("<u4", n), part("<u4", n), part("<u4", terminals)
        self.rules, self.length, self.sym = part(f"<u{width}", 2 * rules).reshape(-1, 2), part("<u4", rules), part(f"<u{width}", symbols)
        self.at = np.concatenate(([0], np.cumsum(self.per, dtype=np.int64)))
        self._len = np.concatenate((np.ones(terminals, np.int64), self.length.astype(np.int64)))
        self._off = np.cumsum(self._len) - self._len
        self._flat = np.concatenate((self.used, self.used[expanded(self.rules, terminals)[0]]))

    def expand(self, sym: np.ndarray) -> np.ndarray:
        return _gather(self._flat, self._off[sym], self._len[sym])

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document alone."""
        return self.expand(self.sym[self.at[k] : self.at[k + 1]])

    def all(self) -> np.ndarray:
        return self.expand(self.sym)


#: A piece is what the byte-level pattern makes a unit of its own: contractions, letters, digits, signs,
#: white space. FINE has its classes for the characters of PLAIN; texts with others are cut by COARSE, at
#: white space only, and texts with ODD, which is white space for one of the two engines, not at all.
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
FINE = re.compile(rf" ?[{LETTER}]+|'(?:[stmd]|ll|ve|re)| ?[0-9]+| ?[^\s0-9{LETTER}]+|\s+(?!\S)|\s+")
PLAIN = re.compile(rf"[^\t-\r\x20-\x7e¡¿«»×÷€‐-‧{LETTER}]")
SPACED = re.compile(r" \S.{,62}\Z")
COARSE = re.compile(r" ?[^\s]+|\s+(?!\S)|\s+")
ODD = re.compile("[\x1c-\x1f\x85\u180e]")


class _Pieces(dict):
    """Numbers of pieces; a piece asked for in vain gets the next number and is noted in new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = k = len(self)
        self.new.append(piece)
        return k


class Encoder:
    """The tokenizers library behind a bounded memory of pieces.

    The memory has two generations: a full one becomes the older, and what is asked for again is
    taken over from there. Only tokenizers that split by the byte-level pattern before anything else
    and normalize nothing are asked by pieces; for all others a text is one piece.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.added = [x.content for x in self.lib.get_added_tokens_decoder().values()]
        self.by_piece = isinstance(self.lib.pre_tokenizer, pre_tokenizers.ByteLevel) and self.lib.normalizer is None and not self.lib.pre_tokenizer.add_prefix_space
        #: Bytes of each id; ids of pieces that are encoded together are told apart by these.
        self.bytes = np.zeros(self.lib.get_vocab_size(with_added_tokens=True), np.int64)
        for token, k in self.lib.get_vocab().items():
            self.bytes[k] = len(token)
        self.remembered = remembered
        self.old: tuple[dict, np.ndarray, np.ndarray, np.ndarray] = ({}, *[np.zeros(0, np.int64)] * 3)
        self._begin()

    def _begin(self) -> None:
        """Only the empty piece, which no text has, is known; it stands for the end id."""
        self.known = _Pieces()
        self.known[""] = 0
        self.flat, self.off, self.n = np.full(1, END, np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)

    @property
    def full(self) -> bool:
        return len(self.known) > self.remembered

    def turn(self) -> None:
        """Begin a new generation; numbers given so far lose their meaning."""
        self.old = (self.known, self.flat, self.off, self.n)
        self._begin()

    def _alone(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids, number of ids of each piece."""
        lists = [e.ids for e in self.lib.encode_batch_fast(pieces, add_special_tokens=False)]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(n.sum())), n

    def _together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that begin with a space, 64 as one text; the library takes half the time for it."""
        joined = ["".join(pieces[i : i + 64]) for i in range(0, len(pieces), 64)]
        ids = np.array([k for e in self.lib.encode_batch_fast(joined, add_special_tokens=False) for k in e.ids], np.uint32)
        upto = np.cumsum(self.bytes[ids])
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, pieces)), np.int64, len(pieces)))
        edge = np.searchsorted(upto, ends) + 1
        if len(upto) and edge[-1] <= len(upto) and np.array_equal(upto[edge - 1], ends):
            return ids, np.diff(edge, prepend=0)
        return self._alone(pieces)

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces, whose numbers follow on those known."""
        old, flat, off, n = self.old
        there = np.fromiter(map(old.get, pieces, repeat(-1)), np.int64, len(pieces))
        spaced = np.fromiter(map(bool, map(SPACED.match, pieces)), bool, len(pieces)) & self.by_piece
        groups = [there >= 0, (there < 0) & spaced, (there < 0) & ~spaced]
        begin, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        got, upto = [self.flat], len(self.flat)

        def put(which: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
            nonlocal upto
            size[which], begin[which] = count, upto + np.cumsum(count) - count
            got.append(ids)
            upto += len(ids)

        if len(which := np.flatnonzero(groups[0])):
            k = there[which]
            put(which, _gather(flat, off[k], n[k]), n[k])
        for ask, chosen in ((self._together, groups[1]), (self._alone, groups[2])):
            # in order, so that the library's tables are asked for neighbours one after another
            which = np.array(sorted(np.flatnonzero(chosen).tolist(), key=pieces.__getitem__), np.int64)
            for i in range(0, len(which), 4096):
                put(which[i : i + 4096], *ask([pieces[k] for k in which[i : i + 4096].tolist()]))
        self.flat = np.concatenate(got)
        self.off, self.n = np.concatenate((self.off, begin)), np.concatenate((self.n, size))

    def _cut(self, text: str) -> list[str]:
        if not self.by_piece or any(a in text for a in self.added):
            return [text]
        if not PLAIN.search(text):
            return FINE.findall(text)
        return [text] if ODD.search(text) else COARSE.findall(text)

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all texts, 0 after each text, and the number of ids of each text."""
        out: list[int] = []
        last = []
        for t in texts:
            if t:
                pieces = self._cut(t)
                out += itemgetter(*pieces)(self.known) if len(pieces) > 1 else (self.known[pieces[0]],)
            out.append(0)
            last.append(len(out))
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        which = np.fromiter(out, np.int64, len(out))
        return which, np.diff(np.cumsum(self.n[which])[np.array(last, np.int64) - 1], prepend=0)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, END after each text, and the number of ids of each text."""
        which, n = self.numbers(texts)
        return _gather(self.flat, self.off[which], self.n[which]), n


def encoder(path: str) -> Encoder:
    """One for each Python worker, kept between tasks until another operator's forget()."""
    if path not in remembered:
        remembered[path] = Encoder(path)
    return remembered[path]


def _shards(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, n_shard = TaskContext.get().partitionId(), encoder(path), 0
        numbers: list[np.ndarray] = []
        tokens: list[np.ndarray] = []
        docs: list[int | None] = []
        held = 0

        def shard() -> pa.RecordBatch:
            nonlocal numbers, tokens, docs, held, n_shard
            body = pack(docs, np.concatenate(tokens), np.concatenate(numbers), enc.flat, enc.off, enc.n)
            cols = [pa.array([part], pa.int32()), pa.array([n_shard], pa.int32()), pa.array([len(docs)], pa.int64()), pa.array([held], pa.int64()), pa.array([body], pa.binary())]
            numbers, tokens, docs, held, n_shard = [], [], [], 0, n_shard + 1
            return pa.RecordBatch.from_arrays(cols, names=["part", "shard", "n_docs", "n_ids", "payload"])

        for b in batches:
            doc_ids, texts = b.column(0).to_pylist(), b.column(1)
            i = 0
            while i < len(doc_ids):
                j, chars = i, 0
                some: list[str] = []
                while j < len(doc_ids) and chars < BATCH:
                    some.append(texts[j].as_py() or "")
                    chars += len(some[-1])
                    j += 1
                if enc.full:
                    if docs:  # its pieces' numbers end with the generation
                        yield shard()
                    enc.turn()
                got, n = enc.numbers(some)
                stops = np.flatnonzero(got == 0) + 1
                upto = np.cumsum(n)
                k = 0
                while k < len(some):  # as many documents as the shard still takes, one at least if it is empty
                    room = SHARD_IDS - held + (int(upto[k - 1]) if k else 0)
                    m = max(int(np.searchsorted(upto, room, side="right")), k + (not docs))
                    if m > k:
                        numbers.append(got[stops[k - 1] if k else 0 : stops[m - 1]])
                        tokens.append(n[k:m])
                        docs += doc_ids[i + k : i + m]
                        held += int(n[k:m].sum())
                    if m < len(some):
                        yield shard()
                    k = m
                i = j
        if docs:
            yield shard()

    return run


def write(docs: DataFrame, tokenizer: str, to: str) -> None:
    """Encode docs (doc_id, text) with the tokenizer file and write shards in ascending doc_id order.

    One shuffle of the texts, by ranges of doc_id and place in the input, so that no id fills a
    range alone; nothing is collected.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("i"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("i").asc()]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(_shards(tokenizer), SHARDS).write.parquet(to)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, n_shard, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            s = Shard(payload.as_py())
            ids = s.all().astype("<u4")
            ends = np.cumsum(s.tokens, dtype=np.int64)
            begins = ends - s.tokens
            raw = memoryview(ids.tobytes())
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part] * len(ends), pa.int32()), "shard": pa.array([n_shard] * len(ends), pa.int32()), "doc_id": pa.array(s.doc_ids, pa.int64()), "_at": pa.array(begins),
                    "n_tokens": pa.array(s.tokens.astype(np.int64)), "ids_crc32": pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(begins.tolist(), ends.tolist())], pa.int64()),
                }
            )


def index(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold, by document: doc_id, start, n_tokens, ids_crc32.

    Starts add up in two steps, parts and then shards in a part, over one small row per shard.
    """
    files = spark.read.schema(SHARDS).parquet(path)
    sizes = files.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = sizes.withColumn("_within", within).join(parts, "part").select("part", "shard", (F.col("_before") + F.col("_within")).alias("_base"))
    found = files.select("part", "shard", "payload").mapInArrow(_index, "part int, shard int, doc_id long, _at long, n_tokens long, ids_crc32 long")
    return found.join(base, ["part", "shard"]).select("doc_id", (F.col("_base") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = encoder(path).lib
        for b in batches:
            for payload in b.column(0):
                s = Shard(payload.as_py())
                for i in range(0, len(s.doc_ids), 256):
                    some = range(i, min(i + 256, len(s.doc_ids)))
                    texts = [lib.decode(s.document(k)[:-1].tolist(), skip_special_tokens=False) for k in some]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([s.doc_ids[k] for k in some], pa.int64()), "text": pa.array(texts, pa.string())})

    return run


def texts(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """The documents back: doc_id, text."""
    return spark.read.schema(SHARDS).parquet(path).select("payload").mapInArrow(_texts(tokenizer), "doc_id long, text string")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_and_index(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs' ids to a new folder in the shared one and read the files back."""
    to = Stash(spark, "tokens").path()
    write(docs, tokenizer or default_tokenizer(), to)
    return index(spark, to)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_index(spark, read(spark, sf_dir, "documents"))
