"""Near-duplicates by SimHash, joined through an inverted index of byte positions.

A fingerprint is eight positional bytes. Fingerprints within RADIUS = 3 bits differ in three bytes
at most, so they share five positional bytes at least, and three of these five lie in the same half
of the fingerprint. A posting list is therefore kept for each three bytes of a half (eight lists
for a fingerprint), which every qualifying pair must meet in; a pair is taken up in the first list
that it shares, its shared bytes are tallied, pairs below five are dropped, and the rest verified
by the bits that differ. Above WIDE fingerprints, lists of three bytes would be long by chance: then
there is one for each five bytes (56 lists), with the same links.

Copies share a fingerprint and are one entry of the index. A posting list longer than HOT, as a
large group of near copies makes, is not paired off: its entries meet in the fingerprints that one
flips one or two of the other 40 bits to. Entries within two bits of such a meeting point are
linked to an entry within one bit of it, if there is one. Two entries at most three bits apart
always have such a point, and entries that are linked so are at most three bits apart, so the
components are the same; the work is 821 rows for an entry (301 with five bytes), whatever the list's length.

Defined cases: null text and text without words have fingerprint zero and are linked like any
other; texts of fewer words than a shingle are one shingle; null ids take part, and a component of
null ids alone has a null id; repeated ids are separate rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, packed, read
from .components import components

RADIUS, BYTES, SHARED = 3, 8, 5
WORDS, SEED = 3, 42
HOT = 4096
#: The bytes of each list: three of four bytes of a half, or any five.
NARROW = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
BROAD = list(combinations(range(8), 5))
#: Fingerprints up to which the lists are of three bytes.
WIDE = 1 << 22

_WORD = re.compile(rb"[^\x20\t-\r]+")
_CHUNK = 1 << 15


def majority(h: np.ndarray) -> int:
    """The bits that over half the hashes have (none: zero)."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _CHUNK):
        ones += np.unpackbits(h[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    import xxhash

    w = _WORD.findall((text or "").encode().lower())
    if not w:
        return 0
    if len(w) < words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(w), seed)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(b" ".join(x), seed) for x in zip(*(w[i:] for i in range(words)))]
    return majority(np.array(hashes, "<u8"))


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words, seed) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _byte(fp: str, i: int) -> Column:
    return F.shiftrightunsigned(F.col(fp), 8 * i).bitwiseAND(F.lit(255))


def key(fp: str, which: tuple[int, ...]) -> Column:
    k = F.lit(0).cast("long")
    for i in which:
        k = k * 256 + _byte(fp, i)
    return k


def links(prints: DataFrame, stash: Stash, hot: int = HOT, lists: list | None = None) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) between different ones, such that the components
    are those of all pairs within RADIUS bits."""
    lists = lists or (NARROW if prints.count() <= WIDE else BROAD)
    posted = stash.keep(prints.select("fp", F.posexplode(F.array(*[key("fp", c) for c in lists])).alias("list", "key")))
    sizes = posted.groupBy("list", "key").agg(F.count(F.lit(1)).alias("n"))
    long_lists = stash.keep(sizes.filter(F.col("n") > hot).select("list", "key"))
    usual = posted.join(sizes.filter((F.col("n") > 1) & (F.col("n") <= hot)).select("list", "key"), ["list", "key"])
    pairs = usual.select("list", "key", F.col("fp").alias("a")).join(usual.select("list", "key", F.col("fp").alias("b")), ["list", "key"]).filter("a < b")
    same = [_byte("a", i) == _byte("b", i) for i in range(BYTES)]
    met_first = F.coalesce(*[F.when(reduce(Column.__and__, [same[i] for i in c]), F.lit(k)) for k, c in enumerate(lists)])
    tally = sum((s.cast("int") for s in same), F.lit(0))
    # A pair that met in an earlier list is left to that one, unless that one was too long.
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    found = pairs.filter(tally >= SHARED).filter(apart)
    if long_lists.isEmpty():
        return found.filter(met_first == F.col("list")).select("a", "b")
    masks = []
    for k, c in enumerate(lists):
        bits = [8 * i + j for i in range(BYTES) if i not in c for j in range(8)]
        for n in range(3):
            for m in combinations(bits, n):
                v = sum(1 << x for x in m)
                masks.append((k, v - (1 << 64) if v >= 1 << 63 else v, n))
    flips = F.broadcast(prints.sparkSession.createDataFrame(masks, "list int, mask long, flipped int"))  # 821 rows for each of 8 lists, 301 for each of 56
    met = posted.join(long_lists, ["list", "key"]).join(flips, "list").select("list", F.col("fp").bitwiseXOR(F.col("mask")).alias("z"), "fp", "flipped")
    centre = met.filter("flipped < 2").groupBy("list", "z").agg(F.min("fp").alias("b"))
    hub = met.join(centre, ["list", "z"]).select(F.col("fp").alias("a"), "b").filter("a <> b").distinct()
    return found.select("a", "b").unionByName(hub)


def classes(docs: DataFrame, words: int = WORDS, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links lead to, itself included."""
    stash = Stash(docs.sparkSession, "simhash")
    rows = stash.keep(fingerprints(docs, words))
    prints = stash.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(prints.select("fp"), stash, hot), stash)
    member = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = stash.keep(member)
    # most fingerprints are alone: only those in links are grouped
    whole = member.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = member.join(whole, "root").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(by_print, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def dedupe(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row of each component: the one with the smallest doc_id (null ids last; of equal ids, one
    row). Rows of other components stay, whatever their ids."""
    stash = Stash(docs.sparkSession, "dedupe")
    whole = stash.keep(packed(docs).withColumn("i", F.monotonically_increasing_id()))
    # the components are those of rows: each row's number takes the place of its id
    found = classes(whole.select(F.col("i").alias("doc_id"), F.col("_row.text").alias("text")), words).select(F.col("doc_id").alias("_of"), "component_id")
    ids = whole.select("i", F.col("_row.doc_id").alias("doc_id"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "i"))
    stays = ids.join(found, F.col("i") == F.col("_of")).groupBy("component_id").agg(best.alias("best")).select(F.col("best.i").alias("_stays"))
    return whole.join(stays, F.col("i") == F.col("_stays"), "left_semi").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
