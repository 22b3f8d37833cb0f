"""Near copies by five-word similarity: SimHash index, prefix lists, exact verification, components.

A text is the set of its WORDS-word shingles; two texts are near copies if the share of common
shingles in all their shingles is 4/5 at least, and a component is what such pairs lead to.

Each set has a SimHash fingerprint. An inverted index, as in simhash.py, has a list for each three positional
bytes (56 lists for a fingerprint); pairs that meet in one and differ in RADIUS bits at most (about ten of 64 differ at
similarity 4/5) are candidates. No
index of a fingerprint's bytes can promise to find every pair at this similarity, so what it leaves
is found by prefix lists. If all
shingles have one fixed order, a set of n shares ceil(4n/5) shingles with any partner at
least, so the first n - ceil(4n/5) + 1 of each set have one in common: lists of these find every
pair that the index left. Shingles that a sample of the documents finds often come last in the order, the rest go by
their hash; the sample is of use for the lists' length only, as every fixed order is exact.

Equal sets are one entry. Each list of the index first compares its entries with one of them, the one
with the longest lists, as a text has that others were made from; the verified links make components.
Lists of LONG entries at most that still hold several components are then paired off across these. Prefix
lists that hold several components go on: first with two of their entries (the one with the
longest lists, and one by a hash, another in each list), then each entry with all of the other
components that are left, where the places of the shared shingle leave room for the similarity.
So copies that are linked already cost no square of their group's size, and no pair that could join
two components is left out; texts that come near the similarity with many others and reach it with
none are still compared with each of these.

Defined cases: words are lower-cased (A-Z); texts of fewer words than a shingle are one shingle;
null texts and texts without words equal each other. Rows are told apart by themselves, not by
doc_id: of a component, the row with the smallest doc_id stays (null ids come last; of equal ids,
one row), whatever ids other rows have.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from . import simhash
from .common import Stash, packed, slices
from .components import components

WORDS, SEED = 5, 42
#: One document in SAMPLED is counted; shingles in OFTEN of these come last, COMMON of them at most.
SAMPLED, OFTEN, COMMON = 16, 4, 50_000
#: The bytes of each list of the index, the length up to which a list is paired off, and bits that may differ.
LISTS, LONG, RADIUS = list(combinations(range(simhash.BYTES), 3)), 64, 19
#: Bits of the mask of shared shingles.
PLACES = 1 << 27

_WORD = re.compile(rb"[^\x20\t-\r]+")


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles, in order."""
    import xxhash

    w = _WORD.findall((text or "").encode().lower())
    k = min(WORDS, len(w))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(x), SEED) for x in zip(*(w[i:] for i in range(k)))], np.uint64)).view(np.int64)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))


def sets(rows: DataFrame) -> DataFrame:
    """i, s of rows (i, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([shingles(t.as_py()) for t in b.column(1)])], names=["i", "s"])

    return rows.select("i", "text").mapInArrow(run, "i long, s array<long>")


def often(rows: DataFrame) -> np.ndarray:
    some = sets(rows.filter(F.pmod(F.xxhash64("i"), F.lit(SAMPLED)) == 0)).select(F.explode("s").alias("h"))
    top = some.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(COMMON)
    return np.sort(np.array([r.h for r in top.collect()], np.int64))


def signatures(rows: DataFrame, last: np.ndarray) -> DataFrame:
    """i, doc_id, digest of the set, its size n, its fingerprint fp, and the first of its shingles in the order."""
    shared = rows.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        late = shared.value
        for b in slices(batches):
            digests, sizes, prints, first = [], [], [], []
            for t in b.column(2):
                s = shingles(t.as_py())
                n = len(s)
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(n)
                prints.append(simhash.majority(s.view("<u8")))
                if len(late) and n:
                    common = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s
                    s = np.concatenate((s[~common], s[common]))
                first.append(s[: n - (4 * n + 4) // 5 + 1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), _lists(first)], names=["i", "doc_id", "digest", "n", "fp", "first"])

    schema = StructType().add("i", LongType()).add(rows.schema["doc_id"]).add("digest", BinaryType()).add("n", LongType()).add("fp", LongType()).add("first", ArrayType(LongType()))
    return rows.select("i", "doc_id", "text").mapInArrow(run, schema)


def _sizes_allow(n: str, m: str) -> Column:
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def verified(pairs: DataFrame, entries: DataFrame, rows: DataFrame, stash: Stash) -> DataFrame:
    """Of pairs (a, b) of rows, those with the similarity.

    What two sets share is in both first parts, or behind the first part that ends earlier in the
    order; pairs that this bound rules out are dropped before whole sets are fetched.
    """
    first = [entries.select(F.col("e").alias(x), F.col("n").alias(f"n_{x}"), F.col("first").alias(f"first_{x}")) for x in "ab"]
    most = F.size(F.array_intersect("first_a", "first_b")) + F.greatest(F.col("n_a") - F.size("first_a"), F.col("n_b") - F.size("first_b"))
    pairs = stash.keep(pairs.join(first[0], "a").join(first[1], "b").filter(9 * most >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b"))
    need = pairs.select(F.col("a").alias("_need")).unionByName(pairs.select(F.col("b").alias("_need"))).distinct()
    found = stash.keep(sets(rows.select("i", "text").join(need, F.col("i") == F.col("_need"), "left_semi")))
    both = pairs.join(found.select(F.col("i").alias("a"), F.col("s").alias("s")), "a").join(found.select(F.col("i").alias("b"), F.col("s").alias("t")), "b")
    return stash.keep(both.filter(9 * F.size(F.array_intersect("s", "t")) >= 4 * (F.size("s") + F.size("t"))).select("a", "b"))


def _bitmaps(keys: DataFrame) -> DataFrame:
    """part, bits of the places (pmod PLACES) of the keys. Keys of a part meet before they are counted:
    else each task sends a bitmap of 4 KB for each part that it has a key of."""
    at = F.pmod(F.col("key"), F.lit(PLACES))
    # the functions count places from 1
    bits = keys.select(F.bitmap_bucket_number(at + 1).alias("part"), F.bitmap_bit_position(at + 1).alias("bit"))
    return bits.repartition("part").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _marked(keys: DataFrame) -> np.ndarray:
    """A bit for each place that a key (pmod PLACES) takes; of constant size, whatever the number of keys."""
    out = np.zeros(PLACES // 8, np.uint8)
    for r in _bitmaps(keys).collect():
        bits = np.frombuffer(bytes(r.bits), np.uint8)
        out[(r.part - 1) * len(bits) : r.part * len(bits)] = bits
    return out


def posts(entries: DataFrame, stash: Stash) -> tuple[DataFrame, str]:
    """key, p (the shingle's place in the entry's order) and entries' other columns of the first shingles (or
    other keys) that several entries have; and the table's path.

    Most shingles are in one entry only. The keys alone are counted; those that are shared set bits in
    a mask, and only entries' shingles that hit it are posted, and then joined to the shared keys,
    so that a chance hit adds a row to the join and nothing to the result.
    """
    counted = entries.select(F.explode("first").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    keys, at = stash.put(counted.select("key"))
    stash.drop()
    shared = entries.sparkSession.sparkContext.broadcast(_marked(keys))
    others = [c for c in entries.columns if c != "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = shared.value
        for b in slices(batches):
            first = b.column(0)
            key = first.flatten().to_numpy(zero_copy_only=False)
            size = first.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(first)), size)
            p = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
            place = key % PLACES
            hit = (mask[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            row = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(p[hit]), *(c.take(row) for c in b.columns[1:])], names=["key", "p", *others])

    schema = StructType([StructField("key", LongType()), StructField("p", LongType()), *(entries.schema[c] for c in others)])
    posted = entries.select("first", *others).mapInArrow(run, schema)
    out = stash.put(posted.join(keys, "key", "left_semi"))
    stash.drop(at)
    return out


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs (e, f) as (a, b), each once."""
    return pairs.select(F.least("e", "f").alias("a"), F.greatest("e", "f").alias("b")).distinct()


def _twice(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lists (key, e, n, p, fp or c, ...) and the same with the names f, m, q, g or d."""
    names = {"key": "key", "e": "f", "n": "m", "p": "q", "fp": "g", "c": "d"}
    return lists, lists.select(*[F.col(c).alias(x) for c, x in names.items() if c in lists.columns])


def _mixed(posted: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """posted (key, e, ...) with c, the entry's component (without roots itself), and held, the list's length,
    of lists that hold several components."""
    found = posted.withColumn("c", F.col("e"))
    if roots is not None:
        found = posted.join(roots, F.col("e") == F.col("node"), "left").withColumn("c", F.coalesce("root", "e")).drop("node", "root")
    lists = found.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("c").alias("x"), F.max("c").alias("y")).filter("x < y")
    return found.join(lists.select("key", "held"), "key")


def _central(lists: DataFrame) -> DataFrame:
    """key, hub: of each list, the entry that has the longest lists, with its columns."""
    known = lists.groupBy(F.col("e").alias("_e")).agg(F.sum("held").alias("known"))
    row = F.struct("known", *[c for c in lists.columns if c not in ("key", "held", "p")])
    return lists.join(known, F.col("e") == F.col("_e")).groupBy("key").agg(F.max(row).alias("hub"))


def met(entries: DataFrame, stash: Stash, settle: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """entries (e, n, fp) to the pairs (a, b) that the index of fingerprints proposes.

    settle makes components (node, root) of the pairs with the lists' central entries; pairs inside a
    component are not proposed any more. Without it, each entry is its own component.
    """
    bytes3 = F.array(*[simhash.key("fp", c) + F.lit(k << 24) for k, c in enumerate(LISTS)])
    posted, at = posts(entries.select("e", "n", "fp", bytes3.alias("first")), stash)
    lists, of = stash.put(_mixed(posted.drop("p")))
    stash.drop(at)
    near = _sizes_allow("n", "m") & (F.bit_count(F.col("fp").bitwiseXOR(F.col("g"))) <= RADIUS)
    hubs = _central(lists).select("key", F.col("hub.e").alias("f"), F.col("hub.n").alias("m"), F.col("hub.fp").alias("g"))
    star = stash.keep(_ordered(lists.join(hubs, "key").filter(F.col("e") != F.col("f")).filter(near)))
    # lists of two are settled
    short = lists.filter((F.col("held") > 2) & (F.col("held") <= LONG)).select("key", "e", "n", "fp")
    one, other = _twice(stash.keep(_mixed(short, settle(star) if settle else None)))
    out = stash.keep(star.unionByName(_ordered(one.join(other, "key").filter(F.col("c") < F.col("d")).filter(near))).distinct())
    stash.drop(of)
    return out


def links(entries: DataFrame, rows: DataFrame, stash: Stash) -> DataFrame:
    """entries (e, n, fp, first) to links (a, b), whose components are those of all similar pairs."""
    steps = []

    def settle(star: DataFrame) -> DataFrame:
        near = verified(star, entries, rows, stash)
        steps.append((star, near, components(near, stash)))
        return steps[-1][2]

    found = met(entries, stash, settle)
    star, near, roots = steps[0]
    posted, at = posts(entries.select("e", "n", "first"), stash)
    lists, of = stash.put(_mixed(posted, roots))
    stash.drop(at)
    hashed = lists.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "e").alias("h"), "e", "n", "c")).alias("hub"))
    hubs = [x.select("key", F.col("hub.e").alias("f"), F.col("hub.n").alias("m"), F.col("hub.c").alias("d")) for x in (hashed, _central(lists))]
    hubs = hubs[0].unionByName(hubs[1]).distinct()
    # entries of one component need no link any more
    pairs = _ordered(lists.join(hubs, "key").filter(F.col("c") != F.col("d")).filter(_sizes_allow("n", "m")))
    pairs = stash.keep(found.unionByName(pairs).distinct().join(star, ["a", "b"], "left_anti"))
    near = near.unionByName(verified(pairs, entries, rows, stash))
    roots = components(near, stash)
    # lists of two are settled; of the others, those that hold several components
    rest = stash.keep(_mixed(lists.filter("held > 2").select("key", "e", "n", "p"), roots))
    stash.drop(of)
    one, other = _twice(rest)
    # in the list of the first shingle that two entries share, what they share lies behind its places
    enough = 9 * F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q")) >= 4 * (F.col("n") + F.col("m"))
    across = _ordered(one.join(other, "key").filter(F.col("c") < F.col("d")).filter(enough))
    across = across.join(star.unionByName(pairs), ["a", "b"], "left_anti")
    return near.unionByName(verified(across, entries, rows, stash))


def dedupe(docs: DataFrame) -> DataFrame:
    """One row of each component."""
    stash = Stash(docs.sparkSession, "copies")
    whole = stash.keep(packed(docs).withColumn("i", F.monotonically_increasing_id()))
    rows = whole.select("i", F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"))
    signed, at = stash.put(signatures(rows, often(rows)))
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "i")
    alike, of = stash.put(signed.groupBy("digest").agg(F.min("i").alias("e"), F.min(best).alias("best")))
    entries, own = stash.put(signed.join(alike.select("e"), F.col("i") == F.col("e"), "left_semi").select(F.col("i").alias("e"), "n", "fp", "first"))
    stash.drop(at)
    roots = components(links(entries, rows, stash), stash)
    member = alike.join(roots, F.col("e") == F.col("node"), "left").select(F.coalesce("root", "e").alias("root"), "best")
    stays = stash.keep(member.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.i").alias("_stays")))
    stash.drop(of, own)
    return whole.join(stays, F.col("i") == F.col("_stays"), "left_semi").select("_row.*")
