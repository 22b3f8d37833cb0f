"""Exact duplicates, found by an exchange of Golomb-coded fingerprints.

Texts are equal when the same bytes remain after the ASCII blanks (space, 9 to 13) are deleted.

1. Each partition cuts its rows into blocks of bounded size, keeps one entry for each distinct text
   of a block (its bytes, how many rows have it, which of them is best) and sorts the entries by
   fingerprint, the first bits of the text's SHA-256. Entries are written bucketed by block.
2. A block sends its sorted fingerprints, shortened to about log2(entries) + SPARE bits, to their
   owners: an owner has one range of fingerprints and gets one Golomb-coded list from each block.
3. An owner answers each list with a bitmap: which of its fingerprints some other entry has too.
4. The bitmaps go back to the blocks (a join on the table's bucketing, so entries stay where they
   are), and only the flagged entries, the suspects, are shuffled with their texts, which are
   compared byte by byte in a grouping. About one unique text in 2^SPARE is a suspect by chance.
5. What a group found (its best row, its size) returns to its entries and from these to their rows.

A text that a third of all rows have is one entry in each block, so no key, list or group holds
more than a row for each block of it; rows of one entry are at most a block's.

Of equal texts the row stays that has the most code points in its original text, then the smallest
doc_id (null ids last), then the first of its partition's rows. Defined cases: null, empty and
all-blank texts are equal to one another; repeated ids are separate rows, of which one stays; null
ids take part, and keep_id is null where such a row stays; other columns are ignored by
groups() and kept by dedupe(). A text of any length is one entry; it never leaves its block
unless it is a suspect.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import golomb
from .common import Stash, packed, read

BLANKS = b" \t\n\v\f\r"
#: A block ends when its texts or rows reach this.
BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 1 << 16
#: Bits of a sent fingerprint beyond log2(entries).
SPARE = 12
#: Entries that an owner gets, about.
OWNED = 1 << 20

_ENTRY = "block long, pos int, sha binary, n long, chars long, doc_id long, row long, body binary, prints binary, members array<struct<row:long,doc_id:long>>"
_ARROW = pa.schema([("block", pa.int64()), ("pos", pa.int32()), ("sha", pa.binary()), ("n", pa.int64()), ("chars", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("body", pa.binary()), ("prints", pa.binary()), ("members", pa.list_(pa.struct([("row", pa.int64()), ("doc_id", pa.int64())])))])


def _entries(docs: DataFrame, block_bytes: int, block_rows: int) -> DataFrame:
    """One row for each distinct text of a block, in the order of their fingerprints: its bytes, the
    number of its rows, the best of them, and all their numbers and ids. The first one also carries
    the block's fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, k, held, rows = TaskContext.get().partitionId() << 33, 0, 0, 0
        found: dict[bytes, list] = {}  # body: the least rank, rows

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal found, k, held, rows
            digests = sorted((hashlib.sha256(body).digest(), body) for body in found)
            prints = np.frombuffer(b"".join(d[:8] for d, _ in digests), ">u8").astype("<u8").tobytes()
            for at in range(0, len(digests), 1024):
                part = digests[at : at + 1024]
                best, members = zip(*(found[body] for _, body in part))
                columns = [[base + k] * len(part), range(at, at + len(part)), [d for d, _ in part], map(len, members), [-r[0] for r in best], [None if r[1] else r[2] for r in best], [r[3] for r in best], [body for _, body in part], [prints if at + j == 0 else None for j in range(len(part))], members]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _ARROW.types)], schema=_ARROW)
            found, k, held, rows = {}, k + 1, 0, 0

        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for doc_id, text, chars, row in zip(b.column(0).to_pylist(), texts, b.column(2).to_pylist(), b.column(3).to_pylist()):
                body = (text.as_py() or b"").translate(None, BLANKS)
                rank = (-(chars or 0), doc_id is None, doc_id or 0, row)
                if body not in found:
                    found[body] = [rank, []]
                    held += len(body)
                e = found[body]
                e[0] = min(e[0], rank)
                e[1].append({"row": row, "doc_id": doc_id})
                rows += 1
                if held >= block_bytes or rows >= block_rows:
                    yield from close()
        if rows:
            yield from close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.length(F.col("text").cast("string")).cast("long"), "_number").mapInArrow(run, _ENTRY)


def _messages(entries: DataFrame, bits: int, owner_bits: int) -> DataFrame:
    """owner, block, first (position of the list's first entry), n, code: each block's lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1)):
                values = np.frombuffer(raw.as_py(), "<u8") >> np.uint64(64 - bits)
                owner = (values >> np.uint64(bits - owner_bits)).astype(np.int64)
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                last = np.r_[first[1:], len(values)]
                low = values & np.uint64((1 << (bits - owner_bits)) - 1)
                code = [golomb.encode(low[i:j], 1 << (bits - owner_bits)) for i, j in zip(first, last)]
                yield pa.RecordBatch.from_arrays([pa.array(owner[first]), pa.array([block] * len(first), pa.int64()), pa.array(first.astype(np.int32)), pa.array((last - first).astype(np.int32)), pa.array(code, pa.binary())], names=["owner", "block", "first", "n", "code"])

    return entries.filter("prints is not null").select("block", "prints").mapInArrow(run, "owner long, block long, first int, n int, code binary")


def _answers(messages: DataFrame, reach: int) -> DataFrame:
    """block, slot, flags: for each list the bits, in words of 64 positions of its block, of the
    fingerprints that occur more than once at their owner (words without any are left out)."""

    def run(lists: pa.Table) -> pa.Table:
        block, first, n = (lists[c].to_numpy() for c in ("block", "first", "n"))
        values = np.concatenate([golomb.decode(c.as_py(), int(k), reach) for c, k in zip(lists["code"], n)])
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(values), bool)
        twice[order] = np.r_[same, False] | np.r_[False, same]
        at = np.flatnonzero(twice)
        lot = np.searchsorted(np.cumsum(n), at, side="right")
        pos = first[lot] + at - (np.cumsum(n) - n)[lot]
        bit = (np.uint64(1) << (pos & 63).astype(np.uint64)).view(np.int64)
        sums = pa.table({"block": block[lot], "slot": (pos >> 6).astype(np.int32), "flags": bit}).group_by(["block", "slot"]).aggregate([("flags", "sum")])
        return sums.select(["block", "slot", "flags_sum"]).rename_columns(["block", "slot", "flags"])

    return messages.groupBy("owner").applyInArrow(run, "block long, slot int, flags long")


def _marked(table: DataFrame, flags: DataFrame) -> DataFrame:
    """Rows of a table bucketed by block whose position in it has its bit set; only flags are shuffled."""
    # a map has 1,024 words at most, as a block has 65,536 positions
    flags = flags.groupBy("block", "slot").agg(F.bit_or("flags").alias("flags"))
    flags = flags.groupBy(F.col("block").alias("_block")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "flags"))).alias("_flags"))
    word = F.coalesce(F.try_element_at("_flags", F.shiftright("pos", 6)), F.lit(0).cast("long"))
    met = table.join(flags.hint("shuffle_hash"), F.col("block") == F.col("_block"))
    return met.filter(F.getbit(word, F.col("pos").bitwiseAND(F.lit(63))) == 1).drop("_block", "_flags")


def _same(entries: DataFrame, spare: int, owned: int) -> DataFrame:
    """sha, best (short, none, doc_id, row) and size of each text that several entries have."""
    shuffles = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = max(2, entries.count())
    owner_bits = max(shuffles - 1, total // owned).bit_length()
    bits = min(63, max(total.bit_length() + spare, owner_bits))
    flags = _answers(_messages(entries, bits, owner_bits), 1 << (bits - owner_bits))
    suspects = _marked(entries.select("block", "pos", "sha", "n", "chars", "doc_id", "row", "body"), flags)
    rank = F.struct((-F.col("chars")).alias("short"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    same = suspects.groupBy("sha", "body").agg(F.min(rank).alias("best"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("entries"))
    # two texts with one digest have never been seen; as results go back by the digest, they'd end the job
    whole = F.when(F.count(F.lit(1)) == 1, F.first("best")).otherwise(F.raise_error(F.lit("two texts have one SHA-256")))
    return same.groupBy("sha").agg(whole.alias("best"), F.sum("size").alias("size"), F.sum("entries").alias("entries")).filter("entries > 1")


def groups(docs: DataFrame, number: Column | None = None, block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS, spare: int = SPARE, owned: int = OWNED) -> DataFrame:
    """row, doc_id, keep_id, group_size, kept, text_sha256 of each row; row is number, a long that no
    two rows share, or one given here in the order of partitions."""
    stash = Stash(docs.sparkSession, "exact")
    docs = docs.select("doc_id", "text", (F.monotonically_increasing_id() if number is None else number).alias("_number"))
    entries = stash.bucketed(_entries(docs, block_bytes, block_rows), "block")
    same = stash.keep(_same(entries, spare, owned)).select(F.col("sha").alias("_sha"), "best", "size")
    # a group meets its entries again by the digest: one row for each block at most
    told = entries.select("sha", "n", "doc_id", "row", "members").join(same, F.col("sha") == F.col("_sha"), "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    told = told.select(F.explode("members").alias("m"), keep.alias("keep_id"), F.coalesce("size", "n").alias("group_size"), F.coalesce("best.row", "row").alias("stays"), F.lower(F.hex("sha")).alias("text_sha256"))
    return told.select(F.col("m.row").alias("row"), F.col("m.doc_id").alias("doc_id"), "keep_id", "group_size", (F.col("m.row") == F.col("stays")).alias("kept"), "text_sha256")


def dedupe(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; they aren't shuffled, only bits of the dropped are."""
    stash = Stash(docs.sparkSession, "dedupe")
    number = F.monotonically_increasing_id()
    whole = stash.bucketed(packed(docs).select("_row", F.shiftright(number, 16).alias("block"), number.bitwiseAND(F.lit(0xFFFF)).cast("int").alias("pos")), "block")
    found = groups(whole.select("_row.doc_id", "_row.text", "block", "pos"), F.shiftleft("block", 16) + F.col("pos"))
    block, pos = F.shiftright("row", 16).alias("block"), F.col("row").bitwiseAND(F.lit(0xFFFF))
    bits = found.filter("kept").select(block, F.shiftright(pos, 6).cast("int").alias("slot"), F.expr("shiftleft(1L, int(row & 63))").alias("flags"))
    return _marked(whole, bits).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents")).drop("row")


#: Texts whose bytes are equal have one digest; only the row that stays needs more.
SQL = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
     s as (select doc_id, length(text) as chars, sha256(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from t)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       row_number() over w = 1 as kept,
       text_sha256
from s window w as (partition by text_sha256 order by chars desc, doc_id nulls last)
"""
