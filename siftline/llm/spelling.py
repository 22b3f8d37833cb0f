"""Spelling variants: words one code point apart, found by forward and backward automata.

A word's two halves cannot both hold the one error, so a near word begins with the first half, or
ends with the second, exactly. Words are dealt by these halves: a word goes as an entry to every
shard that may be asked for it (its beginnings and endings of the lengths that halves of words one
shorter, as long, or one longer have), and as a question to the shards of its own two halves. A
shard holds a minimal acyclic automaton of its entries' beginnings and one of the reversed words;
a question walks one half exactly, completes the other with one error, and reads the near words'
numbers off the path (a perfect hash). What both directions find is one pair.

A half that more than HALF words share, as an ending may, is split: its entries are dealt to
several shards, and questions go to each of them. Shards hold about HELD entries, and no key,
word or text is collected anywhere else; how often a word occurs is added up in each task first.

A word's form is its most frequent near word (ties: the first in code-point order), if that occurs
RATIO times as often at least; roots follow forms to the last by pointer doubling, in about
log2(log2(n)) rounds, since occurrences double at each step.

Defined cases: null and empty texts have no runs; a null doc_id counts as the empty string where runs
are changed; rows with equal ids and texts count each time; texts of any length are read whole; words
of any length take part; other columns are ignored; no words give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .automata import Dictionary
from .common import Stash, read

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS, OCCURRENCES, RATIO = 5, 3, 2
#: One run in so many loses a code point.
CHANGED = 97
#: Entries of a shard, about; words that share a half before it is split; words that a task counts at once.
HELD, HALF, COUNTED = 50_000, 50_000, 500_000


def changed(doc_id: int | None, run: str, every: int = CHANGED) -> str:
    """A lower-cased run as it counts in this document: every so many lose a code point."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    k = h % len(run)
    return run if h % every else run[:k] + run[k + 1 :]


def words(docs: DataFrame, least: int = OCCURRENCES, letters: int = LETTERS, every: int = CHANGED) -> DataFrame:
    """word, n: the distinct runs, as changed() gives them, of enough letters and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def close() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                # bytes.lower() knows A to Z only
                low = (text.as_py() or b"").lower().decode()
                for r, n in Counter(m.group() for m in RUN.finditer(low)).items():
                    if len(r) >= letters and len(w := changed(doc_id, r, every)) >= letters:
                        total[w] += n
                if len(total) >= COUNTED:
                    yield close()
        yield close()

    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _halves(word: Column, longer: int) -> Column:
    """Both halves that the word has if it were longer by so many: struct(forward, half)."""
    size = F.length(word) + longer
    first = F.floor(size / 2).cast("int")
    last = size - first
    return F.array(
        F.struct(F.lit(True).alias("forward"), F.substring(word, F.lit(1), first).alias("half")),
        F.struct(F.lit(False).alias("forward"), F.substring(word, F.length(word) - last + 1, last).alias("half")),
    )


def near(found: DataFrame, stash: Stash, held: int = HELD, half: int = HALF) -> DataFrame:
    """word, near, n (near's): each pair of words one code point apart, in both orders."""
    spark = found.sparkSession
    word = F.col("word")
    entries = found.select("word", "n", F.explode(F.array_distinct(F.concat(*(_halves(word, d) for d in (-1, 0, 1))))).alias("h")).select("word", "n", "h.forward", "h.half")
    asked = found.select("word", F.lit(None).cast("long").alias("n"), F.explode(_halves(word, 0)).alias("h")).select("word", "n", "h.forward", "h.half")
    wide = entries.groupBy("forward", "half").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > half)
    wide = stash.keep(wide.select(F.col("forward").alias("_f"), F.col("half").alias("_h"), F.ceil(F.col("size") / half).cast("int").alias("parts")))
    few = wide.count() <= 100_000  # rows of a half and a number; beyond, a join that splits its large keys
    split = lambda df: df.join(F.broadcast(wide) if few else wide, (F.col("forward") == F.col("_f")) & (F.col("half") == F.col("_h")), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    entries = split(entries).withColumn("part", F.pmod(F.xxhash64(F.lit(1), "word"), F.col("parts")).cast("int"))
    asked = split(asked).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 6 * found.count() // held)
    shard = F.pmod(F.xxhash64("forward", "half", "part"), F.lit(shards)).alias("shard")
    dealt = entries.unionByName(asked).select(shard, "forward", "half", "word", "n")

    def answer(rows: pa.Table) -> pa.Table:
        forward, halves, texts, counts = (rows[c].to_pylist() for c in ("forward", "half", "word", "n"))
        out: tuple[list, list, list] = [], [], []
        for way in (True, False):
            n = {w: c for f, w, c in zip(forward, texts, counts) if f == way and c is not None}
            own = Dictionary(n, forward=way, backward=not way)
            for f, h, w, c in zip(forward, halves, texts, counts):
                if f == way and c is None:
                    for k in own.after(h, w[len(h) :]) if way else own.before(w[: len(w) - len(h)], h):
                        for column, value in zip(out, (w, own.words[k], n[own.words[k]])):
                            column.append(value)
        return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["word", "near", "n"])

    pairs = dealt.groupBy("shard").applyInArrow(answer, "word string, near string, n long")
    return pairs.groupBy("word", "near").agg(F.max("n").alias("n"))


def roots(forms: DataFrame, stash: Stash) -> DataFrame:
    """word, form (no null, no cycle) to word, root: where following forms ends."""
    p, at = stash.put(forms.select("word", F.col("form").alias("root")))
    while True:
        far = p.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        step = p.join(far, F.col("root") == F.col("_word"), "left")
        p, new = stash.put(step.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
        stash.drop(at)
        at = new
        if p.filter("moved").isEmpty():
            return p.select("word", "root")


def variants(docs: DataFrame, least: int = OCCURRENCES, letters: int = LETTERS, every: int = CHANGED, ratio: float = RATIO, held: int = HELD, half: int = HALF) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    stash = Stash(docs.sparkSession, "spelling")
    found = stash.keep(words(docs, least, letters, every))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("near")))
    met = near(found, stash, held, half).groupBy(F.col("word").alias("_word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    told = found.join(met, F.col("word") == F.col("_word"), "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    told = stash.keep(told)
    last = roots(told.filter("form is not null").select("word", "form"), stash).select(F.col("word").alias("_word"), "root")
    return told.join(last, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents"))


#: CRC-32 by its table, made from the polynomial; letters are one or two bytes of UTF-8.
SQL = r"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
runs as (
  select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
counted as (select doc_id, run, count(*) as n from runs where length(run) >= 5 group by all),
hashed as (
  select run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''),
    lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [(192 + (unicode(c) >> 6))::bigint, (128 + (unicode(c) & 63))::bigint] end))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) as h
  from counted, crc),
formed as (
  select case when h % 97 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed),
words as (select word, sum(n)::bigint as n from formed where length(word) >= 5 group by word having sum(n) >= 3),
cut as (select word, n, i, left(word, i::int) || substr(word, i::int + 2) as rest from words, unnest(range(length(word))) as r(i)),
near as (
  select a.word, b.word as near, b.n from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from cut a join words b on a.rest = b.word
  union select b.word, a.word, a.n from cut a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, max(n) as most, arg_min(near, (-n, near)) as near from near group by word),
told as (
  select w.word, case when most >= 2 * w.n then near end as form, w.n, coalesce(n_near, 0) as n_near, case when most >= 2 * w.n then most end as form_n
  from words w left join best b on w.word = b.word),
chain as (
  select word, form as root, 1 as step from told where form is not null
  union all select c.word, t.form, step + 1 from chain c join told t on c.root = t.word where t.form is not null),
last as (select word, arg_max(root, step) as root from chain group by word)
select t.word, form, coalesce(root, t.word) as root, n, n_near, form_n from told t left join last l on t.word = l.word
"""
