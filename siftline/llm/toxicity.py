"""Toxicity by class-conditional Kneser-Ney models.

An expression is a word, read as characters with start and end marks. Each class, toxic and
ordinary, has its own counts at the highest order (ORDER characters), discounted by what the counts
of counts say (D1, D2, D3+ of the modified smoothing); what is taken off goes to a Kneser-Ney
distribution over continuation counts that both classes share (SHARED characters, then one). So rare
expressions are judged by the characters they share with others, and what neither class knows
counts for neither. Counts are of documents that hold a word, so that no document speaks for itself
by repetition.

A word's difference is its log-likelihood under the toxic model less that under the ordinary one. Two
length-normalised differences describe a document: that of the whole text, for each word, and that of
the TELLING words which differ most. A logistic regression on labelled documents that gave no counts
turns the two into a score; toxic documents weigh WEIGHT times there.

Counts are gathered from all labelled training documents and all character sequences keep their
counts, in tables; the distinct words of the documents to score are cut alike and rated by joins on
them. The differences of the words that occur most often, REMEMBERED at most, are sent to the executors;
those of the others are joined to the documents' words and summed. A fifth of the training documents
gives no counts but is for the regression, by a hash of the id about CALIBRATED at most.

Defined cases: null text is empty; texts without words have both differences zero and the score that
the regression gives these; documents with several labels count as toxic if one says so; labels
without a document are ignored; without labels of both kinds every score is 0; rows with null ids are
scored but teach nothing; equal texts score alike; columns of any name are passed on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stash, forget, packed, read, share, slices, taken

ORDER, SHARED = 9, 8
#: Discount of the shared counts.
DISCOUNT = 0.75
CALIBRATED, WEIGHT, RIDGE = 20_000, 3.0, 0.1
TELLING = 2
THRESHOLD = 0.7
#: Words (of LONG characters at most) whose differences are sent to the workers; all others are joined.
REMEMBERED, LONG = 400_000, 64
#: Characters that are rated once for all words that begin with them; bits of a difference after the point.
HEAD, BITS = ORDER - 2, 24
#: Entries that a task gathers before it hands them on.
HELD = 500_000
_WORD = re.compile(r"\w+")
START, END = "\x02", "\x03"


def _crc(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: Column) -> Column:
    return _crc(doc_id) % 3 == 1


def _fold(doc_id: Column) -> Column:
    """Of the training rows, a fifth is for the regression."""
    return F.floor(_crc(doc_id) / 3) % 5 == 0


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (word, ordinary, toxic): documents of each class that hold the word."""
    forget()
    seen: list[Counter] = [Counter(), Counter()]

    def out() -> Iterator[pa.RecordBatch]:
        for kind, c in enumerate(seen):
            if c:
                n, zero = pa.array(list(c.values()), pa.int64()), pa.array([0] * len(c), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), *((zero, n) if kind else (n, zero))], names=["word", "ordinary", "toxic"])
            c.clear()

    for b in batches:
        for t, kind in zip(b.column(0), b.column(1).to_pylist()):
            seen[kind].update(set(words(t.as_py())))
        if sum(map(len, seen)) > HELD:
            yield from out()
    yield from out()


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    seen: Counter = Counter()
    out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
    for b in batches:
        for t in b.column(0):
            seen.update(words(t.as_py()))
        if len(seen) > HELD:
            yield out()
            seen.clear()
    yield out()


def _places(word: str) -> Iterator[str]:
    s = START * (ORDER - 1) + word + END
    return (s[i : i + ORDER] for i in range(len(s) - ORDER + 1))


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, ordinary, toxic) to (g, ordinary, toxic), summed as far as a task holds them."""
    seen: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        n = np.array(list(seen.values()), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(n[:, 0]), pa.array(n[:, 1])], names=["g", "ordinary", "toxic"])

    for b in batches:
        for w, o, t in zip(*(c.to_pylist() for c in b.columns)):
            for g in _places(w):
                if (x := seen.get(g)) is None:
                    seen[g] = [o, t]
                else:
                    x[0] += o
                    x[1] += t
            if len(seen) > HELD:
                yield out()
                seen.clear()
    yield out()


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, w, hid) to (u, ctx, k) of each place: those of the word's head once, for the word whose
    w is hid, with u = 2 hid; the others with u = 2 w + 1."""

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array([g[:-1] for g in found], pa.string()), pa.array([g[-1] for g in found], pa.string())], names=["u", "ctx", "k"])

    u, found = [], []
    for b in batches:
        for word, w, hid in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
            word = word.as_py()
            places = _places(word)
            head = list(islice(places, min(HEAD, len(word))))
            if w == hid:
                found += head
                u += [2 * hid] * len(head)
            while part := list(islice(places, 100_000)):
                found += part
                u += [2 * w + 1] * len(part)
                if len(found) > 100_000:
                    yield out()
                    u, found = [], []
    yield out()


class Learnt:
    """A table (ctx, ratios: next character to difference, rest: that of others), and the regression."""

    def __init__(self, contexts: DataFrame):
        self.contexts = contexts
        #: bias, then a weight for each difference; None without labels of both kinds
        self.weights: list[float] | None = None

    def score(self, a: Column, b: Column) -> Column:
        if self.weights is None:
            return F.lit(0.0)
        z = F.lit(self.weights[0]) + F.lit(self.weights[1]) * a + F.lit(self.weights[2]) * b
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def discounts(ones: list[int]) -> list[float]:
    """What is taken off counts of 1, 2 and 3 or more, from how many sequences occur 1 to 4 times."""
    n1, n2, n3, n4 = (max(1, n) for n in ones)
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.1), float(k) - 0.1) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def _marks(labels: DataFrame) -> DataFrame:
    """_id, toxic of the documents that are labelled and not held out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("toxic") != 0).cast("long")).alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame, stash: Stash) -> Learnt:
    """The differences, from the rows of docs (doc_id, text) that labels (doc_id, toxic) marks and
    that are neither held out nor for the regression."""
    marks = _marks(labels).filter(~_fold(F.col("_id")))
    rows = docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("_id")).select("text", "toxic")
    counted = rows.mapInArrow(_count_words, "word string, ordinary long, toxic long").groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    cut = counted.mapInArrow(_sequences, "g string, ordinary long, toxic long").withColumn("mid", F.substring("g", 2, SHARED - 1))
    # one shuffle, by what stands between the first and the last character, serves the counts and the
    # continuation counts: tasks have summed what they could, and a group is a pair of characters at most
    top = cut.repartition("mid").groupBy("mid", "g").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")).withColumn("k", F.substring("g", ORDER, 1))
    same, all_of = W.partitionBy("mid", "k"), W.partitionBy("mid")
    top = top.withColumn("nth", F.row_number().over(same.orderBy("g"))).withColumn("n", F.count(F.lit(1)).over(same))
    top = top.withColumn("t", F.count(F.lit(1)).over(all_of)).withColumn("kinds", F.count_if(F.col("nth") == 1).over(all_of))
    top, at = stash.put(top.select("g", "k", "ordinary", "toxic", "n", "t", "kinds", (F.col("nth") == 1).alias("first")))
    # a row for each character: of how many different sequences it is the end, and counts of counts
    by = [F.count_if(F.col(c) == i).alias(f"{c}_{i}") for c in ("ordinary", "toxic") for i in range(1, 5)]
    ends = top.groupBy("k").agg(F.count_if("first").alias("n"), *by).collect()
    total = max(1, sum(r.n for r in ends))
    last = docs.sparkSession.createDataFrame([(r.k, max(r.n - DISCOUNT, 0) / total + DISCOUNT * len(ends) / total / 256) for r in ends], "_k string, p1 double")
    off = {c: discounts([sum(r[f"{c}_{i}"] for r in ends) for i in range(1, 5)]) for c in ("ordinary", "toxic")}
    p = (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("p1")) / F.col("t")
    part = top.join(F.broadcast(last), F.col("k") == F.col("_k")).select(F.substring("g", 1, ORDER - 1).alias("ctx"), F.struct("k", "ordinary", "toxic", p.alias("p")).alias("x"))
    group = part.groupBy("ctx").agg(F.collect_list("x").alias("xs"))

    def less(c: Column, kind: str) -> Column:
        d = off[kind]
        return F.when(c <= 0, 0.0).when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])

    for kind in ("ordinary", "toxic"):
        group = group.withColumn(f"n_{kind}", F.aggregate("xs", F.lit(0.0), lambda a, x: a + x[kind]))
        group = group.withColumn(f"l_{kind}", F.when(F.col(f"n_{kind}") > 0, F.aggregate("xs", F.lit(0.0), lambda a, x: a + less(x[kind], kind)) / F.col(f"n_{kind}")).otherwise(1.0))

    def log(x: Column, kind: str) -> Column:
        return F.log((x[kind] - less(x[kind], kind)) / F.greatest(F.col(f"n_{kind}"), F.lit(1.0)) + F.col(f"l_{kind}") * x["p"])

    ratios = F.map_from_arrays(F.transform("xs", lambda x: x["k"]), F.transform("xs", lambda x: log(x, "toxic") - log(x, "ordinary")))
    model = Learnt(stash.keep(group.select("ctx", ratios.alias("ratios"), (F.log("l_toxic") - F.log("l_ordinary")).alias("rest"))))
    stash.drop(at)
    return model


def rate(vocabulary: DataFrame, model: Learnt, stash: Stash) -> DataFrame:
    """vocabulary (word, n; words may repeat) to word, n, ratio: the difference, summed over the word's characters.

    The first HEAD characters are rated once for all words that begin with them. Differences are added
    in fixed point, so that their order doesn't matter.
    """
    # one shuffle brings equal words and equal heads together
    own = vocabulary.withColumn("head", F.substring("word", 1, HEAD)).repartition("head").groupBy("head", "word").agg(F.sum("n").alias("n")).withColumn("w", F.monotonically_increasing_id())
    own, at = stash.put(own.withColumn("hid", F.min("w").over(W.partitionBy("head"))).drop("head"))
    stash.drop()
    places = own.select("word", "w", "hid").mapInArrow(_spread, "u long, ctx string, k string")
    ratio = F.coalesce(F.try_element_at("ratios", F.col("k")), F.col("rest"))
    units = places.join(model.contexts, "ctx").select("u", F.round(ratio * (1 << BITS)).cast("long").alias("v"))
    units, sums = stash.put(units.groupBy("u").agg(F.sum("v").alias("v")))
    stash.drop()
    tails = units.filter(F.col("u") % 2 == 1).select(F.shiftright("u", 1).alias("w"), F.col("v").alias("_tail"))
    heads = units.filter(F.col("u") % 2 == 0).select(F.shiftright("u", 1).alias("hid"), F.col("v").alias("_head"))
    whole = (F.coalesce("_head", F.lit(0)) + F.coalesce("_tail", F.lit(0))) / F.lit(float(1 << BITS))
    out = stash.keep(own.join(heads, "hid", "left").join(tails, "w", "left").select("word", "n", whole.alias("ratio")))
    stash.drop(at, sums)
    return out


def _known(rated: DataFrame) -> dict[str, float]:
    """The differences of the words that occur most often: those with a count from which on there
    are REMEMBERED at most. Nothing is sorted; the driver sees a table of counts and these words."""
    short = rated.filter(F.length("word") <= LONG)
    top = 10_000
    held, least = 0, top + 1
    for r in sorted(short.groupBy(F.least("n", F.lit(top)).alias("n")).agg(F.count(F.lit(1)).alias("held")).collect(), key=lambda r: -r.n):
        if (held := held + r.held) > REMEMBERED:
            break
        least = r.n
    t = short.filter(F.col("n") >= least).select("word", "ratio").toArrow()
    return dict(zip(t.column(0).to_pylist(), t.column(1).to_pylist()))


def describe(docs: DataFrame, model: Learnt, stash: Stash) -> DataFrame:
    """docs (text, then longs) to the differences a (whole text) and b (telling words), with the longs."""
    own = docs.columns[1:]
    rated = rate(docs.select("text").mapInArrow(_vocabulary, "word string, n long"), model, stash)
    shared = docs.sparkSession.sparkContext.broadcast(_known(rated))
    tops = [f"top{i}" for i in range(TELLING)]
    names = ["row", *own, "word", "n", "total", *tops]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = slices(batches)
        known = shared.value.get
        kinds = [pa.int64()] * (1 + len(own)) + [pa.string(), pa.int64(), pa.float64(), *[pa.float64()] * TELLING]
        for b in batches:
            out: list[list] = [[] for _ in names]
            put = [o.append for o in out]
            for t, *ids in zip(b.column(0), *(c.to_pylist() for c in b.columns[1:])):
                n, total, best = 0, 0.0, [float("-inf")] * TELLING
                for w, k in Counter(words(t.as_py())).items():
                    r = known(w)
                    if r is None:
                        for p, v in zip(put, (ids[0], *[None] * len(own), w, k, None, *[None] * TELLING)):
                            p(v)
                        continue
                    n += k
                    total += k * r
                    if r > best[-1]:
                        best = sorted(best + [r] * min(k, TELLING), reverse=True)[:TELLING]
                for p, v in zip(put, (*ids, None, n, total, *(x if x > float("-inf") else None for x in best))):
                    p(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=names)

    schema = ", ".join(["row long", *(f"{c} long" for c in own), "word string", "n long", "total double", *(f"{c} double" for c in tops)])
    seen, at = stash.put(docs.select("text", F.monotonically_increasing_id().alias("row"), *own).mapInArrow(run, schema))
    # the words that aren't sent are joined: one row for each in a document
    rest = seen.filter("word IS NOT NULL").select("row", "word", F.col("n").alias("times")).join(rated.select("word", "ratio"), "word")
    again = [F.when(F.col("times") > i, F.col("ratio")).alias(c) for i, c in enumerate(tops)]
    rest = rest.select("row", *(F.lit(None).cast("long").alias(c) for c in own), F.col("times").alias("n"), (F.col("times") * F.col("ratio")).alias("total"), *again)
    whole = seen.filter("word IS NULL").drop("word").unionByName(rest)
    whole = whole.groupBy("row").agg(*(F.max(c).alias(c) for c in own), F.sum("n").alias("n"), F.sum("total").alias("total"), F.collect_list(F.array_compact(F.array(*tops))).alias("tops"))
    best = F.slice(F.sort_array(F.flatten("tops"), asc=False), 1, TELLING)
    out = whole.select(*own, F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0).alias("a"), (F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / TELLING).alias("b"))
    out = stash.keep(out)
    stash.drop(at)
    return out


def regression(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression on standardised columns by Newton steps; given back for the columns as they are."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack((np.ones(len(x)), (x - mean) / spread))
    w, s = np.zeros(z.shape[1]), np.where(y == 1, WEIGHT, 1.0)
    keep = np.r_[1e-6, np.full(len(w) - 1, RIDGE)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (s * p * (1 - p))) @ z + np.diag(keep), z.T @ (s * (p - y)) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    slope = w[1:] / spread
    return [float(w[0] - slope @ mean), *map(float, slope)]


def _to_calibrate(labels: DataFrame) -> DataFrame:
    marks = _marks(labels).filter(_fold(F.col("_id")))
    return marks.filter(taken(F.col("_id"), share(marks.count(), CALIBRATED)))


def _calibrate(model: Learnt, rows: list) -> None:
    y = np.array([r.toxic for r in rows], float)
    if len(y) and 0 < y.sum() < len(y):
        model.weights = regression(np.array([[r.a, r.b] for r in rows], float), y)


def fit(docs: DataFrame, labels: DataFrame) -> Learnt:
    """Learn from the rows of docs (doc_id, text) that labels (doc_id, toxic) marks and that aren't held out."""
    stash = Stash(docs.sparkSession, "toxicity")
    model = learn(docs, labels, stash)
    rows = docs.select("doc_id", "text").join(_to_calibrate(labels), F.col("doc_id") == F.col("_id")).select("text", "toxic")
    _calibrate(model, describe(rows, model, stash).dropDuplicates(["toxic", "a", "b"]).collect())
    return model


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_text_1"), F.xxhash64(F.lit(7), text).alias("_text_2")]


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, _text_1, _text_2, score) of each row: fit and score in one, so that the documents are read twice, not four times."""
    stash = Stash(docs.sparkSession, "toxicity")
    model = learn(docs, labels, stash)
    seen = describe(docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), *_keys(F.col("text"))), model, stash)
    marks = _to_calibrate(labels)
    _calibrate(model, seen.select("doc_id", "a", "b").dropDuplicates().join(F.broadcast(marks), F.col("doc_id") == F.col("_id")).select("toxic", "a", "b").collect())
    return seen.select("doc_id", "_text_1", "_text_2", model.score(F.col("a"), F.col("b")).alias("score"))


def score(docs: DataFrame, model: Learnt) -> DataFrame:
    """docs with toxic_score (in place of a column of that name); equal texts are scored once."""
    rows = packed(docs, "text").select("_row", *_keys(F.col("text")))
    if model.weights is None:
        found = rows.select("_row", F.lit(0.0).alias("_score"))
    else:
        seen = describe(docs.select("text", *_keys(F.col("text"))), model, Stash(docs.sparkSession, "toxicity"))
        by_text = seen.groupBy("_text_1", "_text_2").agg(F.min(model.score(F.col("a"), F.col("b"))).alias("_score"))
        found = rows.join(by_text, ["_text_1", "_text_2"])
    kept = [c for c in docs.columns if c.lower() != "toxic_score"]
    return found.select(*(F.col("_row").getField(c).alias(c) for c in kept), F.col("_score").alias("toxic_score"))


def drop(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score the threshold or more; only the texts that go are joined."""
    bad = scored(docs, labels).filter(F.col("score") >= threshold).select("_text_1", "_text_2").distinct()
    return packed(docs, "text").select("_row", *_keys(F.col("text"))).join(bad, ["_text_1", "_text_2"], "left_anti").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
