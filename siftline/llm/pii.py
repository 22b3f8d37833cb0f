"""Personal data: patterns with checks, and boosted trees that select further spans.

Four kinds have a pattern and a check and are always reported: email, ip (parts up to 255), card (13
to 19 digits, Luhn), phone (9 to 15 digits). Beside these, generators propose overlapping
candidates with high recall: digit groups (number), long runs of letters and digits (secret) and
addresses written with (at) or [at] (address). Trees over their format (lengths, classes of
characters, groups, Luhn) and context (words before, quotes, signs) score them, and those that
reach the threshold of their generator, calibrated to PRECISION on the half of the candidates that the
trees did not see (a generator with few positive candidates there has the threshold of all), are
reported unless they overlap a span of the four kinds.

The trees and the thresholds come from all candidates of all documents, each as often as it is found; halves
are by a hash of the candidate and what precedes it, so that its copies are in one half. Digit groups that
the checks accept count as personal, other digit groups don't; a run counts as a secret where a name
like token or key and a sign precede it or its form is that of a known kind of key, and the trees do
not see what told so for half of these, so that runs without it are found by their form; a written-out
address counts where its last part is letters alone.

All is DataFrame functions. Spans are found in the row; what is learnt from are counts of equal vectors of
bins (boost.py), and only sums by feature and bin and counts by score reach the driver. Matches are placed by the lengths of what lies between them, added up in chunks, so that a text with very many
matches takes time in proportion. Patterns are possessive where a greedy one would only backtrack in
vain (or overflow the stack), so that long runs of one class take linear time, whatever their length.

Defined cases: null text is empty and has no spans; offsets are code points, end exclusive; equal
rows get equal spans; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boost
from .common import Stash, packed, read

KINDS = ("email", "ip", "card", "phone")
ADDED = ("number", "secret", "address")
PRECISION = 0.9
#: The patterns of the kinds, written so that Java takes linear time. A match of the first begins
#: where the last one ended or where no character of its class precedes.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
NUMBER = r"(?<![0-9])[+(]?[0-9](?:[\x20().\/-]{0,2}+[0-9]){6,}+"
RUN = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+"
AT = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++"
NAMED = r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|key|auth|bearer)[\"'\x20]*[=:]?[\x20\"']*$"
KNOWN = r"^(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{30,}|sk[-_][A-Za-z0-9_-]{16,}|xox[abp]-[A-Za-z0-9-]{10,})$"
FEATURES = ("length", "digits", "lower", "upper", "signs", "groups", "longest", "first", "luhn", "hex", "mixed", "named", "quoted", "context", "distinct")


CHUNK = 256


def let(x: Column, f) -> Column:
    """f(x), with x evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def scanned(xs: Column, op, zero) -> Column:
    """The inclusive running value of an associative op over an array of ints.

    An array can only grow by being copied, so chunks are scanned alone and then put on the running
    value of the chunks before.
    """
    none = F.array().cast("array<int>")
    step = lambda acc, x: let(op(acc["at"], x), lambda v: F.struct(v.alias("at"), F.concat(acc["out"], F.array(v)).alias("out")))
    begin = F.struct(F.lit(zero).alias("at"), none.alias("out"))

    def whole(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / CHUNK).cast("int")), lambda k: F.aggregate(F.slice(v, k * CHUNK + 1, F.lit(CHUNK)), begin, step))
        bases = lambda cs: F.aggregate(cs, begin, lambda acc, c: F.struct(op(acc["at"], c["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        put = lambda cs: let(bases(cs), lambda bs: F.flatten(F.transform(cs, lambda c, i: F.transform(c["out"], lambda x: op(F.get(bs, i), x)))))
        return F.when(F.size(v) > 0, let(chunks, put)).otherwise(none)

    return let(xs, whole)


def located(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m, before>> of a pattern's matches: offsets, the match, and what stands
    between it and the match before (24 characters at most)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.filter(F.arrays_zip(found.alias("m"), between.alias("b")), lambda x: x["m"].isNotNull())

    def placed(ps: Column) -> Column:
        ends = scanned(F.transform(ps, lambda x: F.length(x["b"]) + F.length(x["m"])), lambda a, b: a + b, 0)
        return let(ends, lambda es: F.transform(ps, lambda x, i: F.struct((F.get(es, i) - F.length(x["m"])).alias("s"), F.get(es, i).alias("e"), x["m"].alias("m"), F.substring(x["b"], -24, 24).alias("before"))))

    return let(pairs, placed)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes (luhn_check is not defined for very long ones)."""
    d = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))),
        F.lit(0),
        lambda a, x: a + F.coalesce(x, F.lit(0)),
    )
    return total % 10 == 0


def _card(m: Column) -> Column:
    n = F.length(_digits(m))
    return F.when((n >= 13) & (n <= 19), luhn(_digits(m))).otherwise(False)


CHECKS = {
    "email": (EMAIL, lambda t: t.contains("@"), lambda m: F.lit(True)),
    "ip": (IP, lambda t: t.rlike("[0-9]\\.[0-9]"), lambda m: m.rlike(PART)),
    "card": (CARD, lambda t: t.rlike("[0-9][\\x20-]?[0-9]"), _card),
    "phone": (PHONE, lambda t: t.contains("+"), lambda m: F.length(_digits(m)).between(9, 15)),
}
SPAN = "array<struct<kind:string,s:int,e:int>>"
CANDIDATE = "array<struct<s:int,e:int,m:string,before:string>>"


def based(docs: DataFrame) -> DataFrame:
    """doc_id, _text and the spans of each kind."""
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    for kind, (pattern, may, check) in CHECKS.items():
        spans = _spans(kind, pattern, check)
        df = df.withColumn(f"_{kind}", F.when(may(F.col("_text")), spans).otherwise(F.array().cast(SPAN)))
    return df


def _spans(kind: str, pattern: str, check) -> Column:
    good = F.filter(located(F.col("_text"), pattern), lambda x: check(x["m"]))
    return F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def _count(m: Column, cls: str) -> Column:
    return F.length(F.regexp_replace(m, f"[^{cls}]", "")).cast("double")


def features(x: Column) -> list[Column]:
    m, before = x["m"], x["before"]
    parts = F.split(m, "[^A-Za-z0-9]+")
    d = _digits(m)
    return [
        F.length(m).cast("double"), F.length(d).cast("double"), _count(m, "a-z"), _count(m, "A-Z"), _count(m, "^A-Za-z0-9").cast("double"), F.size(parts).cast("double"), F.array_max(F.transform(parts, F.length)).cast("double"),
        F.ascii(m).cast("double"), F.when(F.length(d).between(8, 19), luhn(d)).otherwise(False).cast("double"), m.rlike("^[0-9a-f]+$").cast("double"), F.size(F.regexp_extract_all(m, F.lit("[a-zA-Z][0-9]|[0-9][a-zA-Z]"), F.lit(0))).cast("double"),
        before.rlike(NAMED).cast("double"), before.rlike("[\"'=:]\\x20?$").cast("double"), before.rlike("(?i)(?:call|phone|tel|mail|card|account|contact|ssn|iban|id)[\\W]*$").cast("double"), F.size(F.array_distinct(F.split(m, ""))).cast("double"),
    ]


def proposed(df: DataFrame) -> DataFrame:
    """with _base, all spans of the four kinds, and _candidates of the generators, by their place: gen,
    s, e, m, before, taken (whether a span of the four kinds overlaps)."""
    t = F.col("_text")
    none = F.array().cast(CANDIDATE)
    gens = [
        F.when(t.rlike("[0-9]"), located(t, NUMBER)).otherwise(none),
        F.when(t.rlike("[A-Za-z0-9_-]{16}"), F.filter(located(t, RUN), lambda x: x["m"].rlike("[0-9]"))).otherwise(none),
        F.when(t.rlike("[(\\[]at[)\\]]"), located(t, AT)).otherwise(none),
    ]
    one = lambda s, k, e, gen, m, before: F.struct(s.alias("s"), F.lit(k).alias("k"), e.alias("e"), gen.alias("gen"), m.alias("m"), before.alias("before"))
    null = F.lit(None).cast("string")
    spans = [F.transform(f"_{k}", lambda x: one(x["s"], 0, x["e"], null, null, null)) for k in KINDS]
    candidate = lambda name: lambda x: one(x["s"], 1, x["e"], F.lit(name), x["m"], x["before"])
    spans += [F.transform(g, candidate(name)) for name, g in zip(ADDED, gens)]
    far = (1 << 31) - 1

    def swept(xs: Column) -> Column:
        # how far the spans reach that begin no later, and where the next one begins
        reach = scanned(F.transform(xs, lambda x: F.when(x["k"] == 0, x["e"]).otherwise(0)), F.greatest, 0)
        following = F.reverse(scanned(F.reverse(F.transform(xs, lambda x: F.when(x["k"] == 0, x["s"]).otherwise(far))), F.least, far))
        marked = F.transform(F.arrays_zip(xs.alias("x"), reach.alias("r"), following.alias("f")), lambda z: F.struct(z["x"].alias("x"), ((z["r"] > z["x"]["s"]) | (z["f"] < z["x"]["e"])).alias("taken")))
        return F.transform(F.filter(marked, lambda z: z["x"]["k"] == 1), lambda z: F.struct(z["x"]["gen"].alias("gen"), z["x"]["s"].alias("s"), z["x"]["e"].alias("e"), z["x"]["m"].alias("m"), z["x"]["before"].alias("before"), z["taken"].alias("taken")))

    every = let(F.array_sort(F.concat(*spans)), swept)
    return df.withColumn("_base", F.concat(*[F.col(f"_{k}") for k in KINDS])).withColumn("_candidates", every)


def _described(c: Column) -> Column:
    told = F.when(c["gen"] == "address", c["m"].rlike("[A-Za-z]{2,}$")).otherwise(c["before"].rlike(NAMED) | c["m"].rlike(KNOWN))
    return F.struct(c["gen"].alias("gen"), c["s"].alias("s"), c["e"].alias("e"), c["taken"].alias("taken"), told.alias("told"), F.array(*features(c)).alias("f"))


def vectors(docs: DataFrame) -> DataFrame:
    """gen, held (whether for the thresholds), b (bins of the features), n and pos: how many of all
    candidates have these, and how many of them count as personal."""
    key = lambda c: F.xxhash64(c["gen"], c["m"], c["before"])
    every = F.transform("_candidates", lambda c: F.struct(key(c).alias("h"), _described(c).alias("c")))
    rows = proposed(based(docs)).select(F.explode(every).alias("x")).select("x.h", "x.c.*")
    # half of each half is described without what tells secrets
    shown = F.pmod(F.shiftright("h", 1), F.lit(2)) == 1
    told = [FEATURES.index("named"), FEATURES.index("quoted")]
    b = F.array(*[boost.binned(F.when(shown, F.get("f", F.lit(i))).otherwise(0.0) if i in told else F.get("f", F.lit(i))) for i in range(len(FEATURES))])
    y = F.when(F.col("gen") == "number", F.col("taken")).otherwise(F.col("told"))
    rows = rows.select("gen", (F.pmod("h", F.lit(2)) == 1).alias("held"), b.alias("b"), y.cast("long").alias("y"))
    return rows.groupBy("gen", "held", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))


def fit(docs: DataFrame) -> tuple[boost.Boosted, dict[str, float]]:
    """The trees and each generator's threshold (a multiple of 1 / LEVELS), from all candidates."""
    stash = Stash(docs.sparkSession, "pii")
    rows, at = stash.put(vectors(docs))
    bins, model = boost.fit_table(rows.filter(~F.col("held")), len(FEATURES))
    level = F.floor(bins.folded("b") * boost.LEVELS)
    got = rows.filter("held").groupBy("gen", level.alias("level")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()
    stash.drop(at)
    gen = np.array([r.gen for r in got])
    score, n, pos = (np.array([r[c] for r in got], float) for c in ("level", "n", "pos"))
    score /= boost.LEVELS
    general = boost.threshold(score, pos, PRECISION, n=n)
    cut = {}
    for g in ADDED:
        mine = gen == g
        cut[g] = boost.threshold(score[mine], pos[mine], PRECISION, n=n[mine]) if pos[mine].sum() >= 5 else min(general, 0.5)
    return model, cut


def find(docs: DataFrame, model: boost.Boosted, thresholds: dict[str, float]) -> DataFrame:
    """doc_id, base (spans of the four kinds, in their order) and more (the spans selected)."""
    df = proposed(based(docs))
    open_ = F.transform(F.filter("_candidates", lambda c: ~c["taken"]), _described)
    least = lambda c: F.coalesce(*[F.when(c["gen"] == g, F.lit(thresholds[g])) for g in ADDED])
    picked = F.filter(open_, lambda c: model.column(lambda i: F.get(c["f"], i)) >= least(c))
    # by generator, then place
    of = lambda g: lambda c: c["gen"] == g
    spans = F.concat(*[F.transform(F.filter(picked, of(g)), lambda c: F.struct(c["gen"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"))) for g in ADDED])
    return df.select("doc_id", F.col("_base").alias("base"), spans.alias("more"), *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[{kind}]", **fitted) -> DataFrame:
    """docs with every span replaced by its mark; overlapping spans are replaced once, by the first.

    Equal texts are redacted alike, in their own rows; null stays null.
    """
    model, thresholds = fitted.get("model"), fitted.get("thresholds")
    if model is None:
        model, thresholds = fit(docs)
    rows = packed(docs).select("_row", F.col("_row.text").alias("text"))
    found = find(rows.select(F.col("_row").alias("doc_id"), "text"), model, thresholds)
    at = F.array_sort(F.transform(F.concat("base", "more"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    text = F.col("doc_id.text")

    def done(xs: Column) -> Column:
        def cut(reach: Column) -> Column:
            def pieces(chars: Column) -> Column:
                def one(x: Column, i: Column) -> Column:
                    upto = F.coalesce(F.get(reach, i - 1), F.lit(0))
                    gap = F.when(x["s"] > upto, F.array_join(F.slice(chars, upto + 1, F.greatest(x["s"] - upto, F.lit(0))), "")).otherwise(F.lit(""))
                    return F.concat(gap, F.when(x["s"] >= upto, F.replace(F.lit(mark), F.lit("{kind}"), x["kind"])).otherwise(F.lit("")))

                rest = F.array_join(F.slice(chars, F.element_at(reach, -1) + 1, F.greatest(F.size(chars), F.lit(1))), "")
                return F.concat(F.array_join(F.transform(xs, one), ""), rest)

            return let(F.split(text, ""), pieces)

        return F.when(F.size(xs) > 0, let(scanned(F.transform(xs, lambda x: x["e"]), F.greatest, 0), cut)).otherwise(text)

    new = found.select(F.col("doc_id").alias("_row"), let(at, done).alias("_new"))
    return new.select(*(F.col("_new").alias(c) if c.lower() == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, *fit(docs))
    total = (F.size("base") + F.size("more")).cast("long")
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], total.alias("n_spans"), (total > 0).cast("int").alias("has_personal"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans"))
