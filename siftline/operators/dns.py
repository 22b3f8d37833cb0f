"""Which addresses a host may be fetched from, by the answers a resolver gave."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.ip import classified, let, public

VERDICT = "struct<ok:boolean,addresses:array<string>,code:string,detail:string>"


def host_verdict(host: Column, answers: Column) -> Column:
    """struct<ok, addresses, code, detail>: every answer must be public; null answers: the lookup failed."""

    def out(code: str | None, detail: Column, addresses: Column) -> Column:
        return F.struct(F.lit(code is None).alias("ok"), addresses.alias("addresses"), F.lit(code).cast("string").alias("code"), detail.cast("string").alias("detail")).cast(VERDICT)

    none = F.array().cast("array<string>")

    def literal(h: Column) -> Column:
        return let(classified(h), lambda c: F.when(c["allowed"], out(None, F.lit(None), F.array(h))).otherwise(out("BLOCKED_URL", F.concat(F.lit("address is not public: "), c["reason"]), none)))

    def named(a: Column) -> Column:
        refused = F.get(F.filter(F.transform(a, lambda x: classified(x)["reason"]), lambda r: r.isNotNull()), 0)
        return let(refused, lambda r: F.when(r.isNotNull(), out("BLOCKED_URL", F.concat(F.lit("an answer is not public: "), r), none)).otherwise(out(None, F.lit(None), a)))

    def judged(h: Column) -> Column:
        numbers = h.contains(":") | h.rlike(r"^[0-9]*(\.[0-9]*){3}$") & h.rlike("[0-9]")
        lookup = F.when(answers.isNull(), out("DNS_FAILURE", F.lit("lookup failed"), none)).when(F.size(answers) == 0, out("DNS_FAILURE", F.lit("no answer"), none))
        return F.when(numbers, literal(h)).otherwise(F.coalesce(lookup, named(answers)))

    return let(F.regexp_replace(F.coalesce(host, F.lit("")), r"^[\[\]]+|[\[\]]+$", ""), judged)


def connectable(answers: Column) -> Column:
    """Of the answers at the time of connecting, those that are public; null if none is."""
    kept = F.filter(F.coalesce(answers, F.array().cast("array<string>")), lambda x: F.coalesce(public(x), F.lit(False)))
    return let(kept, lambda k: F.when(F.size(k) > 0, k))
