"""robots.txt: parsing into groups, group selection, and verdicts for pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ip import let
from ..functions.text import SPACE_CHARS, trimmed
from ..functions.urls import is_web, path_of, query_of
from .responses import text_fetches
from .scoring import settled

AGENT = "siftlinebot"
# Directives that are known, and of these the ones without effect.
KNOWN = frozenset(("user-agent", "allow", "disallow", "sitemap", "crawl-delay", "host", "clean-param", "request-rate", "visit-time"))
NO_EFFECT = frozenset(("crawl-delay", "host", "clean-param", "request-rate", "visit-time"))


def parse(text: str | None) -> dict:
    """groups, sitemaps and whether something was not understood. A rule line ends a run of
    User-agent lines; other lines don't."""
    groups: list[dict] = []
    sitemaps: list[str] = []
    odd, naming = False, False
    for line in (text or "").replace("\r\n", "\n").split("\n"):
        name, colon, value = line.partition("#")[0].partition(":")
        name, value = name.strip(SPACE_CHARS).lower(), value.strip(SPACE_CHARS)
        if not colon:
            odd |= name != ""
        elif name not in KNOWN:
            odd = True
        elif name == "sitemap":
            sitemaps += [value] if value else []
        elif name == "user-agent":
            if not naming:
                groups.append({"user_agents": [], "allow": [], "disallow": []})
                naming = True
            groups[-1]["user_agents"] += [value.lower()] if value else []
        elif name not in NO_EFFECT:
            naming = False
            if groups:
                groups[-1][name].append(value)
            else:
                odd = True
    return {"groups": groups, "sitemaps": sitemaps, "has_unknown": odd}


def _line(text: Column) -> Column:
    """A line's directive in lower case, its value, and whether it has a colon."""
    return let(F.substring_index(text, "#", 1), lambda t: F.struct(F.lower(trimmed(F.substring_index(t, ":", 1))).alias("name"), trimmed(F.substring(t, F.locate(":", t) + 1, F.length(t))).alias("value"), t.contains(":").alias("colon")))


def _groups(lines: Column) -> Column:
    """The groups of lines that name agents or give rules: one for each run of agents and the rules after it."""
    is_agent = lambda x: x["name"] == "user-agent"
    # a group starts where an agent is named and none was just before
    first = lambda i: F.element_at(lines, i)
    places = F.when(F.size(lines) > 0, F.sequence(F.lit(1), F.size(lines))).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: is_agent(first(i)) & ((i == 1) | ~is_agent(first(F.greatest(i - 1, F.lit(1))))))

    def group(part: Column) -> Column:
        values = lambda name: F.transform(F.filter(part, lambda x: x["name"] == name), lambda x: x["value"])
        agents = F.transform(F.filter(values("user-agent"), lambda v: v != ""), F.lower)
        return F.struct(agents.alias("user_agents"), values("allow").alias("allow"), values("disallow").alias("disallow"))

    return let(starts, lambda at: F.transform(at, lambda s, k: let(F.slice(lines, s, F.coalesce(F.get(at, k + 1), F.size(lines) + 1) - s), group)))


def _parsed(lines: Column) -> Column:
    acting = F.filter(lines, lambda x: x["colon"] & x["name"].isin("user-agent", "allow", "disallow"))
    odd = F.exists(lines, lambda x: F.when(x["colon"], ~x["name"].isin(*sorted(KNOWN))).otherwise(x["name"] != ""))
    maps = F.transform(F.filter(lines, lambda x: x["colon"] & (x["name"] == "sitemap") & (x["value"] != "")), lambda x: x["value"])
    # a rule before any agent belongs to no group
    return let(acting, lambda a: F.struct(_groups(a).alias("groups"), maps.alias("sitemaps"), (odd | F.coalesce(F.get(a, 0)["name"] != "user-agent", F.lit(False))).alias("has_unknown")))


def parsed(docs: DataFrame, text: str = "body") -> DataFrame:
    """docs with groups, sitemaps and has_unknown, as parse() reads them."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n", "\n"), "\n"), _line)
    return settled(docs, _p=let(lines, _parsed)).select("*", "_p.*").drop("_p")


def group_for(groups: Column, agent: str = AGENT) -> Column:
    """The group of the longest agent name that the token contains (first of equals), else the first *."""
    token = F.lit(agent.lower())
    best = lambda g: F.array_max(F.transform(F.filter(g["user_agents"], lambda a: (a != "*") & token.contains(a)), F.length))
    longest = F.array_max(F.transform(groups, best))
    named = F.get(F.filter(groups, lambda g: best(g) == longest), 0)
    star = F.get(F.filter(groups, lambda g: F.array_contains(g["user_agents"], "*")), 0)
    return F.when(longest.isNotNull(), named).otherwise(star)


def pattern(rule: Column) -> Column:
    """A rule as a regular expression: * matches anything, a last $ ends."""
    body = F.regexp_replace(rule, r"\$$", "")
    literal = F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(literal, F.lit("*"), F.lit(".*")), F.when(rule.endswith("$"), "$").otherwise(""))


def evaluate(group: Column, path: Column) -> Column:
    """struct<verdict, matched_rule, used_wildcard> of one path and a group's few rules, in the row; what
    matches() finds for many. The longest rule wins, Allow at a tie."""

    def hits(kind: str) -> Column:
        return F.filter(F.coalesce(group[kind], F.array().cast("array<string>")), lambda r: (r != "") & F.regexp_like(path, pattern(r)))

    def longest(rules: Column) -> Column:
        size = F.array_max(F.transform(rules, F.length))
        return F.get(F.filter(rules, lambda r: F.length(r) == size), 0)

    allow, deny = longest(hits("allow")), longest(hits("disallow"))
    wild = F.exists(F.concat(hits("allow"), hits("disallow")), lambda r: r.contains("*") | r.endswith("$"))
    out = lambda v, rule: F.struct(F.lit(v).alias("verdict"), rule.cast("string").alias("matched_rule"), wild.alias("used_wildcard"))
    return F.when(deny.isNull(), out("allowed", allow)).when(F.length(allow) >= F.length(deny), out("allowed", F.concat(F.lit("Allow: "), allow))).otherwise(out("disallowed", F.concat(F.lit("Disallow: "), deny)))


READ_BYTES = 512 * 1024


def documents(fetches: DataFrame) -> DataFrame:
    """Fetches of robots.txt files (origin, url, status, body, and error where there was no answer) as
    verdicts() takes them: read like other texts, READ_BYTES at most. 404 and 410 mean that nothing is
    forbidden; a page of HTML is no such file."""
    got = text_fetches(fetches.withColumnRenamed("error", "thrown"), READ_BYTES)
    none = F.coalesce(F.col("status").isin(404, 410), F.lit(False))
    page = F.col("text").rlike(r"^[\s\x{FEFF}]*<(?i:!doctype|html)")
    why = F.when(none, None).otherwise(F.coalesce("thrown", "error", F.when(~F.coalesce("ok", F.lit(False)), "HTTP_ERROR"), F.when(page, "HTML")))
    return got.select("origin", why.isNull().alias("retrieved"), "url", "status", why.alias("error"), F.when(why.isNull() & ~none, F.col("text")).alias("body"))


def literal(rule: Column) -> Column:
    """What a path must begin with for the rule to match: the rule up to its first * or last $."""
    return F.substring_index(F.regexp_replace(rule, r"\$$", ""), "*", 1)


def wild(rule: Column) -> Column:
    return rule.contains("*") | rule.endswith("$")


def matches(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct paths (origin, path) and rules (origin, kind, ordinal, rule) to verdict, matched_rule and
    used_wildcard of each path that some rule matches.

    A rule can only match a path that begins with its literal part, so paths meet rules by that in an
    equi-join, at the lengths that the origin's rules have; regular expressions are tried on what
    meets and has a wildcard. The longest rule wins, of several the first, Allow at a tie.
    """
    rules = rules.filter("rule <> ''").withColumn("prefix", literal(F.col("rule")))
    # the lengths of literal parts are few, whatever the number of rules
    lengths = rules.groupBy(F.col("origin").alias("_o")).agg(F.collect_set(F.length("prefix")).alias("_lengths"))
    begun = paths.join(lengths, F.col("origin") == F.col("_o")).select("origin", "path", F.explode(F.filter("_lengths", lambda n: n <= F.length("path"))).alias("_n"))
    begun = begun.select("origin", "path", F.substring("path", F.lit(1), F.col("_n")).alias("prefix"))
    met = begun.join(rules, ["origin", "prefix"]).filter(~wild(F.col("rule")) | F.regexp_like("path", pattern(F.col("rule"))))
    rank = F.struct(F.length("rule").alias("size"), (-F.col("ordinal")).alias("first"), F.col("rule"))
    best = met.groupBy("origin", "path").agg(F.max(F.when(F.col("kind") == "allow", rank)).alias("a"), F.max(F.when(F.col("kind") == "disallow", rank)).alias("d"), F.bool_or(wild(F.col("rule"))).alias("used_wildcard"))
    free, tie = F.col("d").isNull(), F.coalesce(F.col("a.size") >= F.col("d.size"), F.lit(False))
    rule = F.when(free, F.col("a.rule")).when(tie, F.concat(F.lit("Allow: "), "a.rule")).otherwise(F.concat(F.lit("Disallow: "), "d.rule"))
    return best.select("origin", "path", F.when(free | tie, "allowed").otherwise("disallowed").alias("verdict"), rule.alias("matched_rule"), "used_wildcard")


def rules_of(docs: DataFrame, agent: str = AGENT) -> DataFrame:
    """Parsed docs (origin, groups) to the rules of the group that holds for the agent."""
    group = group_for(F.col("groups"), agent)
    each = lambda kind: F.transform(F.coalesce(group[kind], F.array().cast("array<string>")), lambda r, i: F.struct(F.lit(kind).alias("kind"), i.alias("ordinal"), r.alias("rule")))
    return docs.select("origin", F.inline(F.concat(each("allow"), each("disallow"))))


def verdicts(pages: DataFrame, docs: DataFrame, agent: str = AGENT) -> DataFrame:
    """pages (page_id, url) against docs (origin, retrieved, url, status, error, body), joined by origin:
    page_id and the fields of the audit's robots column. Each distinct path is judged once."""
    from .audit import origin

    read = parsed(docs.withColumnRenamed("url", "robots_url"))
    own = pages.select("page_id", "url", origin(F.col("url")).alias("_o"), F.concat(path_of(F.col("url")), query_of(F.col("url"))).alias("_path"))
    paths = own.filter(F.col("_o").isNotNull() & F.col("_path").isNotNull()).select(F.col("_o").alias("origin"), F.col("_path").alias("path")).distinct()
    judged = matches(paths, rules_of(read, agent)).select(F.col("origin").alias("_vo"), F.col("path").alias("_vp"), "verdict", F.col("matched_rule").alias("_rule"), "used_wildcard")
    df = own.join(read.select("origin", "retrieved", "robots_url", "status", "error", "sitemaps", "has_unknown"), F.col("_o") == F.col("origin"), "left")
    df = df.join(judged, (F.col("_o") == F.col("_vo")) & (F.col("_path") == F.col("_vp")), "left")
    got = F.coalesce("retrieved", F.lit(False))
    said = F.coalesce("verdict", F.lit("allowed"))
    unsure = (said == "disallowed") & (F.col("used_wildcard") | F.col("has_unknown"))
    verdict = F.when(~got | ~is_web(F.col("url")), "unknown").when(F.col("status").isin(404, 410), "allowed").when(unsure, "unknown").otherwise(said)
    rule = F.when(got & ~F.coalesce(F.col("status"), F.lit(0)).isin(404, 410), F.col("_rule"))
    return df.select("page_id", got.alias("retrieved"), F.coalesce("robots_url", F.concat("_o", F.lit("/robots.txt"))).alias("url"), "status", "error", "sitemaps", verdict.alias("path_verdict"), rule.alias("matched_rule"))
