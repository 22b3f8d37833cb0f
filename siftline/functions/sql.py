"""SQL names for the engine's functions: register(spark), then call them in spark.sql()."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .html import facts
from .text import SPACE
from .ip import PREFIXES6, REFUSED6, expand_ipv6, ranges
from .urls import BLOCKED_HOSTNAMES, BLOCKED_TLDS, LONGEST_URL, PORTS, TWO_PART_SUFFIXES



def _listed(values) -> str:
    return ", ".join(f"'{x}'" for x in values)


def _within(prefix: str, bits: int) -> str:
    """Whether the groups g begin with a prefix."""
    tests = []
    for i, own in enumerate(expand_ipv6(prefix)):
        free = max(0, min(16, 16 * (i + 1) - bits))  # bits of this group that don't count
        if free < 16:
            tests.append(f"shiftright(g[{i}], {free}) = {own >> free}" if free else f"g[{i}] = {own}")
    return " AND ".join(tests)


def _public6() -> str:
    cases = []
    for prefix, bits, why, place in PREFIXES6:  # longest first
        inner = f"ipv4_public(shiftleft(g[{place}], 16) | g[{place} + 1])"
        cases.append(f"WHEN {_within(prefix, bits)} THEN {'false' if place is None or why in REFUSED6 else inner}")
    return "CASE WHEN g IS NULL THEN false " + " ".join(cases) + " ELSE true END"


#: A part x of an odd IPv4 host, decimal, octal or hex; null if it is none, too large a number if it has too many
#: digits. Functions cannot be called with what a lambda names, so this is text.
_ODD_PART = "CASE WHEN x RLIKE '^0[xX]0*[0-9a-fA-F]{1,12}$' THEN CAST(conv(substring(x, 3), 16, 10) AS BIGINT) WHEN x RLIKE '^0[xX]$' THEN 0 WHEN x RLIKE '^0+[0-7]{0,12}$' THEN CAST(conv(x, 8, 10) AS BIGINT) WHEN x RLIKE '^[1-9][0-9]{0,11}$' THEN CAST(x AS BIGINT) WHEN x RLIKE '^(0[xX][0-9a-fA-F]+|0[0-7]+|[1-9][0-9]*)$' THEN 1099511627776 END"
_SUFFIXES = ", ".join(f"'{x}'" for x in TWO_PART_SUFFIXES)
# What SQL can say itself stays SQL, so that Catalyst sees through it. Later ones may use earlier ones.
FUNCTIONS = {
    "trimmed_text": ("t STRING", "STRING", "coalesce(regexp_replace(t, '" + f"^{SPACE}+|{SPACE}+$".replace("\\", "\\\\") + "', ''), '')"),
    "strip_www": ("h STRING", "STRING", r"regexp_replace(lower(h), '^www[.]', '')"),
    "is_ipv4": ("h STRING", "BOOLEAN", r"coalesce(h RLIKE '^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])[.]){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$', false)"),
    "severity_deduction": ("s STRING", "DOUBLE", "CASE s WHEN 'CRITICAL' THEN 1.0D WHEN 'HIGH' THEN 0.7D WHEN 'MEDIUM' THEN 0.4D WHEN 'LOW' THEN 0.15D ELSE 0.0D END"),
    "earned_fraction": ("status STRING, severity STRING", "DOUBLE", "CASE WHEN status = 'UNAVAILABLE' THEN NULL WHEN status IN ('WARNING', 'ERROR') THEN 1.0D - CASE severity WHEN 'CRITICAL' THEN 1.0D WHEN 'HIGH' THEN 0.7D WHEN 'MEDIUM' THEN 0.4D WHEN 'LOW' THEN 0.15D ELSE 0.0D END ELSE 1.0D END"),
    "band_for": ("total INT", "STRING", "CASE WHEN total >= 90 THEN 'excellent' WHEN total >= 75 THEN 'good' WHEN total >= 50 THEN 'needs-improvement' ELSE 'significant-issues' END"),
    "url_host": ("u STRING", "STRING", r"lower(regexp_extract(regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '^(\\[[^\\]]*\\]|[^:]*)', 1))"),
    "url_path": ("u STRING", "STRING", r"coalesce(nullif(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), CASE WHEN u IS NOT NULL THEN '/' END)"),
    "url_query": ("u STRING", "STRING", r"CASE regexp_extract(u, '^[^?#]*([?][^#]*)', 1) WHEN '?' THEN '' ELSE regexp_extract(u, '^[^?#]*([?][^#]*)', 1) END"),
    "registrable_domain": ("h STRING", "STRING", rf"CASE WHEN size(split(regexp_replace(lower(h), '[.]$', ''), '[.]')) <= 2 THEN regexp_replace(lower(h), '[.]$', '') WHEN substring_index(regexp_replace(lower(h), '[.]$', ''), '.', -2) IN ({_SUFFIXES}) THEN substring_index(regexp_replace(lower(h), '[.]$', ''), '.', -3) ELSE substring_index(regexp_replace(lower(h), '[.]$', ''), '.', -2) END"),
    "canonical_key": ("u STRING", "STRING", r"CASE WHEN u RLIKE '^[Hh][Tt][Tt][Pp][Ss]?://[^/?#]' AND url_host(u) <> '' THEN concat(strip_www(url_host(u)), CASE WHEN length(url_path(u)) > 1 THEN regexp_replace(url_path(u), '/+$', '') ELSE '/' END, url_query(u)) END"),
    "url_port": ("u STRING", "STRING", r"regexp_extract(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ':([0-9]+)$', 1)"),
    "ipv4_number": ("h STRING", "BIGINT", "aggregate(split(h, '[.]'), 0L, (a, x) -> a * 256 + coalesce(try_cast(x AS BIGINT), 0L))"),
    "ipv4_public": ("n BIGINT", "BOOLEAN", "n IS NOT NULL AND NOT (" + " OR ".join(f"n BETWEEN {a} AND {b}" for a, b, _ in ranges()) + ")"),
    # an address without its zone, an IPv4 address at its end as two groups; null if what has dots there is none
    "ipv6_plain": ("h STRING", "STRING", "CASE WHEN substring_index(h, ':', -1) NOT LIKE '%.%' THEN h WHEN is_ipv4(substring_index(h, ':', -1)) THEN concat(left(h, length(h) - length(substring_index(h, ':', -1))), lower(hex(shiftright(ipv4_number(substring_index(h, ':', -1)), 16))), ':', lower(hex(ipv4_number(substring_index(h, ':', -1)) & 65535))) END"),
    "ipv6_filled": ("a ARRAY<STRING>, b ARRAY<STRING>, gap BOOLEAN", "ARRAY<STRING>", "CASE WHEN gap AND size(a) + size(b) <= 7 OR NOT gap AND size(a) = 8 THEN concat(a, array_repeat('0', 8 - size(a) - size(b)), b) END"),
    "ipv6_split": ("h STRING", "ARRAY<STRING>", "CASE WHEN h NOT LIKE '%:::%' AND size(split(h, '::')) <= 2 THEN ipv6_filled(CASE WHEN split(h, '::')[0] = '' THEN cast(array() AS ARRAY<STRING>) ELSE split(split(h, '::')[0], ':') END, CASE WHEN coalesce(get(split(h, '::'), 1), '') = '' THEN cast(array() AS ARRAY<STRING>) ELSE split(split(h, '::')[1], ':') END, h LIKE '%::%') END"),
    "ipv6_groups": ("p ARRAY<STRING>", "ARRAY<BIGINT>", "CASE WHEN forall(p, x -> x RLIKE '^[0-9a-fA-F]{1,4}$') THEN transform(p, x -> CAST(conv(x, 16, 10) AS BIGINT)) END"),
    "ipv6_public": ("g ARRAY<BIGINT>", "BOOLEAN", _public6()),
    "address_public": ("h STRING", "BOOLEAN", "CASE WHEN is_ipv4(h) THEN ipv4_public(ipv4_number(h)) WHEN h LIKE '%:%' THEN ipv6_public(ipv6_groups(ipv6_split(ipv6_plain(substring_index(h, '%', 1))))) ELSE false END"),
    "odd_total": ("n ARRAY<BIGINT>", "BIGINT", "CASE WHEN size(n) <= 4 AND forall(n, x -> x IS NOT NULL) AND forall(slice(n, 1, size(n) - 1), x -> x <= 255) AND element_at(n, -1) < shiftleft(1L, 8 * (5 - size(n))) THEN aggregate(slice(n, 1, size(n) - 1), 0L, (a, x) -> a * 256 + x) * shiftleft(1L, 8 * (5 - size(n))) + element_at(n, -1) END"),
    "odd_ipv4_public": ("h STRING", "BOOLEAN", "ipv4_public(odd_total(transform(split(regexp_replace(h, '[.]+$', ''), '[.]'), x -> " + _ODD_PART + ")))"),
    # the URL of what someone typed
    "typed_url": ("t STRING", "STRING", "CASE WHEN t RLIKE '^[a-zA-Z][a-zA-Z0-9+.-]*://' OR t RLIKE '^[a-zA-Z][a-zA-Z0-9+-]*:' THEN t ELSE concat('https://', t) END"),
    "guard_host": ("h STRING", "STRING", f"CASE WHEN h IN ({_listed(BLOCKED_HOSTNAMES)}) THEN 'BLOCKED_URL' WHEN h LIKE '%:%' OR is_ipv4(h) THEN CASE WHEN NOT address_public(h) THEN 'BLOCKED_URL' END WHEN h RLIKE '(^|[.])(0[xX][0-9a-fA-F]*|[0-9]+)[.]?$' THEN CASE WHEN NOT odd_ipv4_public(h) THEN 'BLOCKED_URL' END WHEN h NOT LIKE '%.%' OR substring_index(regexp_replace(h, '[.]+$', ''), '.', -1) IN ({_listed(BLOCKED_TLDS)}) THEN 'BLOCKED_URL' END"),
    # why a URL as typed may not be fetched; null if it may
    "url_guard": ("typed STRING", "STRING", rf"CASE WHEN trimmed_text(typed) = '' THEN 'INVALID_URL' WHEN length(trimmed_text(typed)) > {LONGEST_URL} OR trimmed_text(typed) RLIKE '[\\x00-\\x20\\x7f]' THEN 'INVALID_URL' WHEN lower(regexp_extract(typed_url(trimmed_text(typed)), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) NOT IN ('http', 'https') THEN 'BLOCKED_URL' WHEN typed_url(trimmed_text(typed)) NOT RLIKE '^[Hh][Tt][Tt][Pp][Ss]?://[^/?#]' OR url_host(typed_url(trimmed_text(typed))) = '' OR regexp_replace(url_host(typed_url(trimmed_text(typed))), '^\\[|\\]$', '') RLIKE '[\\x00-\\x20#%<>?@\\\\^`{{|}}]' THEN 'INVALID_URL' WHEN regexp_extract(typed_url(trimmed_text(typed)), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) LIKE '%@%' OR url_port(typed_url(trimmed_text(typed))) <> '' AND coalesce(try_cast(url_port(typed_url(trimmed_text(typed))) AS INT), -1) NOT IN ({', '.join(map(str, PORTS))}) THEN 'BLOCKED_URL' ELSE guard_host(regexp_replace(url_host(typed_url(trimmed_text(typed))), '^\\[|\\]$', '')) END"),
    "looks_like_url": ("v STRING", "BOOLEAN", r"coalesce(trim(v) RLIKE '^([hH][tT][tT][pP][sS]?://)?([^\\s/?#@:]*[.][^\\s/?#@:]*)(:[0-9]*)?([/?#]\\S*)?$', false)"),
}


@udtf(returnType="user_agent string, directive string, path string")
class RobotsRules:
    """Rules of a robots.txt, one row each."""

    def eval(self, text: str):
        from ..operators.robots import parse

        for group in parse(text)["groups"]:
            for agent in group["user_agents"]:
                for directive in ("allow", "disallow"):
                    for path in group[directive]:
                        yield agent, directive, path


@udtf(returnType="ordinal int, href string, resolved string, kind string, anchor_text string")
class HtmlLinks:
    """Links of a document, one row each."""

    def eval(self, html: str, url: str):
        for i, x in enumerate(facts(html, url)["links"]):
            yield i, x["href"], x["resolved"], x["kind"], x["anchor_text"]


def register(spark: SparkSession) -> None:
    for name, (args, out, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {out} RETURN {body}")
    spark.udtf.register("robots_rules", RobotsRules)
    spark.udtf.register("html_links", HtmlLinks)
