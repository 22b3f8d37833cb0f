"""What a failed fetch is called, what its audit answers, and what may be logged about it."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.pages import fetch_error, looks_like_html

# HTTP status of an answer by error code.
STATUS_BY_CODE = {
    "INVALID_URL": 400, "BLOCKED_URL": 400, "UNSUPPORTED_CONTENT_TYPE": 422, "DNS_FAILURE": 502, "CONNECTION_FAILED": 502, "HTTP_ERROR": 502,
    "REDIRECT_LOOP": 502, "TOO_MANY_REDIRECTS": 502, "RESPONSE_TOO_LARGE": 413, "TIMEOUT": 504, "UNKNOWN": 500,
}
# Network errors by the code they become; all others are failed connections.
NETWORK = {
    "BLOCKED_URL": ("ERR_BLOCKED_ADDRESS",),
    "TIMEOUT": ("ETIMEDOUT", "UND_ERR_HEADERS_TIMEOUT", "UND_ERR_BODY_TIMEOUT", "UND_ERR_CONNECT_TIMEOUT"),
    "DNS_FAILURE": ("ENOTFOUND", "EAI_AGAIN", "ERR_INVALID_URL"),
}
# Keys whose values are never logged, deepest level and longest list that are.
SECRET_KEYS = ("authorization", "cookie", "set-cookie", "password", "token", "apikey", "api_key", "secret", "x-api-key", "proxy-authorization")
DEEPEST, LONGEST = 4, 20
TEXT_BYTES = 1024 * 1024


def http_status(code: Column) -> Column:
    """Status of the answer to a failed audit; 500 for codes that are not known, null for no code."""
    known = F.create_map(*[F.lit(x) for pair in STATUS_BY_CODE.items() for x in pair])
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(known, code), F.lit(500)))


def network_error(name: Column, code: Column) -> Column:
    """Error code of an exception with this name and this system code, either of them null."""
    named = F.when(name == "BlockedAddressError", "BLOCKED_URL").when((name == "AbortError") & ~F.coalesce(code.isin(*NETWORK["BLOCKED_URL"]), F.lit(False)), "TIMEOUT")
    by_code = [F.when(code.isin(*codes), F.lit(goal)) for goal, codes in NETWORK.items()]
    return F.coalesce(named, *by_code, F.lit("CONNECTION_FAILED"))


def described(error: BaseException | object) -> dict[str, str]:
    """Name, message and code of an exception, without its trace."""
    if not isinstance(error, BaseException):
        return {"name": "UnknownError", "message": str(error)}
    code = getattr(error, "code", None) or getattr(error, "getCondition", lambda: None)()
    return {"name": type(error).__name__, "message": str(error)} | ({"code": str(code)} if code else {})


def text_fetches(fetches: DataFrame, most: int = TEXT_BYTES) -> DataFrame:
    """Fetches of robots.txt and sitemaps (url, status, body), with ok, text and error.

    Only 2xx is ok; other answers keep their text if there is a page in it. Any content type
    will do. Texts of more bytes than most (sitemap.READ_BYTES, robots.READ_BYTES), empty ones and
    errors without a page have no text.
    """
    status, body = F.col("status"), F.col("body")
    empty = F.trim(F.coalesce(body, F.lit(""))) == ""
    error = F.when(F.octet_length(body) > most, "RESPONSE_TOO_LARGE").when((status >= 400) & (empty | ~looks_like_html(body)), "HTTP_ERROR").when(empty, "UNSUPPORTED_CONTENT_TYPE")
    return fetches.withColumn("error", error).withColumn("ok", F.col("error").isNull() & status.between(200, 299)).withColumn("text", F.when(F.col("error").isNull(), body))


def failures(fetches: DataFrame) -> DataFrame:
    """Fetches that cannot be audited, as sources.store.failed takes them, with the answer's status.

    fetches: page_id, url, status, body, content_type, error_name, error_system; the last two
    are of the exception where there was no answer.
    """
    gate = fetch_error(F.col("status"), F.col("body"), F.col("content_type"))
    thrown = F.when(F.col("error_name").isNotNull() | F.col("error_system").isNotNull(), network_error(F.col("error_name"), F.col("error_system")))
    rows = fetches.withColumn("error_code", F.coalesce(thrown, gate)).filter("error_code IS NOT NULL")
    return rows.select("page_id", "url", "error_code", F.concat(F.lit("The page could not be audited: "), F.lower(F.translate("error_code", "_", " ")), F.lit(".")).alias("error_message"), http_status(F.col("error_code")).alias("http_status"))


def auditable(fetches: DataFrame) -> DataFrame:
    """(page_id, url, html) of the fetches that failures() leaves."""
    gate = fetch_error(F.col("status"), F.col("body"), F.col("content_type"))
    return fetches.filter(F.col("error_name").isNull() & F.col("error_system").isNull() & gate.isNull()).select("page_id", "url", F.col("body").alias("html"))


def redact(value, depth: int = 0):
    """A JSON value that may be logged: secrets hidden, deep parts and the ends of long lists left out."""
    if depth > DEEPEST:
        return "[truncated]"
    if isinstance(value, list):
        return [redact(x, depth + 1) for x in value[:LONGEST]]
    if isinstance(value, dict):
        return {k: "[redacted]" if k.lower() in SECRET_KEYS else redact(x, depth + 1) for k, x in value.items()}
    return value


@F.pandas_udf(StringType())
def redact_json(context: pd.Series) -> pd.Series:
    """redact() of a JSON text; null where it is none. Its levels vary by row, so no schema could tell Spark."""

    def one(text):
        try:
            return json.dumps(redact(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return context.map(one)
