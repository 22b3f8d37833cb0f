"""Page sources: stored pages, charset decoding, and the gates of a fetch."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits, allowed types, kept headers, labels that mean another encoding.
BODY_BYTES, SNIFFED = 5 * 1024 * 1024, 4096
HTML_TYPES = ("text/html", "application/xhtml+xml", "application/xml", "text/xml")
HEADERS = ("content-type", "content-length", "content-encoding", "cache-control", "x-robots-tag", "link", "server", "last-modified", "location", "vary")
ALIASES = {"iso-8859-1": "cp1252", "latin1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252", "iso8859-1": "cp1252", "windows-1252": "cp1252", "utf8": "utf-8", "shift-jis": "cp932", "shift_jis": "cp932", "gb2312": "gbk", "euc-kr": "cp949"}
_META = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.I)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def _codec(label: str | None) -> str | None:
    label = (label or "").strip().lower()
    try:
        return codecs.lookup(ALIASES.get(label, label)).name if label else None
    except LookupError:
        return None


def decode(body: bytes | None, content_type: str | None) -> str:
    """Text of a response: the header's charset, else the document's own, else UTF-8."""
    body = body or b""
    header = re.search(r"charset\s*=\s*[\"']?([A-Za-z0-9_:.-]+)", content_type or "", re.I)
    meta = _META.search(body[:2048])
    codec = _codec(header and header[1]) or _codec(meta and meta[1].decode("ascii", "replace")) or "utf-8"
    text = body.decode(codec, "replace")
    return text.removeprefix("﻿") if codec.startswith("utf") else text


def decoded(fetches: DataFrame) -> DataFrame:
    """fetches (body binary, content_type) with html."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def run(body: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([decode(b, k) for b, k in zip(body, kind)], dtype=object)

    return fetches.withColumn("html", run("body", "content_type"))


def kept_headers(headers: Column) -> Column:
    low = F.transform_keys(headers, lambda k, v: F.lower(k))
    return F.map_filter(low, lambda k, v: k.isin(*HEADERS))


def type_allowed(content_type: Column) -> Column:
    base = F.trim(F.lower(F.split_part(content_type, F.lit(";"), F.lit(1))))
    return content_type.isNull() | (base == "") | base.isin(*HTML_TYPES)


def looks_like_html(body: Column) -> Column:
    return F.substring(body, 1, SNIFFED).rlike(r"(?i)<html|<!doctype html|<head|<body")


def fetch_error(status: Column, body: Column, content_type: Column) -> Column:
    """Why a response cannot be audited; null if it can."""
    empty = F.trim(F.coalesce(body, F.lit(""))) == ""
    return (
        F.when(F.octet_length(body) > BODY_BYTES, "RESPONSE_TOO_LARGE")
        .when(~type_allowed(content_type), "UNSUPPORTED_CONTENT_TYPE")
        .when((status >= 400) & (empty | ~looks_like_html(body)), "HTTP_ERROR")
        .when(empty & ~looks_like_html(body), "UNSUPPORTED_CONTENT_TYPE")
    )
