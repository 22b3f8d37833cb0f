"""Facts of an HTML document.

One pass over the markup with a small tree builder: it keeps the stack of open elements with the
implied end tags of HTML5, so that texts, ancestors and counts are those of a browser's tree for the
elements that matter here (p, headings, a, li, title, head, body and raw-text elements). The result
is one row of nested values, made by an Arrow UDF that runs once per page.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Callable, Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .text import SPACE_CHARS
from .urls import Url, parse_url, registrable

# Elements whose text nobody reads, void elements, and elements that end a paragraph.
HIDDEN = frozenset("script style noscript template svg iframe head object embed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset(("title", "textarea"))
HEAD_ONLY = frozenset("base basefont bgsound link meta title script style noscript template noframes".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
JSON_LIMIT = 2_000_000

_TAG = re.compile(r"<!--(?:>|->)?.*?(?:--!?>|\Z)|<(?:!|\?)[^>]*>?|</([A-Za-z][^\s/>]*)[^>]*>?|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)>?", re.S)
_ATTR = re.compile(r"([^\s/>=\"'][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?", re.S)
_WORDLIKE = re.compile(r"[^\W_]")
_SPACES = re.compile(f"[{SPACE_CHARS}]+")
_CHARSET = re.compile(r"charset=([a-z0-9_:.-]+)", re.I)
_DOCTYPE = re.compile(rf"^[{SPACE_CHARS}]*<!doctype[{SPACE_CHARS}]+html", re.I)

_S, _I, _B, _L, _D = T.StringType(), T.IntegerType(), T.BooleanType(), T.LongType(), T.DoubleType()


def _struct(**kinds) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_PAIRS = T.ArrayType(_struct(key=_S, value=_S))
FACTS = _struct(
    titles=T.ArrayType(_S), meta_descriptions=T.ArrayType(_S), meta_robots=_S, meta_googlebot=_S, canonicals=T.ArrayType(_struct(href=_S, resolved=_S)), html_lang=_S, charset=_S, viewport=_S,
    favicons=T.ArrayType(_struct(rel=_S, href=_S)), headings=T.ArrayType(_struct(level=_I, text=_S, is_empty=_B)),
    images=T.ArrayType(_struct(src=_S, alt=_S, width=_S, height=_S, loading=_S, is_linked=_B)),
    links=T.ArrayType(_struct(href=_S, resolved=_S, host=_S, kind=_S, anchor_text=_S, rel=T.ArrayType(_S), target=_S)),
    open_graph=_PAIRS, twitter=_PAIRS, json_ld=T.ArrayType(_struct(valid=_B, types=T.ArrayType(_S), size=_I)), microdata_types=T.ArrayType(_S), rdfa_types=T.ArrayType(_S),
    hreflang=T.ArrayType(_struct(lang=_S, href=_S)), word_count=_I, character_count=_I, paragraph_count=_I, html_units=_I, excerpt=_S, html_bytes=_L, has_doctype=_B, meta_refresh=_S,
)


def collapse(s: str) -> str:
    return _SPACES.sub(" ", s).strip(" ")


def units(s: str) -> int:
    return len(s) + sum(c > "￿" for c in s) if not s.isascii() else len(s)


def json_types(value: object) -> list[str]:
    """Every @type, outermost first, each once."""
    found: dict[str, None] = {}
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            kinds = v.get("@type")
            for k in kinds if isinstance(kinds, list) else [kinds]:
                if isinstance(k, str):
                    found.setdefault(k)
            todo += reversed(list(v.values()))
        elif isinstance(v, list):
            todo += reversed(v)
    return list(found)


def _strict(name: str) -> object:
    raise ValueError(name)


_TERMINATED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _terminated(s: str) -> str:
    """s with its references decoded that end with a semicolon; browsers also decode some that don't (&amp without one)."""
    known = lambda m: entities.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0]
    return _TERMINATED.sub(known, s)


class _Tree:
    """What of the tree is asked for, gathered while the tags go by."""

    def __init__(self) -> None:
        self.open: list[str] = []
        self.collecting: list[tuple[str, list[str]]] = []  # open elements whose text is wanted
        self.body: list[str] = []
        self.everything: list[str] = []
        self.in_body = self.seen_head = False
        self.hidden = 0
        self.titles: list[str] = []
        self.paragraphs = 0
        self.headings: list[dict] = []
        self.links: list[dict] = []
        self.images: list[dict] = []
        self.scripts: list[str] = []
        self.meta: list[dict[str, str]] = []
        self.link_tags: list[dict[str, str]] = []
        self.types: list[str] = []
        self.rdfa: list[str] = []
        self.base: str | None = None
        self.lang: str | None = None

    def text(self, s: str, visible: bool = True) -> None:
        for _, parts in self.collecting:
            if parts is not None:
                parts.append(s)
        if visible and not self.hidden:
            self.everything.append(s)
            if self.in_body:
                self.body.append(s)

    def pop(self, name: str) -> None:
        """Close the innermost open name and all inside it."""
        if name in self.open:
            while True:
                last = self.open.pop()
                self._closed(last)
                if last == name:
                    break

    def _closed(self, name: str) -> None:
        if name in HIDDEN:
            self.hidden -= 1
        for i in range(len(self.collecting) - 1, -1, -1):
            if self.collecting[i][0] == name:
                parts = self.collecting.pop(i)[1]
                self._collected(name, "".join(parts))
                break

    def _collected(self, name: str, text: str) -> None:
        if name == "p":
            self.paragraphs += collapse(text) != ""
        elif name == "a":
            link = next(x for x in reversed(self.links) if "text" not in x)
            link["text"] = collapse(text)
        elif name in HEADINGS:
            heading = next(x for x in reversed(self.headings) if x["text"] is None and x["level"] == int(name[1]))
            heading["text"] = collapse(text)

    def start(self, name: str, attrs: dict[str, str], closed: bool) -> None:
        if name in ("html", "head", "body"):
            if name == "html" and self.lang is None:
                self.lang = attrs.get("lang")
            if name == "body":
                self.pop("head")
                self.in_body = True
            elif name == "head" and not self.in_body and not self.seen_head:
                self.seen_head = True
                self.open.append(name)
                self.hidden += 1
            return self._noted(attrs)
        if name not in HEAD_ONLY and not self.in_body and "svg" not in self.open and "template" not in self.open:
            self.pop("head")
            self.in_body = True
        if name in ENDS_P and "p" in self.open:
            self.pop("p")
        if name in HEADINGS and self.open and self.open[-1] in HEADINGS:
            self.pop(self.open[-1])
        if name in ("li", "option", "tr", "td", "th", "a", "button") and name in self.open:
            within = {"li": ("ul", "ol"), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}.get(name, ())
            if not any(w in self.open[self.open.index(name) if name == "a" else len(self.open) - 1 - self.open[::-1].index(name) :] for w in within):
                self.pop(name)
        if name in ("dd", "dt"):
            for other in ("dd", "dt"):
                if self.open and self.open[-1] == other:
                    self.pop(other)
        self._noted(attrs)
        if name == "meta":
            self.meta.append(attrs)
        elif name == "link":
            self.link_tags.append(attrs)
        elif name == "base" and self.base is None and "href" in attrs:
            self.base = attrs["href"]
        elif name == "img":
            self.images.append(attrs | {"": "a" in self.open})
            for x in self.links:
                if "text" not in x and "alt" in attrs:
                    x.setdefault("alt", attrs["alt"])
        if name in VOID or (closed and "svg" in self.open):
            return
        self.open.append(name)
        self.hidden += name in HIDDEN
        if name == "a":
            if "href" in attrs:
                self.links.append(dict(href=attrs["href"], rel=attrs.get("rel", ""), target=attrs.get("target")))
                self.collecting.append(("a", []))
        elif name in HEADINGS:
            self.headings.append({"level": int(name[1]), "text": None})
            self.collecting.append((name, []))
        elif name == "p" and not self.hidden:
            self.collecting.append(("p", []))

    def _noted(self, attrs: dict[str, str]) -> None:
        if "itemtype" in attrs:
            last = [x for x in attrs["itemtype"].split("/") if x][-1:]
            self.types += last
        if attrs.get("typeof", "").strip(SPACE_CHARS):
            self.rdfa.append(attrs["typeof"].strip(SPACE_CHARS))

    def end(self, name: str) -> None:
        if name == "p" and "p" not in self.open:
            return  # an empty paragraph
        if name in HEADINGS and name not in self.open:
            name = next((x for x in reversed(self.open) if x in HEADINGS), name)
        if name == "head":
            self.pop(name)
        elif name not in ("html", "body"):
            self.pop(name)


def _walk(markup: str, unescape: Callable[[str], str] = entities.unescape) -> _Tree:
    tree, at, n = _Tree(), 0, len(markup)
    while at < n:
        m = _TAG.search(markup, at)
        upto = m.start() if m else n
        if upto > at:
            s = unescape(markup[at:upto])
            if not tree.in_body and s.strip(SPACE_CHARS) and not tree.hidden - ("head" in tree.open):
                tree.pop("head")
                tree.in_body = True
            tree.text(s)
        if not m:
            break
        at = m.end()
        if m[1]:
            tree.end(m[1].lower())
        elif m[2]:
            name = m[2].lower()
            attrs: dict[str, str] = {}
            for a in _ATTR.finditer(m[3]):
                attrs.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
            svg = "svg" in tree.open
            tree.start(name, attrs, m[3].endswith("/"))
            if (name in RAW or name in RCDATA) and not svg:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(markup, at)
                inner = markup[at : close.start() if close else n]
                at = close.end() if close else n
                if name in RCDATA:
                    inner = unescape(inner)
                if name == "title":
                    tree.titles.append(collapse(inner))
                if name == "script" and attrs.get("type", "").strip().lower() == "application/ld+json":
                    tree.scripts.append(inner)
                tree.text(inner, visible=name not in HIDDEN)
                tree.pop(name)
    while tree.open:
        tree.pop(tree.open[-1])
    return tree


def _json_block(raw: str) -> dict:
    s = raw.strip(SPACE_CHARS)
    out = {"valid": False, "types": [], "size": units(s)}
    if s and len(s) <= JSON_LIMIT:
        try:
            out["types"] = json_types(json.loads(s, parse_constant=_strict))
            out["valid"] = True
        except (ValueError, RecursionError):
            pass
    return out


def _link(x: dict, base: Url) -> dict:
    href = x["href"]
    t = href.strip(SPACE_CHARS)
    url = parse_url(href, base) if t and not t.startswith("#") else None
    low = t.lower()
    if not t:
        kind = "empty"
    elif t.startswith("#"):
        kind = "fragment"
    elif low.startswith("mailto:"):
        kind = "mailto"
    elif low.startswith(("tel:", "sms:", "callto:")):
        kind = "tel"
    elif low.startswith("javascript:"):
        kind = "javascript"
    elif url is None or url.scheme not in ("http", "https"):
        kind = "other"
    else:
        kind = "internal" if registrable(url.host) == registrable(base.host) else "external"
    text = x.get("text") or collapse(x.get("alt", ""))
    return {"href": href, "resolved": url and url.href, "host": url and url.host, "kind": kind, "anchor_text": text, "rel": [r for r in _SPACES.split(x["rel"].lower()) if r], "target": x["target"]}


def facts(markup: str | None, url: str | None, terminated: bool = False) -> dict:
    """The facts of one document; url is its own address. terminated: only references that end with a semicolon are decoded."""
    markup = markup or ""
    t = _walk(markup, _terminated if terminated else entities.unescape)
    own = parse_url(url or "") or parse_url("https://example.invalid/")
    base = (parse_url(t.base, own) if t.base else None) or own
    by_name: dict[str, str] = {}
    by_property: dict[str, str] = {}
    for a in t.meta:
        if "content" in a:
            for source, into in (("name", by_name), ("property", by_property), ("itemprop", by_name)):
                if a.get(source):
                    into.setdefault(a[source].lower(), a["content"])
    rels = [(a, _SPACES.split(a["rel"].lower())) for a in t.link_tags if "rel" in a]
    graph = {k: v for k, v in by_property.items() if k.startswith(("og:", "article:", "product:"))}
    graph |= {k: v for k, v in by_name.items() if k.startswith("og:") and k not in graph}
    twitter = {k: v for m in (by_property, by_name) for k, v in m.items() if k.startswith("twitter:")}
    equiv = [a for a in t.meta if a.get("http-equiv", "").lower() == "content-type"]
    declared = next((a["charset"] for a in t.meta if "charset" in a), "")
    for source in (by_name.get("content-type", ""), equiv[0].get("content", "") if equiv else ""):
        declared = declared or ((m := _CHARSET.search(source)) and m[1]) or ""
    text = collapse("".join(t.body)) or collapse("".join(t.everything))
    pairs = lambda d: [{"key": k, "value": v} for k, v in d.items()]
    return {
        "titles": t.titles,
        "meta_descriptions": [a.get("content", "") for a in t.meta if a.get("name", "").lower() == "description"],
        "meta_robots": by_name.get("robots"),
        "meta_googlebot": by_name.get("googlebot"),
        "canonicals": [{"href": (h := a["href"].strip(SPACE_CHARS)), "resolved": (u := parse_url(h, own)) and u.href} for a, r in rels if "canonical" in r and "href" in a],
        "html_lang": (t.lang or "").strip(SPACE_CHARS) or None,
        "charset": declared.strip(SPACE_CHARS) or None,
        "viewport": by_name.get("viewport"),
        "favicons": [{"rel": a["rel"].lower(), "href": a["href"].strip(SPACE_CHARS)} for a, r in rels if a.get("href") and ({"icon", "shortcut"} & {*r} or re.search("apple-touch-icon|mask-icon", a["rel"].lower()))],
        "headings": [{"level": h["level"], "text": h["text"] or "", "is_empty": not h["text"]} for h in t.headings],
        "images": [{"src": a.get("src", a.get("data-src")), "alt": a.get("alt"), "width": a.get("width"), "height": a.get("height"), "loading": a.get("loading"), "is_linked": a[""]} for a in t.images],
        "links": [_link(x, base) for x in t.links],
        "open_graph": pairs(graph),
        "twitter": pairs(twitter),
        "json_ld": [_json_block(s) for s in t.scripts],
        "microdata_types": list(dict.fromkeys(t.types)),
        "rdfa_types": list(dict.fromkeys(t.rdfa)),
        "hreflang": [{"lang": a["hreflang"], "href": a["href"]} for a, r in rels if "alternate" in r and a.get("hreflang") and a.get("href")],
        "word_count": sum(1 for w in text.split(" ") if _WORDLIKE.search(w)),
        "character_count": units(text),
        "paragraph_count": t.paragraphs,
        "html_units": units(markup),
        "excerpt": text[:300],
        "html_bytes": len(markup.encode("utf-8", "surrogatepass")),
        "has_doctype": bool(_DOCTYPE.search(markup)),
        "meta_refresh": next((a.get("content") for a in reversed(t.meta) if a.get("http-equiv", "").lower() == "refresh"), None),
    }


def with_facts(pages: DataFrame, *own: str, terminated: bool = False) -> DataFrame:
    """pages (page_id, url, html) to page_id, url, facts and the string columns own; each document is parsed once. terminated: see facts."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(FACTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                got = [facts(h, u, terminated) for u, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, kind), *part.columns[3:]], names=["page_id", "url", "facts", *own])

    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("facts", FACTS), *(pages.schema[c] for c in own)])
    return pages.select("page_id", "url", "html", *own).mapInArrow(run, schema)
