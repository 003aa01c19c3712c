"""What HTML pages say, by the standard library's parser.

Text leaves out comments, scripts and styles and keeps title and noscript; of a malformed page, what that parser makes
of it.  Plain parts of a page are parsed once in Arrow batches; what they mean for a brand is decided by columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import simhash
from .udf import vectorized

PAGE = (
    "text string, title string, meta string, forms array<string>, has_password boolean, images array<struct<src:string,attrs:string>>, "
    "icon string, links array<string>, dom_text string"
)
#: Characters of the pages whose parts are held at once: these take many times as much.
PARSED_CHARS = 1 << 20
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts, self.dom_texts, self.metas, self.forms, self.images, self.links = [], [], [], [], [], []
        self.title: str | None = None
        self.icon: str | None = None
        self.has_password = False
        self.markup: list[str] = []
        self.open: list[str] = []

    def handle_starttag(self, tag, attrs):
        named: dict[str, str] = {}
        for k, v in attrs:
            named[k] = "" if v is None else v
        if tag not in _VOID:
            self.open.append(tag)
        if tag == "form":
            self.forms.append(named.get("action", ""))
        elif tag == "input" and named.get("type", "").lower() == "password":
            self.has_password = True
        elif tag == "img":
            shown = dict(named)
            if shown.get("class"):
                shown["class"] = str(shown["class"].split())
            attrs_text = " ".join(_clean(shown.get(k)) for k in ("alt", "src", "class", "id", "title")).lower()
            self.images.append((named.get("src", ""), attrs_text))
        elif tag == "meta" and named.get("content"):
            self.metas.append(_clean(named["content"]))
        elif tag == "link" and "href" in named and self.icon is None and "icon" in " ".join(named.get("rel", "").lower().split()):
            self.icon = named["href"]
        elif tag == "a" and "href" in named:
            self.links.append(named["href"])
        elif tag == "title" and self.title is None:
            self.title = ""
        if not {"script", "style", "noscript"} & set(self.open):
            kept = [(k, v) for k, v in named.items() if not k.startswith("data-") and k not in ("nonce", "integrity")]
            self.markup.append("<" + " ".join([tag, *(f'{k}="{v}"' for k, v in kept)]) + ">")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
            if not {"script", "style", "noscript"} & set(self.open) and tag not in ("script", "style", "noscript"):
                self.markup.append(f"</{tag}>")

    def handle_data(self, data):
        if "script" in self.open or "style" in self.open:
            return
        if "title" in self.open and self.title is not None:
            self.title += data
        part = data.strip()
        if part:
            self.texts.append(part)
            if "noscript" not in self.open:
                self.dom_texts.append(part)


def _clean(x: str | None) -> str:
    text = (x or "").strip()
    return "" if text.lower() in ("nan", "nat", "none", "null") else text


def parse(html: str | None) -> Page:
    page = Page()
    if html:
        page.feed(html)
        page.close()
    return page


def dom_text(page: Page) -> str:
    text = re.sub(r"\s+", " ", " ".join(page.dom_texts).lower())
    return text or re.sub(r"\s+", " ", "".join(page.markup).lower())


@vectorized(PAGE)
def page_parts(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The parts of a page that evidence is drawn from."""
    names = ["text", "title", "meta", "forms", "has_password", "images", "icon", "links", "dom_text"]
    for part in pages:
        rows, held = [], 0
        for html in part:
            if rows and held + len(html or "") > PARSED_CHARS:
                yield pd.DataFrame(rows, columns=names)
                rows, held = [], 0
            held += len(html or "")
            p = parse(html)
            images = [{"src": s, "attrs": a} for s, a in p.images]
            rows.append((" ".join(p.texts).lower(), _clean(p.title).lower(), " ".join(p.metas).lower(), p.forms, p.has_password, images, p.icon, p.links, dom_text(p) if html else ""))
        yield pd.DataFrame(rows, columns=names)


@vectorized("string")
def dom_hash(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """SimHash of a page's text without scripts, styles and noscript; of its markup if it has no text."""
    for part in pages:
        yield part.map(lambda html: simhash(dom_text(parse(html))) if html else "")


@vectorized("string")
def join_url(base: pd.Series, relative: pd.Series) -> pd.Series:
    def join(b: str | None, r: str | None) -> str:
        try:
            return urljoin(b or "", r or "")
        except ValueError:
            return r or ""

    return pd.Series([join(b, r) for b, r in zip(base, relative, strict=True)], dtype="object")


@vectorized("array<string>")
def join_urls(base: pd.Series, relatives: pd.Series) -> pd.Series:
    return pd.Series([[_join(b, r) for r in ([] if rs is None else rs)] for b, rs in zip(base, relatives, strict=True)], dtype="object")


def _join(base: str | None, relative: str | None) -> str:
    try:
        return urljoin(base or "", relative or "")
    except ValueError:
        return relative or ""


def favicon_url(page_url: Column, icon: Column) -> Column:
    return join_url(page_url, F.coalesce(icon, F.lit("/favicon.ico")))


def logo_source(images: Column, tokens: Column) -> Column:
    """src of the first image with "logo" and a brand token in its attributes; else of the first with either; else ""."""
    shown = F.filter(images, lambda i: i["src"] != "")
    held = lambda i: F.exists(tokens, lambda t: i["attrs"].contains(t))
    both = F.filter(shown, lambda i: i["attrs"].contains("logo") & held(i))
    either = F.filter(shown, lambda i: i["attrs"].contains("logo") | held(i))
    return F.coalesce(F.get(both, F.lit(0))["src"], F.get(either, F.lit(0))["src"], F.lit(""))
