"""What pages hold, by an HTML parser in Arrow batches."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE = "title string, description string, pdf_links array<string>, content string"
_SILENT = {"script", "style", "template"}  # their text is not the page's
#: An & that opens no reference ended by a semicolon; scripts and styles, where & is an &, are stepped over.
_OPEN = re.compile(r"(<(script|style)\b.*?</\2\s*>)|&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);)", re.S | re.I)
LEAST = 100  # characters of embedded content below which the whole page's text is taken


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: list[str] | None = None
        self.meta: dict[str, str] = {}
        self.links: list[str] = []
        self.text: list[str] = []
        self.data: list[str] = []
        self.inside: list[str] = []
        self.in_title = self.in_data = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "title" and self.title is None:
            self.title, self.in_title = [], True
        elif tag == "meta":
            for key in (a.get("name"), a.get("property")):
                if key in {"description", "og:description"}:
                    self.meta.setdefault(key, a.get("content", ""))
        elif tag == "a" and "href" in a:
            self.links.append(a["href"])
        if tag in _SILENT:
            self.inside.append(tag)
            self.in_data = tag == "script" and a.get("id") == "__NEXT_DATA__"

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if self.inside and tag == self.inside[-1]:
            self.inside.pop()
            self.in_data = False

    def handle_data(self, data: str) -> None:
        if self.in_data:
            self.data.append(data)
        if self.inside:
            return
        if self.in_title and self.title is not None:
            self.title.append(data)
        if data.strip():
            self.text.append(data.strip())


def parse(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def page_of(url: str | None, html: str | None, social: bool = True, ended: bool = False) -> tuple[str, str, list[str], str]:
    """(title, description, sorted PDF links, content). The description is the page's own, or without
    one, if social is true, that for social networks. The content is that of the page's embedded
    data if it holds at least LEAST characters, else the text of the whole page, line by line. If
    ended is true, a reference without its semicolon (that of a title cut off in it, say) is text;
    else it counts, as in browsers."""
    page = parse(_OPEN.sub(lambda m: m[1] or "&amp;", html) if ended and html else html)
    content = ""
    try:
        found = json.loads("".join(page.data))["props"]["pageProps"]["ssrPageContent"]["content"] if page.data else ""
        content = "\n".join(parse(found).text) if isinstance(found, str) else ""
    except (ValueError, KeyError, TypeError):
        pass
    if len(content.strip()) < LEAST:
        content = "\n".join(page.text)
    links = set()
    for href in page.links:
        try:
            full = urljoin(url or "", href)
        except ValueError:  # an address no one can resolve is no link
            continue
        if full.lower().endswith(".pdf"):
            links.add(full)
    description = page.meta.get("description", page.meta.get("og:description", "") if social else "")
    return "".join(page.title or []).strip(), description.strip(), sorted(links), content


def _resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([urljoin(b or "", h or "") for b, h in zip(base, href)], dtype=object)


def page_info(url: str | Column = "url", html: str | Column = "html", social: bool = True, ended: bool = False) -> Column:
    """struct(title, description, pdf_links, content) of a page; a null page has empty ones."""

    @F.pandas_udf(PAGE)
    def run(url: pd.Series, html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_of(u, h, social, ended) for u, h in zip(url, html)], columns=["title", "description", "pdf_links", "content"])

    return run(url, html)


def resolve(base: str | Column, href: str | Column) -> Column:
    """href as a full address, seen from base."""
    return F.pandas_udf(_resolved, "string")(base, href)
