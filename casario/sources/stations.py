"""Station directory out of landed HTML pages ``(url, html)``."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casario.session import cut_lineage

# Markers the directory pages carry (fixed values).
LINE_TABLE_HEADING = "erminais"
STATION_LINK = "wiki/Esta"
COORDINATE_LINK = "tools.wmflabs.org"
HEADING_ID = "firstHeading"
GEO_CLASS = "geo"

HREF = r'<a\s[^>]*?href="([^"]*)"'


# Elements without content, which never enclose a link.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _PageFacts(HTMLParser):
    """Collects, in one pass, what the directory needs from a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.heading: str | None = None
        self.title: str | None = None
        self.links: list[str] = []
        self.cell_links: list[str] = []
        self._open_tags: list[str] = []
        self.geo: list[str] = []
        self.line_titles: list[str] = []
        self.line_links: list[str] = []
        self._text: list[str] | None = None
        self._into = ""
        self._geo_depth = 0
        self._tables: list[dict] = []
        self._lines_done = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if a.get("id") == HEADING_ID and self.heading is None:
            self._open("heading")
        elif tag == "h1" and self.heading is None:
            self._open("heading")
        elif tag == "title" and self.title is None:
            self._open("title")
        elif tag == "span" and self._geo_depth:
            self._open("geo")
        if GEO_CLASS in (a.get("class") or ""):
            self._geo_depth += 1
        if tag == "table":
            self._tables.append({"cell": 0, "match": False, "titles": [], "links": []})
        elif self._tables:
            t = self._tables[-1]
            if tag == "tr":
                t["cell"] = 0
            elif tag == "td":
                t["cell"] += 1
            elif tag == "th":
                self._open("th")
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
            if self._open_tags[-2:] == ["tr", "td"]:
                self.cell_links.append(a["href"])
        self._enter(tag)
        for t in self._tables:
            if t["cell"] == 1 and (tag == "a" or t.get("in_a")):
                if a.get("title"):
                    t["titles"].append(a["title"])
                if a.get("href"):
                    t["links"].append(a["href"])
            if tag == "a":
                t["in_a"] = True

    def _enter(self, tag: str) -> None:
        """Keeps the path of open elements; a cell or row ends the one before it."""
        if tag in ("td", "th", "tr"):
            stops = ("table", "tr") if tag != "tr" else ("table",)
            while self._open_tags and self._open_tags[-1] not in stops and "table" in self._open_tags:
                self._open_tags.pop()
        if tag not in _VOID:
            self._open_tags.append(tag)

    def _leave(self, tag: str) -> None:
        if tag in self._open_tags:
            while self._open_tags.pop() != tag:
                pass

    def handle_endtag(self, tag):
        self._leave(tag)
        closes = self._text is not None and tag in ("h1", "h2", "title", "span", "th")
        if closes:
            self._close()
        if tag == "a":
            for t in self._tables:
                t["in_a"] = False
        if tag in ("div", "p", "td") or (tag == "span" and not closes):
            self._geo_depth = 0
        if tag == "table" and self._tables:
            t = self._tables.pop()
            if t["match"] and not self._lines_done:
                self.line_titles, self.line_links = t["titles"], t["links"]
                self._lines_done = True

    def handle_data(self, data):
        if self._text is not None:
            self._text.append(data)

    def _open(self, into: str) -> None:
        self._text, self._into = [], into

    def _close(self) -> None:
        text = "".join(self._text or [])
        if self._into == "heading":
            self.heading = text
        elif self._into == "title":
            self.title = text
        elif self._into == "geo":
            self.geo.append(text)
        elif self._into == "th" and LINE_TABLE_HEADING in text and self._tables:
            self._tables[-1]["match"] = True
        self._text, self._into = None, ""


FACTS = (
    "url string, heading string, title string, links array<string>, geo array<string>, "
    "line_titles array<string>, line_links array<string>, cell_links array<string>"
)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for url, html in zip(pdf["url"], pdf["html"]):
            page = _PageFacts()
            page.feed(html or "")
            page.close()
            rows.append(
                (url, page.heading, page.title, page.links, page.geo, page.line_titles, page.line_links, page.cell_links)
            )
        yield pd.DataFrame(
            rows, columns=["url", "heading", "title", "links", "geo", "line_titles", "line_links", "cell_links"]
        )


def page_facts(pages: DataFrame) -> DataFrame:
    """Heading, title, links, coordinates, line table and links directly in table cells of each page (Arrow batches, no shuffle)."""
    return pages.select("url", "html").mapInPandas(_parse, FACTS)


def line_index(facts: DataFrame) -> DataFrame:
    """(index page, line title, line link) pairs of the first line table; extra items are cut off."""
    pairs = F.explode(F.arrays_zip(F.col("line_titles").alias("linha"), F.col("line_links").alias("link")))
    return (
        facts.select("url", pairs.alias("p"))
        .select("url", "p.linha", "p.link")
        .where(F.col("linha").isNotNull() & F.col("link").isNotNull())
    )


def hrefs(html: Column) -> Column:
    """All link targets of a page, by pattern."""
    return F.regexp_extract_all(html, F.lit(HREF), F.lit(1))


def harvest_links(pages: DataFrame, containing: str | None = None) -> DataFrame:
    """Distinct (url, link) pairs, optionally only links containing a text."""
    found = pages.select("url", F.explode(hrefs(F.col("html"))).alias("link"))
    if containing is not None:
        found = found.where(F.contains("link", F.lit(containing)))
    return found.distinct()


def follow(links: DataFrame, pages: DataFrame, key: str = "link", carry: tuple[str, ...] = ()) -> DataFrame:
    """One hop: links joined to the page they lead to. ``pages`` has one row per url."""
    return links.select(*carry, F.col(key).alias("url")).join(pages, "url")


def absolute(base: str, link: Column) -> Column:
    return F.when(link.startswith("/"), F.concat(F.lit(base), link)).otherwise(link)


def harvest_stations(pages: DataFrame, seeds: DataFrame, base: str) -> DataFrame:
    """Follows seed -> line -> station -> coordinates and returns the station table rows.

    Stations of a line are the links directly in its page's table cells.

    ``seeds`` has ``uf`` and ``url``; a state without seeds gives no rows. Stations
    without coordinates are left out.
    """
    def facts_of(urls: DataFrame) -> DataFrame:
        """Parses only the pages that a hop leads to, one of each url."""
        facts = page_facts(pages.join(urls.select("url").distinct(), "url", "left_semi"))
        facts = facts.groupBy("url").agg(F.min(F.struct(*[c for c in facts.columns if c != "url"])).alias("f"))
        return facts.select("url", "f.*")

    # each hop is written, so the next one knows how few pages it needs
    index = facts_of(seeds)
    lines = line_index(index).join(seeds.select("url", "uf"), "url")
    lines = cut_lineage(lines.select("uf", "linha", absolute(base, F.col("link")).alias("link")).distinct())
    on_line = follow(lines, facts_of(lines.select(F.col("link").alias("url"))), carry=("uf", "linha"))
    found = cut_lineage(
        on_line.select("uf", "linha", F.explode("cell_links").alias("link"))
        .where(F.contains("link", F.lit(STATION_LINK)))
        .select("uf", "linha", absolute(base, F.col("link")).alias("link"))
        .distinct()
    )
    detail = follow(found, facts_of(found.select(F.col("link").alias("url"))), carry=("uf", "linha"))
    to_geo = F.get(F.filter("links", lambda c: F.contains(c, F.lit(COORDINATE_LINK))), F.lit(0))
    located = cut_lineage(
        detail.select("uf", "linha", F.col("heading").alias("estacao"), F.col("url").alias("page"), to_geo.alias("link"))
    )
    coords = facts_of(located.select(F.col("link").alias("url"))).select(
        F.col("url").alias("link"),
        F.get("geo", F.lit(0)).try_cast("double").alias("lat"),
        F.get("geo", F.lit(1)).try_cast("double").alias("lng"),
    )
    return (
        located.join(coords, "link")
        .where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
        .select("linha", "estacao", "lat", "lng", F.col("page").alias("url"), "uf")
    )
