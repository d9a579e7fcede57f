"""Items of list pages: a small tree of a page's elements, and the selectors that find cards in it."""

from __future__ import annotations

import collections
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that end where one of these begins beside them, and elements that such an end doesn't reach beyond.
_ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
    "p": {"p", "div", "ul", "ol", "dl", "table", "section", "article", "aside", "header", "footer", "nav", "main", "form", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "pre", "blockquote", "figure", "address", "fieldset"},
}
_CLOSED_WITH = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": {"button", "td", "th", "caption", "object", "template"}}
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*)?((?:\.[\w-]+)*)((?:\[[^\]]*\])*)$")
_ATTRIBUTE = re.compile(r"\[([\w-]+)(?:(\*?=)['\"]?([^'\"\]]*)['\"]?)?\]")


class Element:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def below(self):
        """Elements and texts below, in document order; a stack in place of recursion, as pages may be nested without end."""
        left = [iter(self.children)]
        while left:
            for c in left[-1]:
                yield c
                if isinstance(c, Element):
                    left.append(iter(c.children))
                    break
            else:
                left.pop()

    def every(self):
        """All elements below, in document order."""
        return (c for c in self.below() if isinstance(c, Element))

    def text(self) -> str:
        return "".join(c.strip() for c in self.below() if not isinstance(c, Element))

    def is_a(self, selector: str) -> bool:
        """One simple selector: a tag, classes, attributes with an exact value or a part of it."""
        m = _SIMPLE.match(selector.strip())
        tag, classes, attributes = m.groups()
        own = self.attrs.get("class", "").split()
        if tag and tag != self.tag or any(c not in own for c in classes.split(".")[1:]):
            return False
        return all(name in self.attrs and (not how or (value in self.attrs[name] if how == "*=" else value == self.attrs[name])) for name, how, value in _ATTRIBUTE.findall(attributes))

    def find(self, selectors: str) -> list[Element]:
        """Elements below that are any of several selectors, separated by commas."""
        some = selectors.split(",")
        return [e for e in self.every() if any(e.is_a(s) for s in some)]


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)
        self.open: collections.Counter[str] = collections.Counter()

    def _end_implied(self, tag: str) -> None:
        """Ends the open elements without an end tag of their own that ``tag`` ends."""
        for ended, by in _ENDED_BY.items():
            if tag in by and self.open[ended]:
                e = self.at
                while e.parent and e.tag != ended and e.tag not in _CLOSED_WITH[ended]:
                    e = e.parent
                if e.tag == ended:
                    self._leave(e)

    def _leave(self, e: Element) -> None:
        while self.at is not e:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent
        self.open[e.tag] -= 1
        self.at = e.parent

    def handle_starttag(self, tag, attrs):
        self._end_implied(tag)
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(e)
        if tag not in _VOID:
            self.at = e
            self.open[tag] += 1

    def handle_endtag(self, tag):
        if self.open[tag]:  # else nothing of the kind is open, which a deep page would be searched for each time
            e = self.at
            while e.tag != tag:
                e = e.parent
            self._leave(e)

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str | None) -> Element:
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.root


_ITEMS = "array<struct<title:string,url:string,day:string,tags:array<string>>>"


def listed(html: Column, fund: Column, funds: dict[str, tuple[str, list[str]]], own_domains: dict[str, str]) -> Column:
    """Items of a list page, by its fund's selectors in order: a title of ten characters or more, the first address of each, a date, tags.

    Each page is parsed once, for whichever fund it is of; pages of other funds give none.
    """

    @F.pandas_udf(_ITEMS)
    def parse(pages: pd.Series, of: pd.Series) -> pd.Series:
        def one(page: str | None, fund: str | None) -> list[dict]:
            site, selectors = funds.get(fund, ("", []))
            return _items(tree(page), selectors, site, own_domains.get(fund)) if selectors else []

        return pd.Series([one(page, fund) for page, fund in zip(pages, of, strict=True)])

    return parse(html, fund)


def _items(page: Element, selectors: list[str], site: str, own_domain: str | None) -> list[dict]:
    out: dict[str, dict] = {}
    for selector in selectors:
        for card in page.find(selector):
            head = next(iter(card.find("h2, h3, h4, .title, [class*='title'], a")), None)
            link = next(iter(card.find("a[href]")), None)
            up = card
            while link is None and up is not None:
                link, up = (up if up.tag == "a" and "href" in up.attrs else None), up.parent
            title = head.text() if head else ""
            url = link.attrs["href"] if link else ""
            url = url if not url or url.startswith("http") else site + url
            if len(title) < 10 or not url or url in out or own_domain and own_domain not in url:
                continue
            date = next(iter(card.find("time, .date, [class*='date']")), None)
            tags = [t.text().lower() for t in card.find(".tag, .category, [class*='tag']") if t.text()]
            out[url] = {"title": title, "url": url, "day": (date.attrs.get("datetime") or date.text()) if date else None, "tags": tags}
    return list(out.values())


_REPOSITORIES = "array<struct<name:string,url:string,description:string,language:string,stars_today:bigint,total_stars:bigint,forks:bigint,built_by:array<string>>>"


def _count(text: str) -> int:
    digits = text.replace(",", "")
    return int(digits) if digits.isdigit() else 0


def repositories(html: Column) -> Column:
    """Repositories of a trending page, with their counters."""

    def of(page: str | None) -> list[dict]:
        out = []
        for row in tree(page).find("article.Box-row"):
            link = next((a for h in row.find("h2") for a in h.find("a")), None)
            if link is None or not link.attrs.get("href", "").strip():
                continue
            one = lambda s: next(iter(row.find(s)), None)  # noqa: E731, B023
            text, language, today = one("p"), one("[itemprop='programmingLanguage']"), one(".float-sm-right")
            stars = re.search(r"(\d+(?:,\d+)*)\s*stars?\s*today", " ".join(today.text().split())) if today else None
            counted = {k: sum(_count(a.text()) for a in row.find("a.Link--muted") if k in a.attrs.get("href", "")) for k in ("/stargazers", "/forks")}
            names = [i.attrs.get("alt", "") for i in row.find("img.avatar")[:5]]
            out.append({
                "name": "".join(link.text().split()), "url": "https://github.com" + link.attrs["href"].strip(), "description": text.text() if text else "", "language": language.text() if language else None,
                "stars_today": int(stars[1].replace(",", "")) if stars else 0, "total_stars": counted["/stargazers"], "forks": counted["/forks"], "built_by": [n[1:] for n in names if n.startswith("@")],
            })
        return out

    @F.pandas_udf(_REPOSITORIES)
    def parse(pages: pd.Series) -> pd.Series:
        return pages.map(of)

    return parse(html)


def portfolio(html: Column, selector: str, name_selector: str | None, attribute: str | None = None, most: int = 500) -> Column:
    """Names of companies on a portfolio page: the first of several selectors that finds any, 2 to 100 characters, each once."""

    @F.pandas_udf("array<string>")
    def parse(pages: pd.Series) -> pd.Series:
        def of(page: str | None) -> list[str]:
            root, out = tree(page), {}
            cards = next((found for s in selector.split(",") if (found := root.find(s))), [])
            for card in cards:
                e = next(iter(card.find(name_selector)), None) if name_selector else card
                name = ((e.attrs.get(attribute, "") if attribute else e.text()) if e else "").strip()
                if 2 <= len(name) <= 100 and name.lower() not in out and len(out) < most:
                    out[name.lower()] = name
            return list(out.values())

        return pages.map(of)

    return parse(html)
