"""URLs, addresses, and what a page holds."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from functools import reduce
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKIPPED_PATH = r"(?i)\.(?:7z|avi|css|csv|docx?|gif|jpe?g|js|json|mp3|mp4|mov|pdf|png|pptx?|rar|rss|svg|webp|xlsx?|xml|zip)$|/(?:admin|login|logout|search|wp-admin|wp-json)(?:/|$)"
LEAST_BLOCK, LEAST_PAGE, MOST_PAGE = 12, 120, 160_000
_blocks = frozenset("h1 h2 h3 h4 p li dt dd th td".split())
_left_out = frozenset("script style noscript svg canvas iframe form button nav footer header".split())
_hidden_classes = frozenset(("cookie", "cookies", "modal", "popup"))
_void = frozenset("area base br col embed hr img input link meta source track wbr".split())


def url_path(c: Column) -> Column:
    path = F.regexp_extract(F.regexp_replace(c, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(/.*)?$", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def canonical_url(c: Column | str) -> Column:
    """Without query and fragment, one slash for many, none at the end but of the root."""
    c = F.col(c) if isinstance(c, str) else c
    path = F.regexp_replace(url_path(c), r"/{2,}", "/")
    origin = F.lower(F.regexp_extract(c, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1))
    return F.concat(origin, F.when(F.length(path) > 1, F.regexp_replace(path, r"/$", "")).otherwise(path))


def is_skipped_path(path: Column) -> Column:
    return path.rlike(SKIPPED_PATH)


# Networks that are not public.
PRIVATE_IPV4 = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "100.64.0.0/10", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/3")
PRIVATE_IPV6 = ("::/128", "::1/128", "fc00::/7", "fe80::/10", "2001:db8::/32")


def is_private_address(address: str) -> bool:
    """Addresses that no crawl may reach; whatever is no address counts as one."""
    address = address.lower()
    if address.startswith("::ffff:"):
        return is_private_address(address[7:])
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return True
    if ip.version == 4:
        nets = PRIVATE_IPV4
    else:
        nets = PRIVATE_IPV6
    return any(ip in ipaddress.ip_network(n) for n in nets)


# First and last number of the IPv4 ranges that are not public, as is_private_address has them.
PRIVATE_RANGES = tuple((int(n[0]), int(n[-1])) for n in map(ipaddress.ip_network, PRIVATE_IPV4))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


@F.pandas_udf(T.BooleanType())
def _private(addresses: pd.Series) -> pd.Series:
    return addresses.map(is_private_address, na_action="ignore")


def private_address(address: Column | str) -> Column:
    """is_private_address as a column: IPv4 by arithmetic, and only addresses with colons, which are rare, go to Python."""
    a = F.lower(F.coalesce(F.col(address) if isinstance(address, str) else address, F.lit("")))
    plain = F.regexp_replace(a, r"^(?:::ffff:)+", "")
    octets = F.split(plain, r"\.")
    number = sum((F.get(octets, F.lit(k)).try_cast("long") * (1 << 8 * (3 - k)) for k in range(1, 4)), F.get(octets, F.lit(0)).try_cast("long") * (1 << 24))
    ranges = lambda n: reduce(Column.__or__, [n.between(first, last) for first, last in PRIVATE_RANGES])
    inside = F.transform(F.array(number), ranges)[0]  # the number is worked out once
    is_ipv4, is_ipv6 = plain.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), plain.contains(":")
    return F.when(is_ipv4, inside).otherwise(F.coalesce(_private(F.when(~is_ipv4 & is_ipv6, plain)), F.lit(True)))


class _Page(HTMLParser):
    """Collects title, text blocks by root element, and links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []
        self.hidden = 0
        self.robots = self.og_title = None
        self.titles: dict[str, list[str]] = {}
        self.roots: dict[str, list[list[str]]] = {"body": []}
        self.open: list[tuple[str, list[str]]] = []
        self.links: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("name") == "robots":
            self.robots = a.get("content", "").lower()
        if tag == "meta" and a.get("property") == "og:title" and self.og_title is None:
            self.og_title = a.get("content", "")
        if tag == "a" and "href" in a:
            self.links.append((a["href"], a.get("rel", "").lower()))
        if tag in _void:
            return
        if tag in ("p", "li", "dt", "dd", "th", "td"):
            self._end(tag, stop=("ul", "ol", "dl", "table", "article", "main", "body", "div"))
        elif tag in _blocks or tag in ("div", "ul", "ol", "section", "article", "main", "table", "footer", "nav"):
            self._end("p", stop=("ul", "ol", "dl", "table", "article", "main", "body", "div"))
        gone = tag in _left_out or a.get("aria-hidden") == "true" or bool(_hidden_classes & set(a.get("class", "").split()))
        self.stack.append((tag, gone))
        self.hidden += gone
        if tag in ("main", "article") and not self.hidden:
            self.roots.setdefault(tag, None)
            if self.roots[tag] is None:
                self.roots[tag] = []
        if tag in _blocks and not self.hidden:
            text: list[str] = []
            self.open.append((tag, text))
            inside = {t for t, _ in self.stack}
            for root in ("main", "article"):
                if root in inside and self.roots.get(root) is not None:
                    self.roots[root].append(text)
            self.roots["body"].append(text)
        if tag in ("h1", "title"):
            self.titles.setdefault(tag, [])

    def _end(self, tag, stop=()):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                for t, gone in self.stack[k:]:
                    self.hidden -= gone
                    if self.open and t == self.open[-1][0]:
                        self.open.pop()
                del self.stack[k:]
                return
            if self.stack[k][0] in stop:
                return

    def handle_endtag(self, tag):
        self._end(tag)

    def handle_data(self, data):
        tags = [t for t, _ in self.stack]
        if "title" in tags:
            self.titles["title"].append(data)
        if self.hidden:
            return
        if "h1" in tags and not getattr(self, "_h1_done", False):
            self.titles["h1"].append(data)
        for _, text in self.open:
            text.append(data)


def page_of(html: str, url: str) -> dict | None:
    """Title, text and links of a page; None if it asks not to be indexed or has too little text."""
    page = _Page()
    page.feed(html or "")
    page.close()
    if page.robots and "noindex" in page.robots:
        return None
    clean = lambda x: " ".join("".join(x).split())
    title = clean(page.og_title) if page.og_title is not None else clean(page.titles.get("h1", [])) if "h1" in page.titles else clean(page.titles.get("title", []))
    root = page.roots.get("main") if page.roots.get("main") is not None else page.roots.get("article") if page.roots.get("article") is not None else page.roots["body"]
    seen, blocks = set(), []
    for text in map(clean, root):
        if len(text) >= LEAST_BLOCK and text.lower() not in seen:
            seen.add(text.lower())
            blocks.append(text)
    text = "\n\n".join(x for x in (title, *blocks) if x)[:MOST_PAGE]
    if len(text) < LEAST_PAGE:
        return None
    return {"title": title or urlsplit(url).hostname or "", "text": text, "links": links_of(page.links, url)}


def links_of(found: list[tuple[str, str]], url: str) -> list[str]:
    """Distinct canonical links to the page's own origin that may be followed, most wanted first."""
    here, out = urlsplit(url), {}
    for href, rel in found:
        if not href or href.startswith("#") or re.match(r"(?i)(?:mailto|tel|javascript):", href) or "nofollow" in rel:
            continue
        try:
            to = urlsplit(urljoin(url, unescape(href)))
        except ValueError:
            continue
        if to.scheme not in ("http", "https") or (to.scheme, to.netloc) != (here.scheme, here.netloc) or re.search(SKIPPED_PATH, to.path):
            continue
        path = re.sub(r"/{2,}", "/", to.path or "/")
        out[f"{to.scheme}://{to.netloc}{path[:-1] if len(path) > 1 and path.endswith('/') else path}"] = None
    return sorted(out, key=link_priority)


def link_priority(url: str) -> int:
    path = (urlsplit(url).path or "/").lower()
    for k, hit in ((0, "/about/methodology" in path), (1, path == "/about" or "/about/howitstarted" in path), (2, "/about/contact" in path), (3, path == "/"), (4, path == "/news"), (5, path.startswith("/about/")), (20, path.startswith("/news/"))):
        if hit:
            return k
    return 10


def pages_schema() -> str:
    return "page_id long, url string, title string, text string, links array<string>"


def extract_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas function over (page_id, url, html)."""
    for batch in batches:
        rows = [(i, u, p["title"], p["text"], p["links"]) for i, u, h in zip(batch.page_id, batch.url, batch.html, strict=True) if (p := page_of(h, u))]
        yield pd.DataFrame(rows, columns=["page_id", "url", "title", "text", "links"])
