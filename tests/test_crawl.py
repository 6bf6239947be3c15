"""Crawls over tables against a plain crawl, one page after another, on random sites."""

from __future__ import annotations

import random
from urllib.parse import urlsplit

import pytest

from ventus.sources import crawl, knowledge


def wanted(url: str) -> int:
    path = (urlsplit(url).path or "/").lower()
    for k, hit in ((0, "/about/methodology" in path), (1, path == "/about" or "/about/howitstarted" in path), (2, "/about/contact" in path), (3, path == "/"), (4, path == "/news"), (5, path.startswith("/about/")), (20, path.startswith("/news/"))):
        if hit:
            return k
    return 10


def plain(start, most, whole, pages):
    """(status, addresses kept, pages visited, pages missing) of one crawl."""
    if start not in pages or len(pages[start][0]) < 120:
        return "error", [], 1, 0
    kept, seen, digests, queue, visited, missing = [], set(), set(), [], 1, 0

    def look(url):
        nonlocal queue
        text, links = pages[url]
        seen.add(url)
        if (digest := " ".join(text.split()).lower()) not in digests:
            digests.add(digest)
            kept.append(url)
        for u in sorted(dict.fromkeys(x for x in links if x.startswith("/".join(start.split("/")[:3]) + "/")), key=wanted):
            if len(queue) < crawl.QUEUE and u not in seen and u not in queue:
                queue.append(u)
        queue = sorted(queue, key=wanted)

    look(start)
    while whole and queue and len(kept) < most and visited < 3 * most:
        n = min(3, most - len(kept))
        batch, queue = queue[:n], queue[n:]
        seen.update(batch)
        visited += len(batch)
        missing += sum(u not in pages for u in batch)
        for u in batch:
            if u in pages:
                look(u)
    return "done", kept, visited, missing


def site(rng: random.Random, host: str, n: int):
    paths = ["/", "/about", "/news", "/about/methodology", "/about/contact", "/about/team", *(f"/news/{k}" for k in range(n // 3)), *(f"/p/{k}" for k in range(n))]
    urls = [f"http://{host}{p}" for p in paths]
    return {u: (rng.choice(["Some text of a page. " * 8, f"Own  text of {u}. " * 8, f"own text of {u}. " * 8]), [rng.choice([*urls, "http://other.org/", f"http://{host}/gone/{rng.randrange(9)}"]) for _ in range(rng.choice([0, 3, 12, 120]))]) for u in urls if rng.random() < 0.9}


@pytest.fixture(scope="module")
def sites():
    rng = random.Random(3)
    return {u: p for k in range(6) for u, p in site(rng, f"h{k}.org", rng.choice([5, 30, 200])).items()} | {"http://short.org/": ("short", [])}


def test_crawls_are_those_of_a_plain_crawl(spark, sites):
    rng = random.Random(4)
    starts = [(k, rng.choice([*list(sites)[:40], *(u for u in sites if u.endswith(".org/")), "http://none.org/"]), rng.choice([None, 0, 1, 5, 12, 40]), rng.choice(["site", "site", "page", None])) for k in range(40)]
    starts += [(97, "http://short.org/", 3, "site"), (98, None, 3, "site")]
    pages = spark.createDataFrame([(k, u, t, [*x, None]) for k, (u, (t, x)) in enumerate(sites.items())] + [(10**6, next(iter(sites)) + "?q=2", "later", []), (-1, "http://x.org/", None, None)], "page_id long, url string, text string, links array<string>")
    docs, crawls = crawl.crawl(spark.createDataFrame([*starts, starts[0]], "crawl_id int, url string, max_pages int, mode string"), pages)
    got = {r.crawl_id: [r.status, [], r.pages_visited, r.missing] for r in crawls.collect()}
    for r in docs.orderBy("crawl_id", "position").collect():
        got[r.crawl_id][1].append(r.url)
    want = {i: plain(u, min(max(m if m is not None else 12, 1), 20), mode != "page", sites) for i, u, m, mode in starts}
    assert {k: tuple(v) for k, v in got.items()} == want
    assert sum(len(v[1]) for v in want.values()) > 100 and any(v[3] for v in want.values())


def test_crawls_without_rows(spark):
    pages = spark.createDataFrame([], "page_id long, url string, text string, links array<string>")
    docs, crawls = crawl.crawl(spark.createDataFrame([], "crawl_id int, url string"), pages)
    assert docs.count() == 0 and crawls.count() == 0


def test_pages_that_lose_their_address_take_no_content_along(spark):
    rows = spark.createDataFrame([(1, "http://a.org/u", "t1"), (2, "http://a.org/u/", "t2"), (3, "http://a.org/v", "T2 "), (4, "http://a.org/w", " t1")], "page_id long, url string, text string")
    assert sorted(r.page_id for r in knowledge.distinct_pages(rows).collect()) == [1, 3]
