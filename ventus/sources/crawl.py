"""Crawls over a table of pages: many sites at once, each best first.

A crawl goes from its start page over links within the start page's origin.  It
takes up to BATCH of the most wanted addresses waiting, in the order in which
they were found, reads their pages, and goes on until it has enough documents,
has looked at three times as many pages, or nothing waits.  A page whose
content (white space and case aside) the crawl has already is looked at for its
links and kept no second time; at most QUEUE addresses wait.

All crawls advance together, a round at a time.  The state of a crawl is one
bounded row (what waits, what was seen, what was kept), written after every
round; a round joins what crawls ask for with the pages and folds the answers into
the states, in Spark's own expressions.  Nothing grows with links or pages on the
driver, which learns one number a round: how many crawls go on.

Defined results: a start without a page, or with under LEAST_START characters,
ends its crawl with status 'error' and no documents; pages that a crawl asks for and
doesn't find are counted as missing; of several pages of one address the one of
least id counts; links that are null or of another origin are left out; crawls
of equal id count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ventus.functions.web import canonical_url, is_skipped_path, url_path
from ventus.sources.tables import shared_folder

#: Addresses looked at in a round, addresses that wait, characters of a start page, pages looked at for each document wanted.
BATCH, QUEUE, LEAST_START, TRIES = 3, 80, 120, 3
#: Documents of a crawl: as asked, within these bounds.
LEAST_PAGES, MOST_PAGES, PAGES = 1, 20, 12
#: Asked addresses that are broadcast to the pages; more are exchanged with them.
BROADCAST_ROWS = 100_000

# How much an address is wanted, by its lower-case path; the least number comes first.
WANTED = (
    (0, "contains", "/about/methodology"), (1, "equals", "/about"), (1, "contains", "/about/howitstarted"), (2, "contains", "/about/contact"),
    (3, "equals", "/"), (4, "equals", "/news"), (5, "starts", "/about/"), (20, "starts", "/news/"),
)
OTHERWISE = 10

_TEXT = "array<string>"


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-z]+://[^/?#]*)", 1)


def rank_of(url: Column) -> Column:
    """How much an address is wanted: the first of WANTED that holds for its path."""
    path = F.lower(F.regexp_extract(url, r"^[a-z]+://[^/?#]*(/[^?#]*)?", 1))
    path = F.when(path == "", "/").otherwise(path)
    holds = {"contains": path.contains, "equals": path.__eq__, "starts": path.startswith}
    first, *rest = [F.when(holds[how](text), rank) for rank, how, text in WANTED]
    return F.coalesce(first, *rest, F.lit(OTHERWISE))


def _by_rank(urls: Column) -> Column:
    """Addresses, most wanted first; those wanted alike stay in their order."""
    keyed = F.array_sort(F.transform(urls, lambda u, k: F.struct(rank_of(u).alias("r"), k.alias("k"), u.alias("u"))))
    return F.transform(keyed, lambda x: x["u"])


def _enqueued(queue: Column, seen: Column, links: Column) -> Column:
    """The queue with new links, as far as there is room, most wanted first."""
    more = lambda q, u: F.when((F.size(q) < QUEUE) & ~F.array_contains(seen, u) & ~F.array_contains(q, u), F.array_append(q, u)).otherwise(q)
    return _by_rank(F.aggregate(links, queue, more))


def _with_page(state: dict[str, Column], page: Column) -> dict[str, Column]:
    """A state after a page (address, digest, links) has been looked at; a null page changes nothing."""
    seen = F.array_union(state["seen"], F.array(page["url"]))
    new = ~F.array_contains(state["digests"], page["digest"])
    after = {
        "seen": seen, "queue": _enqueued(state["queue"], seen, page["links"]),
        "digests": F.when(new, F.array_append(state["digests"], page["digest"])).otherwise(state["digests"]),
        "kept": F.when(new, F.array_append(state["kept"], page["url"])).otherwise(state["kept"]),
    }
    return {k: F.when(page.isNotNull(), after[k]).otherwise(v) if k in after else v for k, v in state.items()}


_STATE = {"crawl_id": None, "origin": None, "most": None, "whole": None, "status": None, "queue": _TEXT, "seen": _TEXT, "digests": _TEXT, "kept": _TEXT, "visited": None, "missing": None}


def _pages(pages: DataFrame) -> DataFrame:
    """(url, digest, links, chars, page_id) of the first page of each canonical address; texts stay where they are."""
    digest = F.sha2(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), 256)
    links = F.coalesce(F.filter("links", lambda x: x.isNotNull()), F.array().cast(_TEXT))
    rows = pages.where("text is not null").select(canonical_url("url").alias("url"), "page_id", digest.alias("digest"), links.alias("links"), F.length("text").alias("chars"))
    return rows.groupBy("url").agg(F.min_by(F.struct("digest", "links", "chars", "page_id"), "page_id").alias("p")).select("url", "p.*")


def _found(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages of the addresses (url) asked for."""
    urls = asked.select("url").distinct()
    return pages.join(F.broadcast(urls) if urls.count() <= BROADCAST_ROWS else urls, "url", "left_semi")


def crawl(starts: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((crawl_id, position, page_id, url) of the documents, (crawl_id, status, pages_visited, missing) of the crawls).

    starts: crawl_id, url, and as the caller likes max_pages and mode ('site', or
    'page' for the start alone); pages: page_id, url, text, links.
    """
    spark, folder = starts.sparkSession, shared_folder(starts.sparkSession)

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    none = F.array().cast(_TEXT)
    slim = keep(_pages(pages), "pages")
    most = F.coalesce(F.col("max_pages").cast("int"), F.lit(PAGES)) if "max_pages" in starts.columns else F.lit(PAGES)
    whole = F.coalesce(F.col("mode") == "site", F.lit(True)) if "mode" in starts.columns else F.lit(True)
    first = starts.where("crawl_id is not null").select("crawl_id", canonical_url("url").alias("url"), F.least(F.greatest(most, F.lit(LEAST_PAGES)), F.lit(MOST_PAGES)).alias("most"), whole.alias("whole"))
    first = keep(first.groupBy("crawl_id").agg(F.min(F.struct("url", "most", "whole")).alias("s")).select("crawl_id", "s.*"), "starts")
    met = first.join(_found(first, slim).drop("page_id"), "url", "left").withColumns({"origin": origin(F.col("url")), "ok": F.coalesce(F.col("chars") >= LEAST_START, F.lit(False))})
    page = F.when(F.col("ok"), F.struct("url", "digest", _own_links("links").alias("links")))
    state = {c: F.col(c) if c in ("crawl_id", "origin", "most", "whole") else none for c in _STATE}
    state |= {"status": F.when(F.col("ok"), "done").otherwise("error"), "visited": F.lit(1), "missing": F.lit(0)}
    state = _with_page(state, page)
    state["queue"] = F.when(F.col("whole"), state["queue"]).otherwise(none)
    states, k = keep(met.select(*(v.alias(c) for c, v in state.items())), "state-0"), 0
    while True:
        on = F.col("whole") & (F.size("queue") > 0) & (F.size("kept") < F.col("most")) & (F.col("visited") < F.col("most") * TRIES)
        n = F.when(on, F.least(F.lit(BATCH), F.col("most") - F.size("kept"), F.size("queue"))).otherwise(0)
        asked = states.select("crawl_id", F.posexplode(F.slice("queue", F.lit(1), n)).alias("at", "url"))
        asked = keep(asked, f"asked-{k}")
        found = asked.join(keep(_found(asked, slim), f"found-{k}"), "url", "left")
        came = found.groupBy("crawl_id").agg(F.array_sort(F.collect_list(F.struct("at", "url", "digest", "links"))).alias("batch"))  # BATCH rows of each at most
        rows = states.join(came, "crawl_id", "left")
        batch = F.coalesce("batch", F.array().cast(came.schema["batch"].dataType))
        state = {c: F.col(c) for c in _STATE}
        state |= {"queue": F.slice("queue", F.size(batch) + 1, F.lit(QUEUE)), "seen": F.array_union("seen", F.transform(batch, lambda x: x["url"])), "visited": F.col("visited") + F.size(batch)}
        state["missing"] = F.col("missing") + F.size(F.filter(batch, lambda x: x["digest"].isNull()))
        # the pages of a batch in their order; each step stands in columns of its own, so that plans stay small
        rows = rows.select(*(v.alias(c) for c, v in state.items()), batch.alias("batch"))
        for j in range(BATCH):
            x = F.get("batch", F.lit(j))
            page = F.when(x["digest"].isNotNull(), F.struct(x["url"].alias("url"), x["digest"].alias("digest"), _own_links(x["links"]).alias("links")))
            rows = rows.withColumn("_page", page)
            after = _with_page({c: F.col(c) for c in _STATE}, F.col("_page"))
            rows = rows.select(*(v.alias(c) for c, v in after.items()), "batch")
        going = Observation()
        k += 1
        states = keep(rows.observe(going, F.count_if(F.size("batch") > 0).alias("n")).drop("batch"), f"state-{k}")
        if not going.get["n"]:
            break
    docs = states.select("crawl_id", F.posexplode("kept").alias("position", "url")).join(slim.select("url", "page_id"), "url").select("crawl_id", "position", "page_id", "url")
    return docs, states.select("crawl_id", "status", F.col("visited").alias("pages_visited"), "missing")


def _own_links(links: Column | str) -> Column:
    """Links of the crawl's own origin, each once and canonical, most wanted first."""
    links = F.col(links) if isinstance(links, str) else links
    own = F.filter(F.transform(links, canonical_url), lambda u: u.startswith(F.concat(F.col("origin"), F.lit("/"))) & ~is_skipped_path(url_path(u)))
    return _by_rank(F.array_distinct(own))

