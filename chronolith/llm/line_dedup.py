"""Line removal by site-relative frequency: a line that stands on more than a given share of the pages
of its host is page furniture and goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chronolith.llm.common import stored
from chronolith.llm.near_dedup import near_dedup

#: A line on more than this share of its host's pages is boilerplate ...
MAX_RATIO = 0.02
#: ... if it stands on so many pages at least, so that small hosts lose nothing by chance.
MIN_PAGES = 3


def _lines(text):
    return F.split(text, "\n", -1)


def _key(line):
    """Hash of a line without outer white space; null for a blank line."""
    bare = F.btrim(line, F.lit(" \t\x0b\x0c\r"))
    return F.when(bare != "", F.xxhash64(bare))


def page_key(text):
    """Hash that names a page: its whole text, a null one as an empty one."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def near_pages(docs: DataFrame, text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(page, page_class) of the pages that the stars of near-dedup link with another page: all of a class have its
    smallest key.  Null texts read as empty and stand alone, repeated pages are one, an empty table gives no rows."""
    keyed = docs.select(page_key(text).alias("page"), F.col(text).cast("string").alias("text"))
    # Counting needs most of a group, not its exact component.
    found = near_dedup(keyed, doc_id="page", text="text", width=width, percent=percent, stars_only=True)
    # A page and its exact copies have one key and one class.
    linked = found.groupBy(F.col("doc_id").alias("page")).agg(F.min("component_id").alias("page_class"))
    others = linked.where("page <> page_class")
    heads = others.select(F.col("page_class").alias("page"), "page_class").distinct()
    return stored(others.unionByName(heads), "near_pages")


def line_shares(docs: DataFrame, host: str = "source", text: str = "text", near: DataFrame | None = None) -> DataFrame:
    """(host, line, pages, host_pages): distinct pages of the host that hold the line.

    Exact copies of a page count as one page: whole copies are for document dedup, and must not make the
    body of a page look like furniture.  With `near` (page, page_class), the pages of a class count as one
    page of each host, and a line is on it where any of them has it.  Copies shrink on the map side and no key
    gathers raw lines: the counts are partial sums before they are shuffled.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    pages = (docs.select(F.col(host).alias("host"), page_key(text).alias("page"),
                         F.array_distinct(F.filter(F.transform(_lines(body), _key), lambda h: h.isNotNull())).alias("keys"))
             .groupBy("host", "page").agg(F.first("keys").alias("keys")))
    if near is None:
        lines, single = pages.select("host", F.explode("keys").alias("line")), pages.select("host")
    else:
        # Only the pages of a class, which are few as a rule, are brought together line by line.
        pages = stored(pages.join(near, "page", "left"), "pages")
        alone, classed = pages.where("page_class IS NULL"), pages.where("page_class IS NOT NULL")
        lines = alone.select("host", F.explode("keys").alias("line")).unionByName(
            classed.select("host", "page_class", F.explode("keys").alias("line")).distinct().select("host", "line"))
        single = alone.select("host").unionByName(classed.select("host", "page_class").distinct().select("host"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("pages"))
    totals = single.groupBy("host").agg(F.count("*").alias("host_pages"))
    return (counts.where(F.col("pages") >= MIN_PAGES)
            .join(totals.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h"))


def line_dedup(docs: DataFrame, host: str = "source", text: str = "text",
               max_ratio: float = MAX_RATIO, near: DataFrame | None = None) -> DataFrame:
    """The documents with their boilerplate lines removed; columns n_lines and n_dropped are appended.

    Every row stays, with all its columns; a text of nothing but boilerplate becomes empty.  Blank lines
    are neither counted nor dropped.  A null text stays null with counts 0, a null host is a host of its
    own, and input columns named like the two counts are replaced.  A host's boilerplate lines number at
    most (lines per page / max_ratio), so the list that meets each document is short.  The lists are
    written first: the planner knows their size when it picks the join, and a hot host's documents are
    split by the skew join where the lists are too large to broadcast.  `near` is as in line_shares: without
    it a group of near copies larger than max_ratio of its host's pages loses the lines its members share.
    """
    shares = line_shares(docs, host, text, near)
    lists = stored(shares.where(F.col("pages") > max_ratio * F.col("host_pages"))
                   .groupBy("host").agg(F.collect_set("line").alias("__line_furniture"))
                   .withColumnRenamed("host", "__line_host"), "__line_furniture")
    joined = docs.join(lists, docs[host].eqNullSafe(lists["__line_host"]), "left").drop("__line_host")
    lines = _lines(F.col(text))
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("__line_furniture", _key(x)), F.lit(False)))
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped", text)]
    step = joined.select(*[docs[c] for c in keep], F.col(text).alias("__line_before"), lines.alias("__line_lines"),
                         F.when(F.col("__line_furniture").isNull(), lines).otherwise(kept).alias("__line_kept"))
    cleaned = F.when(F.size("__line_kept") == F.size("__line_lines"), F.col("__line_before")).otherwise(F.array_join("__line_kept", "\n"))
    step = step.select(*keep, cleaned.alias(text),
                       F.size(F.filter(F.coalesce("__line_lines", F.array()), lambda x: _key(x).isNotNull()))
                       .cast("long").alias("n_lines"),
                       F.coalesce(F.size("__line_lines") - F.size("__line_kept"), F.lit(0)).cast("long").alias("n_dropped"))
    order = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return step.select(*order, "n_lines", "n_dropped")
