"""What a fetched document is, where it leads, and which reading fits it.

Refresh links form chains among the documents. They are followed by pointer doubling: each round joins the links with
themselves, so that after k rounds a link spans 2^k steps, and only links that still move take part. Chains that never
end are told from long ones when a round settles nothing: somewhere behind them lies a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resultmart.functions.text import join_url
from resultmart.plans import pages
from resultmart.sources.tables import written

#: What a document can be, and the reasons for those that can't be imported.
REASONS = {
    "pdf": None,
    "html": None,
    "html_fallback": "pdf URL did not return PDF bytes",
    "site_fallback": "site fallback React shell, not a result index",
    "html_wrapper": "old ISUCalcFS wrapper did not expose pages/main.html or pages/main.htm",
    "unknown_html": "source URL did not look like a supported result index",
    "unreachable": "url_error",
}
#: Texts of a page that name its platform, and the reading for each.
MARKERS = {"old_isucalcfs": ["isucalcfs"], "fs_manager": ["fs manager", "judgesdetailsperskater"]}
PLATFORMS = {"old_isucalcfs": "ISUCalcFS", "fs_manager": "FS Manager"}
#: Where a wrapper's main page lies.
MAIN_PAGES = ["pages/main.html", "pages/main.htm"]
#: Refresh elements, with their address last or first.
REFRESH = [r"""(?i)<meta[^>]+http-equiv=["']?refresh["']?[^>]+content=["'][^"']*url=([^"']+)["']""", r"""(?i)<meta[^>]+content=["'][^"']*url=([^"']+)["'][^>]+http-equiv=["']?refresh["']?"""]


def _text(body: str | Column) -> Column:
    return F.coalesce((F.col(body) if isinstance(body, str) else body).cast("string"), F.lit(""))


def _any(low: Column, texts: list[str]) -> Column:
    out = F.lit(False)
    for x in texts:
        out = out | low.contains(x)
    return out


def content_kind(url: str = "url", body: str = "body") -> Column:
    """What a document itself is, wherever it may lead."""
    text = _text(body)
    low = F.lower(text)
    ends_pdf = F.lower(F.regexp_replace(F.col(url), r"[?#].*$", "")).endswith(".pdf")
    shell = low.contains("<!doctype html>") & low.contains('id="root"') & low.contains("/assets/index-")
    wrapper = low.contains("scripts/results") & ~low.contains("pages/main") & F.replace(low, F.lit(" "), F.lit("")).contains("<body></body>")
    marked = _any(low, [x for texts in MARKERS.values() for x in texts])
    return F.when(text.startswith("%PDF"), "pdf").when(ends_pdf, "html_fallback").when(shell, "site_fallback").when(wrapper, "html_wrapper").when(marked, "html").otherwise("unknown_html")


def refresh_url(url: str = "url", body: str = "body") -> Column:
    """Where a page that isn't a PDF sends its reader, as a whole address; null for none."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(_text(body), x, 1), F.lit("")) for x in REFRESH])
    return F.when(~content_kind(url, body).isin("pdf", "html_fallback"), join_url(F.col(url), F.trim(found)))


def preflight(documents: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """Add source_class, what a fetched document is before it is followed or parsed (``meta_refresh`` where it sends elsewhere), and refresh_url."""
    refresh = refresh_url(url, body)
    return documents.withColumns({"source_class": F.when(refresh.isNotNull(), "meta_refresh").otherwise(content_kind(url, body)), "refresh_url": refresh})


def _compose(a: DataFrame, b: DataFrame) -> DataFrame:
    """Links of ``a`` carried on by those of ``b`` where they have any, and whether they were (``moved``)."""
    more = b.select(F.col("source").alias("_at"), F.col("target").alias("_next"), F.col("hops").alias("_more"))
    met = a.join(more, F.col("target") == F.col("_at"), "left")
    return met.select("source", F.coalesce("_next", "target").alias("target"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"), F.col("_at").isNotNull().alias("moved"))


def walk_links(links: DataFrame, hops: int) -> DataFrame:
    """(source, target, hops): where each link of (source, target), one for each source, leads after so many steps, or where it ends before."""
    walk, power, rest = None, links.select("source", "target", F.lit(1).alias("hops")), hops
    while rest:
        if rest & 1:
            walk = power if walk is None else written(_compose(walk, power).drop("moved"), "links")
        rest >>= 1
        if rest:
            power = written(_compose(power, power).drop("moved"), "links")
    return walk


def follow_links(links: DataFrame, hops: int | None = None) -> DataFrame:
    """(source, target, hops, loops) of links (source, target), one for each source: where it ends and after how many steps.

    With ``hops`` a walk stops after so many steps wherever it is. ``loops`` says that the walk never ends by itself;
    without ``hops`` its target is null then. The rounds grow with the logarithm of the longest chain.
    """
    one = written(links.select("source", "target", F.lit(1).alias("hops")), "links")
    ends = []
    moving, left = one, one.count()
    while left:
        known = moving
        for df in ends:
            known = known.unionByName(df)
        # every source is known, so that one join tells the links that go on from those that have ended
        met = written(_compose(moving, known), "links")
        ends.append(met.where("NOT moved").drop("moved"))
        doubled = met.where("moved").drop("moved")
        now = doubled.count()
        if now == left:
            break
        moving, left = doubled, now
    looping = moving.select("source", F.lit(None).cast("string").alias("target"), F.lit(None).cast("int").alias("hops"), F.lit(True).alias("loops"))
    found = looping if left else looping.limit(0)
    for df in ends:
        found = found.unionByName(df.withColumn("loops", F.lit(False)))
    if hops is None:
        return found
    return walk_links(one, hops).join(found.select("source", "loops"), "source")


def check_sources(documents: DataFrame, url: str = "url", body: str = "body", hops: int | None = 3) -> DataFrame:
    """What becomes of each document (urls are unique): url, content_kind, status, reason, resolved_url, resolution, hops, loops, body.

    The kind and the body are those of the document where refreshes end, at most ``hops`` of them, or of the main page
    behind a wrapper; one that sends to no document is unreachable. PDFs and pages of a known platform have passed.
    """
    own = documents.select(F.col(url).alias("url"), F.col(body).alias("body"), content_kind(url, body).alias("content_kind"), refresh_url(url, body).alias("refresh_url"))
    links = own.where("refresh_url IS NOT NULL").select(F.col("url").alias("source"), F.col("refresh_url").alias("target"))
    chains = written(follow_links(links, hops), "chains") if hops is None or hops > 0 else links.select("source", "target", F.lit(0).alias("hops"), F.lit(False).alias("loops")).limit(0)
    there = own.select(F.col("url").alias("target"), "content_kind", "body")
    moved = chains.join(there, "target", "left").select(F.col("source").alias("url"), F.col("target").alias("at"), F.coalesce("content_kind", F.lit("unreachable")).alias("content_kind"), "body", F.lit("meta_refresh").alias("resolution"), "hops", "loops")
    stayed = own.join(chains.select(F.col("source").alias("url")), "url", "left_anti").select("url", F.col("url").alias("at"), "content_kind", "body", F.lit(None).cast("string").alias("resolution"), F.lit(0).alias("hops"), F.lit(False).alias("loops"))
    out = stayed.unionByName(moved)

    wrappers = out.where("content_kind = 'html_wrapper'").select("at").distinct()
    wanted = wrappers.select("at", F.posexplode(F.array(*[join_url(F.col("at"), F.lit(x)) for x in MAIN_PAGES])).alias("_n", "main"))
    mains = own.where(F.lower(_text("body")).contains(MARKERS["old_isucalcfs"][0])).select(F.col("url").alias("main"), F.col("body").alias("main_body"))
    main = wanted.join(mains, "main").groupBy("at").agg(F.min_by(F.struct("main", "main_body"), "_n").alias("m"))
    out = out.join(main, "at", "left")
    opened = F.col("content_kind").eqNullSafe("html_wrapper") & F.col("m").isNotNull()
    kind = F.when(opened, "html").otherwise(F.col("content_kind"))
    reasons = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return out.select(
        "url", kind.alias("content_kind"), F.when(kind.isin("pdf", "html"), "passed").otherwise("failed").alias("status"), F.try_element_at(reasons, kind).alias("reason"),
        F.when(opened, F.col("m.main")).when(F.col("resolution").isNotNull(), F.col("at")).alias("resolved_url"), F.when(opened, "scripts_results_wrapper").otherwise(F.col("resolution")).alias("resolution"),
        "hops", "loops", F.when(opened, F.col("m.main_body")).otherwise(F.col("body")).alias("body"),
    )


def index_yields(cells: DataFrame) -> DataFrame:
    """(doc_id, parser_profile, n_categories, n_segments): what either reading of an index finds in a page's ``cells`` or ``rows``.

    The old layout is the page's first table without its first row; a row of two cells is a category with one result.
    The new one is the first table with headers for category, segment and reports. In both a row of five cells or more
    opens a category by its first cell, or is a segment of the one before by its second.
    """
    if "row" in cells.columns:
        text = lambda i: F.array_max(F.transform(F.filter("row", lambda x: x.cell_no == i), lambda x: x.text))
        heads = F.transform(F.filter("row", lambda x: x.is_header), lambda x: F.lower(x.text))
        rows = cells.select("doc_id", "table_no", "row_no", F.size("row").alias("n"), F.col("is_header").alias("heads"), text(0).alias("first"), text(1).alias("second"), heads.alias("headers"))
    else:
        rows = cells.where("kind = 'cell'").groupBy("doc_id", "table_no", "row_no").agg(
            F.count("*").alias("n"), F.bool_and("is_header").alias("heads"), F.max(F.when(F.col("cell_no") == 0, F.col("text"))).alias("first"), F.max(F.when(F.col("cell_no") == 1, F.col("text"))).alias("second"),
            F.collect_set(F.when(F.col("is_header"), F.lower("text"))).alias("headers"),
        )
    titled = F.size(F.array_except(F.array(*map(F.lit, ("category", "segment", "reports"))), F.col("headers"))) == 0
    rows = rows.select("doc_id", "table_no", "row_no", "n", "heads", "first", "second", F.when(titled, F.col("table_no")).alias("titled"))
    page = Window.partitionBy("doc_id")
    rows = rows.withColumns({"old_table": F.min("table_no").over(page), "new_table": F.min("titled").over(page)})
    wide = F.col("n") >= 5
    old = F.struct(F.lit("old_isucalcfs").alias("parser_profile"), ((F.col("table_no") == F.col("old_table")) & (F.col("row_no") > 0)).alias("holds"), (wide | (F.col("n") == 2)).alias("opens"))
    new = F.struct(F.lit("fs_manager").alias("parser_profile"), (F.col("table_no").eqNullSafe(F.col("new_table")) & ~F.col("heads")).alias("holds"), wide.alias("opens"))
    read = rows.select("doc_id", "row_no", "first", "second", wide.alias("wide"), F.explode(F.filter(F.array(old, new), lambda x: x.holds)).alias("r")).select("*", "r.parser_profile", "r.opens")
    read = read.withColumn("is_category", F.col("opens") & (F.col("first") != ""))
    is_segment = ~F.col("is_category") & F.col("wide") & (F.col("second") != "")
    grouped = read.groupBy("doc_id", "parser_profile").agg(F.count_if("is_category").alias("n_categories"), F.min(F.when(F.col("is_category"), F.col("row_no"))).alias("opened"), F.collect_list(F.when(is_segment, F.col("row_no"))).alias("segments"))
    return grouped.select("doc_id", "parser_profile", "n_categories", F.size(F.filter("segments", lambda x: x > F.col("opened"))).cast("long").alias("n_segments"))


def choose_parser(documents: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """(url, parser_profile, platform, n_categories, n_segments, validation_status, reason): the reading that finds most categories.

    A page that names its platforms is read by their readings only, others by both. Among equals the old reading goes
    first on pages that name it, the new one on pages that name none. A page without categories has failed.
    """
    low = F.lower(_text(body))
    named = {k: _any(low, v) for k, v in MARKERS.items()}
    none = ~(named["old_isucalcfs"] | named["fs_manager"])
    tries = F.filter(F.array(
        F.struct(F.lit("old_isucalcfs").alias("parser_profile"), F.when(none, 1).otherwise(0).alias("turn"), (named["old_isucalcfs"] | none).alias("tried")),
        F.struct(F.lit("fs_manager").alias("parser_profile"), F.when(none, 0).otherwise(1).alias("turn"), (named["fs_manager"] | none).alias("tried")),
    ), lambda x: x.tried)
    asked = documents.select(F.col(url).alias("doc_id"), none.alias("none"), F.explode(tries).alias("t")).select("doc_id", "none", "t.parser_profile", "t.turn")
    found = index_yields(pages.rows(documents, url, body))
    met = asked.join(found, ["doc_id", "parser_profile"], "left").fillna(0, ["n_categories", "n_segments"])
    best = met.groupBy("doc_id").agg(F.max_by(F.struct("parser_profile", "none", "n_categories", "n_segments"), F.struct("n_categories", -F.col("turn"))).alias("b")).select("doc_id", "b.*")
    platforms = F.create_map(*[F.lit(x) for pair in PLATFORMS.items() for x in pair])
    some = F.col("n_categories") > 0
    return best.select(
        F.col("doc_id").alias("url"), "parser_profile", F.when(~F.col("none"), F.try_element_at(platforms, "parser_profile")).alias("platform"), "n_categories", "n_segments",
        F.when(some, "passed").otherwise("failed").alias("validation_status"), F.when(~some, "no categories parsed from result index").alias("reason"),
    )
