"""Queries that apply the operators to the supplied tables, each with the SQL that gives the same rows.

The supplied tables hold no nulls, so queries that depend on them put some in by a rule that the SQL repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resultmart.functions import arrays as A
from resultmart.functions import text as T
from resultmart.operators import aggregate as G
from resultmart.operators import joins as J
from resultmart.operators import latest as L
from resultmart.operators import maintenance as M
from resultmart.operators import windows as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a function under its name, with its SQL."""

    def run(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


@query("""
SELECT o_custkey, o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_day FROM orders WHERE o_orderstatus = 'F'
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
""")
def latest_per_key(spark, d):
    return L.latest_per_key(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey", "o_totalprice", day("o_orderdate").alias("o_day"))


@query("""
SELECT o_custkey, o_orderkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) > 1
""")
def superseded_rows(spark, d):
    return L.superseded(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""
SELECT o_custkey, count(*) AS n_orders, array_to_string(list(o_orderkey ORDER BY o_orderkey DESC), ',') AS order_ids FROM orders GROUP BY 1 HAVING count(*) > 1
""")
def duplicate_audit(spark, d):
    ids = F.array_join(F.transform(F.reverse(A.agg_ordered(F.col("o_orderkey"), F.col("o_orderkey"))), lambda x: x.cast("string")), ",")
    return G.summarise(table(spark, d, "orders"), ["o_custkey"], {"n_orders": F.count("*"), "order_ids": ids}, F.col("n_orders") > 1)


@query("""
WITH p AS (SELECT lower(trim(coalesce(substr(s_name, 1, 17), ''))) AS name_key, s_nationkey AS nation, s_suppkey AS id FROM supplier
  UNION ALL SELECT lower(trim(coalesce(substr(c_name, 1, 17), ''))), c_nationkey, c_custkey FROM customer)
SELECT name_key, nation, count(DISTINCT id) AS n, array_to_string(list(DISTINCT id ORDER BY id), ',') AS ids FROM p GROUP BY 1, 2 HAVING count(DISTINCT id) > 1
""")
def identity_collisions(spark, d):
    key = lambda c: F.lower(F.trim(F.coalesce(F.substring(c, 1, 17), F.lit("")))).alias("name_key")
    s = table(spark, d, "supplier").select(key("s_name"), F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))
    c = table(spark, d, "customer").select(key("c_name"), F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"))
    ids = F.array_join(F.transform(A.agg_ordered(F.col("id"), distinct=True), lambda x: x.cast("string")), ",")
    return G.summarise(s.unionByName(c), ["name_key", "nation"], {"n": F.count_distinct("id"), "ids": ids}, F.col("n") > 1)


@query("""
WITH dead AS (SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) > 1),
o AS (SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM dead)),
l AS (SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM dead))
SELECT 'orders' AS label, count(*) AS rows, sum(o_orderkey)::BIGINT AS key_sum FROM o
UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey)::BIGINT FROM l
""")
def cascade_keep(spark, d):
    orders = table(spark, d, "orders").withColumn("id", F.col("o_orderkey"))
    lines = table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "order_id"}).withColumn("id", F.xxhash64("order_id", "l_partkey", "l_suppkey", "l_linenumber"))
    dead = L.superseded(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("id")
    kept = M.cascade_delete({"orders": orders, "lineitem": lines}, dead, {"lineitem": {"order_id": "orders"}}, root="orders")
    size = lambda df, label, key: df.agg(F.count("*").alias("rows"), F.sum(key).alias("key_sum")).select(F.lit(label).alias("label"), "rows", "key_sum")
    return size(kept["orders"], "orders", "id").unionByName(size(kept["lineitem"], "lineitem", "order_id"))


@query("""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS club, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE upper(trim(regexp_replace(c_name, '#', '  ', 'g'))) END AS name, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, regexp_replace(name, '\\s+', ' ', 'g') AS normalized_name, nullif(club, '') AS club, coalesce(nullif(club, ''), nullif(nation, '')) AS affiliation FROM c WHERE name <> ''
""".replace("\\\\", "\\"))
def clean_affiliation(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    club = F.when(F.col("c_custkey") % 5 == 0, "").when(F.col("c_custkey") % 7 == 0, None).otherwise(F.col("c_mktsegment"))
    name = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(T.normalize_name(F.regexp_replace("c_name", "#", "  ")))
    c = c.withColumns({"club": club, "normalized_name": name}).where(T.non_blank(F.col("normalized_name")))
    return c.select("c_custkey", "normalized_name", T.blank_to_null(F.col("club")).alias("club"), T.first_filled(F.col("club"), F.col("n_name")).alias("affiliation"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL
  WHEN o_orderkey % 6 = 3 AND day(o_orderdate) <= 12 AND month(o_orderdate) > 12 THEN NULL
  WHEN o_orderkey % 6 = 3 AND day(o_orderdate) <= 12 THEN strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d')
  ELSE strftime(o_orderdate, '%Y-%m-%d') END AS start_day
FROM orders
""")
def start_date_parse(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey") % 6
    fmt = lambda p: F.date_format("o_orderdate", p)
    text = F.when(k == 0, F.concat(fmt("d.M.yyyy"), F.lit(" - 1.1.2040"))).when(k == 1, fmt("dd/MM/yyyy")).when(k == 2, F.concat(fmt("d.M"), F.lit(" - 31.12."), fmt("yyyy"))).when(k == 3, fmt("M/d/yyyy")).when(k == 4, F.concat(fmt("dd.MM.yyyy"), F.lit(" evening"))).otherwise("31.02.2020")
    # a month-first text whose day could be a month is read day-first, and a day-first text whose month could be a day isn't
    return o.select("o_orderkey", day(T.parse_event_start(text)).alias("start_day"))


@query("""
SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS date_text, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day,
  CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) || '/' || (year(o_orderdate) + 1) ELSE (year(o_orderdate) - 1) || '/' || year(o_orderdate) END AS season
FROM orders
""")
def season_dim(spark, d):
    c = F.col("o_orderdate")
    return table(spark, d, "orders").select(day("o_orderdate").alias("date_text"), F.year(c).alias("year"), F.month(c).alias("month"), F.dayofmonth(c).alias("day"), T.season(c).alias("season")).distinct()


def _dimension(spark, d):
    club = F.when(F.col("c_custkey") % 4 == 0, None).otherwise(F.substring("c_name", -1, 1))
    c = table(spark, d, "customer").withColumn("club", club)
    groups = G.summarise(c, ["c_mktsegment", "c_nationkey", "club"], {"customers": F.count_distinct("c_custkey"), "lowest": F.min("c_acctbal"), "highest": F.max("c_acctbal")})
    return c, W.dense_key(groups, ["c_mktsegment", "c_nationkey", "club"], "dim_key")


_DIM = """
WITH c AS (SELECT *, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE right(c_name, 1) END AS club FROM customer),
dim AS (SELECT row_number() OVER (ORDER BY c_mktsegment, c_nationkey, club NULLS LAST) AS dim_key, c_mktsegment, c_nationkey, club, count(DISTINCT c_custkey) AS customers, min(c_acctbal) AS lowest, max(c_acctbal) AS highest FROM c GROUP BY c_mktsegment, c_nationkey, club)
"""


@query(_DIM + "SELECT * FROM dim")
def dense_dim(spark, d):
    return _dimension(spark, d)[1]


@query(_DIM + """
SELECT o_orderkey, dim_key, o_totalprice FROM orders LEFT JOIN c ON o_custkey = c_custkey
LEFT JOIN dim ON c.c_mktsegment IS NOT DISTINCT FROM dim.c_mktsegment AND c.c_nationkey IS NOT DISTINCT FROM dim.c_nationkey AND c.club IS NOT DISTINCT FROM dim.club
""")
def star_fact(spark, d):
    c, dim = _dimension(spark, d)
    facts = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return J.null_safe_join(facts, dim.select("dim_key", "c_mktsegment", "c_nationkey", "club"), ["c_mktsegment", "c_nationkey", "club"]).select("o_orderkey", "dim_key", "o_totalprice")


@query("""
WITH p AS (SELECT l_orderkey AS order_id, sum(l_extendedprice) AS total, CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE (l_orderkey % 2)::VARCHAR END AS mark FROM lineitem GROUP BY l_orderkey),
f AS (SELECT o_orderkey AS order_id, o_totalprice AS total, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 4)::VARCHAR END AS mark FROM orders)
SELECT order_id, round(total, 2) AS total, mark, 'detail' AS source FROM p
UNION ALL SELECT order_id, round(total, 2), mark, 'page' FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.order_id = f.order_id AND (coalesce(p.mark, '') = '' OR coalesce(f.mark, '') = '' OR p.mark = f.mark))
""")
def prefer_source(spark, d):
    k = F.col("l_orderkey")
    p = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("total")).select(k.alias("order_id"), "total", F.when(k % 3 == 0, "").otherwise((k % 2).cast("string")).alias("mark"), F.lit("detail").alias("source"))
    k = F.col("o_orderkey")
    f = table(spark, d, "orders").select(k.alias("order_id"), F.col("o_totalprice").alias("total"), F.when(k % 5 == 0, None).otherwise((k % 4).cast("string")).alias("mark"), F.lit("page").alias("source"))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    out = J.prefer_source(p, f, ["order_id"], compatible=lambda a, b: blank(a("mark")) | blank(b("mark")) | (a("mark") == b("mark")))
    return out.withColumn("total", F.round("total", 2))


@query("""
SELECT o_orderkey, o_custkey, lag(o_totalprice) OVER w AS previous_o_totalprice, round(o_totalprice - lag(o_totalprice) OVER w, 4) AS o_totalprice_delta
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END NULLS LAST, o_orderkey)
""")
def progression(spark, d):
    o = table(spark, d, "orders").withColumn("on", F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.col("o_orderdate")))
    out = W.progression(o, ["o_custkey"], ["on"], ["o_totalprice"], "o_orderkey")
    return out.select("o_orderkey", "o_custkey", "previous_o_totalprice", F.round("o_totalprice_delta", 4).alias("o_totalprice_delta"))


@query("""
SELECT CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey % 100 END AS club, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderdate) AS days, min(o_totalprice) AS lowest, max(o_totalprice) AS highest,
  array_to_string(list_transform(list(DISTINCT CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderpriority END ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderpriority END NULLS LAST), lambda x: coalesce(x, 'none')), '|') AS priorities
FROM orders GROUP BY 1
""")
def entity_summary(spark, d):
    club = F.when(F.col("o_custkey") % 10 == 0, None).otherwise(F.col("o_custkey") % 100)
    priority = F.when(F.col("o_orderpriority").startswith("1"), None).otherwise(F.col("o_orderpriority"))
    marks = F.array_join(F.transform(A.agg_ordered(priority, distinct=True), lambda x: F.coalesce(x, F.lit("none"))), "|")
    return G.summarise(table(spark, d, "orders"), [club.alias("club")], {"customers": F.count_distinct("o_custkey"), "days": F.count_distinct("o_orderdate"), "lowest": F.min("o_totalprice"), "highest": F.max("o_totalprice"), "priorities": marks})


@query("""
SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS negative, count(*) FILTER (WHERE c_name LIKE '%7') AS sevens, count(*) FILTER (WHERE NOT regexp_matches(c_mktsegment, '^[A-Z]{8}$')) AS odd FROM customer GROUP BY 1
""")
def quality_counts(spark, d):
    return G.summarise(table(spark, d, "customer"), ["c_mktsegment"], {"n": F.count("*"), "negative": A.count_where(F.col("c_acctbal") < 0), "sevens": A.count_where(F.col("c_name").endswith("7")), "odd": A.count_where(~F.col("c_mktsegment").rlike(r"^[A-Z]{8}\z"))})


@query("""
SELECT l_partkey, count(*) AS lines, count(DISTINCT l_suppkey) AS suppliers, max(l_extendedprice) AS best, strftime(min(l_shipdate), '%Y-%m-%d') AS first_day FROM lineitem GROUP BY 1
""")
def personal_bests(spark, d):
    return G.summarise(table(spark, d, "lineitem"), ["l_partkey"], {"lines": F.count("*"), "suppliers": F.count_distinct("l_suppkey"), "best": F.max("l_extendedprice"), "first_day": day(F.min("l_shipdate"))})


@query("""
SELECT page_id, url, d.doc_id, d.lang, l.quality FROM pages LEFT JOIN documents d ON d.doc_id = page_id LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def evidence_join(spark, d):
    pages, docs, labels = table(spark, d, "pages"), table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality")
    return pages.join(docs.join(labels, "doc_id", "left"), F.col("page_id") == F.col("doc_id"), "left").select("page_id", "url", "doc_id", "lang", "quality")


@query("""
WITH m AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderdate) >= 12)
SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_day, strftime(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), '%Y-%m-%d') AS previous_day FROM orders WHERE o_custkey IN (SELECT o_custkey FROM m)
""")
def multi_occurrence(spark, d, min_days: int = 12):
    o = table(spark, d, "orders")
    many = G.summarise(o, ["o_custkey"], {"n": F.count_distinct("o_orderdate")}, F.col("n") >= min_days).select("o_custkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.join(many, "o_custkey", "left_semi").select("o_custkey", "o_orderkey", day("o_orderdate").alias("o_day"), day(F.lag("o_orderdate").over(w)).alias("previous_day"))


@query("""
WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN lower(substr(p_type, 1, 3)) WHEN p_partkey % 2 = 0 THEN upper(substr(p_type, 1, 3)) ELSE p_type END AS code, p_brand FROM part)
SELECT code, count(*) AS n, count(DISTINCT p_brand) AS brands, CASE WHEN regexp_matches(code, '^[a-z]{3}$') THEN 'fragment' ELSE 'other' END AS kind FROM c WHERE NOT regexp_matches(code, '^[A-Z]{3}$') GROUP BY code ORDER BY n DESC, code LIMIT 25
""")
def nonconforming_codes(spark, d):
    k, t = F.col("p_partkey"), F.col("p_type")
    code = F.when(k % 9 == 0, None).when(k % 5 == 0, F.lower(F.substring(t, 1, 3))).when(k % 2 == 0, F.upper(F.substring(t, 1, 3))).otherwise(t)
    found = table(spark, d, "part").withColumn("code", code).where(T.not_iso3(F.col("code")))
    out = G.summarise(found, ["code"], {"n": F.count("*"), "brands": F.count_distinct("p_brand")})
    return L.top(out.withColumn("kind", T.choose_by([(T.lower_fragment(F.col("code")), "fragment")], "other")), [F.desc("n")], 25, ["code"])


@query("""
SELECT o_orderkey, count(l_orderkey) AS lines, count(l_orderkey) FILTER (WHERE l_returnflag = 'R') AS returned, CASE WHEN count(l_orderkey) = 0 THEN 'empty_category' WHEN count(l_orderkey) FILTER (WHERE l_returnflag = 'R') = 0 THEN 'missing_results_with_entries' ELSE 'complete' END AS state
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1
""")
def missing_classified(spark, d):
    counts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), A.count_where(F.col("l_returnflag") == "R").alias("returned"))
    out = table(spark, d, "orders").select("o_orderkey").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").fillna(0, ["lines", "returned"])
    return out.select("o_orderkey", "lines", "returned", T.choose_by([(F.col("lines") == 0, "empty_category"), (F.col("returned") == 0, "missing_results_with_entries")], "complete").alias("state"))


@query("""
WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)
SELECT lang, word, count(*) AS n FROM w GROUP BY 1, 2
""")
def token_usage(spark, d):
    words = table(spark, d, "documents").select("lang", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("words"))
    return A.explode_tokens(words, "words", "word").groupBy("lang", "word").agg(F.count("*").alias("n"))


_ALIAS = """
WITH a AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' ' || lower(p_brand) WHEN 1 THEN replace(p_brand, '#', ' #  ') WHEN 2 THEN upper(p_brand) || ' ' ELSE p_brand END AS club FROM part),
n AS (SELECT *, lower(regexp_replace(trim(club), '\\s+', ' ', 'g')) AS k FROM a)
""".replace("\\\\", "\\")


def _aliases(spark, d):
    b, k = F.col("p_brand"), F.col("p_partkey") % 4
    club = F.when(k == 0, F.concat(F.lit(" "), F.lower(b))).when(k == 1, F.replace(b, F.lit("#"), F.lit(" #  "))).when(k == 2, F.concat(F.upper(b), F.lit(" "))).otherwise(b)
    parts = table(spark, d, "part").select("p_partkey", club.alias("club"))
    clubs = spark.createDataFrame([], "club_id string, canonical_name string, status string")
    aliases = spark.createDataFrame([], "alias_name string, alias_normalized string, club_id string, confidence string")
    return parts, *M.register_missing_aliases(parts, clubs, aliases)


@query(_ALIAS + "SELECT k AS alias_normalized, min(trim(club)) AS alias_name, 'review' AS confidence FROM n WHERE trim(club) <> '' GROUP BY k")
def alias_registry(spark, d):
    return _aliases(spark, d)[2].select("alias_normalized", "alias_name", "confidence")


@query(_ALIAS + ", r AS (SELECT k, min(trim(club)) AS canonical_name FROM n GROUP BY k) SELECT canonical_name, count(p_partkey) AS uses, count(DISTINCT club) AS spellings FROM r JOIN n USING (k) GROUP BY 1")
def alias_usage(spark, d):
    parts, clubs, aliases = _aliases(spark, d)
    return J.resolve_alias(parts, "club", aliases, clubs).groupBy("canonical_name").agg(F.count("p_partkey").alias("uses"), F.count_distinct("club").alias("spellings"))


@query("""
WITH b AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price, CASE WHEN o_orderpriority LIKE '1%' THEN 'old' END AS note, o_orderpriority AS kept FROM orders WHERE o_orderstatus <> 'P'),
u AS (SELECT l_orderkey AS id, 'R' AS status, CASE WHEN max(l_tax) > 0.07 THEN NULL ELSE max(l_extendedprice) END AS price, 'new' AS note, 'x' AS kept FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT coalesce(b.id, u.id) AS id, CASE WHEN b.id IS NULL THEN u.status WHEN u.id IS NULL OR b.status = 'F' THEN b.status ELSE u.status END AS status, coalesce(u.price, b.price) AS price,
  CASE WHEN b.id IS NULL THEN u.note WHEN u.id IS NULL THEN b.note ELSE concat_ws(chr(10), b.note, u.note) END AS note, CASE WHEN b.id IS NULL THEN u.kept ELSE b.kept END AS kept
FROM b FULL JOIN u ON b.id = u.id
""")
def upsert_policy(spark, d):
    """Orders that aren't pending, changed by their returned lines; returned lines of pending orders are new."""
    b = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.when(F.col("o_orderpriority").startswith("1"), "old").alias("note"), F.col("o_orderpriority").alias("kept"))
    u = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.lit("R").alias("status"), F.when(F.max("l_tax") > 0.07, None).otherwise(F.max("l_extendedprice")).alias("price"), F.lit("new").alias("note"), F.lit("x").alias("kept"))
    return M.upsert(b, u, ["id"], {"status": M.guard("F"), "price": "coalesce", "note": "append", "kept": "keep"})


@query("SELECT row_number() OVER (ORDER BY c_mktsegment, c_name, c_custkey) AS customer_key, c_custkey FROM customer")
def dense_customers(spark, d):
    """A key set that grows with its table."""
    return W.dense_key(table(spark, d, "customer"), ["c_mktsegment", "c_name", "c_custkey"], "customer_key").select("customer_key", "c_custkey")


@query("""
WITH b AS (SELECT o_custkey AS k, min(o_orderkey) AS first_order FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), u AS (SELECT c_custkey AS k, -1::BIGINT AS first_order FROM customer)
SELECT * FROM b UNION ALL SELECT * FROM u WHERE k NOT IN (SELECT k FROM b)
""")
def insert_or_ignore(spark, d):
    b = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("first_order"))
    return M.insert_ignore(b, table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(-1).cast("long").alias("first_order")), ["k"])


@query("""
WITH r0 AS (SELECT c_custkey, c_mktsegment AS club, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE n_name END AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey),
r1 AS (SELECT c_custkey, CASE WHEN nation = '' THEN nation ELSE club END AS club, CASE WHEN nation = '' THEN club ELSE nation END AS nation, nation = '' AS swapped FROM r0),
r2 AS (SELECT c_custkey, CASE WHEN club = '' THEN NULL ELSE club END AS club, nation, swapped FROM r1)
SELECT c_custkey, club, CASE WHEN club IS NULL AND swapped THEN lower(nation) ELSE nation END AS nation, swapped AS noted FROM r2
""")
def rule_chain(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select("c_custkey", F.col("c_mktsegment").alias("club"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("n_name")).alias("nation"), F.create_map().cast("map<string,string>").alias("raw"))
    out = M.apply_rules(rows, [M.Rule("swap", F.col("nation") == "", {"club": F.col("nation"), "nation": F.col("club")}, ["club", "nation"]), M.Rule("blank", F.col("club") == "", {"club": F.lit(None).cast("string")}), M.Rule("lower", F.col("club").isNull() & F.map_contains_key("raw", "swap"), {"nation": F.lower("nation")})])
    return out.select("c_custkey", "club", "nation", F.map_contains_key("raw", "swap").alias("noted"))


_PREFIXES = [("example.com", "/", "com"), ("example.com", "/en", "com-en"), ("example.com", "/en/1", "com-en-1"), ("example.net", "/d", "net-d"), ("example.net", "/de/", "net-de"), ("example.org", "", "org"), ("example.org", "/fr/2", "org-fr-2")]


@query("""
WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*?([a-z0-9-]+\\.[a-z]+)(?:[/?#]|$)', 1) AS site, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
p(site, prefix, profile) AS (VALUES %s)
SELECT page_id, u.site, path, prefix, profile FROM u LEFT JOIN p ON u.site = p.site AND starts_with(path, prefix) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC NULLS LAST) = 1
""".replace("\\\\", "\\") % ", ".join(map(str, _PREFIXES)))
def prefix_profile(spark, d):
    site = F.regexp_extract("url", r"^[a-z]+://[^/?#]*?([a-z0-9-]+\.[a-z]+)(?:[/?#]|$)", 1)
    u = table(spark, d, "pages").select("page_id", site.alias("site"), T.url_path(F.col("url")).alias("path"))
    profiles = spark.createDataFrame(_PREFIXES, "site string, prefix string, profile string")
    return J.longest_prefix_join(u, profiles, ["page_id"], "site", "path", "prefix").select("page_id", "site", "path", "prefix", "profile")


@query("""
SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k, min(json_extract_string(props, '$.k')) AS least, max(length(props))::INT AS longest FROM events GROUP BY 1
""")
def json_props(spark, d):
    k = A.json_field(F.col("props"), "k")
    return G.summarise(table(spark, d, "events"), ["event_type"], {"n": F.count("*"), "with_k": F.count(k), "least": F.min(k), "longest": F.max(F.length("props"))})


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::INT AS qty, l_returnflag AS flag, l_linestatus AS status, NULL::VARCHAR AS gone FROM lineitem
""")
def header_map_wide(spark, d):
    names = F.array(*[F.lit(x) for x in ("Qty", "Flag", "", "Status", "Flag")])
    flag = F.col("l_returnflag")
    cells = F.array(F.col("l_quantity").cast("int").cast("string"), F.lit("first"), F.lit("no name"), F.col("l_linestatus"), flag)
    m = A.zip_map(names, cells)
    return table(spark, d, "lineitem").withColumn("m", m).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", T.to_int(F.element_at("m", F.lit("Qty"))).alias("qty"), F.element_at("m", F.lit("Flag")).alias("flag"), F.element_at("m", F.lit("Status")).alias("status"), F.try_element_at("m", F.lit("Gone")).alias("gone"))


@query("""
WITH m AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, [l_quantity, l_discount, l_tax] AS marks FROM lineitem)
SELECT l_orderkey, judge, count(*) AS n, round(sum(mark), 4) AS total FROM (SELECT l_orderkey, unnest([1, 2, 3])::INT AS judge, unnest(marks) AS mark FROM m) GROUP BY 1, 2
""")
def long_marks(spark, d):
    marks = table(spark, d, "lineitem").select("l_orderkey", F.array("l_quantity", "l_discount", "l_tax").alias("marks"))
    return A.enumerate_rows(marks, "marks", "judge", "mark").groupBy("l_orderkey", "judge").agg(F.count("*").alias("n"), F.round(F.sum("mark"), 4).alias("total"))


@query("""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS place FROM pages)
SELECT page_id, href, min(place)::INT AS place FROM l GROUP BY 1, 2
""")
def link_extract(spark, d):
    links = A.enumerate_rows(table(spark, d, "pages").select("page_id", F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)).alias("links")), "links", "place", "href")
    return L.dedupe_first(links, ["page_id", "href"], "place").select("page_id", "href", "place")


@query("""
WITH u AS (SELECT page_id, html, coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ''), '_no_host') AS host, regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '') AS raw,
  list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '') AS q FROM pages),
v AS (SELECT *, coalesce(nullif(trim(raw, '/'), ''), 'index') AS path FROM u),
w AS (SELECT *, CASE WHEN raw LIKE '%/' OR NOT contains(regexp_extract(path, '[^/]*$'), '.') THEN rtrim(path, '/') || '/index.html' ELSE path END AS file FROM v)
SELECT page_id, sha256(html) AS sha256, host || '/' || file || CASE WHEN len(q) > 0 THEN '__query_' || array_to_string(list_transform(q, lambda x: url_encode(url_decode(replace(split_part(x, '=', 1), '+', ' '))) || '-' || url_encode(url_decode(replace(CASE WHEN contains(x, '=') THEN substr(x, strpos(x, '=') + 1) ELSE '' END, '+', ' ')))), '_') ELSE '' END AS archive_path,
  CASE WHEN length(html) > 0 THEN 'written' ELSE 'skipped' END AS status FROM w
""".replace("\\\\", "\\"))
def doc_manifest(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", T.content_hash(F.col("html")).alias("sha256"), T.archive_path(F.col("url")).alias("archive_path"), F.when(F.length("html") > 0, "written").otherwise("skipped").alias("status"))


@query("""
WITH s AS (SELECT l_orderkey, sum((l_extendedprice * (1 - l_discount) * (1 + l_tax))::DECIMAL(18, 4)) AS net, sum(l_extendedprice::DECIMAL(18, 2)) AS gross FROM lineitem GROUP BY 1)
SELECT o_orderkey, net::DOUBLE AS net, gross::DOUBLE AS gross FROM orders JOIN s ON o_orderkey = l_orderkey WHERE abs(net - o_totalprice::DECIMAL(18, 2)) > 0.02 AND abs(gross - o_totalprice::DECIMAL(18, 2)) > 0.02
""")
def arithmetic_check(spark, d):
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")), 4).cast("decimal(18,4)")
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(net).alias("net"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("gross"))
    o, price = table(spark, d, "orders"), F.col("o_totalprice").cast("decimal(18,2)")
    off = lambda c: F.abs(F.col(c) - price) > F.lit("0.02").cast("decimal(4,2)")
    return o.join(s, F.col("o_orderkey") == F.col("l_orderkey")).where(off("net") & off("gross")).select("o_orderkey", F.col("net").cast("double").alias("net"), F.col("gross").cast("double").alias("gross"))


@query("""
SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS user_turn FROM conversations
""")
def carry_forward(spark, d):
    return W.carry_forward(table(spark, d, "conversations"), ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "user_turn").select("conv_id", "turn", "role", "user_turn")


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS label, count(*) AS rows FROM {t}" for t in _TABLES))
def mart_counts(spark, d):
    return G.labelled_counts(**{t: table(spark, d, t) for t in _TABLES})


@query("""
SELECT o_orderpriority, strftime(o_orderdate, '%Y') AS y, count(*) AS n, count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F') AS finished, max(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS last_pending FROM orders GROUP BY 1, 2
""")
def filtered_aggregates(spark, d):
    status = F.col("o_orderstatus")
    return G.summarise(table(spark, d, "orders"), ["o_orderpriority", F.date_format("o_orderdate", "yyyy").alias("y")], {"n": F.count("*"), "finished": F.count_distinct(F.when(status == "F", F.col("o_custkey"))), "last_pending": F.max(F.when(status == "P", F.col("o_orderkey")))})


@query("""
SELECT url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, CASE WHEN lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) LIKE '%.pdf' THEN 'judges_scores_pdf' ELSE 'html' END AS document_type, page_id FROM pages
""")
def url_context(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("url", T.source_context(u)["host"].alias("host"), T.source_context(u)["path"].alias("path"), T.document_type(u).alias("document_type"), "page_id")
