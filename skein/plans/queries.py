"""The library's operators as queries over the test tables, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scalars as S
from ..operators import dedup, extract, folds, joins, matching, ranking, state
from ..operators.dedup_index import DedupIndex
from ..sources import answers, readers
from ..streaming import stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """``t.orders`` is that table of the folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _values(rows: list[tuple]) -> str:
    """Rows as an SQL list of values."""
    return ", ".join("(" + ", ".join("'" + str(v) + "'" for v in r) + ")" for r in rows)


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _any(words: list[str], column: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


# Ranking, limits and batches.


@query("""
WITH c AS (SELECT d.source, avg(l.quality) AS confidence, count(*) AS n_evidence FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source),
s AS (SELECT *, round_even(0.6::DOUBLE * confidence + 0.4::DOUBLE * least(n_evidence / 20.0::DOUBLE, 1.0::DOUBLE), 2) AS score FROM c)
SELECT row_number() OVER (ORDER BY score DESC, confidence DESC, source)::INTEGER AS rank, source, confidence, n_evidence, score FROM s""")
def evidence_ranking(t: Tables) -> DataFrame:
    c = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.avg("quality").alias("confidence"), F.count(F.lit(1)).alias("n_evidence"))
    return ranking.evidence_ranking(c, "confidence", "n_evidence", [F.asc("source")]).select("rank", "source", "confidence", "n_evidence", "score")


@query("SELECT s_suppkey, s_name, s_acctbal, row_number() OVER (ORDER BY s_acctbal, s_suppkey)::INTEGER AS pos FROM supplier")
def stable_sort(t: Tables) -> DataFrame:
    return ranking.positions(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), [F.asc("s_acctbal"), F.asc("s_suppkey")]).withColumn("pos", F.col("pos").cast("int"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def topk(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15)


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders) WHERE rank <= 5")
def topk_per_group(t: Tables) -> DataFrame:
    return ranking.top_per_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ', ' ORDER BY r) || CASE WHEN max(n) > 3 THEN ' +' || (max(n) - 3)::VARCHAR || ' more' ELSE '' END AS summary FROM r WHERE r <= 3 GROUP BY o_custkey""")
def topk_with_remainder(t: Tables) -> DataFrame:
    return ranking.with_remainder(t.orders, "o_custkey", [F.asc("o_orderkey")], 3, "o_orderkey")


@query("SELECT o_custkey, o_orderkey, floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 10)::INTEGER AS batch FROM orders")
def batch_assign(t: Tables) -> DataFrame:
    return ranking.batches(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], [F.asc("o_orderkey")], 10)


@query("SELECT * FROM (SELECT p_partkey, p_name, p_size FROM part ORDER BY contains(p_name, 'ring') DESC, p_partkey LIMIT 15)")
def preferred_first_topk(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_name", "p_size").orderBy(F.contains("p_name", F.lit("ring")).desc(), "p_partkey").limit(15)


@query("SELECT * FROM (SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_partkey LIMIT 100) WHERE NOT (p_size < 10 AND p_retailprice > 900)")
def limit_then_filter(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_size", "p_retailprice").orderBy("p_partkey").limit(100).filter(~((F.col("p_size") < 10) & (F.col("p_retailprice") > 900)))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7 OR NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 7)")
def filter_or_all(t: Tables) -> DataFrame:
    return ranking.filter_or_all(t.nation.select("n_nationkey", "n_name"), F.col("n_nationkey") == 7)


@query("SELECT n_nationkey, n_name FROM nation")
def filter_or_all_no_match(t: Tables) -> DataFrame:
    return ranking.filter_or_all(t.nation.select("n_nationkey", "n_name"), F.col("n_nationkey") == -1)


# Projections and predicates.


@query("SELECT doc_id, coalesce(lang, '') AS language, substr(coalesce(text, ''), 1, 200) AS description FROM documents")
def project_truncate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("language"), F.substring(F.coalesce("text", F.lit("")), 1, 200).alias("description"))


@query("SELECT page_id, CASE WHEN coalesce(nullif(regexp_extract(url, '[?](.*)$', 1), ''), '') <> '' THEN regexp_extract(url, '[?](.*)$', 1) WHEN regexp_extract(url, '#(.*)$', 1) <> '' THEN regexp_extract(url, '#(.*)$', 1) ELSE url END AS registry_url FROM pages")
def falsy_coalesce(t: Tables) -> DataFrame:
    return t.pages.select("page_id", S.falsy_coalesce(F.regexp_extract("url", "[?](.*)$", 1), F.regexp_extract("url", "#(.*)$", 1), F.col("url")).alias("registry_url"))


@query("""SELECT page_id, CASE WHEN starts_with(target, 'http') THEN 'external' WHEN starts_with(target, 'src/') THEN 'source' WHEN starts_with(target, 'modules/') THEN 'module'
 WHEN starts_with(target, 'project/') THEN 'project' WHEN starts_with(target, 'schema/') THEN 'schema' ELSE 'name' END AS kind
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'src/a.py#f' WHEN 2 THEN 'modules/m' WHEN 3 THEN 'schema/s' ELSE 'Heading' END AS target FROM pages)""")
def classify_links(t: Tables) -> DataFrame:
    m = F.col("page_id") % 5
    target = F.when(m == 0, F.col("url")).when(m == 1, "src/a.py#f").when(m == 2, "modules/m").when(m == 3, "schema/s").otherwise("Heading")
    return t.pages.select("page_id", S.link_kind(target).alias("kind"))


@query("SELECT l_orderkey, l_linenumber, l_discount BETWEEN 0 AND 0.05 AS discount_ok, l_linenumber >= 1 AND l_quantity >= l_linenumber AS lines_ok, l_returnflag IN ('A', 'N') AS flag_ok FROM lineitem")
def validate_ranges(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_discount").between(0, 0.05).alias("discount_ok"), ((F.col("l_linenumber") >= 1) & (F.col("l_quantity") >= F.col("l_linenumber"))).alias("lines_ok"), F.col("l_returnflag").isin("A", "N").alias("flag_ok"))


@query("""SELECT d.doc_id, concat_ws(', ', CASE WHEN l.quality IS NULL THEN 'quality' END, CASE WHEN l.toxic IS NULL THEN 'toxic' END, CASE WHEN d.text IS NULL THEN 'text' END) AS missing
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def missing_fields(t: Tables) -> DataFrame:
    j = t.documents.select("doc_id", "text").join(t.labels, "doc_id", "left")
    return j.select("doc_id", F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in ("quality", "toxic", "text")]).alias("missing"))


@query("""SELECT o_custkey, string_agg(k || '=' || n::VARCHAR, ',' ORDER BY k) AS seats FROM
 (SELECT o_custkey, o_orderstatus AS k, count(*) AS n FROM orders GROUP BY ALL) WHERE n > 1 GROUP BY o_custkey""")
def map_filter_values(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    kept = F.map_filter("m", lambda k, v: v > 1)
    label = F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return m.filter(F.size(kept) > 0).select("o_custkey", label.alias("seats"))


# Joins.


@query("""
WITH p AS (SELECT l_orderkey AS k, arg_max(l_extendedprice, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey) AS last_price FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL) GROUP BY l_orderkey)
SELECT o_orderkey, o_totalprice, last_price FROM orders LEFT JOIN p ON o_orderkey = k""")
def left_lookup_join(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("last_price"))
    prices = lines.select(F.col("l_orderkey").alias("o_orderkey"), "last_price", (F.col("l_linenumber") * F.lit(1000000000000) + F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("seq"))
    return joins.left_lookup(t.orders.select("o_orderkey", "o_totalprice"), prices, ["o_orderkey"], ["last_price"], "seq")


@query("""
WITH a AS (SELECT l_partkey AS p, l_suppkey AS s, l_returnflag AS f, max(l_extendedprice) AS price FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, price FROM lineitem LEFT JOIN a ON p = l_partkey AND s = l_suppkey AND f = l_returnflag""")
def composite_left_join(t: Tables) -> DataFrame:
    keys = ["l_partkey", "l_suppkey", "l_returnflag"]
    prices = t.lineitem.filter("l_returnflag = 'A'").groupBy(*keys).agg(F.max("l_extendedprice").alias("price"))
    return t.lineitem.join(prices, keys, "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price")


@query("""
SELECT c_custkey, o.o_orderkey AS top_order, o.o_totalprice AS top_price FROM customer LEFT JOIN
 (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) o ON o.o_custkey = c_custkey AND n = 1""")
def lateral_top1_enrich(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("top_order"), F.col("o_totalprice").alias("top_price"))
    return joins.top1_lateral(t.customer.select("c_custkey"), o, "c_custkey", [F.desc("top_price"), F.asc("top_order")], ["top_order", "top_price"])


_NAMES = ["Polars", "nodejs-polars", "ts-node", "Kotlin_Stdlib", "jackson", "left-pad", "GSON", "requests"]


@query(f"""
WITH a(k, canonical) AS (VALUES {_values([(n, c) for n, c, _ in C.ALIASES])}),
n AS (SELECT p_partkey, [{", ".join(f"'{n}'" for n in _NAMES)}][(p_partkey % 8)::INTEGER + 1] AS name FROM part)
SELECT p_partkey, name, coalesce(canonical, name) AS canonical, canonical IS NOT NULL AS is_alias FROM n LEFT JOIN a ON replace(lower(name), '-', '_') = k""")
def alias_lookup(t: Tables) -> DataFrame:
    aliases = t.spark.createDataFrame([(n, c) for n, c, _ in C.ALIASES], "key string, canonical string")
    names = t.part.select("p_partkey", F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % 8 + 1).cast("int")).alias("name"))
    j = names.withColumn("key", F.replace(F.lower("name"), F.lit("-"), F.lit("_"))).join(F.broadcast(aliases), "key", "left")  # a constant table
    return j.select("p_partkey", "name", F.coalesce("canonical", "name").alias("canonical"), F.col("canonical").isNotNull().alias("is_alias"))


_LANGS = ["python", "javascript", "rust", "java", "kotlin", "c_cpp", "go"]


@query(f"""
WITH r(s, d, mode, bridge) AS (VALUES {_values([x[:4] for x in C.STRATEGIES])}),
p AS (SELECT s_suppkey, [{_in(_LANGS)}][(s_suppkey % 7)::INTEGER + 1] AS src, [{_in(_LANGS)}][((s_suppkey // 7) % 7)::INTEGER + 1] AS dst FROM supplier)
SELECT s_suppkey, src, dst, coalesce(mode, 'subprocess_json') AS mode, coalesce(bridge, src) AS bridge_lang FROM p LEFT JOIN r ON r.s = src AND r.d = dst""")
def rule_lookup_default(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([x[:4] for x in C.STRATEGIES], "src string, dst string, mode string, bridge_lang string")
    at = lambda c: F.element_at(F.array(*map(F.lit, _LANGS)), (c % 7 + 1).cast("int"))
    p = t.supplier.select("s_suppkey", at(F.col("s_suppkey")).alias("src"), at(F.floor(F.col("s_suppkey") / 7)).alias("dst"))
    return joins.lookup_default(p, rules, ["src", "dst"], {"mode": F.lit("subprocess_json"), "bridge_lang": F.col("src")})


_LICENSES = ["MIT", "GPL-3.0", "LGPL-2.1", "", "Custom", "MPL-2.0", "AGPL-3.0", " ISC "]


@query(f"""
WITH c(k, cat) AS (VALUES {_values([(x, cat) for cat, ids in C.LICENSE_CATEGORIES.items() for x in ids])}), r(s, d, mode) AS (VALUES {_values(C.REUSE_RULES)}),
p AS (SELECT c_custkey, [{_in(_LICENSES)}][(c_custkey % 8)::INTEGER + 1] AS a, [{_in(_LICENSES)}][((c_custkey // 8) % 8)::INTEGER + 1] AS b FROM customer),
q AS (SELECT p.*, CASE WHEN trim(a) = '' THEN 'unknown' ELSE coalesce(x.cat, 'proprietary') END AS ca, CASE WHEN trim(b) = '' THEN 'unknown' ELSE coalesce(y.cat, 'proprietary') END AS cb
  FROM p LEFT JOIN c x ON x.k = trim(a) LEFT JOIN c y ON y.k = trim(b))
SELECT c_custkey, a AS source_license, b AS target_license, coalesce(mode, 'reference_only') AS reuse FROM q LEFT JOIN r ON r.s = ca AND r.d = cb""")
def two_level_rule_join(t: Tables) -> DataFrame:
    at = lambda c: F.element_at(F.array(*map(F.lit, _LICENSES)), (c % 8 + 1).cast("int"))
    p = t.customer.select("c_custkey", at(F.col("c_custkey")).alias("source_license"), at(F.floor(F.col("c_custkey") / 8)).alias("target_license"))
    return p.withColumn("reuse", matching.reuse_mode(F.col("source_license"), F.col("target_license")))


_REQS = ["Brand#1", "brand#12 economy", "PROMO", "no such thing"]


@query(f"""
WITH gaps AS (SELECT DISTINCT s_nationkey AS k, l_partkey AS pos, lower(p_brand || ' ' || p_type) AS req, CASE WHEN p_size < 15 THEN ' Yes ' WHEN p_size < 35 THEN 'partially' ELSE 'no' END AS st FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey),
reqs(requirement) AS (VALUES {_values([(r,) for r in _REQS])}),
hit AS (SELECT k, requirement, arg_min(st, pos) AS st FROM gaps, reqs WHERE contains(req, lower(requirement)) OR contains(lower(requirement), req) GROUP BY ALL)
SELECT n.k AS s_nationkey, requirement, CASE lower(trim(coalesce(st, ''))) WHEN 'yes' THEN 'supported' WHEN 'partially' THEN 'partial' ELSE 'missing' END AS status
FROM (SELECT DISTINCT k FROM gaps) n CROSS JOIN reqs LEFT JOIN hit USING (k, requirement)""")
def coverage_theta_first(t: Tables) -> DataFrame:
    pairs = t.lineitem.join(t.supplier.withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey").select("s_nationkey", "l_partkey")
    st = F.when(F.col("p_size") < 15, " Yes ").when(F.col("p_size") < 35, "partially").otherwise("no")
    gaps = pairs.join(t.part.withColumnRenamed("p_partkey", "l_partkey"), "l_partkey").select("s_nationkey", F.col("l_partkey").alias("pos"), F.concat_ws(" ", "p_brand", "p_type").alias("gap"), st.alias("status"))
    wanted = t.spark.createDataFrame([(r,) for r in _REQS], "requirement string")
    return joins.coverage(gaps, "s_nationkey", "gap", "pos", "status", wanted, "requirement", S.normalize_status, t.part.select(F.concat_ws(" ", "p_brand", "p_type").alias("gap")))


@query("""
WITH o AS (SELECT n_nationkey AS k, p_partkey AS pos, lower(p_name) AS req, CASE WHEN p_size < 15 THEN 'yes' WHEN p_size < 35 THEN 'PARTIAL ' ELSE 'no' END AS st FROM part JOIN nation ON p_partkey % 25 = n_nationkey),
reqs AS (SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN split_part(p_name, ' ', 1) WHEN s_suppkey % 3 = 1 THEN 'a ' || upper(p_name) || ' of all' ELSE left(p_name, 4) END AS requirement FROM supplier JOIN part ON p_partkey = s_suppkey),
hit AS (SELECT k, requirement, arg_min(st, pos) AS st FROM o JOIN reqs ON contains(req, lower(requirement)) OR contains(lower(requirement), req) GROUP BY ALL)
SELECT n.k AS n_nationkey, requirement, CASE lower(trim(coalesce(st, ''))) WHEN 'yes' THEN 'supported' WHEN 'partial' THEN 'partial' ELSE 'missing' END AS status FROM (SELECT DISTINCT k FROM o) n CROSS JOIN reqs LEFT JOIN hit USING (k, requirement)""")
def coverage_of_tables(t: Tables) -> DataFrame:
    """Requirements that are a table, in both directions: parts of gaps' texts and texts around them."""
    st = F.when(F.col("p_size") < 15, "yes").when(F.col("p_size") < 35, "PARTIAL ").otherwise("no")
    gaps = t.part.select((F.col("p_partkey") % 25).alias("n_nationkey"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("gap"), st.alias("status"))
    kind = F.col("s_suppkey") % 3
    asked = t.supplier.join(t.part.select(F.col("p_partkey").alias("s_suppkey"), "p_name"), "s_suppkey").select(F.when(kind == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).when(kind == 1, F.concat(F.lit("a "), F.upper("p_name"), F.lit(" of all"))).otherwise(F.left("p_name", F.lit(4))).alias("requirement"))
    return joins.coverage(gaps, "n_nationkey", "gap", "pos", "status", asked, "requirement", S.normalize_status)


@query("""
WITH s AS (SELECT DISTINCT p_brand AS k FROM part WHERE p_size < 4), m AS (SELECT DISTINCT p_brand AS k, p_type, p_partkey FROM part)
SELECT k AS p_brand, count(*) AS n_places, min(p_partkey) AS first_place FROM m SEMI JOIN s USING (k) GROUP BY k""")
def reverse_index(t: Tables) -> DataFrame:
    r = joins.reverse_index(t.part.select("p_brand", "p_partkey"), t.part.filter("p_size < 4"), "p_brand", ["p_partkey"])
    return r.select("p_brand", F.size("places").cast("long").alias("n_places"), F.element_at("places", 1)["p_partkey"].alias("first_place"))


_WANTED = ["small ring", "RED", "ing", "zzz", "widget"]


@query(f"""
WITH w(wanted) AS (VALUES {_values([(x,) for x in _WANTED])}), n AS (SELECT p_name, min(p_partkey) AS seq FROM part GROUP BY p_name),
c AS (SELECT wanted, p_name, seq, CASE WHEN p_name = wanted THEN 0 ELSE 1 END AS kind FROM w JOIN n ON contains(lower(p_name), lower(wanted))),
b AS (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY kind, seq) AS r FROM c)
SELECT w.wanted, p_name AS match, CASE WHEN kind = 0 THEN 'exact' WHEN kind = 1 THEN 'partial' ELSE 'none' END AS match_kind FROM w LEFT JOIN b ON b.wanted = w.wanted AND r = 1""")
def exact_else_partial(t: Tables) -> DataFrame:
    wanted = t.spark.createDataFrame([(x,) for x in _WANTED], "wanted string")
    return joins.exact_else_partial(wanted, t.part.select("p_name", F.col("p_partkey").alias("seq")), "wanted", "p_name", "seq")


@query(f"""
WITH w(wanted) AS (VALUES {_values([(x,) for x in _WANTED])}),
c AS (SELECT wanted, count(*) AS n, max((lower(p_name) = lower(wanted))::INTEGER) AS same FROM w JOIN (SELECT DISTINCT p_name FROM part) ON contains(lower(p_name), lower(wanted)) GROUP BY wanted)
SELECT w.wanted, coalesce(n, 0) AS n_matches, CASE WHEN same = 1 THEN 'exact' WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS outcome FROM w LEFT JOIN c USING (wanted)""")
def match_cardinality(t: Tables) -> DataFrame:
    return joins.match_cardinality(t.spark.createDataFrame([(x,) for x in _WANTED], "wanted string"), t.part, "wanted", "p_name")


@query("SELECT c_custkey, c_name FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
def anti_orphans(t: Tables) -> DataFrame:
    """Customers without a pending order; all have orders of some kind."""
    return t.customer.select("c_custkey", "c_name").join(t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages), x AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*/[a-z]*)', 1) AS prefix FROM pages WHERE contains(url, '?'))
SELECT page_id, path FROM p WHERE NOT EXISTS (SELECT 1 FROM x WHERE p.path = x.prefix OR starts_with(p.path, x.prefix || '/'))""")
def prefix_theta_anti(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path"))
    prefixes = t.pages.filter("contains(url, '?')").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*/[a-z]*)", 1).alias("prefix"))
    return joins.without_prefix(rows, prefixes, "path", "prefix").select("page_id", "path")


@query("SELECT n.word, p.p_partkey FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS word FROM part) n JOIN part p ON contains(lower(p.p_name), lower(n.word))")
def contains_join(t: Tables) -> DataFrame:
    words = t.part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word")).distinct()
    return joins.contains_join(words, t.part.select("p_partkey", "p_name"), "word", "p_name").select("word", "p_partkey")


@query("""
WITH s AS (SELECT l_partkey, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS stars FROM (SELECT l_partkey, l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) GROUP BY l_partkey)
SELECT p_partkey, stars, coalesce(stars, 0) * 2 + p_size AS rescored FROM part LEFT JOIN s ON p_partkey = l_partkey""")
def last_wins_augment(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("stars")).withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    j = joins.left_lookup(t.part.select("p_partkey", "p_size"), s, ["p_partkey"], ["stars"], "seq")
    return j.select("p_partkey", "stars", (F.coalesce("stars", F.lit(0.0)) * 2 + F.col("p_size")).alias("rescored"))


# Dedup.


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents WHERE trim(coalesce(text, '')) <> '') WHERE n = 1 UNION ALL SELECT doc_id, source FROM documents WHERE trim(coalesce(text, '')) = ''")
def exact_dedup_sha256(t: Tables) -> DataFrame:
    key = F.when(F.coalesce(F.trim("text"), F.lit("")) != "", F.sha2("text", 256))
    return dedup.first_per_key(t.documents, key, "doc_id").select("doc_id", "source")


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS n FROM part), also AS (SELECT lower(p_name) AS k, p_brand, min(p_partkey) AS first FROM n WHERE n > 1 GROUP BY ALL),
g AS (SELECT lower(p_name) AS k, arg_min(p_name, p_partkey) AS p_name, min(p_partkey) AS p_partkey, max(p_retailprice) AS best FROM part GROUP BY 1)
SELECT p_name, p_partkey, best, coalesce((SELECT string_agg(p_brand, ',' ORDER BY first) FROM also WHERE also.k = g.k), '') AS also FROM g""")
def alias_dedup(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_name", "p_brand", F.col("p_retailprice").alias("best"))
    return dedup.alias_dedup(rows, F.lower("p_name"), "p_partkey", "best", "p_brand").select("p_name", "p_partkey", "best", F.array_join("also", ",").alias("also"))


_GREEDY = """
WITH RECURSIVE x AS (SELECT p_name AS txt, min(p_partkey) AS k FROM part GROUP BY p_name),
o AS (SELECT txt, k, row_number() OVER (ORDER BY k) AS i FROM x),
g(i, kept) AS (
  SELECT 0::BIGINT, []::VARCHAR[]
  UNION ALL
  SELECT o.i, CASE WHEN len(list_filter(kept, lambda y: 1 - levenshtein(y, o.txt) / greatest(length(y), length(o.txt))::DOUBLE >= 0.85 - 1e-12)) = 0 THEN list_append(kept, o.txt) ELSE kept END
  FROM g JOIN o ON o.i = g.i + 1)
SELECT k AS p_partkey, txt AS p_name FROM x WHERE list_contains((SELECT arg_max(kept, i) FROM g), txt)"""


@query(_GREEDY)
def fuzzy_title_dedup(t: Tables) -> DataFrame:
    return dedup.fuzzy_dedup(t.part.select("p_partkey", "p_name"), "p_name", "p_partkey")


def _greedy(rows: str, name: str, ratio: float, same: str = "true") -> str:
    """Steps of a recursion over ``rows`` (k, txt, g) in the order of k: ``{name}`` has the k of the rows that stay."""
    return f"""{name}_o AS (SELECT k, txt, g, row_number() OVER (ORDER BY k) AS i FROM {rows}),
{name}_r(i, kept) AS (SELECT 0::BIGINT, []::STRUCT(k BIGINT, txt VARCHAR, g VARCHAR)[] UNION ALL
  SELECT o.i, CASE WHEN len(list_filter(kept, lambda y: {same} AND 1 - levenshtein(y.txt, o.txt) / greatest(length(y.txt), length(o.txt))::DOUBLE >= {ratio} - 1e-12)) = 0 THEN list_append(kept, {{'k': o.k, 'txt': o.txt, 'g': o.g}}) ELSE kept END FROM {name}_r JOIN {name}_o o ON o.i = {name}_r.i + 1),
{name} AS (SELECT y.k AS k FROM (SELECT unnest(arg_max(kept, i)) AS y FROM {name}_r))"""


@query(f"""
WITH RECURSIVE x AS (SELECT p_name AS txt, p_brand AS g, min(p_partkey) AS k FROM part GROUP BY ALL), {_greedy("x", "stay", 0.75, "y.g = o.g")}
SELECT p_partkey, p_name, p_brand FROM part JOIN stay ON k = p_partkey""")
def fuzzy_author_dedup(t: Tables) -> DataFrame:
    return dedup.fuzzy_dedup(t.part.select("p_partkey", "p_name", "p_brand"), "p_name", "p_partkey", 0.75, ["p_brand"])


_LAYERS = f"""
WITH RECURSIVE h AS (SELECT min(p_partkey) AS k FROM part GROUP BY p_name, p_brand, p_type), d AS (SELECT min(p_partkey) AS k FROM part JOIN h ON k = p_partkey GROUP BY CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand || p_size::VARCHAR END, CASE WHEN p_size % 3 = 0 THEN p_partkey END),
x AS (SELECT p_name AS txt, '' AS g, min(p_partkey) AS k FROM part JOIN d ON k = p_partkey GROUP BY 1), {_greedy("x", "one", 0.85)}, z AS (SELECT p_name AS txt, p_brand AS g, p_partkey AS k FROM part JOIN one ON k = p_partkey), {_greedy("z", "two", 0.75, "y.g = o.g")}
SELECT p_partkey, p_name, p_brand FROM part JOIN two ON k = p_partkey"""


@query(_LAYERS)
def dedup_pipeline(t: Tables) -> DataFrame:
    return dedup.dedup_pipeline(_hashed(t), "p_partkey", "hash", "p_name", "p_brand", "doi").drop("hash", "doi")


def _hashed(t: Tables) -> DataFrame:
    doi = F.when(F.col("p_size") % 3 != 0, F.concat("p_brand", "p_size"))
    return t.part.select("p_partkey", "p_name", "p_brand", F.sha2(F.concat_ws("|", "p_name", "p_brand", "p_type"), 256).alias("hash"), doi.alias("doi"))


@query(_LAYERS)
def dedup_in_batches(t: Tables) -> DataFrame:
    """The same rows in four batches, each against what the layers remember of the ones before."""
    rows, folder = _hashed(t), answers.folder_for(t.spark, "dedup")
    index = DedupIndex(t.spark, folder, "p_partkey", "hash", "p_name", "p_brand", "doi")
    index.reset()
    cuts = rows.agg(F.max("p_partkey")).first()[0] or 0
    kept = [index.add(rows.filter(F.floor(F.col("p_partkey") * 4 / (cuts + 1)) == i), i) for i in range(4)]
    return reduce(DataFrame.unionByName, kept).drop("hash", "doi")


@query("SELECT DISTINCT trim(regexp_extract(url, '://([^?#]*)', 1)) AS slug FROM pages WHERE contains(regexp_extract(url, '://([^?#]*)', 1), '/')")
def distinct_trim_sort(t: Tables) -> DataFrame:
    slug = F.trim(F.regexp_extract("url", "://([^?#]*)", 1))
    return t.pages.select(slug.alias("slug")).filter(F.contains("slug", F.lit("/"))).distinct().orderBy("slug")


@query("SELECT * FROM (SELECT p_name, min(p_partkey) AS first_seen FROM part GROUP BY p_name) ORDER BY first_seen LIMIT 20")
def first_seen_distinct(t: Tables) -> DataFrame:
    return t.part.groupBy("p_name").agg(F.min("p_partkey").alias("first_seen")).orderBy("first_seen").limit(20)


@query("""
WITH b AS (SELECT p_partkey, p_name, 0 AS tier FROM part WHERE p_name = 'small ring' UNION ALL SELECT p_partkey, p_name, 1 FROM part WHERE contains(p_name, 'ring') AND p_name <> 'small ring')
SELECT * FROM b ORDER BY tier, p_partkey LIMIT 50""")
def search_exact_then_broad(t: Tables) -> DataFrame:
    exact = t.part.filter("p_name = 'small ring'").select("p_partkey", "p_name", F.lit(0).alias("tier"))
    broad = t.part.filter("contains(p_name, 'ring')").select("p_partkey", "p_name", F.lit(1).alias("tier")).join(exact.select("p_name").distinct(), "p_name", "left_anti").select("p_partkey", "p_name", "tier")
    return exact.unionByName(broad).orderBy("tier", "p_partkey").limit(50)


@query("""
WITH o AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer), n AS (SELECT c_custkey, 'UPDATED' AS c_mktsegment, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 10 = 3)
SELECT * FROM o ANTI JOIN n USING (c_custkey) UNION ALL SELECT * FROM n""")
def upsert_last_wins(t: Tables) -> DataFrame:
    old = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    new = old.filter("c_custkey % 10 = 3").select("c_custkey", F.lit("UPDATED").alias("c_mktsegment"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return readers.upsert(old, new, ["c_custkey"])


# Aggregates.


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def coverage_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH d AS (SELECT p_name, arg_max(p_size, p_partkey) AS p_size FROM part GROUP BY p_name)
SELECT CASE WHEN p_size < 15 THEN 'P0' WHEN p_size < 35 THEN 'P1' ELSE 'P2' END AS tier, count(*) AS n FROM d GROUP BY 1""")
def tier_counts(t: Tables) -> DataFrame:
    d = joins.last_wins(t.part, ["p_name"], ["p_size"], "p_partkey")
    return d.groupBy(F.when(F.col("p_size") < 15, "P0").when(F.col("p_size") < 35, "P1").otherwise("P2").alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS supported, count(*) FILTER (WHERE o_orderstatus = 'P') AS partial FROM orders GROUP BY 1")
def conditional_counts(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("supported"), F.count_if(F.col("o_orderstatus") == "P").alias("partial"))


@query("SELECT l_orderkey, count(*) AS n_lines, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1")
def nested_sizes(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.count("l_partkey").alias("n_lines"), F.count_distinct("l_partkey").alias("n_parts"))


@query("""SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR || '=' || o_orderstatus, ', ' ORDER BY o_orderkey), 'no gap data') AS summary FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def ordered_string_agg(t: Tables) -> DataFrame:
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("a"))
    return t.customer.select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce(F.array_join(F.transform("a", lambda x: F.concat_ws("=", x["o_orderkey"].cast("string"), x["o_orderstatus"])), ", "), F.lit("no gap data")).alias("summary"))


@query("SELECT l_suppkey, min(l_extendedprice) AS lowest, max(l_shipdate) AS latest FROM lineitem GROUP BY 1")
def min_max_group(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.min("l_extendedprice").alias("lowest"), F.max("l_shipdate").alias("latest"))


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE quality < 0.5) / count(*)::DOUBLE AS low_share, count(*) FILTER (WHERE quality < 0.5) * 2 > count(*) AS mostly_low FROM labels JOIN documents USING (doc_id) GROUP BY source")
def share_below_threshold(t: Tables) -> DataFrame:
    g = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") < 0.5).alias("low"))
    return g.select("source", "n", (F.col("low") / F.col("n")).alias("low_share"), (F.col("low") * 2 > F.col("n")).alias("mostly_low"))


@query("""
SELECT l_returnflag, round(sum(n * CASE l_linestatus WHEN 'F' THEN 0.25 ELSE 0.75 END), 3) AS score FROM (SELECT l_returnflag, l_linestatus, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL) GROUP BY 1""")
def weighted_sum(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).cast("double").alias("n"))
    weights = t.spark.createDataFrame([("F", 0.25), ("O", 0.75)], "l_linestatus string, weight double")
    return n.join(F.broadcast(weights), "l_linestatus").groupBy("l_returnflag").agg(F.round(F.sum(F.col("n") * F.col("weight")), 3).alias("score"))  # a constant table


@query("""
SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'failed' WHEN bool_or(o_orderstatus = 'P') THEN 'warnings' WHEN bool_and(o_orderstatus = 'O') THEN 'passed' ELSE 'not_run' END AS overall FROM orders GROUP BY 1""")
def status_fold(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    fold = F.when(F.bool_or(s == "F"), "failed").when(F.bool_or(s == "P"), "warnings").when(F.bool_and(s == "O"), "passed").otherwise("not_run")
    return t.orders.groupBy("o_custkey").agg(fold.alias("overall"))


@query("""
WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'signup') AS warnings FROM events GROUP BY 1)
SELECT *, CASE WHEN errors > 0 THEN 2 WHEN warnings > 0 THEN 1 ELSE 0 END AS exit_code FROM c""")
def severity_counts(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "signup").alias("warnings"))
    return g.withColumn("exit_code", F.when(F.col("errors") > 0, 2).when(F.col("warnings") > 0, 1).otherwise(0))


@query("SELECT p_brand, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS members FROM part GROUP BY p_brand")
def group_collect(t: Tables) -> DataFrame:
    return folds.ordered_join(t.part.select("p_brand", "p_partkey"), ["p_brand"], ["p_partkey"], "p_partkey")


@query("SELECT source, sha256(string_agg(sha256(coalesce(text, '')), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY source")
def ordered_hash_agg(t: Tables) -> DataFrame:
    return folds.ordered_digest(t.documents.select("source", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")), ["source"], ["doc_id"], "h")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, concat_ws('; ', CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_tax = 0 THEN 'no tax' END, CASE WHEN l_quantity > 45 THEN 'bulk' END) AS warnings FROM lineitem""")
def collect_warnings(t: Tables) -> DataFrame:
    w = F.array_compact(F.array(F.when(F.col("l_discount") > 0.08, "discount"), F.when(F.col("l_tax") == 0, "no tax"), F.when(F.col("l_quantity") > 45, "bulk")))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(w, "; ").alias("warnings"))


@query("SELECT 'customer' AS origin, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def union_tagged(t: Tables) -> DataFrame:
    return t.customer.select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).unionByName(t.supplier.select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("""
WITH a AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS y FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT k AS o_custkey, len(list_intersect(x, y)) / greatest(len(list_distinct(list_concat(x, y))), 1)::DOUBLE AS jaccard, len(list_intersect(x, y)) / len(x)::DOUBLE AS containment FROM a JOIN b USING (k)""")
def jaccard_overlap(t: Tables) -> DataFrame:
    side = lambda cond, name: t.orders.filter(cond).groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias(name))
    j = side("o_orderstatus = 'F'", "x").join(side("o_orderstatus <> 'F'", "y"), "o_custkey")
    return j.select("o_custkey", S.jaccard(F.col("x"), F.col("y")).alias("jaccard"), S.containment(F.col("x"), F.col("y")).alias("containment"))


# Scalar functions.

_SCORE_SQL = """CASE WHEN {s} > 10000 THEN 0.4::DOUBLE WHEN {s} > 1000 THEN 0.3::DOUBLE WHEN {s} > 100 THEN 0.2::DOUBLE WHEN {s} > 10 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END"""


@query(f"""SELECT o_orderkey, least(round({_SCORE_SQL.format(s="s")} + CASE WHEN d > 1000000 THEN 0.3::DOUBLE WHEN d > 100000 THEN 0.2::DOUBLE WHEN d > 1000 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN a < 30 THEN 0.3::DOUBLE WHEN a < 365 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END, 6), 1.0::DOUBLE) AS score
FROM (SELECT o_orderkey, o_custkey * 20 AS s, o_totalprice * 4 AS d, date_diff('day', o_orderdate::DATE, DATE '2000-01-01') AS a FROM orders)""")
def quality_score(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.round(S.quality_score(F.col("o_custkey") * 20, F.col("o_totalprice") * 4, F.date_diff(F.lit("2000-01-01").cast("date"), F.col("o_orderdate").cast("date"))), 6).alias("score"))


@query(f"""SELECT o_orderkey, least(round({_SCORE_SQL.format(s="s")} + CASE WHEN d > 100000 THEN 0.3::DOUBLE WHEN d > 10000 THEN 0.25::DOUBLE WHEN d > 1000 THEN 0.2::DOUBLE WHEN d > 100 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN a IS NULL THEN 0.1::DOUBLE WHEN a < 30 THEN 0.3::DOUBLE WHEN a < 365 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END, 6), 1.0::DOUBLE) AS score
FROM (SELECT o_orderkey, o_custkey * 20 AS s, o_totalprice / 3 AS d, CASE WHEN o_orderstatus <> 'P' THEN date_diff('day', o_orderdate::DATE, DATE '2000-01-01') END AS a FROM orders)""")
def quality_score_variant(t: Tables) -> DataFrame:
    days = F.when(F.col("o_orderstatus") != "P", F.date_diff(F.lit("2000-01-01").cast("date"), F.col("o_orderdate").cast("date")))
    return t.orders.select("o_orderkey", F.round(S.import_count_score(F.col("o_custkey") * 20, F.col("o_totalprice") / 3, days), 6).alias("score"))


@query("SELECT o_orderkey, round(least(o_totalprice / 1e6 * 0.5::DOUBLE + o_custkey / 1e4 * 0.5::DOUBLE, 1.0::DOUBLE), 9) AS score FROM orders")
def linear_capped_score(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.round(S.linear_score(F.col("o_totalprice"), F.col("o_custkey")), 9).alias("score"))


@query("""
WITH n AS (SELECT DISTINCT p_name FROM part), p AS (SELECT a.p_name AS a, b.p_name AS b FROM n a JOIN n b ON split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2))
SELECT a, b, levenshtein(a, b)::INTEGER AS distance, round(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE END, 9) AS ratio FROM p""")
def levenshtein_ratio(t: Tables) -> DataFrame:
    n = t.part.select("p_name", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("w")).distinct()
    p = n.select(F.col("p_name").alias("a"), "w").join(n.select(F.col("p_name").alias("b"), "w"), "w")
    return p.select("a", "b", F.levenshtein("a", "b").alias("distance"), F.round(S.levenshtein_ratio(F.col("a"), F.col("b")), 9).alias("ratio"))


@query("""
WITH n AS (SELECT DISTINCT replace(p_name, ' ', '_') AS x, split_part(p_name, ' ', 2) AS y FROM part), m AS (SELECT x, y, regexp_replace(lower(x), '[_-]', '', 'g') AS a, regexp_replace(lower(y), '[_-]', '', 'g') AS b FROM n)
SELECT x, y, round(CASE WHEN a = b THEN 1.0::DOUBLE WHEN contains(a, b) OR contains(b, a) THEN 0.85::DOUBLE ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE END, 9) AS similarity FROM m""")
def name_similarity(t: Tables) -> DataFrame:
    n = t.part.select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("x"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("y")).distinct()
    return n.withColumn("similarity", F.round(S.name_similarity(F.col("x"), F.col("y")), 9))


_FUNCS = ["json_dumps", "load", "get_user", "SaveAll", "flatMap", "open_file", "disconnect", "frobnicate", "parse_x_loads", "post"]


@query(f"""
WITH k(role, ord, w) AS (VALUES {", ".join(f"('{r}', {i}, '{w}')" for i, (r, ws) in enumerate(C.ROLE_KEYWORDS.items()) for w in ws)}),
n AS (SELECT DISTINCT [{_in(_FUNCS)}][(p_partkey % 10)::INTEGER + 1] || '_' || replace(p_name, ' ', '_') AS name FROM part),
s AS (SELECT name, role, ord, max(CASE WHEN lower(name) = w THEN 0.95::DOUBLE WHEN starts_with(lower(name), w || '_') OR ends_with(lower(name), '_' || w) THEN 0.85::DOUBLE WHEN contains(lower(name), '_' || w || '_') THEN 0.75::DOUBLE ELSE 0.6::DOUBLE END) AS c
  FROM n JOIN k ON contains(lower(name), w) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY c DESC, ord) AS r FROM s)
SELECT n.name, coalesce(role, 'unknown') AS role, coalesce(c, 0.0::DOUBLE) AS confidence FROM n LEFT JOIN b ON b.name = n.name AND r = 1""")
def keyword_role(t: Tables) -> DataFrame:
    n = t.part.select(F.concat_ws("_", F.element_at(F.array(*map(F.lit, _FUNCS)), (F.col("p_partkey") % 10 + 1).cast("int")), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name")).distinct()
    return n.withColumn("r", matching.role(F.col("name"))).select("name", "r.role", "r.confidence")


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'A' THEN 'fetch' ELSE 'unknown' END AS sr, CASE WHEN l_linestatus = 'F' THEN 'fetch' ELSE 'unknown' END AS dr, l_discount * 10 AS sim, l_tax * 10 AS sc, 0.6::DOUBLE AS dc, CASE WHEN l_linenumber < 4 THEN 'rust' ELSE '' END AS sl FROM lineitem),
s AS (SELECT *, (CASE WHEN sr = dr AND sr <> 'unknown' THEN 0.45::DOUBLE WHEN sr = dr THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END + sim * 0.35::DOUBLE + (sc + dc) * 0.1::DOUBLE) AS raw FROM p),
f AS (SELECT *, round(least(CASE WHEN sl <> 'python' AND sl <> '' THEN raw * 0.85::DOUBLE ELSE raw END, 1.0::DOUBLE), 6) AS score FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, score, CASE WHEN score >= 0.9 AND sl = '' THEN 'identical' WHEN score >= 0.6 THEN 'similar' WHEN sl <> '' THEN 'cross_lang_guess' ELSE 'low_confidence' END AS label FROM f""")
def mapping_score(t: Tables) -> DataFrame:
    fetch = lambda c: F.when(c, "fetch").otherwise("unknown")
    sl = F.when(F.col("l_linenumber") < 4, "rust").otherwise("")
    score = F.round(S.mapping_score(fetch(F.col("l_returnflag") == "A"), fetch(F.col("l_linestatus") == "F"), F.col("l_discount") * 10, F.col("l_tax") * 10, F.lit(0.6), sl, F.lit("python")), 6)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", score.alias("score"), S.confidence_label(score, sl == "").alias("label"))


@query("""
WITH RECURSIVE n AS (SELECT p_brand AS b, p_partkey AS k, p_name AS name, p_type, regexp_replace(lower(p_name), '[_-]', '', 'g') AS x FROM part),
p AS (SELECT s.b, s.k AS src, s.name AS src_name, d.k AS dst, d.name AS dst_name, CASE WHEN s.x = d.x THEN 1.0::DOUBLE WHEN contains(s.x, d.x) OR contains(d.x, s.x) THEN 0.85::DOUBLE ELSE 1 - levenshtein(s.x, d.x) / greatest(length(s.x), length(d.x))::DOUBLE END AS similarity FROM n s JOIN n d ON s.b = d.b WHERE s.k % 2 = 0 AND d.k % 2 = 1),
o AS (SELECT b, src, list(dst ORDER BY similarity DESC, dst) AS able, row_number() OVER (PARTITION BY b ORDER BY src) AS i FROM p WHERE similarity >= 0.3 GROUP BY b, src),
g(b, i, used, src, dst) AS (SELECT DISTINCT b, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT FROM o UNION ALL
  SELECT b, i, CASE WHEN d IS NULL THEN used ELSE list_append(used, d) END, src, d FROM (SELECT g.b, o.i, g.used, o.src, list_filter(o.able, lambda x: NOT list_contains(g.used, x))[1] AS d FROM g JOIN o ON o.b = g.b AND o.i = g.i + 1))
SELECT b AS p_brand, p.src, src_name, p.dst, dst_name, similarity FROM g JOIN p USING (b, src, dst)""")
def greedy_match(t: Tables) -> DataFrame:
    parts = t.part.select("p_brand", "p_partkey", "p_name", "p_type")
    src, dst = parts.filter("p_partkey % 2 = 0"), parts.filter("p_partkey % 2 = 1")
    return matching.greedy_by_name(src, dst, "p_brand", "p_name", "p_partkey")


@query("""
WITH m AS (SELECT o_custkey AS k, o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL),
a AS (SELECT * FROM m WHERE s = 'F'), b AS (SELECT * FROM m WHERE s = 'O'),
j AS (SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.n = b.n THEN 1.0::DOUBLE WHEN a.n IS NULL OR b.n IS NULL THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS v FROM a FULL JOIN b ON a.k = b.k AND a.p = b.p),
both_ AS (SELECT DISTINCT a.k FROM a JOIN b USING (k))
SELECT k AS o_custkey, round(avg(v), 9) AS similarity FROM j SEMI JOIN both_ USING (k) GROUP BY k""")
def map_similarity(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_custkey", "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    side = lambda s, name: n.filter(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias(name))
    return side("F", "a").join(side("O", "b"), "o_custkey").select("o_custkey", F.round(S.map_similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


@query(f"""
SELECT p_partkey, CASE WHEN m <> '' THEN m WHEN lower(c) IN ({_in(C.P0_CATEGORIES)}) THEN 'P0' WHEN lower(c) IN ({_in(C.P1_CATEGORIES)}) THEN 'P1' WHEN {_any(C.P0_KEYWORDS, "n")} THEN 'P0' WHEN {_any(C.P1_KEYWORDS, "n")} THEN 'P1' ELSE 'P2' END AS tier
FROM (SELECT p_partkey, lower(p_name || ' ' || [{_in(_FUNCS)}][(p_partkey % 10)::INTEGER + 1]) AS n, CASE WHEN p_size < 5 THEN 'Core' WHEN p_size < 9 THEN 'batch' ELSE '' END AS c, CASE WHEN p_partkey % 50 = 0 THEN 'P2' ELSE '' END AS m FROM part)""")
def tier_classify(t: Tables) -> DataFrame:
    name = F.concat_ws(" ", "p_name", F.element_at(F.array(*map(F.lit, _FUNCS)), (F.col("p_partkey") % 10 + 1).cast("int")))
    category = F.when(F.col("p_size") < 5, "Core").when(F.col("p_size") < 9, "batch").otherwise("")
    return t.part.select("p_partkey", S.tier(name, category, F.when(F.col("p_partkey") % 50 == 0, "P2").otherwise("")).alias("tier"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '\\.(html|git)$', ''), '[^A-Za-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def url_slug(t: Tables) -> DataFrame:
    return t.pages.select("page_id", S.url_slug(F.col("url")).alias("slug"))


@query("SELECT page_id, CASE WHEN len(p) > 2 AND p[1] = 'src' THEN p[2] WHEN len(p) > 1 THEN p[1] ELSE regexp_replace(path, '\\.[^.]*$', '') END AS grp FROM (SELECT page_id, path, string_split(path, '/') AS p FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'src/' ELSE '' END || regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages))")
def infer_group(t: Tables) -> DataFrame:
    path = F.concat(F.when(F.col("page_id") % 3 == 0, "src/").otherwise(""), F.regexp_extract("url", "://([^?#]*)", 1))
    return t.pages.select("page_id", S.infer_group(path).alias("grp"))


@query("SELECT event_id, coalesce(floor(date_diff('second', ts::TIMESTAMP(0), TIMESTAMP '2024-02-01') / 86400.0), 999)::INTEGER AS days FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS ts FROM events)")
def days_since(t: Tables) -> DataFrame:
    text = F.when(F.col("event_type") != "error", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("unknown")
    return t.events.select("event_id", S.days_since(text, "2024-02-01").alias("days"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'soon' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events")
def parse_month_date(t: Tables) -> DataFrame:
    text = F.when(F.col("event_type") == "view", "soon").otherwise(F.date_format("ts", "MMM d, yyyy"))
    return t.events.select("event_id", S.parse_month_date(text).alias("day"))


@query("SELECT o_orderkey, o_custkey * 1001 AS n FROM orders")
def parse_thousands(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", S.parse_thousands(F.format_number(F.col("o_custkey") * 1001, 0)).alias("n"))


@query("SELECT p_partkey, CASE WHEN m // 60 = 0 THEN (m % 60)::VARCHAR || 'm' ELSE (m // 60)::VARCHAR || 'h' || lpad((m % 60)::VARCHAR, 2, '0') || 'm' END AS duration FROM (SELECT p_partkey, p_size * 7 AS m FROM part)")
def format_duration(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.format_duration(F.col("p_size") * 7).alias("duration"))


@query("SELECT s_suppkey, CASE WHEN regexp_full_match(c, '[A-Za-z]{3}') THEN upper(c) WHEN lower(c) = 'shenzhen' THEN 'SZX' ELSE upper(c) END AS code FROM (SELECT s_suppkey, ['pvg', 'Shenzhen', 'atlantis'][(s_suppkey % 3)::INTEGER + 1] AS c FROM supplier)")
def resolve_code(t: Tables) -> DataFrame:
    names = F.element_at(F.array(F.lit("pvg"), F.lit("Shenzhen"), F.lit("atlantis")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return t.supplier.select("s_suppkey", S.resolve_code(names, {"shenzhen": "SZX"}).alias("code"))


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN 1700000000 + event_id END AS exp FROM events")
def jwt_exp(t: Tables) -> DataFrame:
    body = F.concat(F.lit('{"exp":'), (F.col("event_id") + 1700000000).cast("string"), F.lit("}"))
    token = F.concat(F.lit("h."), F.when(F.col("event_type") != "error", F.regexp_replace(F.translate(F.base64(body.cast("binary")), "+/", "-_"), "=", "")).otherwise("%%"), F.lit(".s"))
    return t.events.select("event_id", S.jwt_exp(token).alias("exp"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN -1 ELSE (props->>'k')::INTEGER END AS k, event_type = 'error' AS is_corrupt FROM events")
def corrupt_json_default(t: Tables) -> DataFrame:
    broken = t.events.select("event_id", F.when(F.col("event_type") == "error", F.lit('{"k": ')).otherwise(F.col("props")).alias("props"))
    out = readers.json_or_default(broken, "props", "k INT", F.struct(F.lit(-1).alias("k")))
    return out.select("event_id", "parsed.k", "is_corrupt")


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events WHERE event_type <> 'view'")
def skip_malformed_rows(t: Tables) -> DataFrame:
    cells = F.split(F.when(F.col("event_type") == "view", F.lit("broken")).otherwise(F.concat_ws("|", F.col("event_id").cast("string"), F.get_json_object("props", "$.k"))), r"\|")
    return t.events.select(cells.alias("c")).filter(F.size("c") >= 2).select(F.col("c")[0].cast("long").alias("event_id"), F.col("c")[1].cast("long").alias("k"))


# Texts.


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'gs'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS body FROM pages")
def html_strip_tags(t: Tables) -> DataFrame:
    return t.pages.select("page_id", extract.strip_tags(F.col("html")).alias("body"))


@query("SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) AS target FROM pages")
def extract_links(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(F.array_distinct(extract.matches(F.col("html"), 'href="([^"]+)"', 1))).alias("target"))


@query("SELECT page_id, regexp_extract_all(url, '[0-9]+')[-1] AS last_number FROM pages")
def last_regex_match(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.try_element_at(extract.matches(F.col("url"), "([0-9]+)", 1), F.lit(-1)).alias("last_number"))


@query("""SELECT doc_id, length(text) = 0 AS is_empty, contains(text, chr(0)) AS has_nul, starts_with(text, chr(65279)) AS has_bom, ends_with(text, chr(10)) AS ends_with_newline,
 len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 500)) > 0 AS has_long_line, regexp_matches(text, '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]') AS has_control FROM documents""")
def text_quality_flags(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", *extract.text_flags(F.col("text")))


@query("""
WITH h AS (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) || ' ## no heading' || chr(10) || '# ' || regexp_extract(html, '<title>([^<]*)</title>', 1) || chr(10) || '### Deep' || chr(10) || 'é ### Deep' || chr(10) || '## ' || regexp_extract(html, '<h1>([^<]*)</h1>', 1) || chr(10) || '# <!-- x -->' || chr(10) || '#### Low ' || chr(10) || '# End' || chr(10) AS c FROM pages),
l AS (SELECT page_id, unnest(string_split(c, chr(10))) AS l, unnest(range(len(string_split(c, chr(10))))) AS n FROM h),
o AS (SELECT *, coalesce(sum(length(l) + 1) OVER (PARTITION BY page_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM l),
m AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS pos, length(regexp_extract(l, '^(#{1,6})[ ]+(.+)$', 1)) AS level, trim(regexp_extract(l, '^(#{1,6})[ ]+(.+)$', 2)) AS title FROM o WHERE regexp_matches(l, '^(#{1,6})[ ]+(.+)$')),
r AS (SELECT * FROM m WHERE NOT regexp_full_match(title, '<!--.*?-->')),
k AS (SELECT r.*, array_to_string((SELECT list(a.title ORDER BY a.pos) FROM r a WHERE a.page_id = r.page_id AND a.pos <= r.pos AND a.level <= r.level AND (a.pos = r.pos OR a.level < r.level) AND NOT EXISTS (SELECT 1 FROM r b WHERE b.page_id = r.page_id AND b.pos > a.pos AND b.pos <= r.pos AND b.level <= a.level)), '#') AS chain FROM r)
SELECT 'docs/' || page_id::VARCHAR || '.md' AS path, pos::INTEGER AS pos, place::INTEGER AS "offset", level::INTEGER AS level, title, chain, 'docs/' || page_id::VARCHAR || '#' || chain AS section_id, page_id::VARCHAR || '#' || chain AS short_id FROM k""")
def heading_chain(t: Tables) -> DataFrame:
    """Headings of Markdown made of each page's title and heading, a placeholder and lines that look like headings among them."""
    first = lambda tag: F.regexp_extract("html", f"<{tag}>([^<]*)</{tag}>", 1)
    text = F.concat(first("h1"), F.lit(" ## no heading\n# "), first("title"), F.lit("\n### Deep\né ### Deep\n## "), first("h1"), F.lit("\n# <!-- x -->\n#### Low \n# End\n"))
    h = extract.headings(t.pages.select(F.concat(F.lit("docs/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), text.alias("content")))
    return h.withColumn("chain", F.array_join("chain", "#"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, '') || chr(10) || '# @lat: [[mod' || (doc_id % 9)::VARCHAR || '#Part ]]' || chr(10) || '// @lat: [[a]] # @lat: [[b]]', chr(10))) AS l, unnest(range(len(string_split(coalesce(text, '') || chr(10) || 'x' || chr(10) || 'y', chr(10))))) AS n FROM documents)
SELECT doc_id::VARCHAR AS path, (n + 1)::INTEGER AS line, trim(regexp_extract(l, '[#/]{1,2}\\s*@lat:\\s*\\[\\[([^\\]]+)\\]\\]', 1)) AS section_id FROM l WHERE trim(regexp_extract(l, '[#/]{1,2}\\s*@lat:\\s*\\[\\[([^\\]]+)\\]\\]', 1)) <> ''""")
def line_annotations(t: Tables) -> DataFrame:
    """Annotations behind each document's own text."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n# @lat: [[mod"), (F.col("doc_id") % 9).cast("string"), F.lit("#Part ]]\n// @lat: [[a]] # @lat: [[b]]"))
    return extract.line_annotations(t.documents.select(F.col("doc_id").cast("string").alias("path"), text.alias("content")))


@query("SELECT page_id::VARCHAR AS path, (i - 1)::INTEGER AS pos, trim(x) AS target FROM (SELECT page_id, unnest(regexp_extract_all(replace(html, '<p>', '[[') || '[[end]]', '\\[\\[([^\\]]+)\\]\\]', 1)) AS x, unnest(range(1, len(regexp_extract_all(replace(html, '<p>', '[[') || '[[end]]', '\\[\\[([^\\]]+)\\]\\]', 1)) + 1)) AS i FROM pages)")
def wiki_links(t: Tables) -> DataFrame:
    html = F.concat(F.replace("html", F.lit("<p>"), F.lit("[[")), F.lit("[[end]]"))
    return extract.wiki_links(t.pages.select(F.col("page_id").cast("string").alias("path"), html.alias("content")))


@query("""SELECT o_custkey, '<gpx version="1.1"><trk><trkseg>' || string_agg(printf('<trkpt lat="%.8f" lon="%.8f">', o_custkey / 8.0::DOUBLE, o_orderkey / 16.0::DOUBLE) || CASE WHEN o_orderstatus <> 'P' THEN printf('<ele>%.1f</ele>', o_orderkey / 2.0::DOUBLE) ELSE '' END || '</trkpt>', '' ORDER BY o_orderkey) || '</trkseg></trk></gpx>' AS gpx FROM orders GROUP BY 1""")
def track_to_xml(t: Tables) -> DataFrame:
    p = t.orders.select("o_custkey", "o_orderkey", (F.col("o_custkey") / 8).alias("lat"), (F.col("o_orderkey") / 16).alias("lon"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") / 2).alias("ele"))
    return extract.gpx(p, "o_custkey", "o_orderkey", "lat", "lon", "ele")


# State and change.

_SNAPSHOTS = """
old AS (SELECT user_id AS path, max(event_id) AS fp FROM events WHERE ts < TIMESTAMP '2024-01-03' GROUP BY 1), new AS (SELECT user_id AS path, max(event_id) AS fp FROM events WHERE ts < TIMESTAMP '2024-01-03' AND user_id % 7 <> 0 OR ts < TIMESTAMP '2024-01-04' AND user_id % 5 = 0 GROUP BY 1),
j AS (SELECT coalesce(old.path, new.path) AS path, old.fp AS was, new.fp AS now FROM old FULL JOIN new ON old.path = new.path)"""


def _snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.events.select(F.col("user_id").alias("path"), "event_id", "ts")
    day = lambda d: F.col("ts") < F.lit(f"2024-01-0{d}").cast("timestamp_ntz")
    make = lambda c: e.filter(c).groupBy("path").agg(F.max("event_id").alias("fp"))
    return make(day(3)), make((day(3) & (F.col("path") % 7 != 0)) | (day(4) & (F.col("path") % 5 == 0)))


@query(f"""WITH {_SNAPSHOTS}
SELECT path % 40 AS module, CASE WHEN count(was) = 0 THEN 'needs_create' WHEN count(was + now) = 0 THEN 'needs_delete' WHEN bool_or(was IS NOT NULL AND was IS DISTINCT FROM now) THEN 'needs_update' ELSE 'unchanged' END AS status, count(*) AS n_files FROM j GROUP BY 1""")
def snapshot_diff(t: Tables) -> DataFrame:
    return state.snapshot_diff(*_snapshots(t), "path", "fp", F.col("path") % 40)


@query(f"""WITH {_SNAPSHOTS}
SELECT path, CASE WHEN now IS NULL THEN 'file_missing' WHEN was IS NULL THEN 'needs_create' ELSE 'file_changed' END AS change FROM j WHERE was IS DISTINCT FROM now""")
def change_log(t: Tables) -> DataFrame:
    return state.change_log(*_snapshots(t), "path", "fp")


_MANIFEST = """
e AS (SELECT user_id AS u, event_id, ts, 'src/' || CASE WHEN user_id % 9 = 4 THEN 'late' ELSE 'm' END || (user_id % 40)::VARCHAR || '/' || lpad(user_id::VARCHAR, 5, '0') || '.py' AS path FROM events),
was AS (SELECT path, sha256(max(event_id)::VARCHAR) AS fp FROM e WHERE ts < TIMESTAMP '2024-01-03' AND u % 9 <> 4 GROUP BY 1), now AS (SELECT path, sha256(max(event_id)::VARCHAR) AS fp, max(event_id) AS mtime FROM e WHERE (ts < TIMESTAMP '2024-01-03' AND u % 7 <> 0 OR ts < TIMESTAMP '2024-01-04' AND u % 5 = 0) AND u % 40 <> 17 GROUP BY 1),
src AS (SELECT split_part(path, '/', 2) AS module, path, row_number() OVER (PARTITION BY split_part(path, '/', 2) ORDER BY path) - 1 AS pos, fp FROM was),
mods AS (SELECT module, sha256(string_agg(fp, '' ORDER BY pos)) AS hash, 0::BIGINT AS mtime, CASE WHEN length(module) = 2 THEN 'in_review' END AS doc_status FROM src GROUP BY 1),
j AS (SELECT src.*, now.fp AS cur, now.mtime AS m FROM src LEFT JOIN now USING (path)),
g AS (SELECT module, count(*) AS n, count(cur) AS k, sha256(coalesce(string_agg(cur, '' ORDER BY pos), '')) AS h, max(m) AS m FROM j GROUP BY 1),
new AS (SELECT split_part(path, '/', 2) AS module, path, fp, mtime, row_number() OVER (PARTITION BY split_part(path, '/', 2) ORDER BY path) AS nth FROM now ANTI JOIN src USING (path)),
add AS (SELECT module, count(*) AS n, sha256(string_agg(fp, '' ORDER BY path)) AS hash, max(mtime) AS mtime, string_agg(path, ', ' ORDER BY path) FILTER (nth <= 3) AS names FROM new GROUP BY 1)"""


@query(f"""WITH {_MANIFEST}
SELECT mods.module, CASE WHEN k = 0 OR h = hash THEN hash ELSE h END AS hash, CASE WHEN k = 0 OR h = hash THEN mods.mtime ELSE g.m END AS mtime, CASE WHEN k = 0 THEN 'needs_delete' WHEN h <> hash OR k < n THEN 'needs_update' ELSE coalesce(doc_status, 'up_to_date') END AS doc_status, CASE WHEN k = 0 THEN n ELSE k END AS n_files FROM mods JOIN g USING (module)
UNION ALL SELECT module, hash, mtime, 'needs_create', n FROM add ANTI JOIN mods USING (module)""")
def manifest_update(t: Tables) -> DataFrame:
    """The manifest of one slice of events brought up to another; modules that aren't known are inferred from the files' paths."""
    modules, sources, _ = state.update_manifest(*_manifest(t))
    n = sources.groupBy("module").agg(F.count(F.lit(1)).alias("n_files"))
    return modules.join(n, "module", "left").select("module", "hash", "mtime", "doc_status", F.coalesce("n_files", F.lit(0)).alias("n_files"))


@query(f"""WITH {_MANIFEST}
SELECT module, 'file_missing' AS type, 'Source file no longer exists: ' || path AS detail FROM j WHERE cur IS NULL UNION ALL SELECT module, 'needs_delete', 'All source files removed' FROM g WHERE k = 0
UNION ALL SELECT module, 'file_changed', 'Hash changed: ' || hash[:12] || '... → ' || h[:12] || '...' FROM mods JOIN g USING (module) WHERE k > 0 AND h <> hash
UNION ALL SELECT module, 'needs_create', 'New module detected (' || n::VARCHAR || ' file(s)): ' || names || CASE WHEN n > 3 THEN '...' ELSE '' END FROM add""")
def manifest_changes(t: Tables) -> DataFrame:
    return state.update_manifest(*_manifest(t))[2]


def _manifest(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(modules, sources) of an earlier slice and the files of a later one."""
    u = F.col("user_id")
    path = F.concat(F.lit("src/"), F.when(u % 9 == 4, "late").otherwise("m"), (u % 40).cast("string"), F.lit("/"), F.lpad(u.cast("string"), 5, "0"), F.lit(".py"))
    e = t.events.select(u.alias("u"), path.alias("path"), "event_id", "ts")
    day = lambda d: F.col("ts") < F.lit(f"2024-01-0{d}").cast("timestamp_ntz")
    files = lambda c: e.filter(c).groupBy("path").agg(F.max("event_id").alias("mtime")).withColumn("fingerprint", F.sha2(F.col("mtime").cast("string"), 256))
    none = files(F.lit(False))
    modules, sources, _ = state.update_manifest(*state.empty_manifest(t.spark), files(day(3) & (F.col("u") % 9 != 4)).unionByName(none))
    modules = modules.withColumns({"mtime": F.lit(0).cast("long"), "doc_status": F.when(F.length("module") == 2, "in_review")})
    now = files(((day(3) & (F.col("u") % 7 != 0)) | (day(4) & (F.col("u") % 5 == 0))) & (F.col("u") % 40 != 17))
    return modules, sources, now


@query("""
WITH c AS (SELECT user_id, arg_max(event_id, ts) AS v, max(ts) AS e FROM events WHERE event_type = 'view' AND user_id % 3 <> 0 GROUP BY 1), f AS (SELECT user_id, max(event_id) AS v FROM events WHERE event_type = 'click' AND user_id % 2 = 0 GROUP BY 1), k AS (SELECT DISTINCT user_id FROM events)
SELECT k.user_id, CASE WHEN c.e > TIMESTAMP '2024-01-29' THEN c.v ELSE coalesce(f.v, c.v) END AS event_id, CASE WHEN c.e > TIMESTAMP '2024-01-29' THEN 'fresh' WHEN f.v IS NOT NULL THEN 'fetched' WHEN c.v IS NOT NULL THEN 'stale' ELSE 'error' END AS origin
FROM k LEFT JOIN c USING (user_id) LEFT JOIN f USING (user_id)""")
def ttl_fresh_else_stale(t: Tables) -> DataFrame:
    cache = t.events.filter("event_type = 'view' and user_id % 3 <> 0").select("user_id", "event_id", "ts")
    fetched = t.events.filter("event_type = 'click' and user_id % 2 = 0").select("user_id", "event_id")
    return state.fresh_else_stale(t.events.select("user_id").distinct(), cache, fetched, "user_id", "event_id", "ts", F.lit("2024-01-29").cast("timestamp_ntz"))


@query("SELECT event_id, props FROM events WHERE user_id = 8 AND ts > TIMESTAMP '2024-01-15'")
def ttl_lookup(t: Tables) -> DataFrame:
    return t.events.filter((F.col("user_id") == 8) & (F.col("ts") > F.lit("2024-01-15").cast("timestamp_ntz"))).select("event_id", "props")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-15') AS expired, sum(length(props))::BIGINT AS bytes FROM events")
def cache_stats(t: Tables) -> DataFrame:
    return state.cache_stats(t.events, "ts", "props", F.lit("2024-01-15").cast("timestamp_ntz"))


_STATES = {"signup": "queued", "view": "in_progress", "click": "retrying", "purchase": "succeeded", "error": "failed"}


_MOVES = f"""
WITH a(was, now) AS (VALUES {_values([(k, v) for k, vs in C.TRANSITIONS.items() for v in vs])}),
s AS (SELECT user_id, event_id, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATES.items())} END AS status FROM events),
l AS (SELECT *, coalesce(lag(status) OVER w, 'pending') AS was, sum((status = 'retrying')::INTEGER) OVER w::BIGINT AS attempts FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, status, l.was, l.was = status OR a.now IS NOT NULL AS legal, attempts FROM l LEFT JOIN a ON a.was = l.was AND a.now = status"""


@query(_MOVES)
def transition_check(t: Tables) -> DataFrame:
    status = F.element_at(F.create_map(*[F.lit(x) for kv in _STATES.items() for x in kv]), F.col("event_type"))
    return state.check_transitions(t.events.select("user_id", "event_id", status.alias("status")), "user_id", ["event_id"], "status")


@query(_MOVES)
def transition_stream(t: Tables) -> DataFrame:
    """The same rows by a stream with keyed state: events go to a folder, and the stream's rows to another."""
    status = F.element_at(F.create_map(*[F.lit(x) for kv in _STATES.items() for x in kv]), F.col("event_type"))
    folder = answers.folder_for(t.spark, "steps")
    t.events.select("user_id", "event_id", status.alias("status")).write.parquet(f"{folder}/in")
    steps = stateful.step_stream(t.spark.readStream.schema("user_id long, event_id long, status string").parquet(f"{folder}/in"), "user_id", "status", "event_id", strict=False)
    with stateful.with_state_store(t.spark):
        steps.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select(F.col("key").alias("user_id"), F.col("seq").alias("event_id"), "status", "was", "legal", "attempts")


@query("SELECT page_id, list_sort(list_distinct([lower(x) FOR x IN regexp_extract_all(url, '\\.([a-z]+)', 1) IF x IN ('com', 'net', 'org', 'html')])) AS census FROM pages")
def ext_language_census(t: Tables) -> DataFrame:
    found = F.filter(extract.matches(F.col("url"), r"\.([a-z]+)", 1), lambda x: x.isin("com", "net", "org", "html"))
    return t.pages.select("page_id", F.array_sort(F.array_distinct(found)).alias("census"))


@query("SELECT user_id, bool_or(event_type = 'purchase') AS has_purchase, bool_or(event_type = 'signup') AS has_signup FROM events GROUP BY 1")
def marker_detect(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("has_purchase"), F.bool_or(F.col("event_type") == "signup").alias("has_signup"))
