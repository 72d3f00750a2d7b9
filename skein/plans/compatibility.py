"""Queries on slugs, ages, compatibility scores and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import readers
from .queries import Tables, _in, query

_PATHS = ["github.com/acme/tool", "github.com/acme/tool.git", "github.com/acme/tool/v2", "gopkg.in/acme/yaml.v3", "gitlab.com/acme/tool", "github.com/acme", "example.com"]
_TYPES = ["str", "String", "bytes", "Vec<u8>", "json", "JsonValue", "int", ""]


def _pick(values: list[str], number) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


@query(f"""SELECT p_partkey, CASE WHEN x[1] = 'github.com' AND len(x) > 2 THEN x[2] || '/' || CASE WHEN ends_with(x[3], '.git') THEN left(x[3], length(x[3]) - 4) ELSE x[3] END WHEN x[1] = 'gopkg.in' AND len(x) > 2 THEN x[2] || '/' || split_part(x[3], '.v', 1) END AS slug
FROM (SELECT p_partkey, string_split([{_in(_PATHS)}][(p_partkey % 7)::INTEGER + 1], '/') AS x FROM part)""")
def extract_slug(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.github_slug(_pick(_PATHS, F.col("p_partkey"))).alias("slug"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN c_name WHEN c_nationkey % 5 = 0 THEN c_mktsegment ELSE 'home' END AS url FROM customer""")
def priority_map_get(t: Tables) -> DataFrame:
    value = lambda c, v: F.when(c, v).otherwise(F.lit(""))
    urls = F.create_map(F.lit("Other"), F.lit("home"), F.lit("Source"), value(F.col("c_nationkey") % 5 == 0, F.col("c_mktsegment")), F.lit("Repository"), value(F.col("c_nationkey") % 3 == 0, F.concat(F.lit(" "), "c_name")))
    return t.customer.select("c_custkey", S.priority_get(urls, ["Repository", "Source", "Homepage"]).alias("url"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS released, round(least(user_id / 100.0::DOUBLE * 0.5::DOUBLE + CASE WHEN event_type = 'error' THEN 0.1::DOUBLE WHEN a <= 30 THEN 0.3::DOUBLE WHEN a <= 365 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END * 0.5::DOUBLE, 1.0::DOUBLE), 9) AS score
FROM (SELECT *, greatest((1707782400000 - epoch_ms(ts)) / 86400000.0::DOUBLE, 0) AS a FROM events)""")
def epoch_ms_age(t: Tables) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    score = S.version_count_score(F.col("user_id"), F.when(F.col("event_type") != "error", ms), 1707782400000)
    return t.events.select("event_id", S.iso_from_ms(ms).alias("released"), F.round(score, 9).alias("score"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_discount * 2.5::DOUBLE + l_tax * 2.5::DOUBLE + 0.15::DOUBLE * l_quantity / 50 + 0.15::DOUBLE * 0.3::DOUBLE
 + 0.1::DOUBLE * (1.0::DOUBLE - CASE WHEN l_returnflag = 'A' AND l_linestatus <> 'F' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN (l_quantity > 25) <> (l_tax > 0.04) THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) + 0.1::DOUBLE * 0.5::DOUBLE, 6) AS overall FROM lineitem""")
def weighted_compat(t: Tables) -> DataFrame:
    runtime = S.runtime_compatibility(F.col("l_returnflag") == "A", F.col("l_linestatus") == "F", F.col("l_quantity") > 25, F.col("l_tax") > 0.04)
    overall = S.weighted_compatibility(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50, F.lit(0.3), runtime, F.lit(0.5))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(overall, 6).alias("overall"))


@query(f"""SELECT p_partkey, CASE WHEN s = d THEN 'identity' WHEN s IN ('str', 'string') AND d IN ('str', 'string') THEN 'identity' WHEN contains(s, 'json') AND contains(d, 'json') THEN 'identity'
 WHEN s IN ('bytes', 'vec<u8>') AND d IN ('str', 'string') THEN 'decode' WHEN s IN ('str', 'string') AND d IN ('bytes', 'vec<u8>') THEN 'encode' WHEN p_size % 2 = 1 THEN 'bridge' ELSE 'cast' END AS transform
FROM (SELECT p_partkey, p_size, lower([{_in(_TYPES)}][(p_partkey % 8)::INTEGER + 1]) AS s, lower([{_in(_TYPES)}][((p_partkey // 8) % 8)::INTEGER + 1]) AS d FROM part)""")
def return_transform(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.return_transform(_pick(_TYPES, F.col("p_partkey")), _pick(_TYPES, F.floor(F.col("p_partkey") / 8)), F.col("p_size") % 2 == 0).alias("transform"))


@query("""SELECT o_orderkey, round(CASE WHEN o_custkey % 2 = 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN o_orderstatus <> 'O' THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN o_custkey % 3 = 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN o_custkey % 5 = 0 THEN 0.15::DOUBLE ELSE 0 END, 3) AS score FROM orders""")
def dimension_scores(t: Tables) -> DataFrame:
    c, s = F.col("o_custkey"), F.col("o_orderstatus")
    return t.orders.select("o_orderkey", F.round(S.direction_score(c % 2 == 0, s == "F", s != "O", c % 3 == 0, c % 5 == 0), 3).alias("score"))


@query("""SELECT o_custkey, coalesce(string_agg(CASE o_orderstatus WHEN 'F' THEN 'first' WHEN 'O' THEN 'second' ELSE o_orderstatus END || n::VARCHAR, '  ' ORDER BY o_orderstatus) FILTER (WHERE n <> 1), '') AS seats
FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1""")
def map_to_label_string(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).cast("string").alias("n"))
    m = n.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    return m.select("o_custkey", S.label_string(F.col("m"), {"F": "first", "O": "second"}, ["1"]).alias("seats"))


@query("SELECT doc_id, sha256(unhex(substr(hex(encode(text)), 1, 8192)) || encode(strlen(text)::VARCHAR || source)) AS fingerprint FROM documents")
def fingerprint(t: Tables) -> DataFrame:
    """The first 4096 bytes of whole texts, their size and source."""
    return t.documents.select("doc_id", readers.fingerprint(F.col("text"), F.octet_length("text"), F.col("source")).alias("fingerprint"))
