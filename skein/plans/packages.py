"""Queries on package metadata: registry snapshots, scores, licenses, formats, caches and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import packages as P
from ..functions import scalars as S
from ..operators import dedup, matching, ranking
from ..sources import answers, sinks
from ..sources import registries as R
from .queries import ORACLES, Tables, _any, _in, query

AS_OF, NOW_MS = "2024-02-01", 1706745600000  # the same instant


def _snapshots(rows: DataFrame, key: str | list[str], seq: str, items: str, item: Column, **more: Column) -> DataFrame:
    """One JSON answer per key, as a registry gives it: the table's rows in order under ``items``."""
    keys = [key] if isinstance(key, str) else key
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.to_json(item).alias("x")))).alias("a"), F.count(F.lit(1)).alias("n"))
    rest = F.concat(F.lit(","), F.regexp_replace(F.to_json(F.struct(*(c.alias(n) for n, c in more.items()))), r"^\{|\}$", "")) if more else F.lit("")
    return g.select(*keys, F.concat(F.lit(f'{{"{items}":['), F.array_join(F.transform("a", lambda y: y["x"]), ","), F.lit("]"), rest, F.lit("}")).alias("body"))


#: A registry answers one request with some tens of rows: a brand's parts are asked for in pages of 1000 keys.
_ASKED = "asked AS (SELECT * REPLACE (p_brand || '/' || (p_partkey // 1000)::VARCHAR AS p_brand) FROM part)"


def _asked(t: Tables) -> DataFrame:
    return t.part.withColumn("p_brand", F.concat_ws("/", "p_brand", F.floor(F.col("p_partkey") / 1000).cast("string")))


_PLACE = "(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INTEGER AS position, count(*) OVER (PARTITION BY p_brand) AS n"


def _npm_answers(t: Tables) -> DataFrame:
    date = F.when(F.col("p_size") % 7 != 0, F.concat(F.date_format(F.date_sub(F.lit(AS_OF).cast("date"), F.col("p_size") * 20), "yyyy-MM-dd"), F.lit("T00:00:00.500Z")))
    package = F.struct(F.col("p_name").alias("name"), F.concat(F.lit("1."), "p_size").alias("version"), F.lower("p_type").alias("description"), date.alias("date"), F.lit("MIT").alias("license"), F.struct(F.concat(F.lit("https://npm/"), "p_partkey").alias("npm")).alias("links"))
    detail = F.struct(F.struct((F.col("p_size") / 50.0).alias("popularity"), (F.col("p_retailprice").cast("long") * 1000).alias("downloads")).alias("detail"))
    return _snapshots(_asked(t), "p_brand", "p_partkey", "objects", F.struct(package.alias("package"), detail.alias("score")))


@query(f"""
WITH {_ASKED}, r AS (SELECT *, {_PLACE}, trunc(p_size / 50.0::DOUBLE * 10000)::BIGINT AS stars, trunc(p_retailprice)::BIGINT * 1000 AS dl, CASE WHEN p_size % 7 = 0 THEN 999 ELSE p_size * 20 END AS days FROM asked)
SELECT p_brand, position, p_name AS name, '1.' || p_size::VARCHAR AS version, lower(p_type) AS description, 'https://npm/' || p_partkey::VARCHAR AS registry_url, stars, dl AS downloads,
 CASE WHEN p_size % 7 = 0 THEN '' ELSE strftime(DATE '2024-02-01' - (p_size * 20)::INTEGER, '%Y-%m-%d') || 'T00:00:00.500Z' END AS last_commit, 'MIT' AS license_name,
 round((least(stars / 10000::DOUBLE * 0.4::DOUBLE + least(dl / 1000000.0::DOUBLE, 1.0::DOUBLE) * 0.3::DOUBLE + CASE WHEN days <= 30 THEN 0.3::DOUBLE WHEN days <= 365 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END * 0.3::DOUBLE, 1.0::DOUBLE))::DECIMAL(18, 10), 4)::DOUBLE AS score, n >= 20 AS has_more FROM r""")
def npm_rows(t: Tables) -> DataFrame:
    return R.npm(_npm_answers(t), "p_brand", "body", AS_OF)


def _crates_answers(t: Tables) -> DataFrame:
    doc, home = (F.when(F.col("p_size") % 3 == k, F.concat(F.lit(f"https://{w}/"), "p_partkey")).otherwise("") for k, w in ((0, "docs"), (1, "home")))
    item = F.struct(F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("max_version"), F.col("p_type").alias("description"), doc.alias("documentation"), home.alias("homepage"), (F.col("p_partkey") * 400).alias("downloads"), (F.col("p_size") * 10).alias("recent_downloads"))
    return _snapshots(_asked(t), "p_brand", "p_partkey", "crates", item, meta=F.struct((F.col("n") + 1).alias("total")))


@query(f"""
WITH {_ASKED}, r AS (SELECT *, {_PLACE} FROM asked)
SELECT p_brand, position, p_name AS name, p_size::VARCHAR AS version, p_type AS description, CASE WHEN p_size % 3 = 0 THEN 'https://docs/' || p_partkey::VARCHAR WHEN p_size % 3 = 1 THEN 'https://home/' || p_partkey::VARCHAR ELSE 'https://crates.io/crates/' || p_name END AS registry_url,
 0::BIGINT AS stars, p_partkey * 400 AS downloads, '' AS last_commit, '' AS license_name, round((least(p_partkey * 400 / 1e6::DOUBLE * 0.5::DOUBLE + p_size * 10 / 1e4::DOUBLE * 0.5::DOUBLE, 1.0::DOUBLE))::DECIMAL(18, 10), 4)::DOUBLE AS score, n + 1 > n AS has_more FROM r""")
def crates_rows(t: Tables) -> DataFrame:
    return R.crates(_crates_answers(t), "p_brand", "body")


def _maven_answers(t: Tables) -> DataFrame:
    released = F.when(F.col("p_size") % 5 != 0, F.lit(NOW_MS) - F.col("p_size").cast("long") * 20 * 86_400_000)
    ids = F.concat_ws(":", F.lower(F.replace("p_brand", F.lit("#"), F.lit("."))), F.replace("p_name", F.lit(" "), F.lit("-")))
    item = F.struct(ids.alias("id"), F.col("p_type").alias("g"), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.when(F.col("p_size") % 6 == 1, "x-kt").otherwise("lib")).alias("a"), F.col("p_size").cast("string").alias("latestVersion"), F.col("p_size").cast("long").alias("versionCount"), released.alias("timestamp"))
    g = _snapshots(_asked(t), "p_brand", "p_partkey", "docs", item, numFound=F.col("n"))
    return g.select("p_brand", F.concat(F.lit('{"response":'), "body", F.lit("}")).alias("body"))


_MAVEN = f"""
{_ASKED}, r AS (SELECT *, lower(replace(p_brand, '#', '.')) || ':' || replace(p_name, ' ', '-') AS id, CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 6 = 1 THEN 'x-kt' ELSE 'lib' END AS a, CASE WHEN p_size % 5 <> 0 THEN 1706745600000 - p_size::BIGINT * 20 * 86400000 END AS ms FROM asked),
f AS (SELECT *, least(p_size / 100::DOUBLE * 0.5::DOUBLE + CASE WHEN ms IS NULL THEN 0.1::DOUBLE WHEN p_size * 20 <= 30 THEN 0.3::DOUBLE WHEN p_size * 20 <= 365 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END * 0.5::DOUBLE, 1.0::DOUBLE) AS s,
  contains(lower(id || ' ' || p_type || ' ' || a), 'kotlin') OR contains(lower(id || ' ' || p_type || ' ' || a), 'kt') AS kt FROM r)"""
_MAVEN_ROW = """id AS name, p_size::VARCHAR AS version, CASE WHEN a = '' THEN id ELSE p_type || ':' || a END AS description, 'https://search.maven.org/artifact/' || replace(id, ':', '/') || '/' || p_size::VARCHAR || '/jar' AS registry_url, p_size::BIGINT AS stars, 0::BIGINT AS downloads,
 coalesce(strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%SZ'), '') AS last_commit, '' AS license_name"""


@query(f"WITH {_MAVEN} SELECT p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INTEGER AS position, {_MAVEN_ROW}, round(s, 4) AS score, false AS has_more FROM f")
def maven_rows(t: Tables) -> DataFrame:
    return R.maven(_maven_answers(t), "p_brand", "body", NOW_MS)


@query(f"""WITH {_MAVEN}, p AS (SELECT *, (row_number() OVER (PARTITION BY p_brand ORDER BY kt DESC, p_partkey) - 1)::INTEGER AS position FROM f)
SELECT p_brand, position, {_MAVEN_ROW}, round(CASE WHEN kt THEN least(s + 0.2::DOUBLE, 1.0::DOUBLE) ELSE s END, 4) AS score, false AS has_more FROM p""")
def kotlin_rows(t: Tables) -> DataFrame:
    return R.maven(_maven_answers(t), "p_brand", "body", NOW_MS, kotlin_first=True, limit=None)


def _vcpkg_answers(t: Tables) -> DataFrame:
    port = F.replace("p_name", F.lit(" "), F.lit("-"))
    item = F.struct(F.concat(F.when(F.col("p_size") % 5 != 0, "ports/").otherwise("docs/"), port, F.lit("/vcpkg.json")).alias("path"))
    return _snapshots(_asked(t), "p_brand", "p_partkey", "items", item, total_count=F.col("n"))


@query(f"""
WITH {_ASKED}, f AS (SELECT p_brand, replace(p_name, ' ', '-') AS port, min(p_partkey) AS first FROM asked WHERE p_size % 5 <> 0 GROUP BY ALL), p AS (SELECT *, (row_number() OVER (PARTITION BY p_brand ORDER BY first) - 1)::INTEGER AS position, count(*) OVER (PARTITION BY p_brand) AS k FROM f),
n AS (SELECT p_brand, count(*) AS n FROM asked GROUP BY 1), v AS (SELECT replace(p_name, ' ', '-') AS port, min(p_size::VARCHAR) AS version FROM part WHERE p_size % 2 = 0 GROUP BY 1)
SELECT p_brand, position, port AS name, coalesce(version, '') AS version, 'https://github.com/microsoft/vcpkg/tree/master/ports/' || port AS registry_url, 0.5::DOUBLE AS score, n > least(k, 20) AS has_more FROM p JOIN n USING (p_brand) LEFT JOIN v USING (port) WHERE position < 20""")
def vcpkg_rows(t: Tables) -> DataFrame:
    versions = t.part.filter("p_size % 2 = 0").select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("port"), F.col("p_size").cast("string").alias("version"))
    return R.vcpkg(_vcpkg_answers(t), "p_brand", "body", versions)


def _packagist_answers(t: Tables) -> DataFrame:
    item = F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.concat(F.lit("https://packagist/"), "p_name").alias("url"), (F.col("p_size") * F.col("p_size")).alias("favers"), (F.col("p_partkey") * 4000).alias("downloads"), F.when(F.col("p_size") % 3 != 1, F.col("p_size") % 3 == 0).alias("abandoned"), F.lit("MIT").alias("license"))
    return _snapshots(_asked(t), "p_brand", "p_partkey", "results", item)


@query(f"""
WITH {_ASKED}, r AS (SELECT *, {_PLACE}, p_size * p_size AS stars, p_partkey * 4000 AS dl FROM asked)
SELECT p_brand, position, p_name AS name, '' AS version, p_type AS description, 'https://packagist/' || p_name AS registry_url, stars::BIGINT AS stars, dl AS downloads, '' AS last_commit, 'MIT' AS license_name,
 least(CASE WHEN stars > 1000 THEN 0.4::DOUBLE WHEN stars > 100 THEN 0.3::DOUBLE WHEN stars > 10 THEN 0.2::DOUBLE WHEN stars > 1 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN dl > 10000000 THEN 0.3::DOUBLE WHEN dl > 1000000 THEN 0.25::DOUBLE WHEN dl > 100000 THEN 0.2::DOUBLE WHEN dl > 1000 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
 + CASE WHEN p_size % 3 = 0 THEN 0.0::DOUBLE ELSE 0.3::DOUBLE END, 1.0::DOUBLE) AS score, n >= 20 AS has_more FROM r""")
def packagist_rows(t: Tables) -> DataFrame:
    return R.packagist(_packagist_answers(t), "p_brand", "body")


def _repository_answers(t: Tables) -> DataFrame:
    updated = F.when(F.col("p_size") % 9 == 0, "soon").otherwise(F.concat(F.date_format(F.date_sub(F.lit(AS_OF).cast("date"), F.col("p_size") * 20), "yyyy-MM-dd"), F.lit("T00:00:00Z")))
    licence = F.struct(F.when(F.col("p_size") % 2 == 0, "MIT").otherwise("").alias("spdxId"), F.lit("Some License").alias("name"))
    item = F.struct(F.col("p_name").alias("fullName"), F.when(F.col("p_size") % 4 != 0, F.col("p_size") * 30).alias("stargazersCount"), F.col("p_type").alias("description"), F.concat(F.lit("https://g/"), "p_name").alias("url"), updated.alias("updatedAt"), licence.alias("license"))
    g = _asked(t).groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("x")))).alias("a"))
    return g.select("p_brand", F.to_json(F.transform("a", lambda y: y["x"])).alias("body"))


@query(f"""
WITH {_ASKED}, r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nth, CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size * 30 END AS stars, CASE WHEN p_size % 9 = 0 THEN 999 ELSE p_size * 20 END AS days FROM asked),
k AS (SELECT *, (row_number() OVER (PARTITION BY p_brand ORDER BY nth) - 1)::INTEGER AS position, count(*) OVER (PARTITION BY p_brand) AS n FROM r WHERE nth <= 20 AND NOT (stars = 0 AND days > 365))
SELECT p_brand, position, p_name AS name, '' AS version, p_type AS description, 'https://g/' || p_name AS registry_url, stars::BIGINT AS stars, 0::BIGINT AS downloads, CASE WHEN p_size % 9 = 0 THEN 'soon' ELSE strftime(DATE '2024-02-01' - (p_size * 20)::INTEGER, '%Y-%m-%d') || 'T00:00:00Z' END AS last_commit,
 CASE WHEN p_size % 2 = 0 THEN 'MIT' ELSE 'Some License' END AS license_name, least(CASE WHEN stars > 1000 THEN 0.3::DOUBLE WHEN stars > 100 THEN 0.2::DOUBLE WHEN stars > 10 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + 0.0::DOUBLE + CASE WHEN days < 30 THEN 0.3::DOUBLE WHEN days < 365 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END, 1.0::DOUBLE) AS score, n >= 20 AS has_more FROM k""")
def repository_rows(t: Tables) -> DataFrame:
    return R.repositories(_repository_answers(t), "p_brand", "body", AS_OF)


def _module_page_answers(t: Tables) -> DataFrame:
    day = F.when(F.col("p_size") % 4 == 0, "soon").otherwise(F.date_format(F.date_sub(F.lit(AS_OF).cast("date"), F.col("p_size") * 20), "MMM d, yyyy"))
    one = F.format_string(
        '<div class="SearchSnippet" data-x="1"><span class="SearchSnippet-header-path">(%s)</span><p class="SearchSnippet-synopsis">\n %s </p>Imported by <a><strong>%s</strong></a> | <strong>v1.%s</strong> <span data-test-id="snippet-published"><strong>%s</strong></span> <span data-test-id="snippet-license"><a href="/l">MIT</a></span></div>\n</div>\n',
        F.concat(F.lit("ex.org/"), F.replace("p_name", F.lit(" "), F.lit("/"))), F.col("p_type"), F.format_number(F.col("p_partkey") * 1001, 0), F.col("p_size"), day,
    )
    g = _asked(t).groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", one.alias("x")))).alias("a"))
    return g.select("p_brand", F.concat(F.lit("<html>"), F.array_join(F.transform("a", lambda y: y["x"]), ""), F.lit("</html>")).alias("html"))


@query(f"""
WITH {_ASKED}, r AS (SELECT *, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INTEGER AS position, p_partkey * 1001 AS n, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size * 20 END AS days FROM asked)
SELECT p_brand, position, 'ex.org/' || replace(p_name, ' ', '/') AS name, CASE WHEN p_partkey = 0 THEN '0' ELSE 'v1.' || p_size::VARCHAR END AS version, p_type AS description, 'https://pkg.go.dev/ex.org/' || replace(p_name, ' ', '/') AS registry_url, n::BIGINT AS downloads, CASE WHEN days IS NULL THEN 'soon' ELSE strftime(DATE '2024-02-01' - days::INTEGER, '%Y-%m-%d') END AS last_commit, 'MIT' AS license_name,
 least(0.0::DOUBLE + CASE WHEN n > 100000 THEN 0.3::DOUBLE WHEN n > 10000 THEN 0.25::DOUBLE WHEN n > 1000 THEN 0.2::DOUBLE WHEN n > 100 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN days IS NULL THEN 0.1::DOUBLE WHEN days < 30 THEN 0.3::DOUBLE WHEN days < 365 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END, 1.0::DOUBLE) AS score FROM r""")
def module_page_rows(t: Tables) -> DataFrame:
    return R.module_pages(_module_page_answers(t), "p_brand", "html", AS_OF)


def _snippet_answers(t: Tables) -> DataFrame:
    one = F.format_string('<a class="package-snippet" href="/p"><span class="package-snippet__name"> %s </span> <span class="package-snippet__version">%s</span><p class="package-snippet__description">\n A <b>%s</b> part </p></a>', F.when(F.col("p_size") % 6 != 0, F.col("p_name")).otherwise(" "), "p_size", "p_type")
    g = _asked(t).groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", one.alias("x")))).alias("a"))
    return g.select("p_brand", F.concat(F.lit("<html>"), F.array_join(F.transform("a", lambda y: y["x"]), "\n"), F.lit("</html>")).alias("body"))


@query(f"""
WITH {_ASKED}, r AS (SELECT *, {_PLACE} FROM asked)
SELECT p_brand, position, p_name AS name, p_size::VARCHAR AS version, 'A ' || p_type || ' part' AS description FROM r WHERE position < 20 AND p_size % 6 <> 0""")
def snippet_rows(t: Tables) -> DataFrame:
    """Search pages of Python packages; a snippet without a name is no row."""
    return R.snippet_pages(_snippet_answers(t), "p_brand", "body")


#: Each backend's answers in the fixture, and the query whose SQL gives its rows.
_BACKENDS = {
    "javascript": (_npm_answers, "npm_rows"), "rust": (_crates_answers, "crates_rows"), "java": (_maven_answers, "maven_rows"), "c_cpp": (_vcpkg_answers, "vcpkg_rows"),
    "php": (_packagist_answers, "packagist_rows"), "github": (_repository_answers, "repository_rows"), "go": (_module_page_answers, "module_page_rows"), "python": (_snippet_answers, "snippet_rows"),
}


def _all_rows() -> str:
    """The SQL rows of all backends; what one doesn't give is empty, 0 or false."""
    given = {"snippet_rows": "name version description", "vcpkg_rows": "name version registry_url score has_more", "module_page_rows": "name version description registry_url downloads last_commit license_name score"}
    empty = {"name": "''", "version": "''", "description": "''", "registry_url": "''", "stars": "0", "downloads": "0", "last_commit": "''", "license_name": "''", "score": "0.0::DOUBLE", "has_more": "false"}
    one = lambda b, q: f"SELECT '{b}' AS backend, p_brand AS key, position, {', '.join(c if q not in given or c in given[q].split() else f'{v} AS {c}' for c, v in empty.items())} FROM ({ORACLES[q]})"
    return " UNION ALL ".join(one(b, q) for b, (_, q) in _BACKENDS.items())


def saved_answers(t: Tables) -> str:
    """A folder with the fixture's answers of all backends."""
    folder = answers.folder_for(t.spark, "answers")
    every = [f(t).toDF("key", "body").select(F.lit(b).alias("backend"), "key", "body") for b, (f, _) in _BACKENDS.items()]
    answers.save(reduce(DataFrame.unionByName, every), folder)
    return folder


def _backends(t: Tables) -> dict[str, answers.Backend]:
    versions = t.part.filter("p_size % 2 = 0").select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("port"), F.col("p_size").cast("string").alias("version"))
    return {b: f for b, f in answers.default_backends(AS_OF, NOW_MS, versions).items() if b in _BACKENDS}


@query(_all_rows())
def saved_search_rows(t: Tables) -> DataFrame:
    """The search rows of every backend from saved answers."""
    return answers.search_rows(t.spark, saved_answers(t), _backends(t))


@query(f"SELECT * FROM ({_all_rows()}) WHERE backend IN ('rust', 'go') AND key LIKE 'Brand#1%/0'")
def saved_search_filtered(t: Tables) -> DataFrame:
    """Some backends' rows for some keys: only these backends' files are opened."""
    return answers.search_rows(t.spark, saved_answers(t), _backends(t)).filter(F.col("backend").isin("rust", "go") & F.col("key").like("Brand#1%/0"))


@query("""
WITH a AS (SELECT DISTINCT p_name AS slug FROM part), k AS (SELECT p_name AS slug, max(p_retailprice) AS stars FROM part WHERE p_size > 30 GROUP BY 1), m AS (SELECT slug, row_number() OVER (ORDER BY slug) AS n FROM a ANTI JOIN k USING (slug))
SELECT slug, stars, NULL::BIGINT AS batch FROM a JOIN k USING (slug) UNION ALL SELECT slug, NULL, floor((n - 1) / 10)::BIGINT FROM m""")
def star_batches(t: Tables) -> DataFrame:
    cache = t.part.filter("p_size > 30").select(F.col("p_name").alias("slug"), F.col("p_retailprice").alias("stars"))
    return R.cached_and_missing(t.part.select(F.col("p_name").alias("slug")), cache, "slug", "stars")


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nth FROM lineitem), p AS (SELECT l_orderkey, arg_max(l_extendedprice::VARCHAR, nth) AS price, l_partkey % 5 AS code FROM l GROUP BY l_orderkey, l_partkey % 5),
ok AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
SELECT l.l_orderkey, (nth - 1)::INTEGER AS position, 'G' || (l_partkey % 5)::VARCHAR AS train_no, l_suppkey::VARCHAR AS from_station, (l_quantity::INTEGER)::VARCHAR AS second, l.l_returnflag AS seat, p.price FROM l JOIN ok ON o_orderkey = l.l_orderkey LEFT JOIN p ON p.l_orderkey = l.l_orderkey AND p.code = l_partkey % 5""")
def train_rows(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumn("s", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderstatus") != "P").alias("ok")), "l_orderkey")
    key = ["l_orderkey", "ok"]  # as columns: the join has dealt rows by the first
    code = F.concat(F.lit("G"), (F.col("l_partkey") % 5).cast("string"))
    seats = F.create_map(F.lit("second"), F.col("l_quantity").cast("int").cast("string"), F.lit("flag"), F.col("l_returnflag"))
    ok = F.col("ok")
    trains = _snapshots(lines, key, "s", "trains", F.struct(code.alias("train_no"), F.col("l_suppkey").cast("string").alias("from_station"), seats.alias("seats")), success=ok)
    prices = _snapshots(lines, key, "s", "data", F.struct(code.alias("train_code"), F.create_map(F.lit("second"), F.col("l_extendedprice").cast("string")).alias("prices")), success=ok)
    p = R.train_prices(prices, "l_orderkey", "body").withColumnRenamed("train_code", "train_no")
    return R.trains(trains, "l_orderkey", "body").join(p, ["l_orderkey", "train_no"], "left").select("l_orderkey", "position", "train_no", "from_station", F.col("seats")["second"].alias("second"), F.col("seats")["flag"].alias("seat"), F.col("prices")["second"].alias("price"))


@query("""
WITH r AS (SELECT o_custkey AS query, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS position, o_orderkey, o_orderstatus FROM orders WHERE o_custkey % 8 <> 0)
SELECT query, position, 'S' || o_orderkey::VARCHAR AS name, 'C' || (o_orderkey % 100)::VARCHAR AS code, lower(o_orderstatus) AS pinyin, o_orderstatus AS py_short, CASE WHEN o_orderstatus <> 'P' THEN 'city' ELSE '' END AS city FROM r WHERE position < 15""")
def station_rows(t: Tables) -> DataFrame:
    """A station search for each customer; those that failed give none."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    item = F.struct(F.concat(F.lit("S"), k).alias("name"), F.concat(F.lit("C"), k % 100).alias("code"), F.lower(s).alias("pinyin"), s.alias("py_short"), F.when(s != "P", "city").alias("city"))
    g = _snapshots(t.orders.withColumn("query", F.struct("o_custkey", (F.col("o_custkey") % 8 != 0).alias("ok"))), "query", "o_orderkey", "stations", item, success=F.col("query.ok"))
    return R.stations(g.select(F.col("query.o_custkey").alias("query"), "body"), "query", "body")


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nth FROM lineitem)
SELECT l_orderkey AS train, (nth - 1)::INTEGER AS position, lpad(nth::VARCHAR, 2, '0') AS station_no, 'S' || l_suppkey::VARCHAR AS station_name, CASE WHEN l_linenumber > 1 THEN '08:0' || l_linenumber::VARCHAR ELSE '----' END AS arrive_time, '09:0' || l_linenumber::VARCHAR AS start_time, CASE WHEN l_returnflag = 'A' THEN '3min' ELSE '' END AS stopover_time
FROM l JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'""")
def train_stop_rows(t: Tables) -> DataFrame:
    """The stops of each train whose answer succeeded."""
    lines = t.lineitem.withColumn("s", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderstatus") != "P").alias("ok")), "l_orderkey")
    lines = lines.withColumns({"nth": F.row_number().over(Window.partitionBy("l_orderkey").orderBy("s"))})
    n = F.col("l_linenumber")
    stop = F.struct(F.lpad(F.col("nth").cast("string"), 2, "0").alias("station_no"), F.concat(F.lit("S"), "l_suppkey").alias("station_name"), F.when(n > 1, F.concat(F.lit("08:0"), n)).alias("arrive_time"), F.concat(F.lit("09:0"), n).alias("start_time"), F.when(F.col("l_returnflag") == "A", "3min").alias("stopover_time"))
    g = _snapshots(lines, ["l_orderkey", "ok"], "s", "stations", stop, success=F.col("ok"))
    return R.train_stops(g.select(F.col("l_orderkey").alias("train"), "body"), "train", "body")


@query("""
SELECT c_custkey // 40 AS page, (row_number() OVER (PARTITION BY c_custkey // 40 ORDER BY c_custkey) - 1)::INTEGER AS position, c_custkey AS id, c_name AS title, c_mktsegment AS cityName, printf('%.1fkm', CASE WHEN c_acctbal > 0 THEN c_acctbal + 0.123::DOUBLE ELSE 0 END / 1000) AS length, replace(c_name, '#', '_') AS file FROM customer WHERE (c_custkey // 40) % 4 <> 0""")
def route_rows(t: Tables) -> DataFrame:
    item = F.struct(F.col("c_custkey").alias("roadBookId"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("cityName"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") + 0.123).alias("distance"))
    g = _snapshots(t.customer.withColumn("page", F.floor(F.col("c_custkey") / 40)), "page", "c_custkey", "items", item)
    g = g.select("page", F.concat(F.lit('{"code":'), F.when(F.col("page") % 4 == 0, "5").otherwise("0"), F.lit(',"data":'), "body", F.lit("}")).alias("body"))
    return R.routes(g, "page", "body").select("page", "position", "id", "title", "cityName", P.kilometres(F.col("distance")).alias("length"), P.safe_name(F.col("title")).alias("file"))


@query("""
SELECT user_id AS route, 'route-' || user_id::VARCHAR AS title, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER AS position, event_id / 8.0::DOUBLE AS lat, value AS lon, CASE WHEN event_type <> 'error' THEN value * 2 END AS ele FROM events""")
def route_point_rows(t: Tables) -> DataFrame:
    p = F.struct((F.col("event_id") / 8).alias("latitude"), F.col("value").alias("longitute"), F.when(F.col("event_type") != "error", F.col("value") * 2).alias("altitude"))
    g = _snapshots(t.events, "user_id", "event_id", "tracks", p)
    g = g.select(F.col("user_id").alias("route"), F.concat(F.lit('{"code":0,"data":{"summary":{"title":""},"routeInfo":'), "body", F.lit("}}")).alias("body"))
    return R.route_points(g, "route", "body")


# Scores, licenses and plans.

_LICENSES = [*C.LICENSES, "Custom", "MPL-2.0", "AGPL-3.0"]


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


_PAIR = f"p AS (SELECT o_orderkey, [{_in(_LICENSES)}][(o_orderkey % 13)::INTEGER + 1] AS a, [{_in(_LICENSES)}][((o_orderkey // 13) % 13)::INTEGER + 1] AS b FROM orders)"


@query(f"""WITH {_PAIR}
SELECT o_orderkey, CASE WHEN a IN ('Custom', 'MPL-2.0', 'AGPL-3.0') OR b IN ('Custom', 'MPL-2.0', 'AGPL-3.0') THEN 0.3::DOUBLE WHEN a = '' THEN CASE WHEN b = '' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END
 WHEN a IN ('GPL-2.0', 'GPL-3.0') AND b IN ('MIT', 'Apache-2.0', 'BSD-2-Clause', 'BSD-3-Clause', '') THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS score FROM p""")
def license_scores(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", P.license_score(_pick(_LICENSES, F.col("o_orderkey")), _pick(_LICENSES, F.floor(F.col("o_orderkey") / 13))).alias("score"))


@query(f"""WITH {_PAIR}, c(k, cat) AS (VALUES {", ".join(f"('{x}', '{cat}')" for cat, ids in C.LICENSE_CATEGORIES.items() for x in ids)}), r(s, d, m) AS (VALUES {", ".join(map(str, C.REUSE_RULES))}),
q AS (SELECT p.*, CASE WHEN a = '' THEN 'unknown' ELSE coalesce(x.cat, 'proprietary') END AS ca, CASE WHEN b = '' THEN 'unknown' ELSE coalesce(y.cat, 'proprietary') END AS cb FROM p LEFT JOIN c x ON x.k = a LEFT JOIN c y ON y.k = b),
e AS (SELECT q.*, coalesce(m, 'reference_only') AS mode FROM q LEFT JOIN r ON s = ca AND d = cb)
SELECT o_orderkey, ca IN ('weak_copyleft', 'strong_copyleft') AS copyleft, mode = 'copy' AS compatible, CASE mode WHEN 'copy' THEN CASE WHEN ca = 'permissive' THEN 'Permissive license (' || a || ') — safe to copy into ' || b || ' project' WHEN ca = 'weak_copyleft' AND cb = 'strong_copyleft' THEN 'Weak copyleft (' || a || ') → strong copyleft (' || b || '): compatible'
 WHEN ca = 'strong_copyleft' THEN 'Strong copyleft (' || a || ') — can copy but target must be ' || a ELSE 'License compatibility: ' || a || ' → ' || b END WHEN 'port' THEN a || ' (weak copyleft) → ' || b || ': Port with care, keep modification notices'
 WHEN 'reference_only' THEN CASE WHEN ca = 'strong_copyleft' THEN a || ' (strong copyleft) cannot be copied into ' || b || ' project. Study design only.' ELSE a || ' → ' || b || ': Reference only, do not copy directly' END ELSE 'License conflict: ' || a || ' → ' || b || '. Do NOT reuse this code.' END AS why FROM e""")
def license_texts(t: Tables) -> DataFrame:
    a, b = _pick(_LICENSES, F.col("o_orderkey")), _pick(_LICENSES, F.floor(F.col("o_orderkey") / 13))
    rows = t.orders.select("o_orderkey", a.alias("a"), b.alias("b")).withColumns({"ca": matching.license_category(F.col("a")), "cb": matching.license_category(F.col("b")), "mode": matching.reuse_mode(F.col("a"), F.col("b"))})
    return rows.select("o_orderkey", F.col("ca").isin("weak_copyleft", "strong_copyleft").alias("copyleft"), (F.col("mode") == "copy").alias("compatible"), P.explain_license(*map(F.col, ["a", "b", "ca", "cb", "mode"])).alias("why"))


def _first_word(words: list[str]) -> str:
    return " ".join(f"WHEN contains(n, '{w}') THEN '{w}'" for w in words)


@query(f"""
WITH i AS (SELECT p_partkey, lower(p_name) || CASE WHEN p_size % 3 = 0 THEN ' export filter' WHEN p_size % 3 = 1 THEN ' tag sort' ELSE '' END AS n, CASE WHEN p_size < 5 THEN 'Core' WHEN p_size < 9 THEN 'batch' WHEN p_size < 12 THEN 'ui' ELSE '' END AS c, CASE WHEN p_partkey % 50 = 0 THEN 'P2' ELSE '' END AS m FROM part),
k AS (SELECT *, CASE {_first_word(C.P0_KEYWORDS)} END AS k0, CASE {_first_word(C.P1_KEYWORDS)} END AS k1 FROM i),
t AS (SELECT *, CASE WHEN m <> '' THEN m WHEN c = 'Core' THEN 'P0' WHEN c = 'batch' THEN 'P1' WHEN k0 IS NOT NULL THEN 'P0' WHEN k1 IS NOT NULL THEN 'P1' ELSE 'P2' END AS tier FROM k)
SELECT p_partkey, tier, CASE WHEN m <> '' THEN 'Manual override' WHEN c = 'Core' THEN 'Category ''Core'' is P0 by default' WHEN c = 'batch' THEN 'Category ''batch'' is P1 by default' WHEN k0 IS NOT NULL THEN 'Contains P0 keyword ''' || k0 || '''' WHEN k1 IS NOT NULL THEN 'Contains P1 keyword ''' || k1 || '''' ELSE 'No P0/P1 keywords or category detected' END AS reason,
 CASE WHEN c = 'Core' THEN 'large' WHEN c IN ('batch', 'ui') THEN 'medium' ELSE 'small' END AS effort, CASE WHEN c = 'Core' AND tier = 'P0' THEN 'high' WHEN tier = 'P2' THEN 'low' ELSE 'medium' END AS risk FROM t""")
def tier_decisions(t: Tables) -> DataFrame:
    name = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, " Export filter").when(F.col("p_size") % 3 == 1, " tag sort").otherwise(""))
    category = F.when(F.col("p_size") < 5, "Core").when(F.col("p_size") < 9, "batch").when(F.col("p_size") < 12, "ui").otherwise("")
    rows = t.part.select("p_partkey", name.alias("n"), category.alias("c"), F.when(F.col("p_partkey") % 50 == 0, "P2").otherwise("").alias("m"))
    rows = rows.withColumn("tier", S.tier(F.col("n"), F.col("c"), F.col("m")))
    return rows.select("p_partkey", "tier", P.tier_reason(F.col("n"), F.col("c"), F.col("m")).alias("reason"), P.effort(F.col("c")).alias("effort"), P.risk(F.col("c"), F.col("tier")).alias("risk"))


@query("""
WITH o AS (SELECT o_orderkey, CASE o_custkey % 6 WHEN 0 THEN 'import' WHEN 1 THEN 'subprocess_json' WHEN 2 THEN 'pyo3' WHEN 3 THEN 'ffi_cffi' WHEN 4 THEN 'other' END AS mode, CASE WHEN o_custkey % 4 = 0 THEN 'why' ELSE '' END AS why, CASE WHEN o_custkey % 5 <> 0 THEN (o_custkey % 10) / 10::DOUBLE END AS al, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 6 END AS warn,
  CASE WHEN o_custkey % 7 <> 0 THEN 'python' END AS src, CASE WHEN o_custkey % 3 = 0 THEN 'python' ELSE 'rust' END AS dst, o_orderstatus = 'F' AS files, CASE WHEN o_orderstatus = 'P' THEN 'out' ELSE '' END AS dir FROM orders),
m AS (SELECT l_orderkey, avg(c) AS mean, count(*) AS n, count(*) FILTER (c >= 0.5) / count(*)::DOUBLE AS high, bool_or(c < 0.5) AS low FROM (SELECT l_orderkey, round(l_quantity / 53, 4) AS c FROM lineitem) GROUP BY 1),
j AS (SELECT o.*, coalesce(n, 0) AS n, mean, high, low FROM o LEFT JOIN m ON l_orderkey = o_orderkey)
SELECT o_orderkey,
 round(least(CASE WHEN mode IS NOT NULL THEN 0.25 + CASE WHEN why <> '' THEN 0.15 ELSE 0 END ELSE 0 END + CASE WHEN al IS NOT NULL THEN 0.2 + CASE WHEN al > 0.5 THEN 0.1 ELSE 0 END ELSE 0 END + CASE WHEN n = 0 THEN 0 WHEN round(mean, 9) > 0.7 THEN 0.2 ELSE 0.1 END + CASE WHEN dir <> '' THEN 0.1 ELSE 0 END, 1)::DOUBLE, 3) AS architecture,
 round(least(0.3 + CASE mode WHEN 'import' THEN 0.3 WHEN 'subprocess_json' THEN 0.15 WHEN 'pyo3' THEN 0.1 WHEN 'ffi_cffi' THEN 0.1 ELSE 0 END + CASE WHEN src IS NULL THEN 0 WHEN src = dst THEN 0.2 ELSE 0.1 END, 1)::DOUBLE, 3) AS stack,
 round(greatest(least(0.5 + CASE WHEN n = 0 THEN 0 WHEN high > 0.8 THEN 0.2 WHEN high > 0.5 THEN 0.1 ELSE -0.1 END + CASE WHEN al IS NULL THEN 0 WHEN al > 0.7 THEN 0.15 WHEN al > 0.4 THEN 0.05 ELSE -0.1 END + CASE WHEN mode IS NOT NULL AND why <> '' THEN 0.1 ELSE 0 END, 1), 0)::DOUBLE, 3) AS feasibility,
 round(greatest(least(0.3 + CASE WHEN mode IS NULL THEN 0 WHEN mode = 'import' THEN 0.25 WHEN mode = 'subprocess_json' THEN 0.1 ELSE 0.05 END + CASE WHEN n > 0 AND NOT low THEN 0.15 ELSE 0 END + CASE WHEN warn > 0 THEN 0.1 ELSE 0 END - CASE WHEN warn > 3 THEN 0.1 ELSE 0 END + CASE WHEN files THEN 0.1 ELSE 0 END, 1), 0)::DOUBLE, 3) AS risk,
 round((0.5 + CASE WHEN n = 0 THEN -0.2 WHEN n <= 3 THEN 0.2 WHEN n <= 8 THEN 0.1 ELSE -0.1 END)::DOUBLE, 3) AS focus FROM j""")
def plan_scores(t: Tables) -> DataFrame:
    c = F.col("o_custkey")
    modes = F.when(c % 6 == 0, "import").when(c % 6 == 1, "subprocess_json").when(c % 6 == 2, "pyo3").when(c % 6 == 3, "ffi_cffi").when(c % 6 == 4, "other")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.round(F.col("l_quantity") / 53, 4)).alias("conf"))
    j = t.orders.join(lines, "o_orderkey", "left").withColumn("conf", F.coalesce("conf", F.array().cast("array<double>"))).withColumn("mode", modes)
    why, al, warn = F.when((c % 4 == 0) & F.col("mode").isNotNull(), "why").otherwise(""), F.when(c % 5 != 0, (c % 10) / 10), F.when(c % 5 != 0, c % 6)
    src, dst = F.when(c % 7 != 0, "python"), F.when(c % 3 == 0, "python").otherwise("rust")
    s = F.col("o_orderstatus")
    scores = {"architecture": P.architecture_score(F.col("mode"), why, al, F.col("conf"), F.when(s == "P", "out").otherwise("")), "stack": P.stack_score(F.col("mode"), src, dst), "feasibility": P.feasibility_score(why, al, F.col("conf")), "risk": P.risk_score(F.col("mode"), F.col("conf"), warn, s == "F"), "focus": P.focus_score(F.col("conf"))}
    return j.select("o_orderkey", *(F.round(v, 3).alias(k) for k, v in scores.items()))


# Names, formats and checks.

_NAMES = [*C.LANGUAGE_ALIASES, "cobol"]


@query(f"""
SELECT p_partkey, CASE x {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.LANGUAGE_ALIASES.items())} ELSE x END AS language, lower(replace(p_brand, '-', '_')) || '_' || lower(replace(replace(p_name, ' ', '-'), '-', '_')) AS pair_id,
 CASE WHEN p_size % 3 = 0 THEN 'https://host/acme/' || p_size::VARCHAR WHEN p_size % 3 = 1 THEN 'https://x.org/a.git' ELSE '' END AS url, p_size >= 20 AS full, p_size > 10 AS more, p_size > 20 AS over
FROM (SELECT *, [{_in(_NAMES)}][(p_partkey % {len(_NAMES)})::INTEGER + 1] AS x FROM part)""")
def package_ids(t: Tables) -> DataFrame:
    url = F.when(F.col("p_size") % 3 == 0, F.format_string("git@host:acme/%d.git", "p_size")).when(F.col("p_size") % 3 == 1, "https://x.org/a.git")
    n = F.col("p_size")
    more = {k: P.has_more(r, n if r != "total" else F.lit(10), F.lit(20), n) for k, r in (("full", "full"), ("more", "total"), ("over", "over"))}
    return t.part.select("p_partkey", P.resolve_language(_pick(_NAMES, F.col("p_partkey"))).alias("language"), P.pair_id(F.col("p_brand"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("pair_id"), P.https_url(url).alias("url"), *(c.alias(k) for k, c in more.items()))


@query("""
SELECT o_orderkey, printf('%02d:%02d', o_custkey % 24, o_orderkey % 60) AS clock, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderstatus = 'P' THEN '¥n/a' ELSE '¥' || trunc(o_totalprice + 0.013::DOUBLE)::BIGINT::VARCHAR END AS whole, CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE printf('¥%.1f', o_totalprice + 0.013::DOUBLE) END AS exact,
 printf('%.0fkg', (o_orderkey * 500) / 1000::DOUBLE + 0.25) AS carbon, o_orderstatus <> 'O' AND o_custkey - 700 > 60 AS valid, 'a_b_' || o_orderkey::VARCHAR AS file, 'u_' || o_custkey::VARCHAR || '_x.y' AS safe FROM orders""")
def formats(t: Tables) -> DataFrame:
    price = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise((F.col("o_totalprice") + 0.013).cast("string"))
    day = F.array(F.year("o_orderdate"), F.month("o_orderdate"), F.day("o_orderdate"))
    expires = F.when(F.col("o_orderstatus") != "O", F.col("o_custkey"))
    return t.orders.select(
        "o_orderkey", P.clock(F.array(F.col("o_custkey") % 24, F.col("o_orderkey") % 60)).alias("clock"), P.iso_day(day).alias("day"), P.whole_price(price).alias("whole"), P.exact_price(price).alias("exact"),
        P.kilograms(F.col("o_orderkey") * 500 + 250).alias("carbon"), P.token_valid(expires, F.lit(700)).alias("valid"), P.file_title(F.concat(F.lit("a/b\\"), "o_orderkey")).alias("file"), P.safe_name(F.concat(F.lit("u@"), "o_custkey", F.lit("+x.y"))).alias("safe"),
    )


_FILES = ["pyproject.toml", "setup.py", "package.json", "Cargo.toml", "build.gradle", "Makefile", "README.md"]


@query(f"""
WITH f AS (SELECT o_custkey, list(DISTINCT [{_in(_FILES)}][(o_orderkey % 7)::INTEGER + 1]) AS x FROM orders GROUP BY 1)
SELECT o_custkey, concat_ws(',', CASE WHEN list_contains(x, 'pyproject.toml') THEN 'python:0.9:pyproject.toml' WHEN list_contains(x, 'setup.py') THEN 'python:0.9:requirements.txt' END, CASE WHEN list_contains(x, 'package.json') THEN 'javascript:0.95:package.json' END, CASE WHEN list_contains(x, 'Cargo.toml') THEN 'rust:0.95:Cargo.toml' END,
 CASE WHEN list_contains(x, 'build.gradle') THEN 'java/kotlin:0.9:build.gradle' END, CASE WHEN list_contains(x, 'Makefile') THEN 'c_cpp:0.7:Makefile' END) AS found FROM f""")
def ecosystem_markers(t: Tables) -> DataFrame:
    f = t.orders.groupBy("o_custkey").agg(F.collect_set(_pick(_FILES, F.col("o_orderkey"))).alias("x"))
    return f.select("o_custkey", F.array_join(F.transform(P.ecosystems(F.col("x")), lambda e: F.concat_ws(":", e["ecosystem"], e["confidence"].cast("string"), e["file"])), ",").alias("found"))


@query("""SELECT doc_id, doc_id % 7 <> 0 OR text IS NULL AS is_utf8, doc_id % 5 = 0 AND text IS NOT NULL AS has_noncharacter FROM documents""")
def text_encoding_checks(t: Tables) -> DataFrame:
    text = F.concat("text", F.when(F.col("doc_id") % 5 == 0, "﷐").otherwise(""))
    raw = F.when(F.col("doc_id") % 7 == 0, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("C328")))).otherwise(F.col("text").cast("binary"))
    utf8, odd = P.text_checks(text, raw)
    return t.documents.select("doc_id", F.coalesce(utf8, F.lit(True)).alias("is_utf8"), F.coalesce(odd, F.lit(False)).alias("has_noncharacter"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 999 ELSE d END::INTEGER AS npm_days, CASE WHEN event_type = 'error' THEN 9999 ELSE d END::INTEGER AS pypi_days FROM (SELECT *, floor(date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-02-01') / 86400.0) AS d FROM events)""")
def days_since_variants(t: Tables) -> DataFrame:
    text = F.when(F.col("event_type") != "error", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    cut = F.regexp_replace(text, r"\.[^Z]*", "")
    return t.events.select("event_id", S.days_since(cut, AS_OF).alias("npm_days"), S.days_since(cut, AS_OF, 9999).alias("pypi_days"))


@query("""SELECT DISTINCT s_nationkey AS from_station, c_nationkey AS to_station FROM supplier JOIN customer ON s_suppkey % 10 = c_custkey % 10 WHERE s_nationkey <> c_nationkey""")
def route_pairs(t: Tables) -> DataFrame:
    legs = t.supplier.select((F.col("s_suppkey") % 10).alias("k"), F.col("s_nationkey").alias("from_station")).distinct().join(t.customer.select((F.col("c_custkey") % 10).alias("k"), F.col("c_nationkey").alias("to_station")).distinct(), "k")
    return legs.filter("from_station <> to_station").select("from_station", "to_station").distinct()


@query("""SELECT p_brand, string_agg(w, ',' ORDER BY w) AS keywords FROM (SELECT DISTINCT p_brand, w, dense_rank() OVER (PARTITION BY p_brand ORDER BY w) AS r FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part)) WHERE r <= 5 GROUP BY 1""")
def keywords_capped(t: Tables) -> DataFrame:
    words = t.part.select("p_brand", F.explode(F.split("p_name", " ")).alias("w")).distinct()
    top = ranking.top_per_group(words, ["p_brand"], [F.asc("w")], 5)
    return top.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("w")), ",").alias("keywords"))


# Caches, lists and reports.


@query("""
WITH o AS (SELECT user_id::VARCHAR AS key, arg_max(props, event_id) AS data, floor(max(epoch(ts))) AS made FROM events WHERE event_type <> 'error' GROUP BY 1), n AS (SELECT user_id::VARCHAR AS key, max(props) AS data FROM events WHERE event_type = 'error' AND user_id % 3 = 0 GROUP BY 1)
SELECT key, data, made + 86400 * (1 + key::BIGINT % 40) AS expires, made AS created_at FROM o ANTI JOIN n USING (key) WHERE NOT (made + 86400 * (1 + key::BIGINT % 40) < 1706745600 OR made < 1706745600 - 604800) UNION ALL SELECT key, data, 1706832000.0::DOUBLE, 1706745600.0::DOUBLE FROM n""")
def kv_upsert_and_purge(t: Tables) -> DataFrame:
    at = F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).cast("double")
    old = t.events.filter("event_type <> 'error'").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.max_by("props", "event_id").alias("data"), at.alias("created_at"))
    old = old.withColumn("expires", F.col("created_at") + 86_400 * (1 + F.col("key").cast("long") % 40))
    new = t.events.filter("event_type = 'error' and user_id % 3 = 0").select(F.col("user_id").cast("string").alias("key"), F.col("props").alias("data"))
    return sinks.cache_purge(sinks.cache_set(old, new, NOW_MS / 1000), NOW_MS / 1000)


@query("""
WITH n AS (SELECT s_suppkey, 'new' AS s_name, s_suppkey + (SELECT max(s_suppkey) FROM supplier) + 1 AS seq FROM supplier WHERE s_nationkey % 3 = 0)
SELECT s_suppkey, s_name, s_suppkey AS seq FROM supplier ANTI JOIN n USING (s_suppkey) UNION ALL SELECT * FROM n""")
def move_to_end(t: Tables) -> DataFrame:
    old = t.supplier.select("s_suppkey", "s_name", F.col("s_suppkey").alias("seq"))
    return sinks.move_to_end(old, t.supplier.filter("s_nationkey % 3 = 0").select("s_suppkey", F.lit("new").alias("s_name"), F.col("s_suppkey").alias("seq")), "s_suppkey", "seq")


@query(f"""
WITH r AS (SELECT *, {_PLACE} FROM part), l AS (SELECT p_brand, string_agg('### ' || (position + 1)::VARCHAR || '. ' || p_name || ' `' || p_size::VARCHAR || '`' || CASE WHEN p_size % 2 = 1 THEN ' *' || p_size::VARCHAR ELSE '' END || CASE WHEN p_size % 5 <> 0 THEN printf(' (score: %.2f)', p_size / 100::DOUBLE) ELSE '' END || chr(10) || CASE WHEN p_size % 3 = 0 THEN 'No description' ELSE p_type END
 || chr(10) || 'URL: ' || CASE WHEN p_size % 4 = 0 THEN 'N/A' ELSE 'https://x/' || p_partkey::VARCHAR END || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'License: MIT' ELSE '' END || chr(10), chr(10) ORDER BY position) AS body, any_value(n) AS n FROM r WHERE position < 10 GROUP BY 1)
SELECT p_brand, '## Search Results: ' || p_brand || chr(10) || n::VARCHAR || ' results' || chr(10) || chr(10) || body AS report FROM l""")
def search_report(t: Tables) -> DataFrame:
    s = F.col("p_size")
    rows = ranking.top_per_group(t.part, ["p_brand"], [F.asc("p_partkey")], 1 << 30, "position").select(
        "p_brand", (F.col("position") - 1).alias("position"), F.col("p_name").alias("name"), s.cast("string").alias("version"), F.when(s % 2 == 1, s).otherwise(0).alias("stars"), F.when(s % 5 != 0, s / 100).otherwise(0.0).alias("score"),
        F.when(s % 3 != 0, F.col("p_type")).alias("description"), F.when(s % 4 != 0, F.concat(F.lit("https://x/"), "p_partkey")).alias("registry_url"), F.when(s % 2 == 0, "MIT").otherwise("").alias("license_name"),
    )
    return sinks.search_report(rows, "p_brand", "position")


@query("""WITH g AS (SELECT l_suppkey, '<gpx version="1.1"><trk><trkseg>' || string_agg(printf('<trkpt lat="%.8f" lon="%.8f">', l_quantity / 8.0::DOUBLE, l_suppkey / 16.0::DOUBLE) || CASE WHEN l_linenumber <> 3 THEN printf('<ele>%.1f</ele>', l_linenumber / 2.0::DOUBLE) ELSE '' END || '</trkpt>', '' ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) || '</trkseg></trk></gpx>' AS gpx FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1)
SELECT 'track_' || l_suppkey::VARCHAR || '_a.gpx' AS name, length(gpx)::BIGINT AS chars, sha256(gpx) AS digest FROM g""")
def track_files(t: Tables) -> DataFrame:
    """A GPX file for each supplier's lines, written by the data source and read again; tracks without places are no files."""
    folder = answers.folder_for(t.spark, "tracks")
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    points = t.lineitem.select("l_suppkey", seq.alias("seq"), F.concat(F.lit("track "), "l_suppkey", F.lit("/a")).alias("title"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_quantity") / 8).alias("lat"), (F.col("l_suppkey") / 16).alias("lon"), F.when(F.col("l_linenumber") != 3, F.col("l_linenumber") / 2).alias("ele"))
    sinks.write_tracks(points, folder, "l_suppkey", "title", "seq", "lat", "lon", "ele")
    files = t.spark.read.format("binaryFile").load(folder)
    text = F.col("content").cast("string")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.length(text).cast("long").alias("chars"), F.sha2("content", 256).alias("digest"))


@query("""SELECT o_custkey, '| ' || o_custkey::VARCHAR || ' | ' || coalesce((max(o_totalprice) FILTER (o_orderstatus = 'F'))::INTEGER::VARCHAR, '-') || ' | ' || coalesce((max(o_totalprice) FILTER (o_orderstatus = 'O'))::INTEGER::VARCHAR, '-') || ' |' AS line FROM orders GROUP BY 1""")
def matrix_report(t: Tables) -> DataFrame:
    best = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.bround(F.max("o_totalprice"), 0).cast("int").alias("price"))
    return sinks.matrix_report(best, "o_custkey", "o_orderstatus", F.col("price"), ["F", "O"])


@query("""
WITH c AS (SELECT o_custkey AS k, o_orderpriority AS requirement, o_orderstatus AS slug, CASE WHEN max(o_totalprice) > 200000 THEN 'supported' WHEN max(o_totalprice) > 100000 THEN 'partial' ELSE 'missing' END AS status, count(*) AS n FROM orders WHERE o_custkey % 10 <> 3 GROUP BY ALL),
g AS (SELECT o_custkey AS k, o_orderstatus AS slug, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, slug) AS rank FROM g),
s AS (SELECT DISTINCT k, slug FROM c), h AS (SELECT k, string_agg(' | **' || slug || '**', '' ORDER BY slug) AS head, count(*)::INTEGER AS wide FROM s GROUP BY k),
m AS (SELECT k, requirement, string_agg(' | ' || CASE status WHEN 'supported' THEN '✅' WHEN 'partial' THEN '⚠️' ELSE '❌' END, '' ORDER BY slug) AS marks, count(*) FILTER (status = 'supported') AS full_, count(*) FILTER (status = 'partial') AS part_ FROM (SELECT DISTINCT q.k, q.requirement, s.slug FROM c q JOIN s USING (k)) LEFT JOIN c USING (k, requirement, slug) GROUP BY ALL),
l AS (SELECT k, string_agg('| ' || requirement || marks || ' |', chr(10) ORDER BY requirement) AS matrix, string_agg('- ' || requirement || ': ' || full_::VARCHAR || ' supported, ' || part_::VARCHAR || ' partial', chr(10) ORDER BY requirement) AS overview FROM m GROUP BY k),
d AS (SELECT k, string_agg('| ' || rank::VARCHAR || ' | ' || slug || ' | ' || (n / 4.0::DOUBLE)::VARCHAR || ' | ' || n::VARCHAR || ' | ' || (n * 2)::VARCHAR || ' |', chr(10) ORDER BY rank) AS ranks,
  string_agg('### ' || slug || chr(10) || '- **Language**: ' || lower(slug) || chr(10) || '- **Summary**: status ' || slug || chr(10) || '- **Confidence**: ' || n::VARCHAR || chr(10) || '- **Evidence items**: ' || (n * 2)::VARCHAR || chr(10) || '- **Core modules**: ' || rank::VARCHAR || chr(10) || '- **Key types**: ' || n::VARCHAR || chr(10) || '- **Platform APIs**: 0' || chr(10) || '- **Known gaps**: none' || chr(10), chr(10) ORDER BY rank) AS details FROM r GROUP BY k)
SELECT k AS o_custkey, '# Comparison Matrix: ' || k::VARCHAR || chr(10) || chr(10) || CASE WHEN head IS NULL THEN '*No comparison data available.*' || chr(10) ELSE
 '## Requirements Coverage Matrix' || chr(10) || chr(10) || '| Requirement' || head || ' |' || chr(10) || '|' || repeat('---|', wide + 1) || chr(10) || matrix || chr(10) || chr(10) || '## Ranking' || chr(10) || chr(10) || '| Rank | Repo | Score | Confidence | Evidence |' || chr(10) || '|------|------|-------|------------|----------|' || chr(10)
 || ranks || chr(10) || chr(10) || '## Repo Details' || chr(10) || chr(10) || details || chr(10) || '## Coverage Overview' || chr(10) || chr(10) || overview END AS report FROM d LEFT JOIN h USING (k) LEFT JOIN l USING (k)""")
def comparison_report(t: Tables) -> DataFrame:
    """Each customer as a project: priorities are requirements, order states repositories; some customers have no cells."""
    kept = t.orders.filter("o_custkey % 10 <> 3").groupBy("o_custkey", F.col("o_orderpriority").alias("requirement"), F.col("o_orderstatus").alias("slug")).agg(F.max("o_totalprice").alias("p"))
    status = F.when(F.col("p") > 200000, "supported").when(F.col("p") > 100000, "partial").otherwise("missing")
    cells = kept.select("o_custkey", "requirement", F.ascii(F.col("requirement")).alias("r_seq"), "slug", F.ascii("slug").alias("s_seq"), status.alias("status"))
    order = Window.partitionBy("o_custkey").orderBy(F.desc("n"), "slug")
    repos = t.orders.groupBy("o_custkey", F.col("o_orderstatus").alias("slug")).agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.row_number().over(order))
    n = F.col("n")
    repos = repos.select("o_custkey", "rank", "slug", (n / 4).alias("score"), n.alias("confidence"), (n * 2).alias("evidence_count"), F.lower("slug").alias("language"), F.concat(F.lit("status "), "slug").alias("summary"), F.col("rank").alias("core_modules"), n.alias("key_types"), F.lit(0).alias("platform_apis"), F.lit("none").alias("known_gaps"))
    return sinks.comparison_report(cells, repos, "o_custkey")


@query("""SELECT o_custkey, '[' || string_agg('{"o_orderkey":' || o_orderkey::VARCHAR || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']' AS document FROM orders GROUP BY 1""")
def json_documents(t: Tables) -> DataFrame:
    return sinks.document("o_custkey", t.orders, ["o_orderkey", "o_orderstatus"], "o_orderkey")


@query("""SELECT doc_id, doi FROM (SELECT doc_id, doi, row_number() OVER (PARTITION BY doi ORDER BY doc_id) AS n FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE '10.1/' || (doc_id % 97)::VARCHAR END AS doi FROM documents)) WHERE n = 1 OR doi = ''""")
def doi_dedup(t: Tables) -> DataFrame:
    doi = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("10.1/"), F.col("doc_id") % 97))
    return dedup.first_per_key(t.documents.select("doc_id", doi.alias("doi")), F.col("doi"), "doc_id")


@query("""
WITH RECURSIVE w AS (SELECT p_partkey AS k, list_distinct_in_order AS a FROM (SELECT p_partkey, [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), 'my_' || split_part(p_name, ' ', 2), lower(p_type), split_part(p_name, ' ', 1)] AS l, list_filter(l, lambda x, i: NOT list_contains(l[1:i - 1], x)) AS list_distinct_in_order FROM part)),
p AS (SELECT w.k, w.a, coalesce((SELECT b.a FROM w b WHERE b.k = w.k + 7), []) AS b FROM w),
r(k, i, rest, free, found, missing) AS (
  SELECT k, 1, list_filter(a, lambda x: NOT list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x)), list_transform(list_filter(a, lambda x: list_contains(b, x)), lambda x: {'src_name': x, 'dst_name': x, 'transform': 'identity'}), [x for x in [{'src_name': '', 'dst_name': '', 'transform': ''}] if false] FROM p
  UNION ALL SELECT k, i + 1, rest, CASE WHEN best IS NULL THEN free ELSE list_filter(free, lambda x: x <> best.d) END,
    CASE WHEN best IS NULL THEN found ELSE list_append(found, {'src_name': s, 'dst_name': best.d, 'transform': CASE WHEN best.c <= -1 THEN 'identity' ELSE 'rename' END}) END, CASE WHEN best IS NULL THEN list_append(missing, {'src_name': s, 'dst_name': '#MISSING', 'transform': 'unwrap'}) ELSE missing END
  FROM (SELECT *, list_sort(list_filter(list_transform(free, lambda d, n: {'c': -(CASE WHEN replace(d, '_', '') = x THEN 1.0::DOUBLE WHEN contains(x, replace(d, '_', '')) OR contains(replace(d, '_', ''), x) THEN 0.85::DOUBLE ELSE 1 - levenshtein(x, replace(d, '_', '')) / greatest(length(x), length(replace(d, '_', '')))::DOUBLE END), 'n': n, 'd': d}), lambda y: -y.c > 0.6::DOUBLE))[1] AS best
    FROM (SELECT *, rest[i] AS s, replace(rest[i], '_', '') AS x FROM r WHERE i <= len(rest))))
SELECT k AS p_partkey, to_json(list_concat(found, missing))::VARCHAR AS params FROM r WHERE i > len(rest)""")
def param_matches(t: Tables) -> DataFrame:
    """The words of each part's name and type, as parameter names, given to those of the seventh part after it."""
    word = lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    names = t.part.select("p_partkey", F.array(word(1), word(2), F.concat(F.lit("my_"), word(2)), F.lower("p_type"), word(1)).alias("src"))
    other = names.select((F.col("p_partkey") - 7).alias("p_partkey"), F.col("src").alias("dst"))
    pairs = names.join(other, "p_partkey", "left").withColumn("dst", F.coalesce("dst", F.array().cast("array<string>")))
    # Equal pairs of lists are matched once, in as many tasks as shuffles have, however small they are.
    every = pairs.select("src", "dst").distinct().repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    matched = every.withColumn("params", F.to_json(matching.match_params(F.col("src"), F.col("dst"))))
    return pairs.join(matched.hint("merge"), ["src", "dst"]).select("p_partkey", "params")


_URLS = ["https://github.com/acme/tool", "https://github.com/org/repo.git", "git@github.com:user/project.git", "/path/to/my-repo/", "acme/too.l", "https://x.org/%%", " http://x.org/a.b "]


@query(f"""SELECT p_partkey, ['tool', 'repo', 'project', 'my-repo', 'tool', 'repo', 'ab'][i] AS slug, ['https://github.com/acme/tool.git', 'https://github.com/org/repo.git', 'git@github.com:user/project.git', 'https://github.com//path/to/my-repo/.git', 'https://github.com/acme/too.l.git', 'https://x.org/%%.git', 'http://x.org/a.b'][i] AS clone
FROM (SELECT p_partkey, (p_partkey % {len(_URLS)})::INTEGER + 1 AS i FROM part)""")
def repo_slugs(t: Tables) -> DataFrame:
    url = _pick(_URLS, F.col("p_partkey"))
    return t.part.select("p_partkey", P.repo_slug(url).alias("slug"), P.clone_url(url).alias("clone"))


@query("""
WITH h AS (SELECT o_custkey, o_orderkey, 'handoff-' || (o_orderkey % 1000)::VARCHAR || '.md' AS path, (o_orderkey % 1000) * 100000000 + o_orderkey AS nth FROM orders)
SELECT o_custkey, arg_max(path, nth) AS newest, CASE WHEN arg_max(o_orderkey, nth) % 3 = 0 THEN 'abc' || lpad((arg_max(o_orderkey, nth))::VARCHAR, 7, '0') WHEN arg_max(o_orderkey, nth) % 3 = 1 THEN 'fade1234' ELSE '' END AS baseline FROM h GROUP BY 1""")
def newest_baseline(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("see `0000000` and `abc"), F.lpad(k.cast("string"), 7, "0"), F.lit("` or fade1234"))).when(k % 3 == 1, "word fade1234 end").otherwise("none here")
    rows = t.orders.select("o_custkey", F.concat(F.lit("handoff-"), (k % 1000).cast("string"), F.lit(".md")).alias("path"), k.alias("k"), text.alias("text"))
    last = rows.groupBy("o_custkey").agg(F.max_by(F.struct("path", "text"), F.struct(P.natural_key(F.col("path")), "k")).alias("n"))
    return last.select("o_custkey", F.col("n.path").alias("newest"), P.baseline_hash(F.col("n.text")).alias("baseline"))


@query("""
WITH r AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS position FROM orders WHERE o_custkey % 9 <> 0)
SELECT o_custkey, position, o_totalprice AS price, o_orderstatus AS type, 'air' || (o_orderkey % 3)::VARCHAR AS airline, o_orderkey * 2 AS emission, 'A' || (o_orderkey % 5)::VARCHAR AS from_code, printf('%02d:%02d', o_orderkey % 24, o_orderkey % 60) AS departs FROM r WHERE o_orderpriority NOT LIKE '1%'""")
def flight_rows(t: Tables) -> DataFrame:
    """Positional payloads made of each customer's orders; some report an error, some rows have no price."""
    s = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    k = F.col("o_orderkey")
    leg = F.concat(F.lit("[0,0,0,"), s(F.concat(F.lit("A"), k % 5)), F.lit(',"n","m","B",0,['), k % 24, F.lit(","), k % 60, F.lit("],0,[1,2],90]"))
    flight = F.concat(F.lit("["), s(F.col("o_orderstatus")), F.lit(',["air'), k % 3, F.lit('"],['), leg, F.lit("],0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,[0,0,0,0,0,0,0,"), k * 2, F.lit(",7]]"))
    price = F.when(F.col("o_orderpriority").startswith("1"), F.lit("[[]]")).otherwise(F.concat(F.lit("[[null,"), F.col("o_totalprice").cast("string"), F.lit("]]")))
    g = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat(F.lit("["), flight, F.lit(","), price, F.lit("]")).alias("x")))).alias("a"))
    ok = F.concat(F.lit("AF({key: 1, data:[0,0,0,[["), F.array_join(F.transform("a", lambda y: y["x"]), ","), F.lit("]],0],sideChannel: {}})"))
    body = F.when(F.col("o_custkey") % 9 == 0, "AF({data:[], errorHasStatus: true, x: 1})").otherwise(ok)
    f = R.flights(g.select("o_custkey", body.alias("body")), "o_custkey", "body")
    first = F.col("legs")[0]
    return f.select("o_custkey", "position", "price", "type", F.col("airlines")[0].alias("airline"), "emission", first["from_code"].alias("from_code"), P.clock(first["departs"]).alias("departs"))


_AIRPORTS, _AIRLINES = list(C.AIRPORTS), [*C.AIRLINES, "xx"]


@query(f"""
WITH a(name, code) AS (VALUES {", ".join(map(str, C.AIRPORTS.items()))}), l(k, airline) AS (VALUES {", ".join(map(str, C.AIRLINES.items()))}),
n AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'Ab' || o_custkey::VARCHAR WHEN o_orderstatus = 'F' THEN 'pvg' ELSE [{_in(_AIRPORTS)}][(o_orderkey % {len(_AIRPORTS)})::INTEGER + 1] END AS asked, [{_in(_AIRLINES)}][(o_custkey % {len(_AIRLINES)})::INTEGER + 1] AS flown FROM orders)
SELECT o_orderkey, asked, CASE WHEN regexp_full_match(asked, '[A-Za-z]{{3}}') THEN upper(asked) ELSE coalesce(code, upper(asked)) END AS airport, coalesce(airline, flown) AS airline FROM n LEFT JOIN a ON name = lower(asked) LEFT JOIN l ON k = upper(flown)""")
def airport_codes(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    asked = F.when(s == "P", F.concat(F.lit("Ab"), F.col("o_custkey"))).when(s == "F", "pvg").otherwise(_pick(_AIRPORTS, F.col("o_orderkey")))
    return t.orders.select("o_orderkey", asked.alias("asked"), S.resolve_code(asked, C.AIRPORTS).alias("airport"), P.airline_name(_pick(_AIRLINES, F.col("o_custkey"))).alias("airline"))


@query("""
WITH seg AS (SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::INTEGER AS position, 'G' || (l_partkey % 5)::VARCHAR AS code, (l_suppkey % 7)::VARCHAR AS from_station, l_returnflag AS to_station FROM lineitem),
p AS (SELECT 'G' || (p_partkey % 5)::VARCHAR AS code, (p_size % 7)::VARCHAR AS from_station, 'A' AS to_station, arg_max(p_retailprice, p_partkey) AS price FROM part GROUP BY ALL)
SELECT l_orderkey, position, code, from_station, to_station, price FROM seg LEFT JOIN p USING (code, from_station, to_station)""")
def transfer_segment_prices(t: Tables) -> DataFrame:
    seg = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.concat(F.lit("G"), F.col("l_partkey") % 5).alias("code"), (F.col("l_suppkey") % 7).cast("string").alias("from_station"), F.col("l_returnflag").alias("to_station"))
    transfers = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(seg)).alias("segments"))
    prices = t.part.select(F.concat(F.lit("G"), F.col("p_partkey") % 5).alias("code"), (F.col("p_size") % 7).cast("string").alias("from_station"), F.lit("A").alias("to_station"), F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("seq"))
    return R.transfer_prices(transfers, prices, "l_orderkey", "segments")


@query("""SELECT o_custkey, coalesce(string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) FILTER (o_orderkey % 2 = 1), '') AS flags FROM (SELECT o_custkey, o_orderstatus, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) GROUP BY 1""")
def true_flags(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.max("o_orderkey").alias("k"))
    value = F.when(F.col("k") % 2 == 1, "true").when(F.col("k") % 4 == 0, "1").otherwise('"true"')
    m = n.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", value.alias("v")))).alias("m"))
    return m.select("o_custkey", F.array_join(P.true_flags(F.col("m")), ",").alias("flags"))


_ENDS = ["a.py", "b.tsx", "src/c.rs", "d.kts", "e.hpp", "README", ".py", "x.tar.gz"]


@query("""SELECT o_custkey, coalesce(string_agg(DISTINCT l, ',' ORDER BY l), '') AS languages FROM (SELECT o_custkey, ['python', 'javascript', 'rust', 'kotlin', 'c_cpp', NULL, NULL, NULL][(o_orderkey % 8)::INTEGER + 1] AS l FROM orders) GROUP BY 1""")
def language_census(t: Tables) -> DataFrame:
    found = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set(P.language_of_file(_pick(_ENDS, F.col("o_orderkey"))))).alias("l"))
    return found.select("o_custkey", F.array_join("l", ",").alias("languages"))
