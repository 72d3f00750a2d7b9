"""Snapshots of package registries, searches and travel services: JSON texts to rows.

A snapshot is a row with the answer of one request as a text. Every reader gives the same search row
(name, version, description, registry_url, stars, downloads, last_commit, license_name, score) with
the request's key and the place of the result; answers that don't parse, and results without what a
reader needs, give no rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import packages as P
from ..functions import scalars as S
from ..operators.ranking import positions

ROW = ["name", "version", "description", "registry_url", "stars", "downloads", "last_commit", "license_name", "score"]


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _number(c: Column) -> Column:
    return F.coalesce(c.cast("bigint"), F.lit(0))


def _rows(snapshots: DataFrame, key: str, body: str, schema: str, items: str, make: Callable[[Column, Column], dict[str, Column]], more: str, total: str | None = None, limit: int = 20, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """``items``: the path of the results in the answer; ``make``: the fields of a row that aren't empty or 0."""
    parsed = snapshots.select(F.col(key), F.from_json(F.col(body), schema).alias("a"))
    found = F.filter(F.col(f"a.{items}"), keep) if keep else F.col(f"a.{items}")
    rows = parsed.withColumn("n_found", F.size(found)).select(F.col(key), "a", "n_found", F.posexplode(found).alias("position", "x"))
    fields = make(F.col("x"), F.col("a"))
    empty = {"name": "", "version": "", "description": "", "registry_url": "", "stars": 0, "downloads": 0, "last_commit": "", "license_name": "", "score": 0.0}
    columns = [fields.get(c, F.lit(v)).cast("bigint" if c in ("stars", "downloads") else "double" if c == "score" else "string").alias(c) for c, v in empty.items()]
    return rows.select(key, "position", *columns, P.has_more(more, F.col("n_found"), F.lit(limit), F.col(f"a.{total}") if total else F.lit(0)).alias("has_more"))


def npm(snapshots: DataFrame, key: str, body: str, as_of: str, limit: int = 20) -> DataFrame:
    schema = "objects array<struct<package struct<name string, version string, description string, date string, license string, links struct<npm string, repository string>>, score struct<detail struct<popularity double, downloads double>>>>"

    def make(x: Column, _: Column) -> dict[str, Column]:
        p, d = x["package"], x["score"]["detail"]
        days = S.days_since(F.regexp_replace(p["date"], r"\.[^Z]*", ""), as_of)
        return {
            "name": _text(p["name"]), "version": _text(p["version"]), "description": _text(p["description"]), "registry_url": _text(p["links"]["npm"]), "stars": P.popularity_stars(d["popularity"]), "downloads": _number(d["downloads"]),
            "last_commit": _text(p["date"]), "license_name": _text(p["license"]), "score": F.round(P.npm_score(d["popularity"], _number(d["downloads"]), days), 4),
        }

    return _rows(snapshots, key, body, schema, "objects", make, "full", limit=limit)


def crates(snapshots: DataFrame, key: str, body: str) -> DataFrame:
    schema = "crates array<struct<name string, max_version string, description string, documentation string, homepage string, repository string, downloads bigint, recent_downloads bigint, license string>>, meta struct<total bigint>"

    def make(x: Column, _: Column) -> dict[str, Column]:
        return {
            "name": _text(x["name"]), "version": _text(x["max_version"]), "description": F.substring(_text(x["description"]), 1, 500), "registry_url": S.falsy_coalesce(x["documentation"], x["homepage"], F.concat(F.lit("https://crates.io/crates/"), _text(x["name"]))),
            "downloads": _number(x["downloads"]), "license_name": _text(x["license"]), "score": F.round(S.linear_score(_number(x["downloads"]), _number(x["recent_downloads"])), 4),
        }

    return _rows(snapshots, key, body, schema, "crates", make, "total", "meta.total")


def maven(snapshots: DataFrame, key: str, body: str, now_ms: int, kotlin_first: bool = False, limit: int | None = 20) -> DataFrame:
    """``kotlin_first``: of the first max(3 limit, 15) artifacts those that look like Kotlin come first, in their order, and score
    0.2 more; ``limit`` rows stay. Without a ``limit`` that holds for all artifacts, and all stay."""
    schema = "response struct<numFound bigint, docs array<struct<id string, g string, a string, latestVersion string, versionCount bigint, timestamp bigint>>>"

    def make(x: Column, _: Column) -> dict[str, Column]:
        released = F.when(_number(x["timestamp"]) != 0, x["timestamp"])
        pair = F.when((_text(x["g"]) != "") & (_text(x["a"]) != ""), F.concat_ws(":", x["g"], x["a"])).otherwise(_text(x["id"]))
        relevant = P.kotlin_relevant(_text(x["id"]), _text(x["g"]), _text(x["a"])) if kotlin_first else F.lit(False)
        return {
            "name": _text(x["id"]), "version": _text(x["latestVersion"]), "description": pair, "registry_url": F.format_string("https://search.maven.org/artifact/%s/%s/jar", F.replace(_text(x["id"]), F.lit(":"), F.lit("/")), _text(x["latestVersion"])),
            "stars": _number(x["versionCount"]), "last_commit": _text(S.iso_from_ms(released)), "score": F.round(P.kotlin_score(_number(x["versionCount"]), released, now_ms, relevant), 4),
        }

    if not kotlin_first:
        return _rows(snapshots, key, body, schema, "response.docs", make, "total", "response.numFound")
    docs = F.from_json(F.col(body), schema)["response"]
    fetched = docs["docs"] if limit is None else F.slice(docs["docs"], 1, max(3 * limit, 15))
    like = lambda x: P.kotlin_relevant(_text(x["id"]), _text(x["g"]), _text(x["a"]))
    ordered = F.concat(F.filter(fetched, like), F.filter(fetched, lambda x: ~like(x)))
    ordered = ordered if limit is None else F.slice(ordered, 1, limit)
    again = F.to_json(F.struct(F.struct(docs["numFound"].alias("numFound"), ordered.alias("docs")).alias("response")))
    return _rows(snapshots.select(key, again.alias(body)), key, body, schema, "response.docs", make, "total", "response.numFound")


def vcpkg(snapshots: DataFrame, key: str, body: str, versions: DataFrame, limit: int = 20) -> DataFrame:
    """The first file of each port counts; ``versions`` (port, version) fills in what the search doesn't say."""
    parsed = snapshots.select(F.col(key), F.from_json(F.col(body), "total_count bigint, items array<struct<path string>>").alias("a"))
    rows = parsed.select(F.col(key), F.col("a.total_count").alias("total"), F.posexplode("a.items").alias("at", "x")).withColumn("port", F.regexp_extract("x.path", "^ports/([^/]+)/", 1)).filter("port != ''")
    first = rows.groupBy(key, "port").agg(F.min("at").alias("at"), F.first("total").alias("total"))
    own = Window.partitionBy(key)  # an answer
    ranked = first.withColumns({"position": F.row_number().over(own.orderBy("at")) - 1, "n_found": F.least(F.count(F.lit(1)).over(own), F.lit(limit))}).filter(F.col("position") < limit)
    v = versions.groupBy("port").agg(F.min("version").alias("version"))
    return ranked.join(v, "port", "left").select(
        key, "position", F.col("port").alias("name"), _text(F.col("version")).alias("version"), F.concat(F.lit("https://github.com/microsoft/vcpkg/tree/master/ports/"), "port").alias("registry_url"),
        F.lit(P.CONSTANT_SCORE).alias("score"), P.has_more("total", F.col("n_found"), F.lit(limit), F.col("total")).alias("has_more"),
    )


def packagist(snapshots: DataFrame, key: str, body: str, limit: int = 20) -> DataFrame:
    schema = "results array<struct<name string, description string, url string, repository string, favers bigint, downloads bigint, abandoned boolean, license string>>"

    def make(x: Column, _: Column) -> dict[str, Column]:
        return {
            "name": _text(x["name"]), "description": _text(x["description"]), "registry_url": _text(x["url"]), "stars": _number(x["favers"]), "downloads": _number(x["downloads"]), "license_name": _text(x["license"]),
            "score": P.packagist_score(_number(x["favers"]), _number(x["downloads"]), x["abandoned"]),
        }

    return _rows(snapshots, key, body, schema, "results", make, "full", limit=limit)


def repositories(snapshots: DataFrame, key: str, body: str, as_of: str, limit: int = 20) -> DataFrame:
    """A search of repositories: the first ``limit`` results, then without dead ones (no stars, nothing for over a year, or an unknown date)."""
    item = "struct<fullName string, stargazersCount bigint, language string, description string, url string, updatedAt string, license struct<spdxId string, name string>>"
    cut = snapshots.select(F.col(key), F.slice(F.from_json(F.col(body), f"array<{item}>"), 1, limit).alias("items"))
    days = lambda x: S.days_since(x["updatedAt"], as_of)
    again = F.to_json(F.struct("items"))

    def make(x: Column, _: Column) -> dict[str, Column]:
        stars = _number(x["stargazersCount"])
        return {
            "name": _text(x["fullName"]), "description": _text(x["description"]), "registry_url": _text(x["url"]), "stars": stars, "last_commit": _text(x["updatedAt"]), "license_name": _text(S.falsy_coalesce(x["license"]["spdxId"], x["license"]["name"])),
            "score": S.quality_score(stars, F.lit(0), days(x)),
        }

    return _rows(cut.select(key, again.alias(body)), key, body, f"items array<{item}>", "items", make, "full", limit=limit, keep=lambda x: ~((_number(x["stargazersCount"]) == 0) & (days(x) > 365)))


def module_pages(pages: DataFrame, key: str, html: str, as_of: str) -> DataFrame:
    """Search pages of modules: one row for each snippet that names a path; first matches only."""
    # The patterns of these pages are fixed values.
    first = lambda block, pattern: F.regexp_replace(F.regexp_extract(block, "(?s)" + pattern, 1), r"^\s+|\s+$", "")
    blocks = F.regexp_extract_all(F.col(html), F.lit(r'(?s)(<div\s+class="SearchSnippet".*?)(?=<div\s+class="SearchSnippet"|$)'), F.lit(1))
    rows = pages.select(key, F.posexplode(blocks).alias("position", "b")).withColumn("name", first(F.col("b"), r'<span\s+class="SearchSnippet-header-path">\(([^)]+)\)</span>')).filter("name != ''")
    b = F.col("b")
    versions = F.filter(F.regexp_extract_all(b, F.lit("<strong>([^<]+)</strong>"), F.lit(1)), lambda x: x.rlike(r"^v?[\d.]+(?:-[\w.]+)?$"))
    importers = F.coalesce(S.parse_thousands(first(b, r"Imported by.*?<strong>([\d,]+)</strong>")), F.lit(0))
    day = S.parse_month_date(first(b, r'data-test-id="snippet-published"[^>]*><strong>([^<]+)</strong>'))
    licence = first(first(b, r'data-test-id="snippet-license"[^>]*>(.*?)</span>'), r"<a[^>]*>([^<]+)<")
    score = S.import_count_score(F.lit(0), importers, F.nullif(S.days_since(day, as_of, -1), F.lit(-1)))
    return rows.select(
        key, "position", "name", _text(F.try_element_at(versions, F.lit(1))).alias("version"), first(b, r'class="SearchSnippet-synopsis"[^>]*>(.*?)</p>').alias("description"), F.concat(F.lit("https://pkg.go.dev/"), "name").alias("registry_url"),
        importers.cast("bigint").alias("downloads"), day.alias("last_commit"), licence.alias("license_name"), score.alias("score"),
    )


#: What separates the snippets of a search page of Python packages, and what stands before each of their fields.
SNIPPET, SNIPPET_FIELDS = 'class="package-snippet"', {"name": r'class="package-snippet__name">(.+?)</span>', "version": r'class="package-snippet__version">(.+?)</span>', "description": r'(?s)class="package-snippet__description">(.+?)</p>'}


def snippet_pages(pages: DataFrame, key: str, html: str, limit: int = 20) -> DataFrame:
    """Search pages of Python packages: a row for each of the first ``limit`` snippets that has a name; tags within a description are dropped."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    rows = pages.select(key, F.posexplode(F.slice(F.split(F.col(html), SNIPPET), 2, limit)).alias("position", "x"))
    field = {n: strip(F.regexp_extract("x", p, 1)) for n, p in SNIPPET_FIELDS.items()}
    field["description"] = strip(F.regexp_replace(field["description"], "<[^>]+>", ""))
    return rows.select(key, "position", *(c.alias(n) for n, c in field.items())).filter("name != ''")


def cached_and_missing(asked: DataFrame, cache: DataFrame, key: str, value: str, batch: int = 10) -> DataFrame:
    """Distinct keys with their cached value, or with the number of the batch in which they are to be fetched (from 0, in key order).

    Batches are numbered within ranges of the missing keys; a range's offset follows from one count per range."""
    distinct = asked.select(key).filter(F.coalesce(F.col(key), F.lit("")) != "").distinct()
    known = cache.groupBy(key).agg(F.max(value).alias(value))
    found = distinct.join(known, key).select(key, value, F.lit(None).cast("bigint").alias("batch"))
    missing = positions(distinct.join(known, key, "left_anti"), [F.asc(key)], "n")
    return found.unionByName(missing.select(key, F.lit(None).cast(cache.schema[value].dataType).alias(value), F.floor((F.col("n") - 1) / batch).cast("bigint").alias("batch")))


def trains(snapshots: DataFrame, key: str, body: str) -> DataFrame:
    """One row per train of an answer that succeeded: its code, stations, times and seats."""
    schema = "success boolean, count bigint, trains array<struct<train_no string, from_station string, to_station string, start_time string, arrive_time string, duration string, seats map<string, string>>>"
    parsed = snapshots.select(F.col(key), F.from_json(F.col(body), schema).alias("a")).filter("a.success")
    return parsed.select(key, F.posexplode("a.trains").alias("position", "t")).select(key, "position", "t.*")


def stations(snapshots: DataFrame, key: str, body: str, limit: int = 15) -> DataFrame:
    """The stations that a search found: name, code, pinyin, its short form and the city, which may be empty. Searches that failed give none."""
    schema = "success boolean, stations array<struct<name string, code string, pinyin string, py_short string, city string>>"
    parsed = snapshots.select(F.col(key), F.from_json(F.col(body), schema).alias("a")).filter("a.success")
    rows = parsed.select(key, F.posexplode(F.slice("a.stations", 1, limit)).alias("position", "s"))
    return rows.select(key, "position", "s.name", "s.code", "s.pinyin", "s.py_short", _text(F.col("s.city")).alias("city"))


def train_stops(snapshots: DataFrame, key: str, body: str) -> DataFrame:
    """The stops of a train in order; a time that isn't known is ``----``, a stay that isn't known empty. Answers that failed give none."""
    schema = "success boolean, stations array<struct<station_no string, station_name string, arrive_time string, start_time string, stopover_time string>>"
    parsed = snapshots.select(F.col(key), F.from_json(F.col(body), schema).alias("a")).filter("a.success")
    time = lambda c: F.coalesce(F.col(c), F.lit("----"))
    return parsed.select(key, F.posexplode("a.stations").alias("position", "s")).select(key, "position", "s.station_no", "s.station_name", time("s.arrive_time").alias("arrive_time"), time("s.start_time").alias("start_time"), _text(F.col("s.stopover_time")).alias("stopover_time"))


def train_prices(snapshots: DataFrame, key: str, body: str) -> DataFrame:
    """One row per train code of an answer that succeeded: its prices; of repeated codes the last."""
    parsed = snapshots.select(F.col(key), F.from_json(F.col(body), "success boolean, data array<struct<train_code string, prices map<string, string>>>").alias("a")).filter("a.success")
    rows = parsed.select(key, F.posexplode("a.data").alias("position", "t"))
    return rows.groupBy(key, F.col("t.train_code").alias("train_code")).agg(F.max_by("t.prices", "position").alias("prices"))


def routes(snapshots: DataFrame, key: str, body: str) -> DataFrame:
    """Routes found: id, title, nick, city, distance and ascent; answers with another code than 0 give none."""
    schema = "code int, data struct<items array<struct<roadBookId bigint, title string, nickName string, cityName string, distance double, totalAscent double>>>"
    parsed = snapshots.select(F.col(key), F.from_json(F.col(body), schema).alias("a")).filter("a.code = 0")
    return parsed.select(key, F.posexplode("a.data.items").alias("position", "r")).select(key, "position", F.col("r.roadBookId").alias("id"), "r.title", "r.nickName", "r.cityName", "r.distance", "r.totalAscent")


def route_points(snapshots: DataFrame, route: str, body: str) -> DataFrame:
    """The points of routes' details in order, with a title that falls back to the route's number; routes without points give none."""
    schema = "code int, data struct<summary struct<title string, region string, distance double>, routeInfo struct<tracks array<struct<latitude double, longitute double, altitude double>>>>"
    parsed = snapshots.select(F.col(route), F.from_json(F.col(body), schema).alias("a")).filter("a.code = 0")
    title = S.falsy_coalesce(F.col("a.data.summary.title"), F.concat(F.lit("route-"), F.col(route).cast("string")))
    return parsed.select(route, title.alias("title"), F.posexplode("a.data.routeInfo.tracks").alias("position", "p")).select(route, "title", "position", F.col("p.latitude").alias("lat"), F.col("p.longitute").alias("lon"), F.col("p.altitude").alias("ele"))


def flights(snapshots: DataFrame, key: str, body: str) -> DataFrame:
    """Flights of a positional payload: what stands between ``data:`` and the last comma is a JSON array whose fields are known by place.

    Rows that lack a price are left out, and so are payloads that don't parse or report an error."""
    at = lambda c, path: F.get_json_object(c, path)
    data = F.regexp_extract(F.col(body), r"(?s)data:(.*),[^,]*$", 1)
    rows = snapshots.select(F.col(key), data.alias("d")).filter(~F.col("d").endswith("errorHasStatus: true"))
    rows = rows.select(F.col(key), F.posexplode(F.from_json(at(F.col("d"), "$[3][0]"), "array<string>")).alias("position", "k"))
    k = F.col("k")
    out = rows.select(key, "position", at(k, "$[1][0][1]").try_cast("double").alias("price"), at(k, "$[0][0]").alias("type"), F.from_json(at(k, "$[0][1]"), "array<string>").alias("airlines"), F.from_json(at(k, "$[0][2]"), "array<string>").alias("legs"), at(k, "$[0][22][7]").try_cast("bigint").alias("emission"), at(k, "$[0][22][8]").try_cast("bigint").alias("typical_emission"))
    leg = lambda x: F.struct(at(x, "$[3]").alias("from_code"), at(x, "$[6]").alias("to_code"), F.from_json(at(x, "$[8]"), "array<int>").alias("departs"), at(x, "$[11]").cast("int").alias("minutes"))
    return out.filter("price is not null and legs is not null").withColumn("legs", F.transform("legs", leg))


def transfer_prices(transfers: DataFrame, prices: DataFrame, key: str, segments: str) -> DataFrame:
    """Each segment of each transfer, in order, with the price of its (code, from, to), or null; of repeated prices the last by ``seq``."""
    from_to = ["code", "from_station", "to_station"]
    rows = transfers.select(F.col(key), F.posexplode(segments).alias("position", "s")).select(key, "position", *[F.col(f"s.{c}").alias(c) for c in from_to])
    return rows.join(prices.groupBy(*from_to).agg(F.max_by("price", "seq").alias("price")), from_to, "left").select(key, "position", *from_to, "price")
