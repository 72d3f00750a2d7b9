"""Writers: JSON documents, Markdown reports, key-value snapshots with expiry, skeletons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packages import safe_name
from ..operators.extract import gpx
from .files import write_files


def write_json(rows: DataFrame, path: str, per: list[str] | None = None) -> None:
    """One JSON document per row and line; with ``per``, in a folder for each value of these columns."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*per) if per else writer).json(path)


def document(key: str, rows: DataFrame, fields: list[str], order: str) -> DataFrame:
    """One JSON text per key: an array of its rows' fields in order. A key's rows are one document, whose size a document bounds."""
    one = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("_r")))).alias("a"))
    return one.select(key, F.to_json(F.transform("a", lambda x: x["_r"])).alias("document"))


def cache_set(cache: DataFrame, new: DataFrame, now: float, ttl: float = 86_400) -> DataFrame:
    """The cache (key, data, expires, created_at) with the new rows (key, data) in place of old ones of the same key; of repeated new keys the greatest data."""
    fresh = new.groupBy("key").agg(F.max("data").alias("data")).select("key", "data", F.lit(float(now + ttl)).alias("expires"), F.lit(float(now)).alias("created_at"))
    return cache.select("key", "data", "expires", "created_at").join(fresh.select("key"), "key", "left_anti").unionByName(fresh)


def cache_purge(cache: DataFrame, now: float, older: float = 86_400 * 7) -> DataFrame:
    """The rows that haven't expired and aren't older than ``older`` seconds. Purging is a step of its own, never a matter of chance."""
    return cache.filter(~((F.col("expires") < now) | (F.col("created_at") < now - older)))


def move_to_end(session: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """An ordered list with new entries: an entry of the same key is taken out, the new one stands at the end (by ``seq``)."""
    last = session.agg(F.coalesce(F.max(seq), F.lit(0)).alias("_last"))  # one row
    fresh = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), F.col(seq)).alias("_r")).select("_r.*")
    kept = session.join(fresh.select(key), key, "left_anti").select(*session.columns)
    return kept.unionByName(fresh.crossJoin(F.broadcast(last)).withColumn(seq, F.col(seq) + F.col("_last") + 1).select(*session.columns))


def search_report(rows: DataFrame, key: str, position: str, shown: int = 10) -> DataFrame:
    """A Markdown report per key: the number of results and the first ones with version, stars, score, text, address and license."""
    given = lambda c, text: F.when(c, text).otherwise("")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    head = F.concat(F.lit("### "), (F.col("_n") + 1).cast("string"), F.lit(". "), text("name"), F.lit(" `"), text("version"), F.lit("`"), given(F.col("stars") != 0, F.concat(F.lit(" *"), F.col("stars").cast("string"))), given(F.col("score") != 0, F.format_string(" (score: %.2f)", F.col("score"))))
    body = F.concat(
        head, F.lit("\n"), F.when(text("description") == "", "No description").otherwise(F.substring("description", 1, 120)), F.lit("\nURL: "), F.when(text("registry_url") == "", "N/A").otherwise(F.col("registry_url")),
        given(text("license_name") != "", F.concat(F.lit("\nLicense: "), F.col("license_name"))), F.lit("\n"),
    )
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_all"))
    first = rows.filter(F.col(position) < shown).withColumn("_n", F.col(position)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", body.alias("_b")))).alias("_l"))  # at most ``shown`` rows
    title = F.concat(F.lit("## Search Results: "), F.col(key).cast("string"), F.lit("\n"), F.col("_all").cast("string"), F.lit(" results\n"))
    return counted.join(first, key, "left").select(key, F.array_join(F.concat(F.array(title), F.coalesce(F.transform("_l", lambda x: x["_b"]), F.array().cast("array<string>"))), "\n").alias("report"))


def matrix_report(rows: DataFrame, key: str, column: str, value: Column, columns: list[str]) -> DataFrame:
    """A Markdown table row per key with one cell per column; missing cells are ``-``."""
    grid = rows.groupBy(key).pivot(column, columns).agg(F.first(value))
    return grid.select(key, F.concat(F.lit("| "), F.col(key).cast("string"), *[F.concat(F.lit(" | "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-"))) for c in columns], F.lit(" |")).alias("line"))


# Marks of a status, and the counts that a repository's details show.
STATUS_ICONS = {"supported": "✅", "partial": "⚠️", "missing": "❌"}
DETAILS = {"Language": "language", "Summary": "summary", "Confidence": "confidence", "Evidence items": "evidence_count", "Core modules": "core_modules", "Key types": "key_types", "Platform APIs": "platform_apis", "Known gaps": "known_gaps"}


def comparison_report(cells: DataFrame, repos: DataFrame, key: str) -> DataFrame:
    """(key, report): a project's comparison as one Markdown text: coverage matrix, ranking, details and an overview of each requirement.

    ``cells``: key, requirement, r_seq, slug, s_seq, status, one row a cell; cells that aren't there, or have another status, count
    as missing. ``repos``: key, rank, slug, score and the columns of ``DETAILS``, none of them null. Projects without cells say that there are no data.
    Every line is a row until the end, so only a project's finished text is one value; a matrix row holds a mark for each of its repositories."""
    text = lambda c: F.col(c).cast("string")
    line = lambda section, at, value: F.struct(F.lit(section).alias("section"), F.lit(at).cast("long").alias("at") if isinstance(at, int) else F.col(at).cast("long").alias("at"), value.alias("line"))
    joined = lambda parts: F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))
    fixed = lambda section, *lines: [line(section, n, F.lit(x)) for n, x in enumerate(lines)]
    slugs = cells.groupBy(key, "slug").agg(F.min("s_seq").alias("s")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "slug"))), lambda x: x["slug"]).alias("_slugs"))  # a project's repositories
    by_row = cells.groupBy(key, "requirement").agg(F.min("r_seq").alias("at"), F.map_from_entries(F.collect_list(F.struct("slug", "status"))).alias("_of"))
    count = lambda status: F.size(F.filter(F.map_values("_of"), lambda x: x == status)).cast("string")
    icons = F.create_map(*[F.lit(x) for pair in STATUS_ICONS.items() for x in pair])
    mark = lambda s: F.coalesce(F.try_element_at(icons, F.try_element_at(F.col("_of"), s)), F.lit(STATUS_ICONS["missing"]))
    row = joined(F.concat(F.array("requirement"), F.transform("_slugs", mark)))
    seen = F.concat(F.lit("- "), F.col("requirement"), F.lit(": "), count("supported"), F.lit(" supported, "), count("partial"), F.lit(" partial"))
    head = [F.array_join(F.concat(F.array(F.lit("| Requirement")), F.transform("_slugs", lambda s: F.concat(F.lit("**"), s, F.lit("**")))), " | "), F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size("_slugs") + 1))]
    top = [*fixed(1, "## Requirements Coverage Matrix", ""), line(2, 0, F.concat(head[0], F.lit(" |"))), line(2, 1, head[1])]
    rest = [*fixed(4, "", "## Ranking", "", "| Rank | Repo | Score | Confidence | Evidence |", "|------|------|-------|------------|----------|"), *fixed(6, "", "## Repo Details", ""), *fixed(8, "## Coverage Overview", "")]
    details = F.concat(F.lit("### "), F.col("slug"), F.lit("\n"), F.concat_ws("\n", *[F.concat(F.lit(f"- **{name}**: "), text(c)) for name, c in DETAILS.items()]), F.lit("\n"))
    # Projects without cells are known from their repositories.
    known = repos.select(key).union(cells.select(key)).distinct().join(slugs, key, "left")
    title = line(0, 0, F.concat(F.lit("# Comparison Matrix: "), text(key), F.lit("\n")))
    parts = [
        known.select(key, F.inline(F.when(F.col("_slugs").isNull(), F.array(title, line(1, 0, F.lit("*No comparison data available.*\n")))).otherwise(F.array(title, *top, *rest)))),
        by_row.join(slugs, key).select(key, F.inline(F.array(line(3, "at", row), line(9, "at", seen)))),
        repos.join(slugs.select(key), key, "left_semi").select(key, F.inline(F.array(line(5, "rank", joined(F.array(*map(text, ("rank", "slug", "score", "confidence", "evidence_count"))))), line(7, "rank", details)))),
    ]
    lines = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "at", "line"))), lambda x: x["line"]), "\n").alias("report"))


def write_skeleton(rows: DataFrame, path: str, force: bool = False) -> None:
    """Writes the files (name, content) of a skeleton or a manifest that aren't there yet; with ``force``, all of them."""
    write_files(rows, path, force=force)


def write_tracks(points: DataFrame, folder: str, track: str, title: str, seq: str, lat: str, lon: str, ele: str, force: bool = False) -> None:
    """A GPX file for each track that has points, under its title made safe; tracks that share a title get one file."""
    made = gpx(points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()), track, seq, lat, lon, ele)
    names = points.groupBy(track).agg(F.min(title).alias("title"))
    write_files(made.join(names, track).select(F.concat(safe_name("title"), F.lit(".gpx")).alias("name"), F.col("gpx").alias("content")), folder, force=force)
