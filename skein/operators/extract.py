"""Row-generating extraction from texts: declarations, headings, annotations, links, HTML fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of headings, annotations and links.
HEADING, ANNOTATION, WIKI_LINK = r"(?mdU)^(#{1,6})\s+(.+)$", r"[#/]{1,2}\s*@lat:\s*\[\[([^\]]+)\]\]", r"\[\[([^\]]+)\]\]"


def matches(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def section_id(path: Column, chain: Column, short: bool = False) -> Column:
    """A heading's id: the document's path (``short``: its name) without ``.md``, and the chain, joined by ``#``."""
    base = F.regexp_replace(path, r"\.md$", "")
    return F.concat_ws("#", F.element_at(F.split(base, "/"), -1) if short else base, F.array_join(chain, "#"))


def headings(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """One row per Markdown heading: path, pos (among all headings), offset (its first character in the text, from 0), level,
    title, the chain of headings above and including it, section_id and short_id. Placeholders (``<!-- ... -->``) are no headings.

    One fold over a file's headings carries the stack of open headings and the place up to which the text is read; a
    heading's place is the next one at the beginning of a line. A null text has none."""
    kind = "array<struct<level:int,title:string>>"
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    found = F.arrays_zip(*(matches(F.col("text"), HEADING, g).alias(f"g{g}") for g in range(3)))
    lines = F.concat(F.lit("\n"), F.col("text"))

    def step(acc: Column, h: Column) -> Column:
        level, title = F.length(h["g1"]), strip(F.regexp_replace(strip(h["g2"]), "^<!--.*?-->$", ""))
        at = F.position(F.concat(F.lit("\n"), h["g0"]), lines, acc["read"])
        stack = F.when(title == "", acc["stack"]).otherwise(F.array_append(F.filter(acc["stack"], lambda x: x["level"] < level), F.struct(level.alias("level"), title.alias("title"))))
        row = F.struct(F.size(acc["out"]).alias("pos"), (at - 1).alias("offset"), level.alias("level"), title.alias("title"), F.transform(stack, lambda x: x["title"]).alias("chain"))
        return F.struct((at + F.length(h["g0"])).alias("read"), stack.alias("stack"), F.array_append(acc["out"], row).alias("out"))

    first = F.struct(F.lit(1).alias("read"), F.array().cast(kind).alias("stack"), F.array().cast("array<struct<pos:int,offset:int,level:int,title:string,chain:array<string>>>").alias("out"))
    rows = files.select(F.col(path).alias("path"), F.col(text).cast("string").alias("text")).select("path", F.explode(F.aggregate(found, first, step)["out"]).alias("h")).filter("h.title != ''")
    chain = F.col("h.chain")
    return rows.select(F.col("path").alias(path), "h.pos", "h.offset", "h.level", "h.title", chain.alias("chain"), section_id(F.col("path"), chain).alias("section_id"), section_id(F.col("path"), chain, short=True).alias("short_id"))


def line_annotations(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """path, line (from 1) and section_id of the first annotation in each line."""
    lines = files.select(path, F.posexplode(F.split(text, "\n")).alias("n", "l"))
    return lines.select(path, (F.col("n") + 1).alias("line"), F.trim(F.regexp_extract("l", ANNOTATION, 1)).alias("section_id")).filter("section_id != ''")


def wiki_links(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    return files.select(path, F.posexplode(matches(F.col(text), WIKI_LINK, 1)).alias("pos", "target")).withColumn("target", F.trim("target"))


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]+>", " "), r"\s+", " "))


def text_flags(text: Column) -> list[Column]:
    """Quality flags of a text: emptiness, NUL, byte order mark, final newline, long lines, control characters."""
    return [
        (F.length(text) == 0).alias("is_empty"),
        F.contains(text, F.lit("\x00")).alias("has_nul"),
        text.startswith("﻿").alias("has_bom"),
        (F.substring(text, -1, 1) == "\n").alias("ends_with_newline"),
        F.exists(F.split(text, "\n"), lambda x: F.length(x) > 500).alias("has_long_line"),
        text.rlike(r"[\x01-\x08\x0B\x0C\x0E-\x1F]").alias("has_control"),
    ]


def gpx(points: DataFrame, track: str, seq: str, lat: str, lon: str, ele: str) -> DataFrame:
    """One GPX track per key: its points in order, elevation where known."""
    place = '<trkpt lat="%.8f" lon="%.8f">'
    one = F.when(F.col(ele).isNotNull(), F.format_string(place + "<ele>%.1f</ele></trkpt>", F.col(lat), F.col(lon), F.col(ele))).otherwise(F.format_string(place + "</trkpt>", F.col(lat), F.col(lon)))
    g = points.groupBy(track).agg(F.collect_list(F.struct(F.col(seq).alias("s"), one.alias("p"))).alias("a"))
    # sort_array compares the structs itself; array_sort evaluates a lambda at each comparison.
    return g.select(track, F.concat(F.lit('<gpx version="1.1"><trk><trkseg>'), F.array_join(F.sort_array("a")["p"], ""), F.lit("</trkseg></trk></gpx>")).alias("gpx"))

