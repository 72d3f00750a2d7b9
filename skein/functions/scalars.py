"""Column functions: scores, similarities, formats and parsers. Each takes and returns columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import P0_CATEGORIES, P0_KEYWORDS, P1_CATEGORIES, P1_KEYWORDS


def falsy_coalesce(*cols: Column) -> Column:
    """The first column that is neither null nor empty, else the last."""
    out = cols[-1]
    for c in reversed(cols[:-1]):
        out = F.when(c.isNotNull() & (c != ""), c).otherwise(out)
    return out


def _steps(value: Column, steps: list[tuple[float, float]]) -> Column:
    """The weight of the first step that the value exceeds, else 0."""
    out = F.lit(0.0)
    for least, weight in reversed(steps):
        out = F.when(value > least, F.lit(weight)).otherwise(out)
    return out


def _recency(days: Column) -> Column:
    return F.when(days < 30, F.lit(0.3)).when(days < 365, F.lit(0.2)).otherwise(F.lit(0.1))


STARS = [(10000, 0.4), (1000, 0.3), (100, 0.2), (10, 0.1)]


def quality_score(stars: Column, downloads: Column, days: Column) -> Column:
    """Popularity, use and recency in steps, at most 1."""
    return F.least(_steps(stars, STARS) + _steps(downloads, [(1_000_000, 0.3), (100_000, 0.2), (1_000, 0.1)]) + _recency(days), F.lit(1.0))


def import_count_score(stars: Column, importers: Column, days: Column) -> Column:
    """The variant for import counts; an unknown date counts as old."""
    return F.least(_steps(stars, STARS) + _steps(importers, [(100_000, 0.3), (10_000, 0.25), (1_000, 0.2), (100, 0.1)]) + F.when(days.isNull(), F.lit(0.1)).otherwise(_recency(days)), F.lit(1.0))


def linear_score(total: Column, recent: Column) -> Column:
    """Half a million-scale total, half a ten-thousand-scale recent count, at most 1."""
    return F.least(total / 1e6 * 0.5 + recent / 1e4 * 0.5, F.lit(1.0))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; equal texts 1, an empty text 0."""
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def plain_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[_-]", "")


def name_similarity(a: Column, b: Column) -> Column:
    """Of names without ``_`` and ``-``, in lower case: equal 1, one within the other 0.85, else the ratio."""
    x, y = plain_name(a), plain_name(b)
    return F.when(x == y, F.lit(1.0)).when(F.contains(x, y) | F.contains(y, x), F.lit(0.85)).otherwise(levenshtein_ratio(x, y))


def mapping_score(src_role: Column, dst_role: Column, similarity: Column, src_conf: Column, dst_conf: Column, src_lang: Column, dst_lang: Column) -> Column:
    """How well one function stands for another: role, name and confidence, less across languages."""
    role = F.when((src_role == dst_role) & (src_role != "unknown"), F.lit(0.45)).when(src_role == dst_role, F.lit(0.25)).otherwise(F.lit(0.0))
    score = role + similarity * 0.35 + (src_conf + dst_conf) * 0.1
    return F.least(F.when((src_lang != dst_lang) & (src_lang != "") & (dst_lang != ""), score * 0.85).otherwise(score), F.lit(1.0))


def confidence_label(score: Column, same_lang: Column) -> Column:
    return F.when((score >= 0.9) & same_lang, "identical").when(score >= 0.6, "similar").when(~same_lang, "cross_lang_guess").otherwise("low_confidence")


def tier(name: Column, category: Column, manual: Column) -> Column:
    """P0, P1 or P2: a manual mark, then the category, then the first keyword in the name."""
    n, c = F.lower(name), F.lower(category)
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(n, w))
    return F.when(manual != "", manual).when(c.isin(P0_CATEGORIES), "P0").when(c.isin(P1_CATEGORIES), "P1").when(any_of(P0_KEYWORDS), "P0").when(any_of(P1_KEYWORDS), "P1").otherwise("P2")


def normalize_status(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin("supported", "yes", "✅", "full"), "supported").when(v.isin("partial", "⚠️", "partially"), "partial").otherwise("missing")


def days_since(text: Column, as_of: str, unknown: int = 999) -> Column:
    """Whole days from an ISO time text to ``as_of``; ``unknown`` where it can't be read."""
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp(text))
    return F.coalesce(F.floor(seconds / 86400).cast("int"), F.lit(unknown))


def parse_month_date(text: Column) -> Column:
    """``Feb 28, 2026`` as an ISO date; other texts unchanged."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text, F.lit("MMM d, yyyy")), "yyyy-MM-dd"), text)


def parse_thousands(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("bigint")


def format_duration(minutes: Column) -> Column:
    """155 is ``2h35m``; less than an hour ``35m``."""
    h, m = F.floor(minutes / 60), F.pmod(minutes, F.lit(60))
    return F.when(h == 0, F.concat(m.cast("string"), F.lit("m"))).otherwise(F.format_string("%dh%02dm", h, m))


def resolve_code(text: Column, aliases: dict[str, str]) -> Column:
    """Three letters: upper case; else the alias of the lower-cased text, else upper case."""
    table = F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])
    return F.when(text.rlike("^[A-Za-z]{3}$"), F.upper(text)).otherwise(F.coalesce(F.try_element_at(table, F.lower(text)), F.upper(text)))


def url_slug(url: Column) -> Column:
    """Host and path of a URL as ``host-path-parts``, without query, fragment or extension."""
    bare = F.regexp_replace(F.regexp_replace(url, "^[a-z]+://", ""), "[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\.(html|git)$", ""), "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")


def infer_group(path: Column) -> Column:
    """``src/X/...`` and ``X/...`` belong to X, a bare file to its stem."""
    parts = F.split(path, "/")
    return F.when((F.size(parts) > 2) & (parts[0] == "src"), parts[1]).when(F.size(parts) > 1, parts[0]).otherwise(F.regexp_replace(path, r"\.[^.]*$", ""))


def jwt_exp(token: Column) -> Column:
    """The ``exp`` claim of a JSON web token, null where it can't be read."""
    body = F.translate(F.split_part(token, F.lit("."), F.lit(2)), "-_", "+/")
    padded = F.rpad(body, F.ceil(F.length(body) / 4).cast("int") * 4, "=")
    return F.get_json_object(F.try_to_binary(padded, F.lit("base64")).cast("string"), "$.exp").try_cast("bigint")


def map_similarity(a: Column, b: Column) -> Column:
    """Over the keys of both maps: equal values 1, one-sided keys 0.3; both empty 1, one empty 0.3."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    one = lambda k: F.when(F.try_element_at(a, k) == F.try_element_at(b, k), F.lit(1.0)).when(F.try_element_at(a, k).isNull() | F.try_element_at(b, k).isNull(), F.lit(0.3)).otherwise(F.lit(0.0))
    total = F.aggregate(F.transform(keys, one), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.3)).otherwise(total / F.size(keys))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def containment(a: Column, b: Column) -> Column:
    """The share of a's distinct values in b; an empty a counts 0.5."""
    return F.when(F.size(a) == 0, F.lit(0.5)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a)))


def link_kind(target: Column) -> Column:
    """The first rule that fits a wiki link's target."""
    return F.when(target.startswith("http"), "external").when(target.startswith("src/"), "source").when(target.startswith("modules/"), "module").when(target.startswith("project/"), "project").when(target.startswith("schema/"), "schema").otherwise("name")


def github_slug(path: Column) -> Column:
    """``owner/repo`` of a module path on github.com, or on gopkg.in without its version; else null.

    Names hold letters, digits, ``_``, ``.`` and ``-``; a repository's name ends before a ``v`` and digits behind its first character."""
    parts = F.split(path, "/")
    host, owner, repo = parts[0], F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    plain = owner.rlike(r"^[\w.-]+$") & repo.rlike(r"^[\w.-]+$")
    bare = F.regexp_replace(F.regexp_replace(repo, r"^(.+?)v\d+.*$", "$1"), r"\.git$", "")
    versioned = F.regexp_replace(repo, r"^(.+?)\.v\d+$", "$1")
    return F.when(plain & (host == "github.com"), F.concat_ws("/", owner, bare)).when(plain & (host == "gopkg.in") & (F.size(parts) == 3), F.concat_ws("/", owner, versioned))


def priority_get(urls: Column, keys: list[str]) -> Column:
    """The first non-empty value of a map by the keys' order, else any other non-empty value (the least), else empty."""
    rest = F.array_min(F.filter(F.map_values(urls), lambda v: v.isNotNull() & (v != "")))
    return F.trim(F.coalesce(*[F.nullif(F.try_element_at(urls, F.lit(k)), F.lit("")) for k in keys], rest, F.lit("")))


def version_count_score(versions: Column, released_ms: Column, now_ms: int) -> Column:
    """Half a count of versions per hundred, half recency by the age in days as a fraction; no date counts as old."""
    age = F.greatest((F.lit(now_ms) - released_ms) / 86_400_000, F.lit(0.0))
    recency = F.when(released_ms.isNull(), 0.1).when(age <= 30, 0.3).when(age <= 365, 0.2).otherwise(0.1)
    return F.least(versions / 100 * 0.5 + recency * 0.5, F.lit(1.0))


def iso_from_ms(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def runtime_compatibility(src_async: Column, dst_async: Column, src_safe: Column, dst_safe: Column) -> Column:
    """1, less 0.5 for async onto sync and 0.2 where thread safety differs."""
    return F.lit(1.0) - F.when(src_async & ~dst_async, 0.5).otherwise(0.0) - F.when(src_safe != dst_safe, 0.2).otherwise(0.0)


def weighted_compatibility(io: Column, formats: Column, errors: Column, shape: Column, runtime: Column, license_score: Column) -> Column:
    return io * 0.25 + formats * 0.25 + errors * 0.15 + shape * 0.15 + runtime * 0.10 + license_score * 0.10


#: Names of text types and of byte types.
TEXT_TYPES, BYTE_TYPES = ["str", "string", "&str", "string?", "string!"], ["bytes", "vec<u8>", "byte[]"]


def return_transform(src: Column, dst: Column, same_lang: Column) -> Column:
    """How a return value is carried over: identity, decode, encode, bridge or cast."""
    s, d = (F.trim(F.lower(c)) for c in (src, dst))
    plain = lambda c: c.isin(TEXT_TYPES[:2])  # noqa: E731  those that bytes are read as
    alike = (s == d) | (s.isin(TEXT_TYPES) & d.isin(TEXT_TYPES)) | (F.contains(s, F.lit("json")) & F.contains(d, F.lit("json")))
    return F.when(alike, "identity").when(s.isin(BYTE_TYPES) & plain(d), "decode").when(plain(s) & d.isin(BYTE_TYPES), "encode").when(same_lang, "cast").otherwise("bridge")


def direction_score(has_pair: Column, has_src: Column, has_dst: Column, has_strategy: Column, has_mappings: Column) -> Column:
    """How clear an integration's direction is, from which parts of it are given."""
    part = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    return F.least(part(has_pair, 0.3) + part(has_src, 0.2) + part(has_dst, 0.2) + part(has_strategy, 0.15) + part(has_mappings, 0.15), F.lit(1.0))


def label_string(values: Column, labels: dict[str, str], drop: list[str]) -> Column:
    """A map's entries by key as ``label value``, without null and dropped values, two spaces apart."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    kept = F.filter(F.array_sort(F.map_entries(values)), lambda e: e["value"].isNotNull() & ~e["value"].isin(*drop))
    return F.array_join(F.transform(kept, lambda e: F.concat(F.coalesce(F.try_element_at(table, e["key"]), e["key"]), e["value"])), "  ")
