"""Column functions on package metadata: registry scores, ids, license texts, formats and checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import AIRLINES, ECOSYSTEM_MARKERS, EXTENSIONS, LANGUAGE_ALIASES, LICENSE_SCORES, LICENSES, P0_CATEGORIES, P0_KEYWORDS, P1_CATEGORIES, P1_KEYWORDS
from .scalars import _steps, version_count_score

#: What a number is multiplied by before it is cut to an integer, and other scores of the registries.
POPULARITY, CONSTANT_SCORE = 10_000, 0.5


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def packagist_score(stars: Column, downloads: Column, abandoned: Column) -> Column:
    """Steps of favourites and downloads, and 0.3 unless the package is abandoned (null: it isn't)."""
    s = _steps(stars, [(1000, 0.4), (100, 0.3), (10, 0.2), (1, 0.1)]) + _steps(downloads, [(10_000_000, 0.3), (1_000_000, 0.25), (100_000, 0.2), (1_000, 0.1)])
    return F.least(s + F.when(F.coalesce(abandoned, F.lit(False)), 0.0).otherwise(0.3), F.lit(1.0))


def popularity_stars(popularity: Column) -> Column:
    """A popularity from 0 to 1 as a count of stars."""
    return F.coalesce((popularity * POPULARITY).cast("int"), F.lit(0))


def npm_score(popularity: Column, downloads: Column, days: Column) -> Column:
    """Popularity and downloads by proportion, recency by steps that hold their ends."""
    recency = F.when(days <= 30, 0.3).when(days <= 365, 0.2).otherwise(0.1)
    return F.least(popularity_stars(popularity) / POPULARITY * 0.4 + F.least(F.coalesce(downloads, F.lit(0)) / 1_000_000, F.lit(1.0)) * 0.3 + recency * 0.3, F.lit(1.0))


def kotlin_relevant(*ids: Column) -> Column:
    """Whether ``kotlin`` or ``kt`` stands anywhere in the ids."""
    text = F.lower(F.concat_ws(" ", *ids))
    return F.contains(text, F.lit("kotlin")) | F.contains(text, F.lit("kt"))


def kotlin_score(versions: Column, released_ms: Column, now_ms: int, relevant: Column) -> Column:
    score = version_count_score(versions, released_ms, now_ms)
    return F.when(relevant, F.least(score + 0.2, F.lit(1.0))).otherwise(score)


def has_more(rule: str, found: Column, limit: Column, total: Column) -> Column:
    """Whether there is more to fetch: ``full`` (the limit is reached), ``total`` (the stated total is greater) or ``over`` (more than the limit)."""
    return {"full": found >= limit, "total": total > found, "over": found > limit}[rule]


def resolve_language(name: Column) -> Column:
    """The language of an alias; other names stay."""
    return F.coalesce(_lookup(LANGUAGE_ALIASES, name), name)


def pair_id(a: Column, b: Column) -> Column:
    one = lambda c: F.replace(F.lower(c), F.lit("-"), F.lit("_"))
    return F.concat_ws("_", one(a), one(b))


def https_url(url: Column) -> Column:
    """``git@host:path.git`` as an https address; other urls stay, null is empty."""
    ssh = F.replace(F.replace(F.replace(url, F.lit(":"), F.lit("/")), F.lit("git@"), F.lit("https://")), F.lit(".git"), F.lit(""))
    return F.coalesce(F.when(url.startswith("git@"), ssh).otherwise(url), F.lit(""))


def license_score(source: Column, target: Column) -> Column:
    """How well two licenses go together; 0.3 where one isn't known to the table."""
    table = F.create_map(*[F.lit(x) for s, row in LICENSE_SCORES.items() for t, score in zip(LICENSES, row, strict=True) for x in (f"{s}>{t}", score)])
    return F.coalesce(F.try_element_at(table, F.concat(source, F.lit(">"), target)), F.lit(0.3))


def airline_name(code: Column) -> Column:
    """The airline of a code in any case; one that isn't listed is its own name."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in AIRLINES.items() for x in pair]), F.upper(code)), code)


#: The sentences below, and the words of efforts and risks, are fixed values.
def explain_license(source: Column, target: Column, source_category: Column, target_category: Column, mode: Column) -> Column:
    """One sentence on what the reuse mode of two licenses means."""
    say = F.format_string
    copy = (
        F.when(source_category == "permissive", say("Permissive license (%s) — safe to copy into %s project", source, target))
        .when((source_category == "weak_copyleft") & (target_category == "strong_copyleft"), say("Weak copyleft (%s) → strong copyleft (%s): compatible", source, target))
        .when(source_category == "strong_copyleft", say("Strong copyleft (%s) — can copy but target must be %s", source, source))
        .otherwise(say("License compatibility: %s → %s", source, target))
    )
    study = F.when(source_category == "strong_copyleft", say("%s (strong copyleft) cannot be copied into %s project. Study design only.", source, target)).otherwise(say("%s → %s: Reference only, do not copy directly", source, target))
    port = say("%s (weak copyleft) → %s: Port with care, keep modification notices", source, target)
    avoid = say("License conflict: %s → %s. Do NOT reuse this code.", source, target)
    return F.when(mode == "copy", copy).when(mode == "port", port).when(mode == "reference_only", study).when(mode == "avoid", avoid).otherwise(say("License compatibility unknown: %s → %s. Exercise caution.", source, target))


def tier_reason(name: Column, category: Column, manual: Column) -> Column:
    """Why an item has its tier; of several keywords the first of the list."""
    n, c = F.lower(name), F.lower(category)
    first = lambda words: F.try_element_at(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(n, w)), F.lit(1))
    by_category = lambda t: F.format_string(f"Category '%s' is {t} by default", category)
    return (
        F.when(manual != "", "Manual override").when(c.isin(P0_CATEGORIES), by_category("P0")).when(c.isin(P1_CATEGORIES), by_category("P1"))
        .when(first(P0_KEYWORDS).isNotNull(), F.format_string("Contains P0 keyword '%s'", first(P0_KEYWORDS))).when(first(P1_KEYWORDS).isNotNull(), F.format_string("Contains P1 keyword '%s'", first(P1_KEYWORDS)))
        .otherwise("No P0/P1 keywords or category detected")
    )


def effort(category: Column) -> Column:
    c = F.lower(category)
    return F.when(c.isin("core", "export", "import", "pipeline", "search"), "large").when(c.isin(*P1_CATEGORIES, "ui"), "medium").otherwise("small")


def risk(category: Column, tier: Column) -> Column:
    return F.when(F.lower(category).isin("core", "pipeline", "import", "export") & (tier == "P0"), "high").when(tier == "P2", "low").otherwise("medium")


# Sub-scores of an integration plan. A missing part is null.


def _part(given: Column, weight: float) -> Column:
    return F.when(F.coalesce(given, F.lit(False)), F.lit(weight)).otherwise(F.lit(0.0))


def _clamp(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(score, F.lit(1.0)))


def architecture_score(mode: Column, rationale: Column, alignment: Column, confidences: Column, output_dir: Column) -> Column:
    """``confidences``: the mappings' confidences as an array; ``alignment``: the overall score."""
    mean = F.aggregate(confidences, F.lit(0.0), lambda s, x: s + x) / F.size(confidences)
    return F.least(_part(mode.isNotNull(), 0.25) + _part(mode.isNotNull() & (rationale != ""), 0.15) + _part(alignment.isNotNull(), 0.2) + _part(alignment > 0.5, 0.1) + F.when(F.size(confidences) > 0, F.when(mean > 0.7, 0.2).otherwise(0.1)).otherwise(0.0) + _part(output_dir != "", 0.1), F.lit(1.0))


def stack_score(mode: Column, src_lang: Column, dst_lang: Column) -> Column:
    by_mode = F.when(mode == "import", 0.3).when(mode == "subprocess_json", 0.15).when(mode.isin("pyo3", "ffi_cffi"), 0.1).otherwise(0.0)
    return F.least(F.lit(0.3) + by_mode + F.when(src_lang.isNull() | dst_lang.isNull(), 0.0).when(src_lang == dst_lang, 0.2).otherwise(0.1), F.lit(1.0))


def feasibility_score(rationale: Column, alignment: Column, confidences: Column) -> Column:
    high = F.size(F.filter(confidences, lambda x: x >= 0.5)) / F.size(confidences)
    of_mappings = F.when(F.size(confidences) > 0, F.when(high > 0.8, 0.2).when(high > 0.5, 0.1).otherwise(-0.1)).otherwise(0.0)
    of_alignment = F.when(alignment > 0.7, 0.15).when(alignment > 0.4, 0.05).when(alignment.isNotNull(), -0.1).otherwise(0.0)
    return _clamp(F.lit(0.5) + of_mappings + of_alignment + _part(rationale != "", 0.1))


def risk_score(mode: Column, confidences: Column, n_warnings: Column, has_files: Column) -> Column:
    """Higher is less risk. ``n_warnings``: of the alignment, null where there is none."""
    of_mode = F.when(mode == "import", 0.25).when(mode == "subprocess_json", 0.1).when(mode.isNotNull(), 0.05).otherwise(0.0)
    sure = (F.size(confidences) > 0) & ~F.exists(confidences, lambda x: x < 0.5)
    return _clamp(F.lit(0.3) + of_mode + _part(sure, 0.15) + _part(n_warnings > 0, 0.1) - _part(n_warnings > 3, 0.1) + _part(has_files, 0.1))


def focus_score(confidences: Column) -> Column:
    n = F.size(confidences)
    return F.lit(0.5) + F.when(n <= 0, -0.2).when(n <= 3, 0.2).when(n <= 8, 0.1).otherwise(-0.1)


# Formats and checks.


def clock(parts: Column) -> Column:
    """``[7, 45]`` is ``07:45``."""
    return F.format_string("%02d:%02d", parts[0], parts[1])


def iso_day(parts: Column) -> Column:
    """``[2026, 7, 28]`` is ``2026-07-28``."""
    return F.format_string("%04d-%02d-%02d", parts[0], parts[1], parts[2])


def whole_price(price: Column) -> Column:
    """Cut to an integer; what is no number stays as it is."""
    return F.concat(F.lit("¥"), F.coalesce(price.try_cast("double").cast("bigint").cast("string"), price))


def exact_price(price: Column) -> Column:
    """With one decimal; what is no number stays as it is, without the sign."""
    value = price.try_cast("double")
    return F.when(value.isNotNull(), F.format_string("¥%.1f", value)).otherwise(price)


def kilometres(metres: Column) -> Column:
    return F.format_string("%.1fkm", F.coalesce(metres, F.lit(0)) / 1000)


def kilograms(grams: Column) -> Column:
    return F.when(grams.isNotNull(), F.format_string("%.0fkg", grams / 1000))


def token_valid(expires: Column, now: Column, margin: int = 60) -> Column:
    """Whether a token lasts for more than the margin; unknown expiry: no."""
    return F.coalesce(expires - now > margin, F.lit(False))


def safe_name(text: Column) -> Column:
    """Letters, digits, ``-``, ``_`` and ``.`` stay; other characters become ``_``."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}\-_.]", "_")


def file_title(text: Column) -> Column:
    """A title without path separators."""
    return F.translate(text, "/\\", "__")


def ecosystems(files: Column) -> Column:
    """The ecosystems that an array of file names marks: structs (ecosystem, confidence, file), in a fixed order."""
    found = [F.when(F.arrays_overlap(files, F.array(*map(F.lit, marks))), F.struct(F.lit(e).alias("ecosystem"), F.lit(c).alias("confidence"), F.when(F.array_contains(files, named), named).otherwise(otherwise).alias("file"))) for e, c, marks, named, otherwise in ECOSYSTEM_MARKERS]
    return F.array_compact(F.array(*found))


def text_checks(text: Column, raw: Column) -> list[Column]:
    """Whether bytes are valid UTF-8, and whether a text holds Unicode non-characters."""
    return [F.is_valid_utf8(raw.cast("string")).alias("is_utf8"), text.rlike(r"[\x{FDD0}-\x{FDEF}\x{FFFE}\x{FFFF}]").alias("has_noncharacter")]


def repo_slug(url: Column) -> Column:
    """The last part of a repository's address or of a local path, of letters, digits, ``-`` and ``_``; nothing left: ``repo``. Local paths keep their name as it is."""
    bare = F.regexp_replace(F.trim(url), r"\.git$", "")
    local = ~F.contains(bare, F.lit("://")) & (bare.startswith("/") | bare.rlike(r"^[A-Za-z]:\\"))
    own = F.when(F.contains(bare, F.lit("@")) & F.contains(bare, F.lit(":")), F.element_at(F.split(bare, ":"), -1)).otherwise(bare)
    slug = F.regexp_replace(F.element_at(F.split(own, "/"), -1), "[^a-zA-Z0-9_-]", "")
    return F.when(local, F.element_at(F.split(F.regexp_replace(bare, "/+$", ""), "/"), -1)).otherwise(F.when(slug == "", "repo").otherwise(slug))


def clone_url(url: Column) -> Column:
    """An address in the form in which it can be cloned; ``owner/repo`` stands for the usual host."""
    u = F.trim(url)
    short = F.contains(u, F.lit("/")) & ~u.startswith("http")
    return F.when(u.endswith(".git") | u.startswith("git@"), u).when(short, F.concat(F.lit("https://github.com/"), u, F.lit(".git"))).when(u.startswith("https://"), F.concat(u, F.lit(".git"))).otherwise(u)


def natural_key(text: Column) -> Column:
    """A key in whose order numbers within texts count by value (of up to 20 digits)."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x)), "")


def baseline_hash(text: Column) -> Column:
    """The last commit hash in back quotes, else the last one that stands alone, else empty."""
    last = lambda pattern: F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))
    return F.coalesce(last("`([a-f0-9]{7,40})`"), last(r"\b([a-f0-9]{7,40})\b"), F.lit(""))


def true_flags(flags: Column) -> Column:
    """The sorted keys of a map of JSON values whose value is literally true."""
    return F.array_sort(F.map_keys(F.map_filter(flags, lambda k, v: v == "true")))


def language_of_file(path: Column) -> Column:
    """The language of a file's extension, or null; names that only begin with a point have none."""
    return _lookup(EXTENSIONS, F.regexp_extract(path, r"[^/.](\.[^./]*)$", 1))
