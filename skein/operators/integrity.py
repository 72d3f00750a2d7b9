"""Checks between documents, their sections, the code that names them and the modules they describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import SECTION_PREFIXES
from ..functions.scalars import link_kind


def _issue(rows: DataFrame, severity: str, kind: str, subject: Column, place: Column) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(kind).alias("type"), subject.cast("string").alias("subject"), place.cast("string").alias("location"))


def issues(sections: DataFrame, annotations: DataFrame, links: DataFrame, documents: DataFrame, modules: DataFrame) -> DataFrame:
    """All that doesn't fit together: severity, type, subject, location.

    ``sections`` (section_id, doc_path), ``annotations`` (path, line, section_id), ``links`` (doc_path, target),
    ``documents`` (doc_path), ``modules`` (module, doc_path). Found are sections that no annotation names, annotations of no section, links of
    a document's own kind to no document, modules without their document, and documents of no module. Each is an anti join."""
    ids = sections.select("section_id").distinct()
    orphan = sections.join(annotations.select("section_id").distinct(), "section_id", "left_anti")
    broken = annotations.join(ids, "section_id", "left_anti")
    own = links.filter(link_kind(F.col("target")).isin("module", "project", "name")).withColumn("wanted", F.concat(F.lit("docs/"), "target", F.lit(".md")))
    dead = own.join(documents.select(F.col("doc_path").alias("wanted")), "wanted", "left_anti")
    missing = modules.join(documents.select("doc_path"), "doc_path", "left_anti")
    unlisted = documents.join(modules.select("doc_path"), "doc_path", "left_anti")
    out = _issue(orphan, "warning", "orphan_section", F.col("section_id"), F.col("doc_path"))
    for more in (
        _issue(broken, "error", "broken_ref", F.col("section_id"), F.concat_ws(":", "path", F.col("line").cast("string"))), _issue(dead, "warning", "broken_wiki_link", F.col("target"), F.col("doc_path")),
        _issue(missing, "error", "missing_doc", F.col("module"), F.col("doc_path")), _issue(unlisted, "warning", "orphan_doc", F.col("doc_path"), F.col("doc_path")),
    ):
        out = out.unionByName(more)
    return out


def severity(found: DataFrame, group: list[str], strict: bool = False) -> DataFrame:
    """Errors and warnings, and the exit code: 2 with errors, 1 with warnings, 0; with ``strict``, warnings count as errors."""
    counts = found.groupBy(*group).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    bad = F.col("errors") + F.col("warnings") if strict else F.col("errors")
    return counts.withColumn("exit_code", F.when(bad > 0, 2).when(F.col("warnings") > 0, 1).otherwise(0))


def module_of_file(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Each file (path) with the first module, by ``seq``, one of whose paths (module, seq, source) is contained in it, anywhere
    and in the same case; an empty source path is contained in every one; else null."""
    from .joins import contains_join

    first = F.min(F.struct("seq", "module"))
    needles = sources.filter("source <> ''").groupBy("source").agg(first.alias("hit"))
    hits = contains_join(needles, files.select(F.col("path").alias("at")).distinct(), "source", "at", case=True).groupBy("at").agg(F.min("hit").alias("hit"))
    every = sources.filter("source = ''").agg(first.alias("every"))  # one row
    joined = files.join(hits, F.col("path") == F.col("at"), "left").crossJoin(F.broadcast(every))
    return joined.select(*files.columns, F.least("hit", "every")["module"].alias("module"))


def bare_section(section_id: Column) -> Column:
    """What stands before the first ``#``, without the first folder prefix that fits."""
    prefix = F.split_part(section_id, F.lit("#"), F.lit(1))
    out = prefix
    for p in reversed(SECTION_PREFIXES):
        out = F.when(prefix.startswith(p), F.substring(prefix, len(p) + 1, 10_000)).otherwise(out)
    return out


def infer_document(wanted: DataFrame, sections: DataFrame) -> DataFrame:
    """Each wanted section id with the document of the first section, by ``seq``, whose id contains its bare form; else null."""
    from .joins import contains_join

    keyed = wanted.withColumn("bare", bare_section(F.col("section_id")))
    found = contains_join(keyed.select("bare").distinct(), sections.select(F.col("section_id").alias("sid"), "seq", "doc_path"), "bare", "sid", case=True).groupBy("bare").agg(F.min_by("doc_path", "seq").alias("doc_path"))
    return keyed.join(found, "bare", "left").select(*wanted.columns, "doc_path")


def bounded_log(commits: DataFrame, group: str, seq: str, baseline: str, most: int = 30) -> DataFrame:
    """The commits after the group's baseline (a ``seq``), or the last ``most`` where it has none."""
    from .ranking import top_per_group

    after = commits.filter(F.col(baseline).isNotNull() & (F.col(seq) > F.col(baseline)))
    last = top_per_group(commits.filter(F.col(baseline).isNull()), [group], [F.desc(seq)], most).drop("rank")
    return after.unionByName(last)
