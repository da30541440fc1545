"""Traces of tampering: what a submitted file shows, alone or against its template or the submission before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The traces in the order in which they are reported.
EVIDENCE = ["trackingOff", "lockReleased", "lockChanged", "authorDateRemoved", "notFromTemplate", "untrackedText", "datedBeforePrevious"]


def is_track_lock(prefix: str = "") -> Column:
    return F.coalesce((F.col(f"{prefix}protection_edit") == "trackedChanges") & F.col(f"{prefix}protection_enforced"), F.lit(False))


def untracked_text(runs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, untracked_chars, untracked_sessions: text of editing sessions that the template doesn't know, outside tracked changes.

    runs: doc_id, template_id, rsid, tracked, chars. known: template_id, rsid.
    """
    rows = runs.where(~F.col("tracked") & F.col("rsid").isNotNull() & (F.col("chars") > 0))
    rows = rows.join(known.select("template_id", "rsid").distinct(), ["template_id", "rsid"], "left_anti")
    return rows.groupBy("doc_id").agg(F.sum("chars").cast("long").alias("untracked_chars"), F.count_distinct("rsid").alias("untracked_sessions"))


def check(facts: DataFrame, templates: DataFrame | None = None, *, least_chars: int = 1, compare_password: bool = True) -> DataFrame:
    """doc_id, evidence, details: a row for each trace found.

    facts: as from the file source, with template_id if there are templates (facts of theirs, by their doc_id); null: none.
    """
    if "template_id" not in facts.columns:
        facts = facts.withColumn("template_id", F.lit(None).cast("long"))
    rows = facts
    names = ["protection_edit", "protection_enforced", "protection_key", "rsid_root"]
    if templates is not None:
        t = templates.select(F.col("doc_id").alias("template_id"), F.lit(True).alias("t_there"), *[F.col(c).alias(f"t_{c}") for c in names])
        known = F.array_union(F.array_union("listed_rsids", "used_rsids"), F.when(F.col("rsid_root").isNotNull(), F.array("rsid_root")).otherwise(F.array().cast("array<string>")))
        known = templates.select(F.col("doc_id").alias("template_id"), F.explode(known).alias("rsid"))
        some = facts.where(F.size("used_rsids") > 0).join(known.select("template_id").distinct(), "template_id", "left_semi")
        text = untracked_text(some.select("doc_id", "template_id", F.inline("runs")), known)
        rows = rows.join(t, "template_id", "left").join(text, "doc_id", "left")
    else:
        rows = rows.withColumns({"t_there": F.lit(None).cast("boolean"), "untracked_chars": F.lit(None).cast("long"), "untracked_sessions": F.lit(None).cast("long")} | {f"t_{c}": F.lit(None).cast(dict(facts.dtypes)[c]) for c in names})
    against = F.coalesce("t_there", F.lit(False))
    locked, t_locked = is_track_lock(), is_track_lock("t_")
    released = (against & t_locked & ~locked) | (~against & F.coalesce((F.col("protection_edit") == "trackedChanges") & ~F.col("protection_enforced"), F.lit(False)))
    tests: dict[str, tuple[Column, dict[str, Column]]] = {
        "trackingOff": (F.col("settings_part_found") & ~F.col("track_revisions"), {}),
        "lockReleased": (released, {"protection": F.col("protection_edit")}),
        "lockChanged": (F.lit(compare_password) & against & t_locked & locked & ~F.col("protection_key").eqNullSafe(F.col("t_protection_key")), {}),
        "authorDateRemoved": ((F.col("undated") > 0) | (F.col("without_author") > 0), {"undated": F.col("undated"), "withoutAuthor": F.col("without_author")}),
        "notFromTemplate": (F.col("rsid_root") != F.col("t_rsid_root"), {"templateRsidRoot": F.col("t_rsid_root"), "rsidRoot": F.col("rsid_root")}),
        "untrackedText": (F.col("untracked_chars") >= least_chars, {"chars": F.col("untracked_chars"), "sessions": F.col("untracked_sessions")}),
    }
    none = F.create_map().cast("map<string,string>")
    found = [F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(k).alias("evidence"), (F.create_map(*[x for n, v in d.items() for x in (F.lit(n), v.cast("string"))]) if d else none).alias("details"))) for k, (cond, d) in tests.items()]
    return rows.select("doc_id", F.inline(F.filter(F.array(*found), lambda e: e.isNotNull())))


def by_submission(facts: DataFrame) -> DataFrame:
    """``facts`` of submissions (key, n) with template_id: the submission before is the template of the next."""
    from pyspark.sql import Window as W

    return facts.withColumn("template_id", F.lag("doc_id").over(W.partitionBy("key").orderBy("n")))


def report(evidence: list[DataFrame]) -> DataFrame:
    """doc_id, evidence (list in the fixed order), tampered: from one or more tables of traces."""
    rows = reduce(DataFrame.unionByName, [e.select("doc_id", "evidence") for e in evidence]).distinct()
    order = F.array(*[F.lit(e) for e in EVIDENCE])
    return rows.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.array_position(order, F.col("evidence")).alias("k"), "evidence"))), lambda e: e["evidence"]).alias("evidence")).withColumn("tampered", F.size("evidence") > 0)


def marked_name(path: Column) -> Column:
    """The name of an output with ``-tampered`` before its extension."""
    return F.regexp_replace(path, r"^(.*?)(\.[^./\\]*)?$", "$1-tampered$2")
