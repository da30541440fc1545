"""Classifiers: events and windows in, highlights out; of several, the category with the highest priority wins an insertion.

A classifier is any object with ``id``, ``version``, ``categories`` and ``classify(context) -> DataFrame`` of highlights:
doc_id, classifier, category, level, event_ids, start, end, lo, hi. With ``document_text`` true it may read texts when isolated.
"""

from __future__ import annotations

import dataclasses
import logging
import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.kinds import with_moved
from palimpsest.operators.rules import PRIORITY, RuleSet, with_level
from palimpsest.operators.windows import WindowOptions, windows

HIGHLIGHT = ["doc_id", "classifier", "category", "level", "event_ids", "start", "end", "lo", "hi"]
#: Fixed value: seconds that a classifier from elsewhere may take.
DEADLINE = 10.0
log = logging.getLogger(__name__)


@dataclasses.dataclass(frozen=True)
class Category:
    id: str
    role: str
    color: str
    priority: int
    label: str
    pattern: str = "none"


#: The categories that are always there.
BUILT_IN = [
    Category("fine", "fine", "#16A34A", 0, "Fine edits"),
    Category("bulk", "highlight", "#EA6C00", 1, "Bulk insertion"),
    Category("moved", "moved", "#7C3AED", 100, "Moved or copied"),
    Category("deleted", "deleted", "#DC2626", 0, "Deleted"),
    Category("total", "total", "#2563EB", 0, "Length"),
]


class Registry:
    """Categories by id; of roles other than highlight there is one each, the last registered."""

    def __init__(self, categories: list[Category] = BUILT_IN):
        self.by_id: dict[str, Category] = {}
        for c in categories:
            self.register(c)

    def register(self, category: Category) -> None:
        if category.role != "highlight":
            self.by_id = {k: c for k, c in self.by_id.items() if c.role != category.role}
        self.by_id[category.id] = category

    def highlights(self) -> list[Category]:
        return sorted([c for c in self.by_id.values() if c.role == "highlight"], key=lambda c: -c.priority)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c.id, c.role, c.color, c.priority, c.label, c.pattern) for c in self.by_id.values()], "category string, role string, color string, priority int, label string, pattern string")


class Context:
    """What classifiers see: the positioned events, and windows by their options, each computed once.

    ``redacted`` is what a classifier sees that may not read the document: the same, with empty texts. Its windows are those
    of the whole events, since which insertions were moved is told by text.
    """

    def __init__(self, events: DataFrame, whole: Context | None = None):
        self.events = events
        self._whole = whole
        self._windows: dict[WindowOptions, DataFrame] = {}

    def windows(self, options: WindowOptions) -> DataFrame:
        if self._whole is not None:
            return self._whole.windows(options)
        if options not in self._windows:
            self._windows[options] = windows(self.events, options)
        return self._windows[options]

    def redacted(self) -> Context:
        return Context(self.events.withColumn("text", F.lit("")), self)


class Classifier(Protocol):
    id: str
    version: str
    categories: list[Category]

    def classify(self, context: Context) -> DataFrame: ...


class Relocation:
    """Insertions whose text was deleted somewhere in the document at a known time."""

    id, version, categories, document_text = "builtin.relocation", "1.0.0", [], True

    def classify(self, context: Context) -> DataFrame:
        events = context.events.where(~F.coalesce("move", F.lit(False)) & F.col("ts").isNotNull())
        found = with_moved(events).where("moved")
        return found.select("doc_id", F.lit(self.id).alias("classifier"), F.lit("moved").alias("category"), F.lit(None).cast("string").alias("level"), F.array("rev_id").alias("event_ids"), F.col("ts").alias("start"), F.col("ts").alias("end"), F.col("start_offset").alias("lo"), F.col("end_offset").alias("hi"))


class Rules:
    """Windows that have a level."""

    id, version, document_text = "builtin.rules", "1.0.0", True

    def __init__(self, rules: RuleSet):
        self.rules = rules
        self.categories = [Category(x.category_id, "highlight", x.color, PRIORITY + len(rules.levels) - k, x.name(), x.pattern) for k, x in enumerate(rules.levels)]

    def classify(self, context: Context) -> DataFrame:
        rows = with_level(context.windows(self.rules.window), self.rules).where("level is not null")
        return rows.select("doc_id", F.lit(self.id).alias("classifier"), "category", "level", "event_ids", "start", "end", "lo", "hi")


def built_in(rules: RuleSet) -> list[Classifier]:
    return [Relocation(), Rules(rules)]


@dataclasses.dataclass
class Result:
    highlights: DataFrame
    winners: DataFrame
    categories: Registry
    errors: dict[str, str]


def winning(highlights: DataFrame, categories: DataFrame) -> DataFrame:
    """One row for each insertion with a highlight: the highest priority, of equal ones the earliest classifier.

    highlights: HIGHLIGHT, with ``nth`` of the classifier. categories: category, role, priority.
    """
    rows = highlights.join(F.broadcast(categories.select("category", "role", "priority")), "category", "left").withColumn("rev_id", F.explode("event_ids"))
    best = W.partitionBy("doc_id", "rev_id").orderBy(F.coalesce("priority", F.lit(0)).desc(), "nth", "start", "lo")
    return rows.withColumn("__rank", F.row_number().over(best)).where("__rank = 1").drop("__rank", "event_ids")


def within(spark: SparkSession, seconds: float, work: Callable[[], DataFrame]) -> DataFrame:
    """What ``work`` gives, if it takes no longer; else its Spark jobs are cancelled and TimeoutError is raised."""
    tag, out = f"classifier-{uuid.uuid4().hex}", []

    def tagged() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            out.append(work())
        except BaseException as e:
            out.append(e)

    thread = InheritableThread(target=tagged, session=spark)
    thread.daemon = True  # work that hangs outside of Spark can't be stopped; it is left behind
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        spark.sparkContext.cancelJobsWithTag(tag)
        raise TimeoutError(f"took more than {seconds:g} seconds")
    if isinstance(out[0], BaseException):
        raise out[0]
    return out[0]


def run(classifiers: list[Classifier], context: Context, *, isolate: bool = False, seconds: float = DEADLINE) -> Result:
    """All classifiers' highlights, in their order, and the winner of each insertion.

    With ``isolate``, for classifiers from elsewhere, one that raises gives no highlights and an entry in ``errors``, also if it
    raises on rows only: its highlights are computed at once, into a checkpoint. One that takes more than ``seconds`` gives none
    either: its jobs are cancelled, and the rest goes on. One that lacks ``document_text`` sees no texts then.
    Categories are the built-in ones but bulk, and those of the classifiers.
    """
    registry = Registry([c for c in BUILT_IN if c.id != "bulk"])
    found, errors = [], {}
    spark = context.events.sparkSession
    if isolate and not spark.sparkContext.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(at)
    for k, c in enumerate(classifiers):
        for category in c.categories:
            registry.register(category)
        try:
            seen = context.redacted() if isolate and not getattr(c, "document_text", False) else context
            found_by = lambda c=c, seen=seen, k=k: c.classify(seen).select(*HIGHLIGHT).withColumn("nth", F.lit(k))
            rows = within(spark, seconds, lambda f=found_by: f().checkpoint(eager=True)) if isolate else found_by()
        except Exception as e:
            if not isolate:
                raise
            log.warning("classifier %s: %s", c.id, e)
            errors[c.id] = str(e)
            continue
        found.append(rows)
    highlights = found[0] if found else spark.createDataFrame([], "doc_id long, classifier string, category string, level string, event_ids array<string>, start timestamp, end timestamp, lo int, hi int, nth int")
    for rows in found[1:]:
        highlights = highlights.unionByName(rows)
    return Result(highlights, winning(highlights, registry.table(spark)), registry, errors)


def apply(events: DataFrame, winners: DataFrame) -> DataFrame:
    """``events`` with kind, level and category from the winners: moved, bulk (of a highlight's category) or fine."""
    w = winners.select("doc_id", "rev_id", F.col("role").alias("__role"), F.col("category").alias("__category"), F.col("level").alias("__level"))
    events = events.join(w, ["doc_id", "rev_id"], "left")
    ins, high = F.col("type") == "ins", F.col("__role") == "highlight"
    kind = F.when(~ins, None).when(F.col("__role") == "moved", "moved").when(high, "bulk").otherwise("fine")
    return events.withColumns({"kind": kind, "category": F.when(ins & high, F.col("__category")), "level": F.when(ins & high, F.col("__level"))}).drop("__role", "__category", "__level")
