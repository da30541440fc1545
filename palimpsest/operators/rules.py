"""Rules over window features, given by users as YAML or JSON.

``SHAPES`` says what a rule file looks like, ``checked`` walks a value along it, and ``compiled`` turns a checked condition
into a column.
"""

from __future__ import annotations

import dataclasses
import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.kinds import BULK_CHARS
from palimpsest.operators.windows import WindowOptions

#: The features that rules may name, as in rule files, with their columns; the operators; fill patterns.
FEATURES = {"insertedChars": "inserted_chars", "durationSec": "duration_sec", "cps": "cps", "spanChars": "span_chars", "spanParas": "span_paras", "maxSingleInsert": "max_single_insert", "paraCount": "para_count", "postEditRatio": "post_edit_ratio", "precedingDeletedChars": "preceding_deleted_chars", "insertCount": "insert_count", "precededByDeletion": "preceded_by_deletion"}
TRUTHS = {"precededByDeletion"}
LANGUAGES = ["en", "ja"]
COMPARE = {"gte": Column.__ge__, "gt": Column.__gt__, "lte": Column.__le__, "lt": Column.__lt__, "eq": Column.__eq__}
PATTERNS = ["none", "diagonal", "dots", "cross", "horizontal", "vertical"]
PRIORITY = 10


class RuleError(ValueError):
    """What is wrong with a rule file, and where."""

    def __init__(self, where: str, what: str):
        super().__init__(f"{where}: {what}")
        self.where = where


@dataclasses.dataclass(frozen=True)
class Level:
    id: str
    color: str
    when: Column
    label: str | dict[str, str]
    pattern: str = "none"
    category: str | None = None

    @property
    def category_id(self) -> str:
        return self.category or f"level:{self.id}"

    def name(self, lang: str = "en") -> str:
        if isinstance(self.label, str):
            return self.label
        return self.label.get(lang) or self.label.get("en") or self.label.get("ja") or self.id


@dataclasses.dataclass(frozen=True)
class RuleSet:
    name: str
    window: WindowOptions
    levels: list[Level]


def default_rules(bulk_chars: int = BULK_CHARS) -> RuleSet:
    """Insertions of one author and time with so many characters together are one level, ``bulk``."""
    when = compiled({"insertedChars": {"gte": bulk_chars}})
    return RuleSet(f"default(bulk-chars={bulk_chars})", WindowOptions(by_author=True), [Level("bulk", "#EA6C00", when, {"en": "Bulk insertion"}, category="bulk")])


def _is_number(value: object) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value)


def _leaf(what: str, holds: Callable[[object], bool]) -> tuple[str, Callable[[object], bool]]:
    return what, holds


#: The shapes of a rule file. A leaf says what it must be; a dictionary gives the shapes of its keys (``!`` after those that must
#: be there, ``""`` among them if one at least must be); a list holds one shape for all its members, of which there must be
#: one; a name stands for its shape; and of a set of names, given as a tuple, that counts which fits the value's kind and keys best.
SHAPES: dict[str, object] = {
    "file": {"ruleSet!": "text", "window": "window", "levels!": ["level"]},
    "window": {"seconds!": "amount", "chars": "amount", "paras": "amount", "byAuthor": "truth"},
    "level": {"id!": "text", "label": ("text", "texts"), "color!": "colour", "when!": ("all", "any", "not", "measures"), "pattern": "pattern"},
    "texts": {"": None} | dict.fromkeys(LANGUAGES, "text"),
    "all": {"all!": [("all", "any", "not", "measures")]},
    "any": {"any!": [("all", "any", "not", "measures")]},
    "not": {"not!": ("all", "any", "not", "measures")},
    "measures": {"": None} | {f: ("truth", "same") if f in TRUTHS else ("number", "bounds") for f in FEATURES},
    "bounds": {"": None} | dict.fromkeys(COMPARE, "number"),
    "same": {"eq!": "truth"},
    "text": _leaf("a text", lambda v: isinstance(v, str) and bool(v.strip())),
    "truth": _leaf("true or false", lambda v: isinstance(v, bool)),
    "number": _leaf("a number", _is_number),
    "amount": _leaf("a number, 0 or more", lambda v: _is_number(v) and v >= 0),
    "colour": _leaf("#rgb or #rrggbb", lambda v: isinstance(v, str) and bool(re.fullmatch(r"#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})", v))),
    "pattern": _leaf(f"one of {', '.join(PATTERNS)}", lambda v: v in PATTERNS),
}


def _best(names: tuple[str, ...], value: object) -> str:
    """Of shapes that may stand here, the one that a value means: by its kind, and by the first key that they share."""
    keyed = [n for n in names if isinstance(SHAPES[n], dict)]
    plain = [n for n in names if n not in keyed]
    if not isinstance(value, dict):
        return plain[0] if plain else keyed[-1]
    return next((n for n in keyed if any(k.rstrip("!") in value for k in SHAPES[n] if k)), keyed[-1])


def checked(value: object, shape: object, where: str = "") -> None:
    """Raises a RuleError with the place of the first thing that isn't as the shape says."""
    at = where or "(root)"
    if isinstance(shape, tuple) and isinstance(shape[0], str) and shape[0] in SHAPES:
        shape = _best(shape, value)
    if isinstance(shape, str):
        shape = SHAPES[shape]
    if isinstance(shape, tuple):
        what, holds = shape
        if not holds(value):
            raise RuleError(at, f"must be {what}")
    elif isinstance(shape, list):
        if not isinstance(value, list) or not value:
            raise RuleError(at, "must be a list that isn't empty")
        for k, member in enumerate(value):
            checked(member, shape[0], f"{where}[{k}]")
    else:
        known = {k.rstrip("!"): k for k in shape if k}
        if not isinstance(value, dict):
            raise RuleError(at, "must be a mapping")
        wrong = [f"unknown key {k!r}; known: {', '.join(known)}" for k in value if k not in known]
        wrong += [f"{k} is missing" for k, full in known.items() if full.endswith("!") and k not in value]
        if wrong or "" in shape and not value:
            raise RuleError(at, (wrong or ["is empty"])[0])
        for k, member in value.items():
            checked(member, shape[known[k]], f"{where}.{k}".lstrip("."))


def compiled(when: dict) -> Column:
    """The column of a checked condition: ``all``, ``any`` and ``not`` of conditions, or features with comparisons that must all hold; a bare value means ``eq``."""
    joins = {"all": Column.__and__, "any": Column.__or__}
    parts: list[Column] = []
    for key, inner in when.items():
        if key in joins:
            parts.append(reduce(joins[key], map(compiled, inner)))
        elif key == "not":
            parts.append(~compiled(inner))
        else:
            tests = inner if isinstance(inner, dict) else {"eq": inner}
            parts += [COMPARE[op](F.col(FEATURES[key]), F.lit(value)) for op, value in tests.items()]
    return reduce(Column.__and__, parts)


def rule_set(value: object) -> RuleSet:
    """Rules from what a YAML or JSON file holds."""
    if isinstance(value, dict) and value.get("window", ...) is None:  # a key with nothing after it
        value = {k: v for k, v in value.items() if k != "window"}
    checked(value, "file")
    ids = [x["id"] for x in value["levels"]]
    for k, name in enumerate(ids):
        if name in ids[:k]:
            raise RuleError(f"levels[{k}].id", f"{name!r} is there twice")
    fills = PATTERNS[1:]
    levels = [Level(x["id"], x["color"], compiled(x["when"]), x.get("label", x["id"]), x.get("pattern", fills[k % len(fills)])) for k, x in enumerate(value["levels"])]
    window = value.get("window")
    bounds = WindowOptions(window["seconds"], window.get("chars"), window.get("paras"), window.get("byAuthor", False)) if window else WindowOptions(by_author=True)
    return RuleSet(value["ruleSet"], bounds, levels)


def load_rules(text: str) -> RuleSet:
    """Rules from YAML or JSON text."""
    import yaml

    return rule_set(yaml.safe_load(text))


def with_level(windows: DataFrame, rules: RuleSet) -> DataFrame:
    """``windows`` with level and category: the first level whose condition holds, or null."""
    level = category = F.lit(None).cast("string")
    for x in reversed(rules.levels):
        hit = F.coalesce(x.when, F.lit(False))
        level, category = F.when(hit, F.lit(x.id)).otherwise(level), F.when(hit, F.lit(x.category_id)).otherwise(category)
    return windows.withColumns({"level": level, "category": category})


def levels_of_insertions(windows: DataFrame) -> DataFrame:
    """doc_id, rev_id, level, category of the insertions in windows that have a level."""
    return windows.where("level is not null").select("doc_id", F.explode("event_ids").alias("rev_id"), "level", "category")
