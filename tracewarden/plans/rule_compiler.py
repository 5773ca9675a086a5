"""Detection rules compiled to Catalyst expressions.

Conditions become a syntax tree first and columns last, so a rule is parsed once, not for each event, and Spark folds
and shares what rules have in common. ``compat=True`` reproduces an interpreter that stops reading at a short cut:
after a true left side of ``or``, or a false one of ``and``, the rest of the group is left over and the rule fails.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from fnmatch import fnmatch
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nested import at, leaves
from ..sources.rules import Rule

MODIFIERS = ("contains", "startswith", "endswith", "re")
MATCH = "struct<rule_id:string,rule_title:string,level:string,description:string,tags:array<string>,rule_path:string>"
ENGINE = "sigma_edge"


# ---- conditions


@dataclass(frozen=True)
class Leaf:
    names: tuple[str, ...]
    all: bool = False


@dataclass(frozen=True)
class Not:
    item: object


@dataclass(frozen=True)
class Both:
    kind: str  # "and" or "or"
    left: object
    right: object


class ConditionError(ValueError):
    pass


class _Parser:
    def __init__(self, text: str, names: list[str]):
        self.tokens = re.findall(r"[()]|[^\s()]+", text)
        self.names, self.at = names, 0

    def peek(self) -> str | None:
        return self.tokens[self.at].lower() if self.at < len(self.tokens) else None

    def take(self) -> str:
        if self.at >= len(self.tokens):
            raise ConditionError("the condition ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def parse(self) -> object:
        tree = self.chain("or", lambda: self.chain("and", self.negation))
        if self.at != len(self.tokens):
            raise ConditionError(f"unexpected {self.tokens[self.at]!r}")
        return tree

    def chain(self, word: str, below) -> object:
        tree = below()
        while self.peek() == word:
            self.take()
            tree = Both(word, tree, below())
        return tree

    def negation(self) -> object:
        if self.peek() == "not":
            self.take()
            return Not(self.negation())
        return self.primary()

    def primary(self) -> object:
        token = self.take()
        if token == "(":
            tree = self.chain("or", lambda: self.chain("and", self.negation))
            if self.take() != ")":
                raise ConditionError("a parenthesis is open")
            return tree
        if token == ")" or token.lower() in ("and", "or"):
            raise ConditionError(f"unexpected {token!r}")
        if self.peek() == "of":
            self.take()
            pattern = self.take()
            if token.lower() not in ("1", "all"):
                raise ConditionError(f"{token!r} of is unknown")
            return Leaf(tuple(n for n in self.names if fnmatch(n, pattern)), token.lower() == "all")
        return Leaf((token,) if token in self.names else ())


def parse_condition(text: str, names: list[str]) -> object:
    return _Parser(text, names).parse()


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _standard(tree: object, of: dict[str, Column]) -> Column:
    if isinstance(tree, Not):
        return ~_standard(tree.item, of)
    if isinstance(tree, Both):
        a, b = _standard(tree.left, of), _standard(tree.right, of)
        return a & b if tree.kind == "and" else a | b
    found = [of[n] for n in tree.names]
    return (_all(found) if tree.all else _any(found)) if found else F.lit(False)


def _compat(tree: object, of: dict[str, Column]) -> tuple[Column, Column]:
    """(value, whether everything was read)."""
    if isinstance(tree, Not):
        value, read = _compat(tree.item, of)
        return ~value, read
    if isinstance(tree, Both):
        (a, read_a), (b, read_b) = _compat(tree.left, of), _compat(tree.right, of)
        return b, read_a & (a if tree.kind == "and" else ~a) & read_b
    return _standard(tree, of), F.lit(True)


# ---- fields


def _java(pattern: str) -> str | None:
    """A pattern of Python's ``re`` for Java; None if it is not valid."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    return "(?i)(?u)" + re.sub(r"\(\?P<", "(?<", re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)).replace(r"\Z", r"\z")


def _test(value: Column, expected: object, modifier: str) -> Column:
    text = str(expected)
    if modifier == "re":
        pattern = _java(text)
        return F.lit(False) if pattern is None else value.rlike(pattern)
    lower = F.lower(value)
    if modifier in MODIFIERS:
        return getattr(lower, modifier)(F.lit(text.lower()))
    return lower == F.lit(text.lower())


def field_predicate(schema: T.StructType, field: str, expected: object, strict: bool = False) -> Column:
    """``path|modifier...: expected``. A missing field never matches; an array matches if any of its elements does."""
    path, *modifiers = [p.strip() for p in field.split("|")]
    if unknown := [m for m in modifiers if m not in (*MODIFIERS, "all")]:
        if strict:
            raise ValueError(f"unknown modifiers in {field!r}: {unknown}")
        warnings.warn(f"unknown modifiers in {field!r} mean equality: {unknown}", stacklevel=2)
    modifier = next((m for m in MODIFIERS if m in modifiers), "equals")
    found = leaves(schema).get(path)
    if found is None:
        return F.lit(False)
    values = expected if isinstance(expected, list) else [expected]
    return _present(found, values, modifier, "all" in modifiers)


def _present(found: tuple[tuple[str, ...], T.DataType], values: list, modifier: str, every: bool) -> Column:
    path, kind = found
    value = at(path)

    def one(expected: object) -> Column:
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.exists(value, lambda x: F.coalesce(_test(x.cast("string"), expected, modifier), F.lit(False))), F.lit(False))
        return F.coalesce(_test(value.cast("string"), expected, modifier), F.lit(False))

    tests = [one(v) for v in values]
    return value.isNotNull() & (_all(tests) if every else _any(tests))


def selection_predicate(schema: T.StructType, selection: object, strict: bool = False) -> Column:
    """A map is all of its fields, a list any of its items; anything else never matches."""
    if isinstance(selection, dict):
        return _all([field_predicate(schema, str(k), v, strict) for k, v in selection.items()])
    if isinstance(selection, list):
        return _any([selection_predicate(schema, s, strict) for s in selection])
    return F.lit(False)


def rule_predicate(schema: T.StructType, rule: Rule, compat: bool = False, strict: bool = False) -> Column:
    """Whether a row matches a rule; never null. A condition that can't be read never matches."""
    selections = {str(k): v for k, v in rule.detection.items() if k != "condition"}
    try:
        tree = parse_condition(rule.detection["condition"], list(selections))
    except ConditionError:
        if strict:
            raise
        return F.lit(False)
    of = {k: selection_predicate(schema, s, strict) for k, s in selections.items()}
    if compat:
        value, read = _compat(tree, of)
        return value & read
    return _standard(tree, of)


# ---- rule sets


def with_matches(df: DataFrame, rules: list[Rule], compat: bool = False, matches_col: str = "matches", per_step: int = 40) -> DataFrame:
    """``df`` and an array with every matching rule, in the rules' order. Large sets are tested in several projections."""

    def entry(r: Rule) -> Column:
        tags = F.array(*map(F.lit, r.tags)) if r.tags else F.array().cast("array<string>")
        return F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.title).alias("rule_title"), F.lit(r.level).alias("level"), F.lit(r.description).alias("description"), tags.alias("tags"), F.lit(r.path).alias("rule_path"))

    out = df.withColumn(matches_col, F.array().cast(f"array<{MATCH}>"))
    for k in range(0, len(rules), per_step):
        tested = F.array(*[F.when(rule_predicate(df.schema, r, compat), entry(r)) for r in rules[k : k + per_step]])
        out = out.withColumn(matches_col, F.concat(matches_col, F.filter(tested, lambda m: m.isNotNull()).cast(f"array<{MATCH}>")))
    return out


def detect(documents: DataFrame, rules: list[Rule], enabled: bool = True, compat: bool = False, ruleset: str = "local-sigma") -> DataFrame:
    """``documents`` with ``rule`` and ``edr.detection``; the first matching rule is the primary one and makes an alert."""
    found = with_matches(documents, rules if enabled else [], compat, "__matches")
    hit = F.size("__matches") > 0
    first = F.get("__matches", 0)
    reason = F.lit(None if enabled else "sigma engine disabled").cast("string")
    detection = F.struct(
        hit.alias("matched"),
        F.lit(ENGINE).alias("engine"),
        F.lit(ruleset).alias("ruleset"),
        first["rule_id"].alias("rule_id"),
        first["rule_title"].alias("rule_title"),
        first["level"].alias("severity"),
        reason.alias("reason"),
        F.when(hit, F.col("__matches")).alias("matches"),
    )
    rule = F.when(hit, F.struct(first["rule_id"].alias("id"), first["rule_title"].alias("name"), first["level"].alias("level"), F.lit(ruleset).alias("ruleset")))
    edr = F.col("edr").withField("detection", detection) if "edr" in documents.columns else F.struct(detection.alias("detection"))
    event = F.col("event").withField("kind", F.when(hit, "alert").otherwise(F.col("event.kind")))
    return found.withColumns({"event": event, "rule": rule, "edr": edr}).drop("__matches")
