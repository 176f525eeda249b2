"""Ordered rules that ignore or archive entries of a tree.

A rule's regular expression is searched (not anchored) in an entry's path relative to the scan's root,
with ``/`` between components; the first rule that matches decides, and the root itself is never
matched. What lies below an ignored, archived or colliding entry isn't visited.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import expr

IGNORE, ARCHIVE = "ignore", "archive"


@dataclass(frozen=True)
class ScanRule:
    pattern: str
    action: str


# The built-in presets.
PRESETS = {
    "git": ScanRule(r"(^|/)\.git$", ARCHIVE),
    "rust_target": ScanRule(r"(^|/)target$", IGNORE),
    "node_modules": ScanRule(r"(^|/)node_modules$", IGNORE),
    "python_venv": ScanRule(r"(^|/)(\.venv|venv)$", IGNORE),
}


class InvalidRule(ValueError):
    """A rule that can't be used; nothing has been stored."""


def ordered(rules=(), bundle_git: bool = False) -> list[ScanRule]:
    """The rules in the order of their use: git directories first if they're to be bundled."""
    return [PRESETS["git"]] * bundle_git + [r if isinstance(r, ScanRule) else ScanRule(*r) for r in rules]


def from_flags(git=False, rust=False, node=False, python=False, ignore=(), archive=()) -> list[ScanRule]:
    """The command line's order: presets, then all that ignore, then all that archive."""
    on = [k for k, v in (("git", git), ("rust_target", rust), ("node_modules", node), ("python_venv", python)) if v]
    return [PRESETS[k] for k in on] + [ScanRule(p, IGNORE) for p in ignore] + [ScanRule(p, ARCHIVE) for p in archive]


def enabled(presets: list[str], custom: list[dict], active: set[str]) -> list[ScanRule]:
    """Presets, then the saved rules that are chosen."""
    return [PRESETS[p] for p in presets] + [ScanRule(r["pattern"], r["action"]) for r in custom if r["id"] in active and r.get("enabled", True)]


def java_pattern(pattern: str) -> str:
    """``pattern`` for the JVM: Unicode classes, and ``$`` only at the very end. Raises InvalidRule for what linear-time engines lack."""
    try:
        re.compile(re.sub(r"\\[pP](\{[^}]*\}|\w)|\\z", "x", pattern))
    except re.error as e:
        raise InvalidRule(f"invalid scan rule regex: {pattern}: {e}") from None
    if re.search(r"\(\?[=!]|\(\?<[=!]|\(\?>|\\[1-9]|\(\?[a-zA-Z]*U|[*+?}]\+", re.sub(r"\\\\", "", pattern)):
        raise InvalidRule(f"invalid scan rule regex: {pattern}: look-around, back references, possessive repeats and the U flag aren't supported")
    out, bracket, k = [], False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            out.append(pattern[k : k + 2])
            k += 2
            continue
        bracket = c == "[" or bracket and c != "]"
        out.append(r"\z" if c == "$" and not bracket else c)
        k += 1
    return "(?U)" + "".join(out)


def compiled(rules: list[ScanRule]) -> list[tuple[str, str]]:
    """(JVM pattern, action) for each rule, checked."""
    for r in rules:
        if r.action not in (IGNORE, ARCHIVE):
            raise InvalidRule(f"invalid scan rule action: {r.action}")
    return [(java_pattern(r.pattern), r.action) for r in rules]


def check_custom(rule: dict) -> None:
    """A saved rule needs a label, a pattern, and an expression that compiles."""
    if not rule.get("label", "").strip():
        raise InvalidRule("a rule needs a label")
    if not rule.get("pattern", "").strip():
        raise InvalidRule("a rule needs a pattern")
    compiled([ScanRule(rule["pattern"], rule["action"])])


def first_match(rel: Column, rules: list[ScanRule]) -> Column:
    """The action of the first rule that matches, or null."""
    whens = [F.when(rel.rlike(p), F.lit(a)) for p, a in compiled(rules)]
    return F.when(rel != "", F.coalesce(*whens, F.lit(None).cast("string")))


def decided(entries: DataFrame, rules: list[ScanRule]) -> DataFrame:
    """``entries(rel, kind, ...)`` that a scan visits, with ``decision``: ignore, archive, skip (archive rule on what's no directory), collision or plain.

    A collision is ``X.tar`` beside a directory ``X`` that is archived. ``lstat_kind``, if there, tells real directories from links.
    """
    lstat = F.col("lstat_kind") if "lstat_kind" in entries.columns else F.col("kind")
    marked = entries.withColumn("_ru_a", first_match(F.col("rel"), rules)).withColumn("_ru_l", lstat)
    tarred = marked.where((F.col("_ru_a") == ARCHIVE) & (F.col("_ru_l") == "dir")).select(F.concat("rel", F.lit(".tar")).alias("_ru_t")).distinct()
    named = ~F.col("rel").rlike(r"(^|/)\.tar\z")
    marked = marked.join(tarred, F.col("rel") == F.col("_ru_t"), "left")
    decision = (
        F.when(F.col("_ru_a") == IGNORE, IGNORE)
        .when((F.col("_ru_a") == ARCHIVE) & (F.col("_ru_l") == "dir"), ARCHIVE)
        .when(F.col("_ru_a") == ARCHIVE, "skip")
        .when(F.col("_ru_t").isNotNull() & named, "collision")
        .otherwise("plain")
    )
    marked = marked.withColumn("decision", decision).drop("_ru_a", "_ru_l", "_ru_t")
    closed = marked.where("decision <> 'plain'").select(F.col("rel").alias("_ru_top"))
    below = marked.select("rel", F.explode(expr.relative_parents(F.col("rel"))).alias("_ru_up")).join(closed, F.col("_ru_up") == F.col("_ru_top"), "left_semi").select(F.col("rel").alias("_ru_hidden")).distinct()
    return marked.join(below, F.col("rel") == F.col("_ru_hidden"), "left_anti")


def merge_rules(saved: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rules by id: incoming ones replace saved ones, new ids are added."""
    return saved.join(incoming.select("id"), "id", "left_anti").unionByName(incoming)


def any_match(rel: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [rel.rlike(java_pattern(p)) for p in patterns], F.lit(False))
