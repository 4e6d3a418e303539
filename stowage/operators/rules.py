"""Project rules: boolean trees over facts of one folder, compiled to columns.

The tree's leaves ask for facts (is there a file like this, how many files
like that below here). ``leaf_facts`` lists the distinct facts that a set of
rules needs, so that the folder roll-up gathers exactly those in its one pass;
``compile_expr`` turns a tree into a boolean column over the gathered facts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowage.functions.globs import glob_in_path, glob_match

Expr = dict


def file(glob: str) -> Expr:
    """The folder itself holds a file like ``glob``."""
    return {"op": "file", "glob": glob}


def dir(glob: str) -> Expr:
    """The folder has a child folder like ``glob``."""
    return {"op": "dir", "glob": glob}


def count(glob: str, min: int = 1) -> Expr:
    """At least ``min`` files like ``glob`` anywhere below the folder."""
    return {"op": "count", "glob": glob, "min": min}


def name(glob: str) -> Expr:
    """The folder's own name is like ``glob``."""
    return {"op": "name", "glob": glob}


def depth(min: int) -> Expr:
    """The folder lies at least ``min`` segments deep."""
    return {"op": "depth", "min": min}


def all_(*items: Expr) -> Expr:
    return {"op": "and", "items": list(items)}


def any_(*items: Expr) -> Expr:
    return {"op": "or", "items": list(items)}


def not_(expr: Expr) -> Expr:
    return {"op": "not", "expr": expr}


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    color: str
    expr: Expr | None

    @classmethod
    def from_json(cls, data: dict) -> Rule:
        return cls(data["id"], data.get("name", data["id"]), data.get("color", ""), data.get("expr"))


# The rules in force unless a caller brings others. First match wins.
BUILTIN_RULES = (
    Rule("git", "Git repo", "green", dir(".git")),
    Rule("node", "Node project", "yellow", all_(
        any_(file("package.json"), file("yarn.lock"), file("pnpm-lock.yaml")),
        not_(name("node_modules")))),
    Rule("xcode", "Xcode project", "blue", any_(dir("*.xcodeproj"), dir("*.xcworkspace"))),
    Rule("rust", "Rust project", "orange", file("Cargo.toml")),
    Rule("python", "Python project", "purple", any_(
        file("pyproject.toml"), file("setup.py"), file("Pipfile"), file("requirements.txt"))),
    Rule("ableton", "Ableton session", "pink", count("*.als", 1)),
    Rule("photoshoot", "Photo shoot", "teal", all_(
        count("*.{jpg,jpeg,raw,heic,nef,cr2,arw,dng}", 30), depth(3))),
    Rule("video", "Video project", "red", any_(
        file("*.prproj"), file("*.aep"), dir("*.fcpxbundle"), file("*.fcpxml"))),
)

# Folders whose content says nothing about the project around them.
OPAQUE_NAMES = (
    "node_modules", ".git", "dist", "build", "target", "out",
    ".next", ".nuxt", ".cache", ".parcel-cache",
    "Pods", "vendor", ".bundle",
    "__pycache__", ".pytest_cache", ".venv", "venv",
)


@dataclass(frozen=True)
class ProjectSettings:
    """How projects are found and grouped."""

    enabled: bool = True
    threshold: float = 0.9
    detect_nested: bool = False
    rules: tuple[Rule, ...] = BUILTIN_RULES
    opaque: tuple[str, ...] = OPAQUE_NAMES

    def override(self, **changes) -> ProjectSettings:
        """Settings of one build: what it states replaces what is stored."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})

    @property
    def effective_threshold(self) -> float:
        """A threshold of zero means the default."""
        return self.threshold or 0.9


def leaf_facts(rules) -> dict[tuple[str, str], str]:
    """Distinct ``(op, glob)`` leaves that need the roll-up, with a column name for each."""
    found: dict[tuple[str, str], str] = {}

    def walk(expr):
        if not isinstance(expr, dict):
            return
        if expr.get("op") in ("file", "dir", "count"):
            leaf = (expr["op"], expr.get("glob") or "")
            found.setdefault(leaf, f"fact_{len(found)}")
        for item in expr.get("items") or []:
            walk(item)
        walk(expr.get("expr"))

    for rule in rules:
        walk(rule.expr)
    return found


def compile_expr(expr: Expr | None, facts: dict[tuple[str, str], str]) -> Column:
    """Boolean column of a rule tree. Unknown operators and missing trees are false."""
    op = expr.get("op") if isinstance(expr, dict) else None
    glob = (expr or {}).get("glob") or ""
    if op in ("and", "or"):
        parts = [compile_expr(item, facts) for item in expr.get("items") or []]
        start = F.lit(op == "and")
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), parts, start)
    if op == "not":
        return ~compile_expr(expr.get("expr"), facts)
    if op in ("file", "dir"):
        return F.coalesce(F.col(facts[op, glob]) > 0, F.lit(False))
    if op == "count":
        return F.coalesce(F.col(facts[op, glob]) >= (expr.get("min") or 1), F.lit(False))
    if op == "name":
        return F.coalesce(glob_match("folder_name", glob), F.lit(False))
    if op == "depth":
        return F.col("depth") >= (expr.get("min") or 0)
    return F.lit(False)


def could_be(expr: Expr | None, value: bool) -> str | bool:
    """Whether a rule tree may come out as ``value`` in a folder of which only the name is known.

    Where the name decides, this is a regex that holds in a path where such a name starts.
    """
    op = expr.get("op") if isinstance(expr, dict) else None
    if op in ("and", "or"):
        parts = [could_be(item, value) for item in expr.get("items") or []]
        every = (op == "and") == value
        open_parts = [part for part in parts if not isinstance(part, bool)]
        if any(part is (not every) for part in parts):
            return not every
        return ("".join(open_parts) if every else f"(?:{'|'.join(open_parts)})") if open_parts else every
    if op == "not":
        return could_be(expr.get("expr"), not value)
    if op == "name":
        held = glob_in_path(expr.get("glob") or "")
        return held if value else f"(?!{held})"
    if op in ("file", "dir", "count", "depth"):
        return True
    return not value


def first_match(rules, facts: dict[tuple[str, str], str]) -> Column:
    """Struct of the first rule that holds, or null."""
    tests = [
        F.when(compile_expr(rule.expr, facts), F.struct(
            F.lit(rule.id).alias("rule_id"), F.lit(rule.name).alias("rule_name"),
            F.lit(rule.color).alias("rule_color")))
        for rule in rules
    ]
    return F.coalesce(*tests) if tests else F.lit(None)
