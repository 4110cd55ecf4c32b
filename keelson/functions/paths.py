"""Paths: globs, renames in commit logs, and the constant that a path stands for."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is never scored.
DEFAULT_EXCLUDES = (
    "db/schema.rb",
    "db/migrate/**",
    "node_modules/**",
    "**/node_modules/**",
    "vendor/**",
    "**/*.min.js",
    "tmp/**",
    "log/**",
    "coverage/**",
    "spec/**",
    "test/**",
    "__tests__/**",
    "**/__tests__/**",
    "**/*.test.js",
    "**/*.test.ts",
    "**/*.test.jsx",
    "**/*.test.tsx",
    "**/*.spec.js",
    "**/*.spec.ts",
    "**/*.spec.jsx",
    "**/*.spec.tsx",
)

# File endings and their languages.
LANGUAGES = {".rb": "ruby", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript"}

# Plurals without a rule.
IRREGULAR = {"people": "person", "children": "child", "men": "man", "women": "woman", "mice": "mouse", "geese": "goose"}


def glob_regex(glob: str) -> str:
    """An anchored regular expression. `**/` spans any number of folders, `*` and `?` stay within one."""
    out, at = [], 0
    while at < len(glob):
        if glob.startswith("**/", at):
            out.append("(?:[^/]+/)*")
            at += 3
        elif glob[at] == "*":
            out.append("[^/]*")
            at += 1
        elif glob[at] == "?":
            out.append("[^/]")
            at += 1
        elif glob[at] == "[" and "]" in glob[at + 2 :]:
            end = glob.index("]", at + 2)
            body = glob[at + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            at = end + 1
        elif glob[at] == "{" and "}" in glob[at:]:
            out.append(re.escape("{"))
            at += 1
        else:
            out.append(re.escape(glob[at]))
            at += 1
    whole = "".join(out)
    inside = re.fullmatch(r"(\*\*/)?([^*?\[]+)/\*\*", glob)
    if inside:  # everything under a folder, at any depth for `**/dir/**` and from the root for `dir/**`
        folder = re.escape(inside[2])
        whole = f"(?:{'(?:.*/)?' if inside[1] else ''}{folder}/.*|{whole})"
    return whole


def matches_any(path: Column, globs: list[str] | tuple[str, ...]) -> Column:
    if not globs:
        return F.lit(False)
    return path.rlike("^(?:" + "|".join(glob_regex(g) for g in globs) + ")$")


def language(path: Column) -> Column:
    """By the ending, case-sensitive; null for other files."""
    pairs = [F.lit(x) for pair in LANGUAGES.items() for x in pair]
    return F.element_at(F.create_map(*pairs), F.regexp_extract(path, r"\.(?:rb|js|jsx|ts|tsx)$", 0))


def language_group(lang: Column) -> Column:
    return F.when(lang == "ruby", "ruby").when(lang.isNotNull(), "javascript")


def renamed(path: Column) -> Column:
    """The new name in `a/{old => new}/b` and `old => new`; other paths are unchanged."""
    braces = F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1")
    plain = F.when(braces.contains(" => "), F.element_at(F.split(braces, " => "), -1)).otherwise(braces)
    return F.regexp_replace(F.regexp_replace(plain, "/{2,}", "/"), r"^(\./)+", "")


def camelized(word: Column) -> Column:
    """Parts between underscores with the first letter upper and the others lower."""
    return F.array_join(F.transform(F.split(word, "_"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")


def singularized(word: Column) -> Column:
    pairs = [F.lit(x) for pair in IRREGULAR.items() for x in pair]
    return (
        F.when(F.lower(word).isin(list(IRREGULAR)), F.element_at(F.create_map(*pairs), F.lower(word)))
        .when(word.rlike("(ses|xes|zes|ches|shes)$"), F.regexp_replace(word, "es$", ""))
        .when(word.endswith("ies"), F.regexp_replace(word, "ies$", "y"))
        .otherwise(F.regexp_replace(word, "s$", ""))
    )


def _given(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def path_constant(path: Column) -> Column:
    """The constant that autoloading expects in a file, or null.

    Folders count from behind the first app, lib or test; app has one more level, its kinds of classes. Folders up to
    `concerns` don't count.
    """
    return _given(F.split(path, "/"), _constant_of)


def _constant_of(parts: Column) -> Column:
    roots = F.filter(F.transform(F.array(F.lit("app"), F.lit("lib"), F.lit("test")), lambda r: F.array_position(parts, r)), lambda i: i > 0)

    def below(at: Column) -> Column:
        skip = (at + F.when(F.try_element_at(parts, at.cast("int")) == "app", 1).otherwise(0)).cast("int")
        return F.when(at.isNotNull(), _given(F.slice(parts, skip + 1, F.greatest(F.size(parts) - skip, F.lit(0))), under))

    def under(rest: Column) -> Column:
        own = _given(F.array_position(rest, "concerns").cast("int"), lambda c: F.when(c > 0, F.slice(rest, c + 1, F.size(rest))).otherwise(rest))
        return _given(F.filter(own, lambda p: p != "concerns"), named)

    def named(rest: Column) -> Column:
        names = F.transform(rest, lambda p, i: camelized(F.when(i == F.size(rest) - 1, F.regexp_replace(p, r"\.rb$", "")).otherwise(p)))
        return _given(F.array_join(names, "::"), lambda constant: F.when(constant.rlike(r"^[A-Z]\w*(::[A-Z]\w*)*$"), constant))

    return _given(F.array_min(roots), below)
