"""Names, patterns and paths as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_pattern(pattern: str) -> str:
    """A search pattern for ilike: ``*`` is any text; without one, a substring is meant."""
    return pattern.replace("*", "%") if "*" in pattern else f"%{pattern}%"


def escaped_like(pattern: str) -> str:
    """A pattern for LIKE with escape ``!``: ``*`` is any text, all else stands for itself."""
    return re.sub(r"[%_!]", r"!\g<0>", pattern).replace("*", "%")


def path_glob(pattern: str) -> str:
    """A regular expression for a path glob: ``**`` crosses folders, ``*`` and ``?`` don't."""
    out = []
    for part in re.findall(r"\*\*/?|\*|\?|[^*?]+", pattern):
        out.append({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part))
    return "^" + "".join(out) + "$"


def package_glob(pattern: str) -> str:
    """A regular expression for a package boundary: ``..`` is any sub-package or none, ``*`` any text."""
    out = []
    for part in re.findall(r"\.\.|\*|[^.*]+|\.", pattern):
        out.append({"..": r"(?:\..*)?", "*": ".*"}.get(part) or re.escape(part))
    return "^" + "".join(out) + "$"


def property_pattern(pattern: str) -> str:
    """A case-insensitive regular expression in which only ``*`` is special."""
    return "(?i)" + ".*".join(re.escape(p) for p in pattern.split("*"))


def outer_name(name: Column) -> Column:
    """A class name without nested parts."""
    return F.substring_index(name, "$", 1)


def package_name(name: Column, default: str = "<default>") -> Column:
    """The package of a class name: before the last dot of its outermost class."""
    outer = outer_name(name)
    return F.when(F.instr(outer, ".") > 0, F.regexp_replace(outer, r"\.[^.]*$", "")).otherwise(default)


def simple_name(name: Column) -> Column:
    """The part of a class name after its last dot."""
    return F.substring_index(name, ".", -1)


def base_name(path: Column) -> Column:
    """The last part of a path."""
    return F.substring_index(path, "/", -1)


def is_main() -> Column:
    """Whether a member is a program's entry: public static void main(String[])."""
    return (F.col("kind") == "METHOD") & (F.col("name") == "main") & (F.col("descriptor") == "([Ljava/lang/String;)V") & has_modifier(F.col("modifiers"), "public") & has_modifier(F.col("modifiers"), "static")


def has_modifier(modifiers: Column, flag: str) -> Column:
    """Whether a space-separated list of modifiers has this one."""
    return F.array_contains(F.split(modifiers, r"\s+"), flag)


def library_of(name: Column) -> Column:
    """The first two parts of a dotted name; of a name with one dot the first; else empty."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) >= 3, F.concat_ws(".", parts[0], parts[1])).when(F.size(parts) == 2, parts[0]).otherwise("")
