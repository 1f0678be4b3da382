"""Paths as component arrays, and globs as regular expressions."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != ".") & (p != ""))


def suffixes(path: Column) -> Column:
    """Every trailing component sequence of a path, as strings, the whole path first."""
    p = parts(path)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1))), lambda i: F.array_join(F.slice(p, i, F.size(p)), "/"))


def common_suffix(a: Column, b: Column) -> Column:
    """How many trailing components two component arrays share."""
    equal = F.zip_with(F.reverse(a), F.reverse(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    state = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    step = lambda s, e: F.struct((s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n"), (s["on"] & e).alias("on"))
    return F.aggregate(equal, state, step, lambda s: s["n"])


def glob_regex(glob: str, separator: str = "/") -> str:
    """A glob as an anchored regular expression: * and ? stay in a component, ** crosses components, [..] is a class, {a,b} a choice."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + f"(?:.*{separator})?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c in "*?":
            out, i = out + f"[^{separator}]" + ("*" if c == "*" else ""), i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inside = glob[i + 1 : end]
            negated = inside[0] in "!^"
            inside = inside[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out, i = out + f"(?!{separator})[{'^' if negated else ''}{inside}]", end + 1
        elif c == "{":
            out, i, depth = out + "(?:", i + 1, depth + 1
        elif c == "}" and depth:
            out, i, depth = out + ")", i + 1, depth - 1
        elif c == "," and depth:
            out, i = out + "|", i + 1
        else:
            out, i = out + re.escape(c), i + 1
    if depth:
        raise ValueError(f"unclosed choice in glob {glob!r}")
    return f"^{out}$"
