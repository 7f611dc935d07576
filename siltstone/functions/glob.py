"""Globs with ``**`` as regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class BadGlob(ValueError):
    pass


def to_regex(glob: str) -> str:
    """Java and Python regular expression of a glob over slash-separated paths.

    ``*`` and ``?`` stay within a segment, ``**`` as a whole segment spans any number of them (none included), ``[a-z]``,
    ``[!a]`` and ``[^a]`` are classes, ``{a,b}`` alternatives (nested ones too), a backslash quotes.
    """
    out, i, depth, n = [], 0, 0, len(glob)
    while i < n:
        c = glob[i]
        starts = i == 0 or glob[i - 1] in "/{,"
        if c == "*" and glob.startswith("**", i):
            ends = i + 2 == n or glob[i + 2] in "/},"
            if starts and ends:
                if i + 2 < n and glob[i + 2] == "/":
                    out.append("(?:[^/]+/)*")
                    i += 3
                else:
                    if out and out[-1] == "/":
                        out[-1] = "(?:/.*)?"
                    else:
                        out.append(".*")
                    i += 2
                continue
            out.append("[^/]*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise BadGlob(glob)
            body = glob[i + 1 : end]
            negated = body[0] in "!^"
            inner = re.sub(r"([\\\[\]&~])", r"\\\1", body[1:] if negated else body)
            if not inner:
                raise BadGlob(glob)
            out.append(f"[^/{inner}]" if negated else f"[{inner}]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\":
            if i + 1 == n:
                raise BadGlob(glob)
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(c if c == "/" else re.escape(c))
        i += 1
    if depth:
        raise BadGlob(glob)
    return "".join(out)


def compile_excludes(globs: list[str]) -> str | None:
    """One regular expression for lower-cased paths that any glob matches; a bad glob matches nothing."""
    parts = []
    for g in globs:
        try:
            parts.append(to_regex(g.lower()))
        except BadGlob:
            continue
    return f"^(?:{'|'.join(parts)})$" if parts else None


def excluded(rel_path: Column, globs: list[str]) -> Column:
    """Whether a file is excluded: it or any folder above it (as ``a`` or ``a/``) matches a glob, in any letter case."""
    rx = compile_excludes(globs)
    if rx is None:
        return F.lit(False)
    low = F.lower(rel_path)
    parts = F.split(low, "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    above = F.exists(folders, lambda p: p.rlike(rx) | F.concat(p, F.lit("/")).rlike(rx))
    return low.rlike(rx) | ((F.size(parts) > 1) & above)
