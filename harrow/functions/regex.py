"""Python regular expressions as Column predicates on the JVM.

Python's character classes are Unicode and its line terminator is the line feed alone; Java needs flags U and d for that.
A pattern is tried only on texts that hold what any match of it holds: looking for a plain text is much cheaper.
"""

from __future__ import annotations

import functools
import re
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F


def java(pattern: str, flags: str = "") -> str:
    """The Java form of a Python pattern; flags are of i (ignore case), s (dot matches all), m (multi-line)."""
    return f"(?Ud{flags.replace('i', 'iu')}){pattern}"


@functools.lru_cache(1 << 10)
def held(pattern: str, flags: str = "") -> tuple[str, bool]:
    """The longest text that every match holds, empty if none is certain, and whether it is so in lower case only."""
    try:
        tree = parser.parse(pattern.replace(r"\x{2019}", "\u2019"), re.I if "i" in flags else 0)
    except re.error:  # a pattern in Java's own syntax
        return "", False
    runs = [""]

    def walk(items) -> None:
        for what, value in items:
            if what is op.LITERAL:
                runs[-1] += chr(value)
            elif what is op.SUBPATTERN and not value[1] and not value[2]:
                walk(value[3])
            elif what in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
                runs.append("")
                walk(value[2])
                runs.append("")
            elif what is not op.AT:
                runs.append("")

    walk(tree)
    folded, longest = bool(tree.state.flags & re.I), max(runs, key=len)
    return (longest.lower() if folded else longest), folded


#: Letters that match s, i or k without regard to case but aren't lowered to them.
ODD = "[\u017f\u0131\u0130\u212a]"


def folded(text: Column) -> Column:
    """struct<text, low, odd> for has: the text, in lower case, and whether it holds letters that lower case doesn't tell."""
    return F.struct(text.alias("text"), F.lower(text).alias("low"), text.rlike(ODD).alias("odd"))


def has(text: Column, pattern: str, flags: str = "", by: Column | None = None) -> Column:
    """Whether the pattern is found anywhere in text; false where text is null. by is folded(text), for patterns that
    ignore case."""
    found, (must, low) = text.rlike(java(pattern, flags)), held(pattern, flags)
    if must and not low:
        found = F.contains(text, F.lit(must)) & found
    elif must and by is not None:
        found = (by["odd"] | F.contains(by["low"], F.lit(must))) & found
    return F.coalesce(found, F.lit(False))


def has_any(text: Column, patterns, flags: str = "") -> Column:
    """Whether one of the patterns is found: one pass over the texts that hold what one of them must."""
    found = text.rlike(java("|".join(f"(?:{p})" for p in patterns), flags))
    needed = [held(p, flags) for p in patterns]
    if all(must and not low for must, low in needed):
        found = functools.reduce(lambda a, b: a | b, (F.contains(text, F.lit(must)) for must in dict.fromkeys(m for m, _ in needed))) & found
    return F.coalesce(found, F.lit(False))


def grab(text: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    """A group of the first match; null without a match."""
    return F.when(has(text, pattern, flags), F.regexp_extract(text, java(pattern, flags), group))


def first_label(text: Column, labelled, flags: str = "") -> Column:
    """The label of the first of (pattern, label) pairs that is found; null if none is."""
    return F.coalesce(*[F.when(has(text, p, flags), F.lit(label)) for p, label in labelled])


def strip(text: Column) -> Column:
    """Without white space at either end, in Python's sense."""
    return F.regexp_replace(text, java(r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"), "")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda variable stands for it, so the plan doesn't repeat it."""
    return F.element_at(F.transform(F.array(value), body), 1)
