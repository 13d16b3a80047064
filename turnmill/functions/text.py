"""String expressions shared by the normalisers and renderers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.strip`` removes.
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Whitespace trim on both ends; newlines and Unicode spaces included."""
    return F.btrim(col(c), F.lit(STRIP_CHARS))


def after_first(c: Column | str, mark: str) -> Column:
    """Text behind the first ``mark``; empty where the mark is missing."""
    c = col(c)
    at = F.instr(c, mark)
    return F.when(at > 0, F.substring(c, at + len(mark), F.length(c))).otherwise(F.lit(""))


def fill(template: str, **slots: Column | str) -> Column:
    """Fill ``{name}`` slots by concatenation.

    The template is cut at its slots once, when the plan is built, so slot text that itself
    contains ``{input}`` or ``{round}`` is never filled again.
    """
    parts: list[Column] = []
    rest = template
    while rest:
        hits = [(rest.index("{%s}" % n), n) for n in slots if "{%s}" % n in rest]
        if not hits:
            parts.append(F.lit(rest))
            break
        at, name = min(hits)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(col(slots[name]).cast("string"))
        rest = rest[at + len(name) + 2:]
    return F.concat(*parts) if parts else F.lit("")


def blank_if_null(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))
