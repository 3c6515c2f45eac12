"""String expressions: trimming, lines, globs, case names."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from relaypack.functions.patterns import BLANKS, LINE_END


#: The characters of the class BLANKS, one by one.
_BLANK_CHARS = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{BLANKS}]", c))


def strip(col: Column) -> Column:
    """Without Unicode white space at both ends; looks at the ends only."""
    return F.btrim(col, F.lit(_BLANK_CHARS))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once wherever f uses it: an expression that is repeated grows the plan by as much at each step."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def is_blank(col: Column) -> Column:
    return ~col.rlike(f"[^{BLANKS}]")


def lines(col: Column) -> Column:
    """Array of lines, each with its own line end."""
    return F.filter(F.split(col, f"(?<=\r\n)|(?<=[\n\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029])|(?<=\r)(?!\n)"), lambda x: x != "")


def bare_lines(col: Column) -> Column:
    return F.transform(lines(col), lambda x: F.regexp_replace(x, f"(?:{LINE_END})$", ""))


def normal_key(col: Column) -> Column:
    """Lower-cased, runs of other characters than a-z and 0-9 become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def glob_regex(glob: str) -> str:
    """A case-sensitive shell glob (``*``, ``?``, ``[seq]``, ``[!seq]``) as an anchored pattern for both Java and RE2."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2 if glob[i + 1 : i + 2] != "!" else i + 3) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = glob[i + 1 : end]
            negated, body = body[:1] == "!", body.removeprefix("!")
            out.append("[" + "^" * negated + re.sub(r"([\\\[\]^&])", r"\\\1", body) + "]")
            i = end
        else:
            out.append(re.escape(c) if not c.isalnum() else c)
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def snake_code(col: Column) -> Column:
    """Name of an exception class -> its failure code."""
    return F.regexp_replace(F.lower(F.regexp_replace(col, "(?<!^)(?=[A-Z])", "_")), "_error$", "")
