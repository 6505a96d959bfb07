"""AS-path expressions.

Two tokenisations exist on purpose. Counting ASNs and finding the origin split
on runs of whitespace; finding transit ASes splits on every single space, so a
doubled space yields an empty hop. Hops stay text: an AS set such as
``{65001,65002}`` is one hop.

No expression here uses a lambda, because higher-order functions take their
operator out of whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the placeholder ASN that old speakers show for a 32-bit ASN.
AS_TRANS = "23456"

# One hop followed by more copies of itself. Possessive, so a path with
# thousands of copies neither backtracks nor deepens the stack.
_PREPENDING = r"(?<![^ ])([^ ]*+)(?: \1(?![^ ]))++"


def _has_other_blanks(path: Column) -> Column:
    """True if some whitespace is not a plain space.

    Working on plain spaces is far cheaper than splitting on a pattern, so the
    pattern is kept for the paths that need it.
    """
    return path.rlike(r"[\t\n\x0B\f\r]")


def tokens(path: Column) -> Column:
    """Whitespace-separated tokens; an empty or blank path has none."""
    pieces = F.when(_has_other_blanks(path), F.split(path, r"\s+")).otherwise(F.split(path, " "))
    return F.array_remove(pieces, "")


def origin(path: Column) -> Column:
    """Last token, or the empty string if the path is missing or blank."""
    pieces = F.array_remove(F.split(path, r"\s+"), "")
    last = F.when(_has_other_blanks(path), F.try_element_at(pieces, F.lit(-1)))
    last = last.otherwise(F.substring_index(F.rtrim(path), " ", -1))
    return F.coalesce(last, F.lit(""))


def is_valid_origin(asn: Column) -> Column:
    """False for no origin, AS_TRANS and AS sets."""
    return (asn != "") & (asn != AS_TRANS) & ~asn.contains("{")


def squash(path: Column) -> Column:
    """Path text with prepending removed: adjacent equal hops become one."""
    return F.regexp_replace(path, _PREPENDING, "$1")


def hops(path: Column) -> Column:
    """Hops split on every single space, prepending removed."""
    return F.split(squash(path), " ")


def interior(squashed: Column) -> Column:
    """The transit hops of a path: without its first and last, so none if it has fewer than 3."""
    return F.slice(squashed, 2, F.greatest(F.size(squashed) - 2, F.lit(0)))
