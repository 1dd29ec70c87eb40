"""Column functions on sequences over ACGU and on the positions of interaction states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The pairs that two strands can form, as "first letter, second letter".
PAIRS = ("AU", "CG", "GC", "GU", "UA", "UG")


def normalize(s: Column) -> Column:
    """ASCII letters in upper case, T as U; other characters stay."""
    return F.translate(s, "abcdefghijklmnopqrstuvwxyzT", "ABCDEFGHIJKLMNOPQRSUUVWXYZU")


def complement(s: Column) -> Column:
    """Each base's partner; other characters stay."""
    return F.translate(s, "ACGTU", "UGCAA")


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def is_sequence(s: Column) -> Column:
    """Only letters of ACGU in either case, one at least; null is no sequence."""
    return F.coalesce(s.rlike("^[ACGUacgu]+$"), F.lit(False))


def can_pair(a: Column, b: Column) -> Column:
    return F.concat(a, b).isin(*PAIRS)


def reorient(i1: Column, i2: Column, j1: Column, j2: Column, length_b: Column) -> tuple[Column, Column, Column, Column]:
    """The same site with the second strand counted from its other end."""
    return i1, length_b - j2 + 1, j1, length_b - i2 + 1


def symmetric(i1: Column, i2: Column, j1: Column, j2: Column, n: Column) -> tuple[Column, Column, Column, Column]:
    """The site with the two strands of a homodimer of length ``n`` exchanged."""
    return n - j2 + 1, n - j1 + 1, n - i2 + 1, n - i1 + 1


def state_text(sites: Column) -> Column:
    """{(i1,i2)-(j1,j2),...}; the open state is {}."""
    one = F.transform(sites, lambda s: F.format_string("(%d,%d)-(%d,%d)", s["i1"], s["i2"], s["j1"], s["j2"]))
    return F.concat(F.lit("{"), F.array_join(one, ","), F.lit("}"))


def dot_bracket(length_a: Column, length_b: Column, i1: Column, i2: Column, j1: Column, j2: Column) -> Column:
    """Brackets at the ends of the site on both strands, dots elsewhere, "&" between the strands."""

    def strand(n: Column, i: Column, j: Column, mark: str) -> Column:
        dots = F.repeat(F.lit("."), n)
        once = F.overlay(dots, F.lit(mark), i)
        return F.overlay(once, F.lit(mark), j)

    return F.concat(strand(length_a, i1, j1, "("), F.lit("&"), strand(length_b, i2, j2, ")"))


def encode_site(i1: Column, i2: Column, j1: Column, j2: Column) -> Column:
    """Four positions of 16 bits in one long; positions over 32767 on the first strand give a negative code."""
    part = lambda c, n: F.shiftleft(c.cast("long"), n)
    return part(i1, 48).bitwiseOR(part(i2, 32)).bitwiseOR(part(j1, 16)).bitwiseOR(j2.cast("long"))


def decode_site(code: Column) -> tuple[Column, ...]:
    return tuple(F.shiftrightunsigned(code, n).bitwiseAND(F.lit(0xFFFF)).cast("int") for n in (48, 32, 16, 0))
