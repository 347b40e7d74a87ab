"""Column expressions on cuts (arrays of edge ids), lines, labels and small graphs. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ids(line: Column) -> Column:
    """'3, 1' -> [3, 1]; a blank line is the empty cut; text that is no number raises under ANSI."""
    return F.when(F.trim(line) == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(line, ","), lambda x: F.trim(x).cast("int")))


def as_set(edges: Column) -> Column:
    """A cut as a set: sorted, without repeated ids."""
    return F.array_sort(F.array_distinct(edges))


def as_bag(edges: Column) -> Column:
    """A cut as a sorted bag: repeated ids stay."""
    return F.array_sort(edges)


def as_line(edges: Column, sep: str = ",") -> Column:
    return F.array_join(F.transform(edges, lambda x: x.cast("string")), sep)


def line_size(line: Column) -> Column:
    """Number of comma-separated fields, commas in (non-nested) parentheses apart."""
    return F.size(F.split(F.regexp_replace(line, r"\([^)]*\)", ""), ",", -1))


def opposite(src: Column, dst: Column, node: Column) -> Column:
    return F.when(src == node, dst).otherwise(src)


def round_half_up(value: Column, digits: int) -> Column:
    """Half-up for positive input, as decimal text is rounded."""
    return F.round(value, digits)


def general(value: Column) -> Column:
    """A double as %g writes it: six significant digits without trailing zeros, with an exponent below 1e-4 and from 1e6 on.

    A value whose shortest decimal text lies halfway between two results is rounded up.
    """
    short = lambda text: F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    coded = F.format_string("%.5e", F.abs(value))  # d.ddddde+dd
    power = F.substring_index(coded, "e", -1).cast("int")
    digits = F.replace(F.substring_index(coded, "e", 1), F.lit("."), F.lit(""))
    fixed = F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)).otherwise(
        F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2, F.lit(6)))
    )
    wide = F.concat(short(F.substring_index(coded, "e", 1)), F.lit("e"), F.substring_index(coded, "e", -1))
    text = F.when(value == 0, "0").when((power < -4) | (power >= 6), wide).otherwise(short(fixed))
    return F.concat(F.when(value < 0, "-").otherwise(""), text)


def base_name(path: Column, suffix: str = ".csv") -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), rf"\Q{suffix}\E$", "")


def colour_name(code: Column) -> Column:
    return F.when(code == 0, "black").when(code == 1, "red").when(code == 2, "blue").otherwise("unknown")


def xor_reduced(basis: Column, label: Column) -> Column:
    """A non-negative label reduced by a basis whose members were reduced when they came in."""
    return F.aggregate(basis, label, lambda a, b: F.least(a, a.bitwiseXOR(b)))


def gf2_rank(labels: Column) -> Column:
    """Rank over GF(2) of an array of non-negative longs."""

    def add(basis: Column, x: Column) -> Column:
        y = xor_reduced(basis, x)
        return F.when(y == 0, basis).otherwise(F.concat(basis, F.array(y)))

    return F.size(F.aggregate(labels, F.array().cast("array<bigint>"), add))


def has_coloop(labels: Column) -> Column:
    """Whether some label lies in no XOR dependency of the array: its removal lowers the rank."""
    rank = gf2_rank(labels)
    places = F.sequence(F.lit(1), F.size(labels))
    without = lambda i: F.filter(F.transform(labels, lambda x, j: F.struct((j + 1).alias("j"), x.alias("x"))), lambda s: s["j"] != i)
    return F.when(F.size(labels) == 0, F.lit(False)).otherwise(F.exists(places, lambda i: gf2_rank(F.transform(without(i), lambda s: s["x"])) < rank))
