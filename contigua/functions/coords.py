"""Coordinates of matches as struct expressions: ``start`` and ``end`` (both inclusive, from 0) and the ``len`` of the whole."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contigua.functions import batches as B
from contigua.functions import sequence as S


def coord(start: Column, end: Column, length: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), length.cast("int").alias("len"))


def flip(c: Column) -> Column:
    """The same bases counted from the other end."""
    return coord(c["len"] - 1 - c["end"], c["len"] - 1 - c["start"], c["len"])


def is_left_extreme(c: Column) -> Column:
    return c["start"] == 0


def is_right_extreme(c: Column) -> Column:
    return c["end"] == c["len"] - 1


def is_full(c: Column) -> Column:
    return is_left_extreme(c) & is_right_extreme(c)


def complement(c: Column) -> Column:
    """What a match that reaches an end leaves over; of all nothing (end before start), of nothing all."""
    empty = c["end"] < c["start"]
    start = F.when(is_full(c), 0).when(empty, 0).when(is_left_extreme(c), c["end"] + 1).otherwise(0)
    end = F.when(is_full(c), -1).when(empty, c["len"] - 1).when(is_left_extreme(c), c["len"] - 1).otherwise(c["start"] - 1)
    return coord(start, end, c["len"])


def intersect(a: Column, b: Column) -> Column:
    """Half-open intervals (``start``, ``end``) that both hold; 0, 0 if none."""
    start, end = F.greatest(a["start"], b["start"]), F.least(a["end"], b["end"])
    return F.struct(F.when(end > start, start).otherwise(0).alias("start"), F.when(end > start, end).otherwise(0).alias("end"))


def translate(c: Column, first: Column, second: Column, is_rc: Column) -> Column:
    """A part ``c`` of the first sequence of a match in coordinates of the second."""
    shift = F.when(is_rc, flip(second)["start"]).otherwise(second["start"]) - first["start"]
    moved = coord(c["start"] + shift, c["end"] + shift, second["len"])
    return F.when(is_rc, flip(moved)).otherwise(moved)


def infer(xy: tuple[Column, Column, Column], xz: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """The match of y and z (their parts, and whether one is turned) from those of x with either: what both cover."""
    shared = coord(F.greatest(xy[0]["start"], xz[0]["start"]), F.least(xy[0]["end"], xz[0]["end"]), xy[0]["len"])
    return translate(shared, *xy), translate(shared, *xz), xy[2] != xz[2]


def expand(first: Column, second: Column, is_rc: Column) -> tuple[Column, Column]:
    """A match grown until one of the sequences ends on either side."""
    turned = F.when(is_rc, flip(second)).otherwise(second)
    left = F.least(first["start"], turned["start"])
    right = F.least(first["len"] - 1 - first["end"], turned["len"] - 1 - turned["end"])
    grown = coord(turned["start"] - left, turned["end"] + right, turned["len"])
    return coord(first["start"] - left, first["end"] + right, first["len"]), F.when(is_rc, flip(grown)).otherwise(grown)


def part(seq: Column, c: Column) -> Column:
    return F.substring(seq, c["start"] + 1, c["end"] - c["start"] + 1)


def differences(a: Column, b: Column, first: Column, second: Column, is_rc: Column) -> Column:
    """Differing bases of the matched parts."""
    other = part(b, second)
    return B.differing_udf(part(a, first), F.when(is_rc, S.reverse_complement(other)).otherwise(other))
