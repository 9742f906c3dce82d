"""Scalar expressions: fixed-point rounding, times, merchant codes, routing tags, distances, bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import DIMENSIONS, MCC_RISK, SCALE


def unit_fixed(x: Column) -> Column:
    """Clamp to [0, 1], scale, round half up: how queries are quantised."""
    return F.floor(F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0)) * float(SCALE) + 0.5).cast("int")


def quantize(x: Column) -> Column:
    """Through single precision, scale, round half even, saturate to 16 bits: how the corpus is quantised."""
    return F.least(F.greatest(F.rint(x.cast("float") * F.lit(float(SCALE))), F.lit(-32768.0)), F.lit(32767.0)).cast("int")


def quantize_vector(v: Column) -> Column:
    return F.transform(v, quantize)


def iso_epoch(s: Column) -> Column:
    """Seconds since 1970 of an ISO 8601 text; 0 if it has another shape. Fractions are dropped, offsets applied."""
    shaped = s.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d")
    return F.coalesce(F.when(shaped, F.unix_timestamp(F.try_to_timestamp(s))), F.lit(0)).cast("long")


def hour_utc(seconds: Column) -> Column:
    return F.floor(F.pmod(seconds, F.lit(86400)) / 3600).cast("int")


def weekday_utc(seconds: Column) -> Column:
    """Monday 0 to Sunday 6."""
    return F.pmod(F.floor(seconds / 86400) + 3, F.lit(7)).cast("int")


def mcc_normal(mcc: Column) -> Column:
    """Four characters, zeros to the right."""
    return F.rpad(F.substring(F.coalesce(mcc, F.lit("")), 1, 4), 4, "0")


def mcc_risk(mcc: Column, table: dict[str, float] | None = None) -> Column:
    """Fixed-point risk of a code by a literal map; 5000 for codes that it has not."""
    pairs = [F.lit(x) for code, risk in (table or MCC_RISK).items() for x in (code, int(risk * SCALE + 0.5))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), mcc_normal(mcc)), F.lit(SCALE // 2)).cast("int")


def merchant_known(known: Column, merchant: Column) -> Column:
    """Membership; an empty id, or one of 256 bytes or more, is unknown."""
    fits = F.octet_length(merchant).between(1, 255)
    return F.coalesce(F.array_contains(known, merchant), F.lit(False)) & F.coalesce(fits, F.lit(False))


def tag(has_last: Column, unknown: Column, online: Column, card: Column) -> Column:
    """Routing tag: four bits."""
    return (has_last.cast("int") + unknown.cast("int") * 2 + online.cast("int") * 4 + card.cast("int") * 8).cast("int")


def reference_tag(v: Column) -> Column:
    """The tag of a corpus vector, from its raw values."""
    at = [F.get(v, i).cast("float") for i in range(DIMENSIONS)]
    return tag(at[5] >= 0, at[11] > 0.5, at[9] > 0.5, at[10] > 0.5)


def short_tag(full: Column) -> Column:
    """The older tag of two bits."""
    return full.bitwiseAND(3)


def squared_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Unrolled, so that it stays in generated code; bigint, so that it cannot overflow."""
    terms = [(x - y).cast("long") * (x - y).cast("long") for x, y in zip(a, b)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def manhattan_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    terms = [F.abs(x - y).cast("long") for x, y in zip(a, b)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def cosine_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """1 - cosine; 1 where either vector is zero."""
    dot = sum((x.cast("double") * y for x, y in zip(a, b)), F.lit(0.0))
    norm = lambda v: F.sqrt(sum((x.cast("double") * x for x in v), F.lit(0.0)))
    return F.coalesce(1.0 - F.try_divide(dot, norm(a) * norm(b)), F.lit(1.0))


METRICS = {"euclidean": squared_distance, "manhattan": manhattan_distance, "cosine": cosine_distance}


def box_bound(q: Sequence[Column], low: Sequence[Column], high: Sequence[Column]) -> Column:
    """Squared distance from a point to a box: no member of the box is nearer."""
    outside = [F.greatest(lo - x, x - hi, F.lit(0)).cast("long") for x, lo, hi in zip(q, low, high)]
    total = outside[0] * outside[0]
    for o in outside[1:]:
        total = total + o * o
    return total


def dims(v: str, n: int = DIMENSIONS) -> list[Column]:
    return [F.get(F.col(v), i) for i in range(n)]


def approved(frauds: Column, deny_from: int) -> Column:
    return frauds < deny_from


def fraud_score(frauds: Column, k: int) -> Column:
    return F.least(frauds, F.lit(k)) / F.lit(float(k))


def content_length(header: Column) -> Column:
    """The number after Content-Length, in any case; -1 without one, 0 if no digits follow."""
    found = F.regexp_extract(header, r"(?i)content-length:[ \t]*([0-9]*)", 1)
    there = header.rlike(r"(?i)content-length:")
    return F.when(~there, F.lit(-1)).when(found == "", F.lit(0)).otherwise(F.try_to_number(found, F.lit("9999999999")).cast("long"))
