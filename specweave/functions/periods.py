"""Requested and retained periods as two YYYYMM integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specweave import model as M


def month_of(ts: Column) -> Column:
    return (F.year(ts) * 100 + F.month(ts)).cast("int")


def parts(text: Column) -> Column:
    return F.split(F.replace(text, F.lit(" "), F.lit("")), "~")


def parse(p: Column) -> tuple[Column, Column, Column]:
    """(start, end, bad) of ``parts``: both null when not two parts, ``bad`` when a part is no integer."""
    two = F.coalesce(F.size(p) == 2, F.lit(False))
    start = F.when(two, F.get(p, F.lit(0)).try_cast("int"))
    end = F.when(two, F.get(p, F.lit(1)).try_cast("int"))
    return start, end, two & (start.isNull() | end.isNull())


def compare(rs: Column, re: Column, hs: Column, he: Column) -> dict[str, Column]:
    """Tag, deliverable period and evidence of a request against what is held."""
    lo, hi = F.greatest(rs, hs), F.least(re, he)
    no_hold = hs.isNull() | he.isNull()
    no_request = rs.isNull() | re.isNull()
    disjoint = lo > hi
    inside = (rs >= hs) & (re <= he)

    def pick(a, b, c, d, e):
        return F.when(no_hold, a).when(no_request, b).when(disjoint, c).when(inside, d).otherwise(e)

    none = F.lit(None).cast("int")
    text = F.format_string
    return {
        "tag": pick(
            F.lit("period_mismatch"), F.lit("full_period"), F.lit("period_mismatch"),
            F.lit("full_period"), F.lit("confirm_period"),
        ),
        "start": pick(none, hs, none, rs, lo),
        "end": pick(none, he, none, re, hi),
        "evidence": pick(
            F.lit(M.EV_NO_RETENTION),
            text(M.EV_NO_REQUEST, hs, he),
            text(M.EV_DISJOINT, rs, re, hs, he),
            text(M.EV_CONTAINED, hs, he),
            text(M.EV_PARTIAL, lo, hi),
        ),
    }


def render(start: Column, end: Column) -> Column:
    return F.when(start.isNotNull() & end.isNotNull(), F.concat(start.cast("string"), F.lit("~"), end.cast("string")))
