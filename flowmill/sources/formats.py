"""Lines of text by format strings: %name is an element or a figure made of some, anything else stands as it is."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.functions import scalars as S
from flowmill.sources.flows import element

# The named formats.
FORMATS = {
    "pipe": "%ts|%td|%pr|%sa4|%sp|%da4|%dp|%pkt|%byt|%fl",
    "csv": "%ts,%td,%pr,%sa4,%sp,%da4,%dp,%pkt,%byt,%fl",
    "line": "%ts %td %pr %sa4:%sp -> %da4:%dp %sa6:%sp -> %da6:%dp %pkt %byt %fl",
    "line4": "%ts %td %pr %sa4:%sp -> %da4:%dp %pkt %byt %fl",
    "long4": "%ts %td %pr %sa4:%sp -> %da4:%dp %flg %tos %pkt %byt %fl",
    "extended4": "%ts %td %pr %sa4:%sp -> %da4:%dp %flg %tos %pkt %byt %bps %pps %bpp %fl",
    "line6": "%ts %td %pr %sa6:%sp -> %da6:%dp %pkt %byt %fl",
    "long6": "%ts %td %pr %sa6:%sp -> %da6:%dp %flg %tos %pkt %byt %fl",
    "extended6": "%ts %td %pr %sa6:%sp -> %da6:%dp %flg %tos %pkt %byt %bps %pps %bpp %fl",
}
FIGURES = {"td": S.duration, "bps": S.bits_per_second, "pps": S.packets_per_second, "bpp": S.bytes_per_packet}
SHOWN = {"ts": S.timestamp_text, "te": S.timestamp_text, "td": S.seconds_text, "pr": lambda c: S.named(c, S.PROTOCOLS), "flg": S.flags_text} | {n: S.ipv4_text for n in ("sa4", "da4")} | {n: S.ipv6_compact for n in ("sa6", "da6")}
SAME = {"srcip4": "sa4", "dstip4": "da4", "srcip6": "sa6", "dstip6": "da6", "srcport": "sp", "dstport": "dp", "proto": "pr", "srcas": "sas", "dstas": "das", "flows": "fl"}
ABSENT = {"flg": "......", "sp": "0", "dp": "0", "tos": "0", "sas": "0", "das": "0"}


def parts(form: str) -> list[str]:
    """The names, with their %, and the text between; form: a named format, or fmt: and a string."""
    form = FORMATS.get(form, form).removeprefix("fmt:")
    return re.findall(r"%[A-Za-z0-9]+|[^%]+|%", form)


def figure(flows: DataFrame, name: str) -> Column | None:
    """The column that a name asks for: an element, a figure, the count of flows (1 before aggregation); None if unknown."""
    if name in FIGURES:
        return FIGURES[name]()
    if name == "fl":
        return F.col("flows") if "flows" in flows.columns else F.lit(1)
    return F.col(element(name)) if element(name) in flows.columns else None


def projected(flows: DataFrame, form: str) -> DataFrame:
    """A column for each known name of the format, once, as it is; names that flows don't have are passed over."""
    names = dict.fromkeys(SAME.get(p[1:], p[1:]) for p in parts(form) if len(p) > 1 and p[0] == "%")
    return flows.select(*(c.alias(n) for n in names if (c := figure(flows, n)) is not None))


def lines(flows: DataFrame, form: str) -> DataFrame:
    """A line of each flow; absent elements, and those that flows don't have, by their default text."""
    out = []
    for p in parts(form):
        name = SAME.get(p[1:], p[1:])
        if len(p) < 2 or p[0] != "%":
            out.append(F.lit(p))
            continue
        c = figure(flows, name)
        shown = F.lit(None) if c is None else SHOWN.get(name, lambda c: c.cast("string"))(c)
        out.append(F.coalesce(shown, F.lit(ABSENT.get(name, "NULL"))))
    return flows.select(F.concat(*out).alias("line"))


def table(flows: DataFrame, form: str, most: int = 1000) -> str:
    """The first `most` rows as text in columns, under their names, with a last line of how many rows there are."""
    rows = projected(flows, form)
    shown = rows.select(*(F.coalesce(SHOWN.get(n, lambda c: c.cast("string"))(F.col(f"`{n}`")), F.lit(ABSENT.get(n, "NULL"))).alias(n) for n in rows.columns)).limit(most).collect()
    cells = [rows.columns, *(list(r) for r in shown)]
    wide = [max(len(str(c[k])) for c in cells) for k in range(len(rows.columns))]
    return "\n".join(["  ".join(str(x).rjust(w) for x, w in zip(c, wide, strict=True)) for c in cells] + [f"{rows.count()} rows"])
