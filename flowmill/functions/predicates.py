"""Flow predicates as Columns. They are true or false, never null: an absent element fails every
comparison but "not equal", so NOT, AND, OR and XOR of them follow two-valued logic. Absence is tested
beside the comparison, not put around it, so that both reach the scan."""

from __future__ import annotations

import ipaddress
import operator
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowmill.sources.flows import GROUPS, element

SUFFIXES = {"k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12}
FLAGS = {"F": 1, "S": 2, "R": 4, "P": 8, "A": 16, "U": 32}
_OPS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


def number(value: str | int | float) -> int | float:
    """1.5k -> 1500, in decimal; hexadecimal with 0x; a C suffix (u, l) means nothing; anything else as it is."""
    if not isinstance(value, str):
        return value
    low = value.strip().lower()
    if low.startswith("0x"):
        return int(low, 16)
    low = low.rstrip("ul") or low
    scale = SUFFIXES.get(low[-1], 1)
    out = Decimal(low[:-1] if scale > 1 else low) * scale
    return int(out) if out == int(out) else float(out)


def _members(name: str) -> tuple[str, ...]:
    return GROUPS.get(name.removeprefix("%"), (element(name),))


def compare(name: str, op: str, value: str | int | float | Column) -> Column:
    """A comparison; over a group of elements any member may meet it, for != all must."""
    value = value if isinstance(value, Column) else F.lit(number(value))
    met = (lambda c: c.isNull() | value.isNull() | (c != value)) if op == "!=" else (lambda c: c.isNotNull() & value.isNotNull() & _OPS[op](c, value))
    each = [met(F.col(m)) for m in _members(name)]
    return reduce(operator.and_ if op == "!=" else operator.or_, each)


def exists(name: str) -> Column:
    return reduce(operator.or_, [F.col(m).isNotNull() for m in _members(name)])


def one_of(name: str, values: list) -> Column:
    return reduce(operator.or_, [F.col(m).isNotNull() & F.col(m).isin(*map(number, values)) for m in _members(name)])


def in_network(name: str, network: str) -> Column:
    """CIDR as a range of numbers (IPv4) or of 16-byte strings (IPv6), which Parquet statistics can prune."""
    net = ipaddress.ip_network(network, strict=False)
    low, high = (int(net[0]), int(net[-1])) if net.version == 4 else (bytearray(net[0].packed), bytearray(net[-1].packed))
    return reduce(operator.or_, [F.col(m).isNotNull() & F.col(m).between(F.lit(low), F.lit(high)) for m in _members(name)])


def any_flags(letters: str, name: str = "flg") -> Column:
    mask = sum(FLAGS[c] for c in letters)
    return F.col(element(name)).isNotNull() & (F.col(element(name)).bitwiseAND(mask) > 0)


def all_flags(letters: str, name: str = "flg") -> Column:
    mask = sum(FLAGS[c] for c in letters)
    return F.col(element(name)).isNotNull() & (F.col(element(name)).bitwiseAND(mask) == mask)


def text(column: str, how: str, value: str) -> Column:
    """how: contains, is, starts, ends, matches (regular expression), or not."""
    c = F.col(element(column))
    got = {"contains": c.contains(value), "is": c == value, "starts": c.startswith(value), "ends": c.endswith(value), "matches": c.rlike(value), "not": c != value}[how]
    return c.isNull() | got if how == "not" else c.isNotNull() & got


def either(a: Column, b: Column) -> Column:
    """Exclusive or."""
    return a != b


def within(start_ms: int, end_ms: int | None = None) -> Column:
    """Flows that begin from start on and end by end."""
    got = compare("ts", ">=", start_ms)
    return got if end_ms is None else got & compare("te", "<=", end_ms)
