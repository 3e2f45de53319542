"""Filters in Spark SQL: %name stands for an element, and temporary SQL functions read networks, flags and names.

All functions are two-valued: an absent element is in no network and has no flags, so NOT of them is true.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.functions.scalars import PROTOCOLS
from flowmill.sources.flows import element

# Ports by service name.
PORTS = {"tcpmux": 1, "echo": 7, "discard": 9, "systat": 11, "daytime": 13, "msp": 18, "ftp-data": 20, "ftp": 21, "ssh": 22, "telnet": 23, "smtp": 25, "time": 37, "rap": 38, "rlp": 39, "graphics": 41, "name": 42, "nameserver": 42, "nicname": 43, "http": 80, "https": 443}


def map_sql(table: dict[str, int]) -> str:
    return "map(" + ", ".join(f"'{k.lower()}', {v}" for k, v in table.items()) + ")"


def ip4_sql(text: str) -> str:
    return "(" + " + ".join(f"bigint(split_part({text}, '.', {k + 1})) * {256 ** (3 - k)}L" for k in range(4)) + ")"


# Nothing here needs a lambda, so calls of literals are folded to a number, and the comparison reaches the scan.
FUNCTIONS = {
    "ip4(t STRING) RETURNS BIGINT": ip4_sql("t"),
    "num(t STRING) RETURNS BIGINT": """CASE WHEN lower(t) LIKE '0x%' THEN bigint(conv(substr(t, 3), 16, 10))
      ELSE bigint(CAST(regexp_replace(lower(t), '[kmgtul]+$', '') AS DECIMAL(18, 6)) * element_at(map('', 1L, 'k', 1000L, 'm', 1000000L, 'g', 1000000000L, 't', 1000000000000L), regexp_extract(lower(t), '([kmgt]?)[ul]*$', 1))) END""",
    "in_net(a BIGINT, net STRING) RETURNS BOOLEAN": f"""a IS NOT NULL
      AND a >= shiftleft(shiftright({ip4_sql("split_part(net, '/', 1)")}, 32 - int(split_part(net, '/', 2))), 32 - int(split_part(net, '/', 2)))
      AND a < shiftleft(1 + shiftright({ip4_sql("split_part(net, '/', 1)")}, 32 - int(split_part(net, '/', 2))), 32 - int(split_part(net, '/', 2)))""",
    "in_net6(a BINARY, net STRING) RETURNS BOOLEAN": "a IS NOT NULL AND startswith(lower(hex(a)), net)",
    "flag_bits(letters STRING) RETURNS INT": "aggregate(transform(split(upper(letters), ''), x -> element_at(map('F', 1, 'S', 2, 'R', 4, 'P', 8, 'A', 16, 'U', 32, 'E', 64, 'C', 128, 'N', 256, 'X', 511, '', 0), x)), 0, (a, x) -> a | x)",
    "all_flags(f INT, bits INT) RETURNS BOOLEAN": "f IS NOT NULL AND f & bits = bits",
    "any_flags(f INT, bits INT) RETURNS BOOLEAN": "f IS NOT NULL AND f & bits > 0",
    "proto(name STRING) RETURNS INT": f"element_at({map_sql({v: k for k, v in PROTOCOLS.items()})}, lower(name))",
    "port(name STRING) RETURNS INT": f"element_at({map_sql(PORTS)}, lower(name))",
    "millis(t STRING) RETURNS BIGINT": "unix_millis(to_timestamp(t, 'yyyy/MM/dd.HH:mm:ss'))",
}


def register(spark: SparkSession) -> None:
    """Make FUNCTIONS known to the session, as SQL that Catalyst takes into the plan of a query."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def columns_of(condition: str) -> str:
    """The condition with physical names; aggregates have no place before the aggregation."""
    if re.search(r"%(fl|flows)\b", condition):
        raise ValueError("%fl counts flows: it is known after aggregation, as a condition of the groups")
    return re.sub(r"'[^']*'|%([A-Za-z]\w*)", lambda m: f"`{element(m[1])}`" if m[1] else m[0], condition)


def where(flows: DataFrame, condition: str) -> DataFrame:
    """The flows that meet a condition, as (num() is of whole numbers): %byt > num('1.5k') AND in_net(%srcip4, '10.0.0.0/8') OR %dp IN (80, port('https'))."""
    register(flows.sparkSession)
    return flows.filter(F.expr(columns_of(condition)))


def where_file(flows: DataFrame, path: str) -> DataFrame:
    """where() with the condition that a file has."""
    return where(flows, flows.sparkSession.read.text(path, wholetext=True).first()[0])


def problem(flows: DataFrame, condition: str) -> str | None:
    """What is wrong with a condition: its analysis only, nothing runs; None if it can be used."""
    try:
        where(flows, condition).schema  # noqa: B018
    except Exception as e:  # of the analyser or ours
        return str(e).splitlines()[0]
    return None
