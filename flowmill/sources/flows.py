"""Flow records as DataFrames: one wide nullable row a flow; null means that its template lacks the element."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: element -> aliases; the physical names e<enterprise>id<element> stay the columns' names
ALIASES = {
    "e0id152": "ts", "e0id153": "te", "e0id1": "byt", "e0id2": "pkt", "e0id4": "pr proto", "e0id8": "sa4 srcip4", "e0id12": "da4 dstip4",
    "e0id27": "sa6 srcip6", "e0id28": "da6 dstip6", "e0id7": "sp srcport", "e0id11": "dp dstport", "e0id6": "flg", "e0id5": "tos",
    "e0id10": "in", "e0id14": "out", "e0id16": "sas", "e0id17": "das", "e0id32": "icmptype", "e0id56": "smac", "e0id80": "dmac",
    "e0id60": "ipv", "e16982id501": "httph", "e0id192": "ttl", "e0id403": "eip4", "e0id404": "eip6", "e0id405": "odid", "e0id58": "vlan",
}
#: alias of a group -> its members
GROUPS = {"port": ("e0id11", "e0id7"), "ip4": ("e0id8", "e0id12"), "ip6": ("e0id27", "e0id28")}
ELEMENTS = {alias: element for element, names in ALIASES.items() for alias in names.split()}


def element(name: str) -> str:
    """The column of an alias (with or without %), or the name itself."""
    return ELEMENTS.get(name.removeprefix("%"), name)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows derived from lineitem, through four weeks: a fifth of IPv6, ports only for TCP, UDP and ICMP, flags
    only for TCP, hosts only for web ports."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part, order, supplier, line = (F.col(f"l_{c}").cast("long") for c in ("partkey", "orderkey", "suppkey", "linenumber"))
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("long") % 28
    start = F.lit(820454400000) + day * 86400000 + (order * 7919 + part * 104729 + line * 1300) % 86400000
    v4 = order % 5 != 0
    has_ports = part % 5 < 3
    wide = lambda head, c: F.when(~v4, F.unhex(F.concat(F.lit(head), F.lpad(F.lower(F.hex(c)), 32 - len(head), "0"))))
    return lines.select(
        (order % 4).cast("long").alias("odid"), start.cast("long").alias("e0id152"), (start + F.floor(F.col("l_discount") * 100) * 250).cast("long").alias("e0id153"),
        F.floor("l_extendedprice").cast("long").alias("e0id1"), F.floor("l_quantity").cast("long").alias("e0id2"),
        F.element_at(F.array(*map(F.lit, (17, 6, 6, 1, 47))), (part % 5 + 1).cast("int")).alias("e0id4"),
        F.when(v4, (supplier + 167772160).cast("long")).alias("e0id8"), F.when(v4, (part % 65536 + 3232235520).cast("long")).alias("e0id12"),
        wide("20010db8", supplier).alias("e0id27"), wide("20010db80001", part).alias("e0id28"),
        F.when(has_ports, (order % 64512 + 1024).cast("int")).alias("e0id7"),
        F.when(has_ports, F.element_at(F.array(*map(F.lit, (80, 443, 53, 25, 110, 995))), (supplier % 6 + 1).cast("int"))).alias("e0id11"),
        F.when((part % 5).isin(1, 2), (order % 64).cast("int")).alias("e0id6"),
        (supplier % 40 + 64512).cast("int").alias("e0id16"), F.when(part % 3 > 0, (part % 60 + 64600).cast("int")).alias("e0id17"),
        F.when(has_ports & (supplier % 6 < 2), F.concat(F.lit("host"), (part % 50).cast("string"), F.lit(".example"))).alias("e16982id501"),
    )


#: The same rows in SQL, IPv6 as hexadecimal digits.
FLOWS_SQL = """SELECT CAST(l_orderkey % 4 AS BIGINT) AS odid, CAST(t AS BIGINT) AS e0id152,
  CAST(t + floor(l_discount*100)*250 AS BIGINT) AS e0id153,
  CAST(floor(l_extendedprice) AS BIGINT) AS e0id1, CAST(floor(l_quantity) AS BIGINT) AS e0id2,
  CAST(CASE l_partkey % 5 WHEN 0 THEN 17 WHEN 1 THEN 6 WHEN 2 THEN 6 WHEN 3 THEN 1 ELSE 47 END AS INTEGER) AS e0id4,
  CASE WHEN l_orderkey % 5 <> 0 THEN CAST(167772160 + l_suppkey AS BIGINT) END AS e0id8,
  CASE WHEN l_orderkey % 5 <> 0 THEN CAST(3232235520 + l_partkey % 65536 AS BIGINT) END AS e0id12,
  CASE WHEN l_orderkey % 5 = 0 THEN '20010db8' || lpad(lower(to_hex(l_suppkey)),24,'0') END AS e0id27,
  CASE WHEN l_orderkey % 5 = 0 THEN '20010db80001' || lpad(lower(to_hex(l_partkey)),20,'0') END AS e0id28,
  CASE WHEN l_partkey % 5 < 3 THEN CAST(1024 + l_orderkey % 64512 AS INTEGER) END AS e0id7,
  CASE WHEN l_partkey % 5 < 3 THEN CAST(CASE l_suppkey % 6 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 25 WHEN 4 THEN 110 ELSE 995 END AS INTEGER) END AS e0id11,
  CASE WHEN l_partkey % 5 IN (1,2) THEN CAST(l_orderkey % 64 AS INTEGER) END AS e0id6,
  CAST(l_suppkey % 40 + 64512 AS INTEGER) AS e0id16, CASE WHEN l_partkey % 3 > 0 THEN CAST(l_partkey % 60 + 64600 AS INTEGER) END AS e0id17,
  CASE WHEN l_partkey % 5 < 3 AND l_suppkey % 6 < 2 THEN 'host' || CAST(l_partkey % 50 AS VARCHAR) || '.example' END AS e16982id501
  FROM (SELECT *, 820454400000 + (epoch_ms(l_shipdate) // 86400000 % 28) * 86400000 + (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 1300) % 86400000 AS t FROM lineitem)"""
