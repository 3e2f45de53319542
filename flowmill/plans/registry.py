"""The registered flow queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowmill.functions import predicates as P
from flowmill.functions import scalars as S
from flowmill.functions.sql import where
from flowmill.operators import aggregate as A
from flowmill.operators import enrich, lifecycle, route, stats
from flowmill.sources import formats, sinks
from flowmill.sources.flows import FLOWS_SQL, flows
from flowmill.sources.folders import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    """A query over the flows; its SQL sees them as f."""
    QUERIES[name] = lambda spark, sf_dir: query(flows(spark, sf_dir))
    if sql:
        ORACLES[name] = f"WITH f AS ({FLOWS_SQL}) {sql}"


def shown(df: DataFrame) -> DataFrame:
    """IPv6 as hexadecimal digits, as in the SQL."""
    return df.withColumns({c: F.lower(F.hex(c)) for c in ("e0id27", "e0id28") if c in df.columns})


# Predicates: each over all flows, counted with their bytes by protocol.
FILTERS: dict[str, tuple[Callable[[], Column], str]] = {}


def add_filters() -> None:
    ip = lambda a: sum(int(x) << s for x, s in zip(a.split("."), (24, 16, 8, 0), strict=True))
    FILTERS.update({
        "filter_cmp": (lambda: P.compare("byt", ">=", "20k") & P.compare("pkt", "<", 30), "e0id1 >= 20000 AND e0id2 < 30"),
        "filter_cidr4": (lambda: P.in_network("sa4", "10.0.0.0/27"), f"coalesce(e0id8 BETWEEN {ip('10.0.0.0')} AND {ip('10.0.0.31')}, false)"),
        "filter_cidr4_not": (lambda: ~P.in_network("da4", "192.168.0.64/26"), f"NOT coalesce(e0id12 BETWEEN {ip('192.168.0.64')} AND {ip('192.168.0.127')}, false)"),
        "filter_cidr6": (lambda: P.in_network("sa6", "2001:db8::/124"), "coalesce(e0id27 BETWEEN '20010db8000000000000000000000000' AND '20010db800000000000000000000000f', false)"),
        "filter_bitmask_syn": (lambda: P.any_flags("S"), "coalesce(e0id6 & 2 > 0, false)"),
        "filter_flags_all": (lambda: P.all_flags("SA"), "coalesce(e0id6 & 18 = 18, false)"),
        "filter_in_list": (lambda: P.one_of("dp", [80, 443]), "coalesce(e0id11 IN (80, 443), false)"),
        "filter_not_in": (lambda: ~P.one_of("dp", [80, 443]), "NOT coalesce(e0id11 IN (80, 443), false)"),
        "filter_group_port": (lambda: P.compare("port", "=", 53), "coalesce(e0id11 = 53, false) OR coalesce(e0id7 = 53, false)"),
        "filter_group_port_not": (lambda: P.compare("port", "!=", 80), "coalesce(e0id11 <> 80, true) AND coalesce(e0id7 <> 80, true)"),
        "filter_exists": (lambda: P.exists("flg") & ~P.exists("sa6"), "e0id6 IS NOT NULL AND e0id27 IS NULL"),
        "filter_neq_absent": (lambda: P.compare("flg", "!=", 2), "coalesce(e0id6 <> 2, true)"),
        "filter_xor": (lambda: P.either(P.compare("proto", "=", 6), P.compare("byt", ">", "30k")), "xor(CAST(e0id4 = 6 AS INTEGER), CAST(e0id1 > 30000 AS INTEGER)) = 1"),
        "filter_time_window": (lambda: P.within(820886400000, 821750400000), "e0id152 >= 820886400000 AND e0id153 <= 821750400000"),
        "filter_suffix_numbers": (lambda: P.compare("byt", ">", "0.05m") | P.compare("byt", "<", "0x3e8"), "e0id1 > 50000 OR e0id1 < 1000"),
        "filter_decimal_number": (lambda: P.compare("byt", ">=", "12.345k") & P.compare("byt", "<=", "0.013001m"), "e0id1 BETWEEN 12345 AND 13001"),
        "filter_text_contains": (lambda: P.text("httph", "contains", "t1"), "coalesce(contains(e16982id501, 't1'), false)"),
        "filter_text_starts": (lambda: P.text("httph", "starts", "host2"), "coalesce(starts_with(e16982id501, 'host2'), false)"),
        "filter_text_ends": (lambda: P.text("httph", "ends", "7.example"), "coalesce(suffix(e16982id501, '7.example'), false)"),
        "filter_text_not": (lambda: P.text("httph", "not", "host11.example"), "coalesce(e16982id501 <> 'host11.example', true)"),
        "filter_text_regex": (lambda: P.text("httph", "matches", "^host[0-4]?[13579][.]"), "coalesce(regexp_matches(e16982id501, '^host[0-4]?[13579][.]'), false)"),
        "filter_columns": (lambda: P.compare("sp", ">", F.col("e0id11")), "coalesce(e0id7 > e0id11, false)"),
        "filter_flat_precedence": (lambda: (P.compare("proto", "=", 6) | P.compare("proto", "=", 17)) & P.compare("pkt", ">", 25), "(e0id4 = 6 OR e0id4 = 17) AND e0id2 > 25"),
        "filter_network_mask": (lambda: P.in_network("ip4", "192.168.0.0/26"), f"coalesce(e0id8 BETWEEN {ip('192.168.0.0')} AND {ip('192.168.0.63')}, false) OR coalesce(e0id12 BETWEEN {ip('192.168.0.0')} AND {ip('192.168.0.63')}, false)"),
        "filter_rate": (lambda: F.coalesce(S.bits_per_second() > 1_000_000, F.lit(False)), "coalesce(CASE WHEN e0id153 = e0id152 THEN 0 ELSE e0id1 * 8000 // (e0id153 - e0id152) END > 1000000, false)"),
    })
    for name, (predicate, sql) in FILTERS.items():
        add(name, lambda f, p=predicate: f.filter(p()).groupBy("e0id4").agg(F.count("*").alias("flows"), F.sum("e0id1").alias("byt"), F.min("e0id152").alias("ts")), f"SELECT e0id4, count(*) AS flows, CAST(sum(e0id1) AS BIGINT) AS byt, min(e0id152) AS ts FROM f WHERE {sql} GROUP BY e0id4")


AGG = "min(e0id152) AS e0id152, max(e0id153) AS e0id153, CAST(sum(e0id2) AS BIGINT) AS e0id2, CAST(sum(e0id1) AS BIGINT) AS e0id1, count(*) AS flows"


def add_aggregates() -> None:
    five = "e0id8, e0id12, e0id27, e0id28, e0id7, e0id11, e0id4"
    add("agg_5tuple", lambda f: shown(A.aggregate(f, A.FIVE_TUPLE)), f"SELECT {five}, {AGG} FROM f GROUP BY {five}")
    add("agg_by_cols", lambda f: A.aggregate(f, ("dp", "pr")), f"SELECT e0id11, e0id4, {AGG} FROM f GROUP BY ALL")
    add("agg_global", lambda f: A.aggregate(f), f"SELECT {AGG} FROM f")
    add("agg_partition_class", lambda f: shown(A.aggregate(f, ("flg", "sa6"))), f"SELECT e0id6, e0id27, {AGG} FROM f WHERE e0id6 IS NOT NULL OR e0id27 IS NOT NULL GROUP BY e0id6, e0id27")
    rates = "SELECT *, e0id153 - e0id152 AS td, e0id2 / nullif(e0id153 - e0id152, 0) AS pps, e0id1 / nullif(e0id153 - e0id152, 0) AS bps, e0id1 / nullif(e0id2, 0) AS bpp"
    add("agg_computed_rates", lambda f: A.with_rates(A.aggregate(f, ("dp",))), f"{rates} FROM (SELECT e0id11, {AGG} FROM f WHERE e0id11 IS NOT NULL GROUP BY e0id11)")
    add("having_bytes", lambda f: A.aggregate(f, ("sa4",), having=F.col("e0id1") > 500_000), f"SELECT e0id8, {AGG} FROM f WHERE e0id8 IS NOT NULL GROUP BY e0id8 HAVING sum(e0id1) > 500000")
    add("totals_weighted", lambda f: A.aggregate(f, ("pr",)).agg(F.sum("e0id1").alias("byt"), F.sum("flows").alias("flows"), (F.sum("e0id1") / F.sum("flows")).alias("mean_byt")), "SELECT CAST(sum(e0id1) AS BIGINT) AS byt, count(*) AS flows, sum(e0id1) / count(*) AS mean_byt FROM f")
    add("union_sources", lambda f: f.filter("odid < 2").unionByName(f.filter("odid >= 2")).groupBy("odid").agg(F.count("*").alias("flows")), "SELECT odid, count(*) AS flows FROM f GROUP BY odid")
    add("distinct_hosts", lambda f: f.groupBy("e0id4").agg(F.countDistinct("e0id8").alias("hosts")), "SELECT e0id4, count(DISTINCT e0id8) AS hosts FROM f GROUP BY e0id4")
    add("sort_limit_tiebreak", lambda f: f.select("e0id152", "e0id1", "e0id2", "e0id4", "e0id7").orderBy(F.desc("e0id1"), "e0id152", "e0id2", "e0id4", "e0id7").limit(100), "SELECT e0id152, e0id1, e0id2, e0id4, e0id7 FROM f ORDER BY e0id1 DESC, e0id152, e0id2, e0id4, e0id7 NULLS FIRST LIMIT 100")


def top_sql(key: str, order: str, where: str, n: int) -> str:
    groups = f"SELECT {key}, {AGG} FROM f WHERE {key} IS NOT NULL AND ({where}) GROUP BY {key}"
    return f", g AS ({groups}) SELECT *, round(100.0 * {order} / (SELECT sum({order}) FROM g), 1) AS percent FROM g ORDER BY {order} DESC, {key} LIMIT {n}"


def add_top() -> None:
    def top(name: str, key: str, order: str, predicate: Callable[[], Column] | None = None, where: str = "true", n: int = 10) -> None:
        element, by = A.element(key), A.element(order)
        add(name, lambda f: shown(A.top_n(f if predicate is None else f.filter(predicate()), key, order, n)), top_sql(element, by, where, n))

    def rates(name: str, key: str) -> None:
        add(name, lambda f: shown(A.with_rates(A.top_n(f, key, "byt"))), top_sql(A.element(key), "e0id1", "true", 10).replace("SELECT *, round", "SELECT *, e0id153 - e0id152 AS td, e0id2 / nullif(e0id153 - e0id152, 0) AS pps, e0id1 / nullif(e0id153 - e0id152, 0) AS bps, e0id1 / nullif(e0id2, 0) AS bpp, round"))

    tcp = (lambda: P.compare("proto", "=", 6), "e0id4 = 6")
    top("topn_srcip_bytes", "sa4", "byt", *tcp)
    top("topn_percent", "pr", "flows")
    # the headline suite: addresses, ports, autonomous systems and hosts by bytes and by flows
    tcp_to_web = (lambda: P.one_of("dp", [80, 443]) & P.compare("proto", "=", 6), "coalesce(e0id11 IN (80, 443), false) AND e0id4 = 6")
    for key in ("sa4", "da4", "sa6", "da6"):
        for order in ("byt", "pkt", "flows"):
            top(f"bench_top_{key}_{order}", key, order)
        top(f"bench_top_web_{key}_byt", key, "byt", *tcp_to_web)
        rates(f"bench_rate_{key}", key)
    for key in ("sp", "dp"):
        top(f"bench_top_{key}_flows", key, "flows")
        top(f"bench_top_udp_{key}_byt", key, "byt", lambda: P.compare("proto", "=", 17), "e0id4 = 17")
        top(f"bench_top_tcp_{key}_byt", key, "byt", *tcp)
    for key in ("sas", "das"):
        rates(f"bench_rate_{key}", key)
    top("bench_top_httph_flows", "httph", "flows")
    top("bench_top_pr_byt", "pr", "byt")
    top("bench_top_syn_sa4", "sa4", "flows", lambda: P.any_flags("S"), "coalesce(e0id6 & 2 > 0, false)")
    top("bench_top_net_da4", "da4", "pkt", lambda: P.in_network("sa4", "10.0.0.0/26"), "coalesce(e0id8 BETWEEN 167772160 AND 167772223, false)")


def names_sql(column: str, names: dict[int, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + f" ELSE CAST({column} AS VARCHAR) END"


IP4 = "CAST({0} >> 24 AS VARCHAR) || '.' || CAST({0} >> 16 & 255 AS VARCHAR) || '.' || CAST({0} >> 8 & 255 AS VARCHAR) || '.' || CAST({0} & 255 AS VARCHAR)"
FLAGS = " || ".join(f"CASE WHEN e0id6 & {bit} > 0 THEN '{c}' ELSE '.' END" for c, bit in zip("UAPRSF", (32, 16, 8, 4, 2, 1), strict=True))
TIME = "strftime(make_timestamp({0} * 1000), '%Y-%m-%d %H:%M:%S') || '.' || lpad(CAST({0} % 1000 AS VARCHAR), 3, '0')"


# Codes with the texts that are expected of them, written out.
CODES = [
    ("fn_http_method", lambda c: S.named(c, S.HTTP_METHODS), range(0, 12), "0 GET POST HTTP HEAD PUT OPTIONS DELETE TRACE CONNECT PATCH 11".split()),
    ("fn_sip_method", lambda c: S.named(c, S.SIP_METHODS), range(0, 16), "0 INVITE ACK BYE CANCEL OPTIONS REGISTER PRACK SUBSCRIBE NOTIFY PUBLISH INFO REFER MESSAGE UPDATE 15".split()),
    ("fn_dns_rcode", lambda c: S.named(c, S.DNS_RCODES), [*range(0, 12), *range(16, 24)], "NoError FormErr ServFail NXDomain NotImp Refused YXDomain YXRRSet NXRRSet NotAuth NotZone 11 BADVERS/BADSIG BADKEY BADTIME BADMODE BADNAME BADALG BADTRUNC 23".split()),
    ("fn_tls_version", lambda c: S.named(c, S.TLS_VERSIONS), [2, 5, 768, 769, 770, 771, 772, 921, 1177, 8960, 8961, 8962, 8963, 773], ["SSLv2.0", "TLSv1.0 (SKYPE)", "SSLv3.0", "TLSv1.0", "TLSv1.1", "TLSv1.2", "TLSv1.3 (HYPOTHETICAL)", "TLSv1.152 (HYPOTHETICAL)", "TLSv2.152 (HYPOTHETICAL)", "SSLv2.0 (SSLv3.0)", "SSLv2.0 (TLSv1.0)", "SSLv2.0 (TLSv1.1)", "SSLv2.0 (TLSv1.2)", "773"]),
    ("fn_voip_type", lambda c: S.named(c, S.VOIP_TYPES), [0, 1, 2, 3, 4, 5, 8, 16], ["NO VOIP", "SERV REQUEST", "SERV REPLY", "CALL REQUEST", "CALL REPLY", "5", "VOICE DATA", "RTCP"]),
    ("fn_rtp_codec", S.rtp_codec, [0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 25, 26, 28, 31, 32, 33, 34, 72, 76, 95, 96, 127], "PCMU Reserved GSM G723 DVI4 DVI4 LPC PCMA G722 L16 L16 QCELP CN MPA G728 DVI4 DVI4 G729 Reserved Unassigned CelB JPEG nv H261 MPV MP2T H263 Reserved Reserved Unassigned dynamic dynamic".split()),
    ("fn_sip_type", lambda c: S.named(c, S.SIP_TYPES), [0, 1, 10, 11, 99, 100, 101, 180, 183, 200, 407, 486, 603, 999], ["Invalid", "Invite", "Subscribe", "11", "Status", "Trying", "Dial Established", "Ringing", "Session Progress", "OK", "Proxy Auth Required", "Busy Here", "Decline", "Undefined"]),
    ("fn_http_status", S.http_status, [100, 200, 206, 226, 299, 301, 304, 404, 416, 429, 500, 511], ["100 Continue", "200 OK", "206 Partial Content", "226 IM Used", "299", "301 Moved Permanently", "304 Not Modified", "404 Not Found", "416 Requested Range Not Satisfiable", "429 Too Many Requests", "500 Internal Server Error", "511 Network Authentication Required"]),
    ("fn_mac_text", S.mac_text, [0, 1, 2199023255562, 281474976710655], ["00:00:00:00:00:00", "00:00:00:00:00:01", "02:00:00:00:00:0a", "ff:ff:ff:ff:ff:ff"]),
]
PARSED = [
    ("fn_parse_proto", lambda c: S.number_of(c, S.PROTOCOLS).cast("long"), ["TCP", "udp", "Icmp", "47", "IPv6-ICMP", "nosuch"], [6, 17, 1, 47, 58, None]),
    ("fn_parse_ip4", S.ipv4_number, ["10.0.0.1", "255.255.255.255", "0.0.0.0", "1.2.3", "1.2.3.256", "x"], [167772161, 4294967295, 0, None, None, None]),
    ("fn_parse_flags", lambda c: S.flags_number(c).cast("long"), ["S", "SA", "fsrpau", "", ".A..S."], [2, 18, 63, 0, 18]),
    ("fn_parse_mac", S.mac_number, ["02:00:00:00:00:0a", "ff:ff:ff:ff:ff:ff"], [2199023255562, 281474976710655]),
    ("fn_parse_method", lambda c: S.number_of(c, S.HTTP_METHODS).cast("long"), ["GET", "patch", "PUT", "99"], [1, 10, 5, 99]),
]


def add_functions() -> None:
    c = F.col

    def value(name: str, out: Callable[[], Column], sql: str, by: str = "e0id1") -> None:
        add(name, lambda f: f.select("e0id152", by, out().alias("v")) if by != "e0id152" else f.select("e0id152", out().alias("v")), f"SELECT e0id152, {by}, {sql} AS v FROM f" if by != "e0id152" else f"SELECT e0id152, {sql} AS v FROM f")

    value("fn_tcpflags", lambda: S.flags_text(c("e0id6")), FLAGS)
    value("fn_proto_name", lambda: S.named(c("e0id4"), S.PROTOCOLS), names_sql("e0id4", S.PROTOCOLS))
    value("fn_ip_text", lambda: S.ipv4_text(c("e0id8")), IP4.format("e0id8"))
    value("fn_ip6_text", lambda: S.ipv6_text(c("e0id27")), "regexp_replace(e0id27, '(....)(....)(....)(....)(....)(....)(....)(....)', '\\1:\\2:\\3:\\4:\\5:\\6:\\7:\\8')")
    value("fn_mac_text", lambda: S.mac_text(c("e0id12")), "regexp_replace(lpad(lower(to_hex(e0id12)), 12, '0'), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6')")
    value("fn_timestamp_fmt", lambda: S.timestamp_text(c("e0id152")), TIME.format("e0id152"))
    value("fn_duration_fmt", lambda: S.seconds_text(c("e0id153") - c("e0id152")), "printf('%.3f', (e0id153 - e0id152) / 1000.0)")
    value("fn_smtp_cmd", lambda: S.smtp_commands(c("e0id1") % 4096 + F.when(c("e0id2") > 25, 32768).otherwise(0)), "concat_ws(',', " + ", ".join(f"CASE WHEN (e0id1 % 4096) & {1 << k} > 0 THEN '{n}' END" for k, n in enumerate("EH,HE,ML,RC,D,RST,VF,EX,HLP,N,Q".split(","))) + ", CASE WHEN e0id2 > 25 THEN 'U' END)")
    value("fn_smtp_status", lambda: S.smtp_status(c("e0id1") * 65537 % 4294967296), "concat(" + ", ".join(f"'{x}'" if x == "|" else f"CASE WHEN (e0id1 * 65537 % 4294967296) & {1 << k} > 0 THEN '{x}' ELSE '-' END" for x, k in zip("SHRCOUV|I|NMLSP|CAISPMUENFR|SU", (0, 1, 2, 3, 4, 5, 6, 0, 7, 0, 8, 9, 10, 11, 12, 0, *range(13, 24), 0, 30, 31), strict=True)) + ")")
    for name, shown_as, codes, expected in CODES:
        pick = lambda codes=codes: F.element_at(F.array(*map(F.lit, codes)), (c("e0id1") % len(codes) + 1).cast("int"))
        value(name, lambda pick=pick, shown_as=shown_as: shown_as(pick()), f"list_extract([{', '.join(f'{chr(39)}{x}{chr(39)}' for x in expected)}], e0id1 % {len(codes)} + 1)")
    for name, table, texts, expected in PARSED:
        pick = lambda texts=texts: F.element_at(F.array(*map(F.lit, texts)), (c("e0id1") % len(texts) + 1).cast("int"))
        value(name, lambda pick=pick, table=table: table(pick()), f"list_extract([{', '.join('NULL' if x is None else f'CAST({x} AS BIGINT)' for x in expected)}], e0id1 % {len(texts)} + 1)")
    value("fn_ip6_compact", lambda: S.ipv6_compact(c("e0id27")), "'2001:db8::' || ltrim(lower(to_hex(CAST('0x' || substr(e0id27, 25) AS BIGINT))), '0')")
    value("anon_truncate6", lambda: F.lower(F.hex(S.truncated6(c("e0id28")))), "substr(e0id28, 1, 14) || '0000000000000000' || substr(e0id28, 31, 2)")
    value("fn_ntp_millis", lambda: S.ntp_millis(F.shiftleft(c("e0id1") + 2208988800, 32) + 2147483648), "e0id1 * 1000 + 500")
    value("fn_multiplier", lambda: S.multiplied(c("e0id2"), 0.25, 2), "printf('%.2f', e0id2 * 0.25)")
    value("fn_source_crc", lambda: S.source_crc(F.lit("10.0.0.1"), F.lit(4739) + c("e0id2") * 0), "CAST(3018675508 AS BIGINT)")
    value("fn_json_text", lambda: S.json_text(F.concat(F.lit('a"b'), F.chr(c("e0id2") % 3 + 1), c("e16982id501"))), """'"a\\"b' || e16982id501 || '"'""")
    value("fn_window_start", lambda: S.window_start(c("e0id153"), 300_000), "e0id153 - e0id153 % 300000")
    value("anon_truncate", lambda: S.truncated(c("e0id12")), "e0id12 & 4294901760")
    add("human_numbers", lambda f: A.aggregate(f, ("dp",)).select("e0id11", S.human(c("e0id1")).alias("v")), "SELECT e0id11, CASE WHEN s > 1000000000000 THEN printf('%.1f', s / 1e12) || ' T' WHEN s > 1000000000 THEN printf('%.1f', s / 1e9) || ' G' WHEN s > 1000000 THEN printf('%.1f', s / 1e6) || ' M' ELSE CAST(s AS VARCHAR) END AS v FROM (SELECT e0id11, CAST(sum(e0id1) AS BIGINT) AS s FROM f WHERE e0id11 IS NOT NULL GROUP BY e0id11)")
    add("rates_pps_bps_bpp", lambda f: f.select("e0id152", "e0id1", "e0id2", S.duration().alias("td"), S.packets_per_second().alias("pps"), S.bits_per_second().alias("bps"), S.bytes_per_packet().alias("bpp")),
        "SELECT e0id152, e0id1, e0id2, td, CASE WHEN td = 0 THEN 0 ELSE e0id2 * 1000 // td END AS pps, CASE WHEN td = 0 THEN 0 ELSE e0id1 * 8000 // td END AS bps, CASE WHEN e0id2 = 0 THEN 0 ELSE e0id1 // e0id2 END AS bpp FROM (SELECT *, CASE WHEN e0id153 >= e0id152 THEN e0id153 - e0id152 END AS td FROM f)")
    add("anon_cryptopan", lambda f: f.groupBy("e0id8").agg(F.count("*").alias("flows")).select("e0id8", "flows", S.prefix_preserving(c("e0id8"), bytes(range(32))).alias("v")), None)
    add("timenow_shift", lambda f: route.shift_to_now(f, F.floor(c("e0id153") / 1000), F.lit(1_700_000_000)).select("e0id1", "e0id152", "e0id153"), "SELECT e0id1, e0id152 + (1700000000 - e0id153 // 1000) * 1000 AS e0id152, e0id153 + (1700000000 - e0id153 // 1000) * 1000 AS e0id153 FROM f")
    add("timecheck_flag", lambda f: f.groupBy(route.in_future(821_500_000_000).alias("late")).agg(F.count("*").alias("flows")), "SELECT coalesce(e0id152 > 821586400000, false) OR coalesce(e0id153 > 821586400000, false) AS late, count(*) AS flows FROM f GROUP BY 1")


def add_enrichment() -> None:
    def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def dhcp(spark: SparkSession, sf_dir: str) -> DataFrame:
        leases = read(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select((F.col("s_suppkey") + 167772160).alias("ip"), (F.col("s_suppkey") + 0x020000000000).alias("mac"))
        return enrich.hardware_address(flows(spark, sf_dir), leases).select("e0id152", "e0id1", "e0id8", "e0id56")

    QUERIES["join_dhcp_lookup"] = dhcp
    ORACLES["join_dhcp_lookup"] = f"WITH f AS ({FLOWS_SQL}) SELECT e0id152, e0id1, e0id8, CASE WHEN e0id8 IS NOT NULL THEN coalesce(s_suppkey + 2199023255552, 0) END AS e0id56 FROM f LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) s ON e0id8 = s_suppkey + 167772160"

    def users(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 100 + 167772161).alias("ip"), F.floor(F.unix_millis(F.col("o_orderdate").cast("timestamp")) / 1000).cast("long").alias("time"), F.when(F.col("o_orderstatus") != "F", 1).otherwise(0).alias("action"), F.concat(F.lit("user"), "o_custkey").alias("name"))
        log = log.groupBy("ip", "time").agg(F.max(F.struct("name", "action")).alias("e")).select("ip", "time", "e.action", "e.name")
        return enrich.user_at(flows(spark, sf_dir), log).select("e0id152", "e0id1", "e0id8", "srcName")

    QUERIES["join_uid_asof"] = users
    ORACLES["join_uid_asof"] = f"""WITH f AS ({FLOWS_SQL}), log AS (SELECT o_custkey % 100 + 167772161 AS ip, epoch_ms(o_orderdate) // 1000 AS time, max(struct_pack(name := 'user' || CAST(o_custkey AS VARCHAR), action := CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END)) AS e FROM orders GROUP BY 1, 2)
        SELECT e0id152, e0id1, e0id8, coalesce(CASE WHEN e.action = 1 THEN e.name END, '') AS srcName FROM f ASOF LEFT JOIN log ON e0id8 = ip AND e0id152 // 1000 >= time"""

    def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
        low = F.col("n_nationkey").cast("long") * 16 + 167772160
        blocks = read(spark, sf_dir, "nation").select(low.alias("lo"), (low + 15).alias("hi"), F.col("n_nationkey").alias("code"))
        return enrich.country(flows(spark, sf_dir), blocks).select("e0id152", "e0id1", "e0id8", "srcCountry")

    QUERIES["join_geo_range"] = countries
    ORACLES["join_geo_range"] = f"WITH f AS ({FLOWS_SQL}) SELECT e0id152, e0id1, e0id8, coalesce(n_nationkey, 0) AS srcCountry FROM f LEFT JOIN nation ON e0id8 BETWEEN 167772160 + n_nationkey * 16 AND 167772160 + n_nationkey * 16 + 15"


    def countries6(spark: SparkSession, sf_dir: str) -> DataFrame:
        low = lambda extra: F.unhex(F.concat(F.lit("20010db8"), F.lpad(F.lower(F.hex(F.col("n_nationkey") * 16 + extra)), 24, "0")))
        blocks = read(spark, sf_dir, "nation").select(low(0).alias("lo"), low(15).alias("hi"), F.col("n_nationkey").alias("code"))
        return enrich.country(flows(spark, sf_dir), blocks, "sa6").select("e0id152", "e0id1", F.lower(F.hex("e0id27")).alias("e0id27"), "srcCountry")

    QUERIES["join_geo_range6"] = countries6
    ORACLES["join_geo_range6"] = f"WITH f AS ({FLOWS_SQL}) SELECT e0id152, e0id1, e0id27, coalesce(n_nationkey, 0) AS srcCountry FROM f LEFT JOIN nation ON CAST('0x' || substr(e0id27, 9) AS HUGEINT) BETWEEN n_nationkey * 16 AND n_nationkey * 16 + 15"


def profile() -> route.Profile:
    return route.Profile("live", [route.Channel("ch1", F.col("odid") == 0), route.Channel("ch2", F.col("odid") == 1)], [
        route.Profile("emails", [route.Channel("pop3", P.one_of("port", [110, 995])), route.Channel("smtp", P.compare("port", "=", 25), ("ch1",))]),
        route.Profile("web", [route.Channel("http", P.one_of("port", [80, 443]))]),
    ])


CHANNELS_SQL = """, labelled AS (SELECT *, odid = 0 AS c1, odid = 1 AS c2, coalesce(e0id11 IN (110, 995), false) OR coalesce(e0id7 IN (110, 995), false) AS pop,
  coalesce(e0id11 = 25, false) OR coalesce(e0id7 = 25, false) AS smtp, coalesce(e0id11 IN (80, 443), false) OR coalesce(e0id7 IN (80, 443), false) AS http FROM f),
  x AS (SELECT *, 'live' AS profile, 'ch1' AS channel FROM labelled WHERE c1 UNION ALL SELECT *, 'live', 'ch2' FROM labelled WHERE c2
    UNION ALL SELECT *, 'live/emails', 'pop3' FROM labelled WHERE pop AND (c1 OR c2) UNION ALL SELECT *, 'live/emails', 'smtp' FROM labelled WHERE smtp AND c1
    UNION ALL SELECT *, 'live/web', 'http' FROM labelled WHERE http AND (c1 OR c2))"""


ALL = "odid e0id152 e0id153 e0id1 e0id2 e0id4 e0id8 e0id12 e0id27 e0id28 e0id7 e0id11 e0id6 e0id16 e0id17 e16982id501"


def counters_sql() -> str:
    which = {"total": "true", "tcp": "coalesce(e0id4 = 6, false)", "udp": "coalesce(e0id4 = 17, false)", "icmp": "coalesce(e0id4 IN (1, 58), false)", "other": "NOT coalesce(e0id4 IN (6, 17, 1, 58), false)"}
    return ", ".join(f"count(*) FILTER ({w}) AS flows_{k}, CAST(coalesce(sum(e0id2) FILTER ({w}), 0) AS BIGINT) AS packets_{k}, CAST(coalesce(sum(e0id1) FILTER ({w}), 0) AS BIGINT) AS bytes_{k}" for k, w in which.items())


def add_routing_and_stats() -> None:
    count = lambda df, *keys: df.groupBy(*keys).agg(F.count("*").alias("flows"), F.sum("e0id1").alias("byt"))
    counted = "count(*) AS flows, CAST(sum(e0id1) AS BIGINT) AS byt"
    add("joinflows_remap", lambda f: count(route.merge_sources(f, {0: 10, 1: 10}, None), "odid", "e0id405"), f"SELECT CASE WHEN odid < 2 THEN 10 ELSE odid END AS odid, odid AS e0id405, {counted} FROM f GROUP BY 1, 2")
    rules = lambda: [([0, 1], P.compare("proto", "=", 6), 100), ([0], P.compare("dp", "=", 80), 101)]
    add("route_profiles", lambda f: count(route.route(f, rules()), "odid"), f", r AS (SELECT * FROM f WHERE odid > 1 UNION ALL SELECT * REPLACE (CAST(100 AS BIGINT) AS odid) FROM f WHERE odid < 2 AND e0id4 = 6 UNION ALL SELECT * REPLACE (CAST(101 AS BIGINT) AS odid) FROM f WHERE odid = 0 AND e0id11 = 80) SELECT odid, {counted} FROM r GROUP BY odid")
    add("odip_fill", lambda f: count(route.fill_exporter(f, F.col("odid") + 167837696), "e0id403"), f"SELECT odid + 167837696 AS e0id403, {counted} FROM f GROUP BY 1")
    add("profile_labels", lambda f: route.classify(f, profile()).groupBy(F.size("channels").alias("n")).agg(F.count("*").alias("flows")), ", n AS (SELECT CAST(odid = 0 AS INT) + CAST(odid = 1 AS INT) + CAST((coalesce(e0id11 IN (110, 995), false) OR coalesce(e0id7 IN (110, 995), false)) AND odid < 2 AS INT) + CAST((coalesce(e0id11 = 25, false) OR coalesce(e0id7 = 25, false)) AND odid = 0 AS INT) + CAST((coalesce(e0id11 IN (80, 443), false) OR coalesce(e0id7 IN (80, 443), false)) AND odid < 2 AS INT) AS n FROM f) SELECT n, count(*) AS flows FROM n GROUP BY n")
    add("channel_split", lambda f: count(route.classify(f, profile()).select("*", F.explode("channels").alias("c")).select("*", "c.profile", "c.channel"), "profile", "channel"), f"{CHANNELS_SQL} SELECT profile, channel, {counted} FROM x GROUP BY ALL")
    day = 86_400_000
    add("stats_per_odid_5min", lambda f: stats.by_window(f), f"SELECT odid, e0id153 - e0id153 % 300000 AS window_start, {counters_sql()} FROM f GROUP BY ALL")
    add("stats_totals_5min", lambda f: stats.by_window(f, ()), f"SELECT e0id153 - e0id153 % 300000 AS window_start, {counters_sql()} FROM f GROUP BY ALL")
    more = "max(e0id2) AS packets_max, max(e0id1) AS bytes_max, CAST(sum(e0id2) // count(*) AS BIGINT) AS packets_avg, CAST(sum(e0id1) // count(*) AS BIGINT) AS bytes_avg"
    add("profile_stats_5min", lambda f: stats.by_channel(route.classify(f, profile())), f"{CHANNELS_SQL} SELECT profile, channel, e0id153 - e0id153 % 300000 AS window_start, {counters_sql()}, {more} FROM x GROUP BY ALL")
    series = "SELECT odid, e0id153 - e0id153 % 300000 AS w, CAST(sum(e0id1) AS BIGINT) AS b FROM f GROUP BY ALL"
    for name, times in (("stats_consolidate_30min", 6), ("stats_consolidate_2h", 24), ("stats_consolidate_day", 288)):
        add(name, lambda f, t=times: stats.consolidate(stats.by_window(f), ("odid",), "bytes_total", 300_000, t), f"SELECT odid, w - w % {300_000 * times} AS window_start, avg(b) AS bytes_total_avg, max(b) AS bytes_total_max FROM ({series}) GROUP BY 1, 2")

    def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 8).alias("source"), "event_id", (F.col("event_id") % 7 + 1).alias("records"))
        sent = F.sum(F.col("records") + F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 3).otherwise(0)).over(Window.partitionBy("source").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
        e = e.withColumn("sequence", F.pmod(F.coalesce(sent, F.lit(0)) + 4294967000, F.lit(1 << 32)))
        return stats.losses(e, "source", "sequence", "records", "event_id")

    QUERIES["stats_loss_seq"] = messages
    ORACLES["stats_loss_seq"] = "WITH e AS (SELECT user_id % 8 AS source, event_id, event_id % 7 + 1 AS records, CASE WHEN event_id % 5 = 0 THEN event_id % 3 ELSE 0 END AS gap, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id DESC) AS back FROM events) SELECT source, CAST(sum(records) AS BIGINT) AS received, CAST(sum(CASE WHEN back > 1 THEN gap ELSE 0 END) AS BIGINT) AS lost FROM e GROUP BY source"
    add("template_info", lambda f: lifecycle.described(f), "SELECT element, rows, present FROM (SELECT count(*) AS rows, " + ", ".join(f"count({c}) AS {c}" for c in ALL.split()) + " FROM f) UNPIVOT (present FOR element IN (" + ", ".join(ALL.split()) + "))")
    folders = lambda f: f.groupBy(S.window_start(F.col("e0id153"), day).alias("window_start")).agg(F.sum("e0id1").alias("bytes"))
    add("expire_plan", lambda f: lifecycle.expired(folders(f), 50_000_000), f", d AS (SELECT e0id153 - e0id153 % {day} AS window_start, CAST(sum(e0id1) AS BIGINT) AS bytes FROM f GROUP BY 1), k AS (SELECT *, CAST(sum(bytes) OVER (ORDER BY window_start DESC) AS BIGINT) AS kept_bytes, row_number() OVER (ORDER BY window_start DESC) AS n FROM d) SELECT window_start, bytes, kept_bytes FROM k WHERE kept_bytes > 50000000 AND n > 1")

    def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Written in windows of six hours, compacted into days, of which the second week is read again."""
        small, large = new_folder(spark, "flows"), new_folder(spark, "flows-by-day")
        lifecycle.write_flows(flows(spark, sf_dir).withColumn("window_start", S.window_start(F.col("e0id153"), day // 4)), small, ("window_start",))
        lifecycle.compact(spark, small, large, day, ("window_start",))
        week = lifecycle.between(spark, large, 820454400000 + 7 * day, 820454400000 + 13 * day)
        return week.groupBy(F.col("window_start").cast("long").alias("window_start")).agg(F.sum("e0id1").alias("bytes"), F.count("*").alias("flows"), F.count("e0id27").alias("flows6"))

    QUERIES["compact_by_day"] = compacted
    ORACLES["compact_by_day"] = f"WITH f AS ({FLOWS_SQL}) SELECT e0id153 - e0id153 % {day} AS window_start, CAST(sum(e0id1) AS BIGINT) AS bytes, count(*) AS flows, count(e0id27) AS flows6 FROM f WHERE e0id153 - e0id153 % {day} BETWEEN {820454400000 + 7 * day} AND {820454400000 + 13 * day} GROUP BY 1"

    def twice(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Statistics of two tables, one without ports, written apart and merged."""
        paths = [new_folder(spark, "stats"), new_folder(spark, "stats")]
        f = flows(spark, sf_dir)
        lifecycle.write_flows(f.filter("odid < 2").drop("e0id7"), paths[0], ("odid",))
        lifecycle.write_flows(f.filter("odid >= 1"), paths[1], ("odid",))
        both = [stats.by_window(spark.read.parquet(p), ("odid",), day) for p in paths]
        return stats.merged(both[0].unionByName(both[1]))

    QUERIES["stats_merge"] = twice
    ORACLES["stats_merge"] = f"WITH f AS ({FLOWS_SQL} UNION ALL SELECT * FROM ({FLOWS_SQL}) WHERE odid = 1) SELECT odid, e0id153 - e0id153 % {day} AS window_start, {counters_sql()} FROM f GROUP BY ALL"

    def several(spark: SparkSession, sf_dir: str) -> DataFrame:
        paths = [new_folder(spark, "several"), new_folder(spark, "several")]
        f = flows(spark, sf_dir)
        lifecycle.write_flows(f.filter("odid = 0").drop("e0id7"), paths[0], ("odid",))
        lifecycle.write_flows(f.filter("odid > 1"), paths[1], ("odid",))
        return lifecycle.several(spark, paths).groupBy(F.col("odid").cast("long").alias("odid")).agg(F.count("*").alias("flows"), F.count("e0id7").alias("ports"), F.count("e0id11").alias("targets"))

    QUERIES["scan_several"] = several
    ORACLES["scan_several"] = f"WITH f AS ({FLOWS_SQL}) SELECT odid, count(*) AS flows, CASE WHEN odid > 0 THEN count(e0id7) ELSE 0 END AS ports, count(e0id11) AS targets FROM f WHERE odid <> 1 GROUP BY odid"


def add_formats() -> None:
    nn = lambda sql, default="NULL": f"coalesce({sql}, '{default}')"
    text = lambda c: f"CAST({c} AS VARCHAR)"
    fields = [TIME.format("e0id152"), "printf('%.3f', (e0id153 - e0id152) / 1000.0)", names_sql("e0id4", S.PROTOCOLS), nn(IP4.format("e0id8")), nn(text("e0id7"), "0"), nn(IP4.format("e0id12")), nn(text("e0id11"), "0"), text("e0id2"), text("e0id1"), "'1'"]
    for name, separator in (("csv", ","), ("pipe", "|")):
        add(f"format_{name}", lambda f, n=name: formats.lines(f, n), f"SELECT {f' || {chr(39)}{separator}{chr(39)} || '.join(f'({x})' for x in fields)} AS line FROM f")
    ts, td, pr, sa, sp, da, dp, pkt, byt, fl = (f"({x})" for x in fields)
    add("format_line4", lambda f: formats.lines(f, "line4"), f"SELECT concat({ts}, ' ', {td}, ' ', {pr}, ' ', {sa}, ':', {sp}, ' -> ', {da}, ':', {dp}, ' ', {pkt}, ' ', {byt}, ' ', {fl}) AS line FROM f")
    rate = lambda top: f"CAST(CASE WHEN e0id153 = e0id152 THEN 0 ELSE {top} // (e0id153 - e0id152) END AS VARCHAR)"
    add("format_extended4", lambda f: formats.lines(f, "extended4"), f"SELECT concat({ts}, ' ', {td}, ' ', {pr}, ' ', {sa}, ':', {sp}, ' -> ', {da}, ':', {dp}, ' ', coalesce({FLAGS}, '......'), ' 0 ', {pkt}, ' ', {byt}, ' ', {rate('e0id1 * 8000')}, ' ', {rate('e0id2 * 1000')}, ' ', CAST(CASE WHEN e0id2 = 0 THEN 0 ELSE e0id1 // e0id2 END AS VARCHAR), ' 1') AS line FROM f")
    add("format_own", lambda f: formats.lines(A.aggregate(f, ("sa4", "dp")), "fmt:[%srcip4] %dstport=%byt/%fl %nosuch"), f"SELECT concat('[', {nn(IP4.format('e0id8'))}, '] ', {nn(text('e0id11'), '0')}, '=', b, '/', n, ' NULL') AS line FROM (SELECT e0id8, e0id11, sum(e0id1) AS b, count(*) AS n FROM f WHERE e0id8 IS NOT NULL OR e0id11 IS NOT NULL GROUP BY 1, 2)")
    add("project_format", lambda f: formats.projected(f, "fmt:%ts %srcip4 %byt %bps %nosuch %byt"), "SELECT e0id152 AS ts, e0id8 AS sa4, e0id1 AS byt, CASE WHEN e0id153 = e0id152 THEN 0 ELSE e0id1 * 8000 // (e0id153 - e0id152) END AS bps FROM f")
    add("project_computed", lambda f: f.select("e0id152", (F.col("e0id153") - F.col("e0id152")).alias("a"), (F.col("e0id1") + F.col("e0id2")).alias("b"), (F.col("e0id1") * F.col("e0id2")).alias("c"), F.try_divide(F.col("e0id1"), F.col("e0id11")).alias("d")), "SELECT e0id152, e0id153 - e0id152 AS a, e0id1 + e0id2 AS b, e0id1 * e0id2 AS c, e0id1 / e0id11 AS d FROM f")
    add("unirec_projection", lambda f: sinks.unirec(f), "SELECT coalesce(lpad(upper(to_hex(e0id8)), 32, '0'), upper(e0id27)) AS SRC_IP, coalesce(lpad(upper(to_hex(e0id12)), 32, '0'), upper(e0id28)) AS DST_IP, e0id7 AS SRC_PORT, e0id11 AS DST_PORT, e0id4 AS PROTOCOL, e0id6 AS TCP_FLAGS, e0id1 AS BYTES, e0id2 AS PACKETS, CAST(1 << greatest(odid - 1, 0) AS BIGINT) AS LINK_BIT_FIELD FROM f")
    add("nfdump_projection", lambda f: sinks.storable(f).select("e0id152", "e0id153", "e0id1", "e0id2", "e0id4", "e0id8", "e0id12"), "SELECT e0id152, e0id153, e0id1, e0id2, e0id4, e0id8, e0id12 FROM f WHERE e0id8 IS NOT NULL")
    add("json_raw", lambda f: sinks.json_records(f, "", formatted=False, odid=True, times=True), "SELECT '{\"@type\":\"ipfix.entry\",\"odid\":' || odid || coalesce(',\"sourceIPv4Address\":\"' || " + IP4.format("e0id8") + " || '\"', '') || coalesce(',\"destinationIPv4Address\":\"' || " + IP4.format("e0id12") + " || '\"', '') || ',\"protocolIdentifier\":' || e0id4 || coalesce(',\"tcpControlBits\":' || e0id6, '') || ',\"octetDeltaCount\":' || e0id1 || ',\"packetDeltaCount\":' || e0id2 || ',\"flowStartMilliseconds\":' || e0id152 || ',\"flowEndMilliseconds\":' || e0id153 || '}' AS json FROM f")
    add("json_record", lambda f: sinks.json_records(f), "SELECT '{\"@type\":\"ipfix.entry\"' || coalesce(',\"ipfix.sourceIPv4Address\":\"' || " + IP4.format("e0id8") + " || '\"', '') || coalesce(',\"ipfix.destinationIPv4Address\":\"' || " + IP4.format("e0id12") + " || '\"', '') || ',\"ipfix.protocolIdentifier\":\"' || " + names_sql("e0id4", S.PROTOCOLS) + " || '\"' || coalesce(',\"ipfix.tcpControlBits\":\"' || " + FLAGS + " || '\"', '') || ',\"ipfix.octetDeltaCount\":' || CAST(e0id1 AS VARCHAR) || ',\"ipfix.packetDeltaCount\":' || CAST(e0id2 AS VARCHAR) || '}' AS json FROM f")


# Conditions in Spark SQL, and what they mean in plain SQL.
CONDITIONS = {
    "sql_compare": ("%byt >= num('20k') AND %pkt < 30", "e0id1 >= 20000 AND e0id2 < 30"),
    "sql_suffixes": ("%byt > num('0.05m') OR %byt < num('0x3e8') OR %byt = num('12345u')", "e0id1 > 50000 OR e0id1 < 1000 OR e0id1 = 12345"),
    "sql_network": ("in_net(%srcip4, '10.0.0.0/27') OR in_net(%dstip4, '192.168.0.128/25')", "e0id8 BETWEEN 167772160 AND 167772191 OR e0id12 BETWEEN 3232235648 AND 3232235775"),
    "sql_not_network": ("NOT in_net(%srcip4, '10.0.0.0/29')", "NOT coalesce(e0id8 BETWEEN 167772160 AND 167772167, false)"),
    "sql_network6": ("in_net6(%srcip6, '20010db800000000000000000000000')", "coalesce(starts_with(e0id27, '20010db800000000000000000000000'), false)"),
    "sql_address": ("%srcip4 = ip4('10.0.0.7')", "e0id8 = 167772167"),
    "sql_flags_all": ("all_flags(%flg, flag_bits('SA')) AND NOT any_flags(%flg, flag_bits('f'))", "coalesce(e0id6 & 18 = 18, false) AND NOT coalesce(e0id6 & 1 > 0, false)"),
    "sql_names": ("%proto = proto('TCP') AND %dp IN (port('http'), port('https'), port('smtp'))", "e0id4 = 6 AND e0id11 IN (80, 443, 25)"),
    "sql_exists": ("%flg IS NOT NULL AND %sa6 IS NULL", "e0id6 IS NOT NULL AND e0id27 IS NULL"),
    "sql_time": ("%ts >= millis('1996/01/06.00:00:00') AND %te <= millis('1996/01/16.12:30:00')", "e0id152 >= 820886400000 AND e0id153 <= 821795400000"),
    "sql_precedence": ("%proto = 17 OR %proto = 6 AND %pkt > 25", "e0id4 = 17 OR (e0id4 = 6 AND e0id2 > 25)"),
    "sql_flat_left": ("(%proto = 17 OR %proto = 6) AND %pkt > 25", "(e0id4 = 17 OR e0id4 = 6) AND e0id2 > 25"),
    "sql_text": ("%httph LIKE 'host1%.example' AND %httph NOT LIKE '%2.example'", "e16982id501 LIKE 'host1%.example' AND e16982id501 NOT LIKE '%2.example'"),
    "sql_domain": ("odid IN (1, 3) AND (%sas BETWEEN 64512 AND 64530 OR %das IS NULL)", "odid IN (1, 3) AND (e0id16 BETWEEN 64512 AND 64530 OR e0id17 IS NULL)"),
    "sql_either": ("((%dp = 53) IS TRUE) != ((%byt > 30000) IS TRUE)", "(e0id11 = 53) IS TRUE <> (e0id1 > 30000) IS TRUE"),
    "sql_columns": ("%sp > %dp * 100 OR %byt > %pkt * 1900", "e0id7 > e0id11 * 100 OR e0id1 > e0id2 * 1900"),
}


def add_conditions() -> None:
    for name, (condition, sql) in CONDITIONS.items():
        add(name, lambda f, c=condition: where(f, c).groupBy("e0id4").agg(F.count("*").alias("flows"), F.sum("e0id1").alias("byt"), F.min("e0id152").alias("ts")), f"SELECT e0id4, count(*) AS flows, CAST(sum(e0id1) AS BIGINT) AS byt, min(e0id152) AS ts FROM f WHERE {sql} GROUP BY e0id4")
    having = "SELECT e0id8, " + AGG + " FROM f WHERE e0id4 = 6 AND e0id8 IS NOT NULL GROUP BY e0id8 HAVING sum(e0id1) > 200000 AND count(*) >= 5"
    add("sql_having", lambda f: where(A.aggregate(where(f, "%proto = proto('tcp')"), ("sa4",)), "%byt > num('200k') AND flows >= 5"), having)


def add_all() -> None:
    """Fill QUERIES and ORACLES. Columns need a session, so they are made only when a query is called."""
    if not QUERIES:
        for part in (add_filters, add_conditions, add_aggregates, add_top, add_functions, add_enrichment, add_routing_and_stats, add_formats):
            part()
