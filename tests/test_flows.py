import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowmill.functions import predicates as P
from flowmill.functions import scalars as S
from flowmill.functions import sql
from flowmill.operators import aggregate, enrich, lifecycle, route, stats
from flowmill.sources import formats, sinks
from flowmill.sources.flows import flows
from flowmill.streaming import pipeline

DATA = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline" and n in entry.oracle_sql()]


def rows(names, values):
    show = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(show(r[n]) for n in names) for r in values), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("lineitem", "orders", "supplier", "nation", "events", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = entry.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert rows(names, got.collect()) == rows(names, [dict(zip(names, r, strict=True)) for r in want.fetchall()])


@pytest.mark.parametrize("op,present,absent", [("=", False, False), ("!=", True, True), ("<", True, False), (">=", False, False)])
def test_absent_elements_are_two_valued(spark, op, present, absent):
    df = spark.createDataFrame([(1, 3), (2, None)], "id int, e0id6 int")
    got = {r.id: r for r in df.select("id", P.compare("flg", op, 5).alias("p"), (~P.compare("flg", op, 5)).alias("n")).collect()}
    assert (got[1].p, got[1].n, got[2].p, got[2].n) == (present, not present, absent, not absent)


def test_anonymised_addresses_share_exactly_their_prefixes(spark):
    ips = [0x0A000001, 0x0A000002, 0x0A010001, 0xC0A80001, 0x0A000003]
    df = spark.createDataFrame([(i,) for i in ips], "ip long").select("ip", S.prefix_preserving(F.col("ip"), bytes(range(32))).alias("a"))
    got = {r.ip: r.a for r in df.collect()}
    shared = lambda a, b: 32 - (a ^ b).bit_length()
    assert all(shared(a, b) == shared(got[a], got[b]) for a in ips for b in ips)


def test_unknown_channel_source_is_refused():
    with pytest.raises(ValueError):
        route.labels(route.Profile("q", [route.Channel("b", 1, ("c",))]), "", {"a": 1})


def test_stream_equals_batch(spark, tmp_path):
    f = flows(spark, DATA)
    f.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = pipeline.windowed(pipeline.flow_stream(spark, str(tmp_path / "in"), f.schema, 10), late="5000 days")
    query = stream.writeStream.format("memory").queryName("t").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    want = stats.by_window(f)
    got = spark.table("t").select(want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_crypto_pan_known_answers(spark):
    """The published sample: its key, addresses and their anonymised forms."""
    key = bytes([21, 34, 23, 141, 51, 164, 207, 128, 19, 10, 91, 22, 73, 144, 125, 16, 216, 152, 143, 131, 121, 121, 101, 39, 98, 87, 76, 45, 42, 132, 34, 2])
    pairs = [("128.11.68.132", "135.242.180.132"), ("129.118.74.4", "134.136.186.123"), ("130.132.252.244", "133.68.164.234"), ("141.223.7.43", "141.167.8.160"), ("192.102.249.13", "252.138.62.131")]
    df = spark.createDataFrame(pairs, "plain string, hidden string")
    got = df.select("hidden", S.ipv4_text(S.prefix_preserving(S.ipv4_number(F.col("plain")), key)).alias("g")).collect()
    assert [r.g for r in got] == [r.hidden for r in got]


def test_numbers_are_decimal():
    assert all(P.number(f"{n / 1000:.3f}k") == n for n in range(0, 20000, 7))
    assert (P.number("0x1F"), P.number("5u"), P.number("1.5M"), P.number("2.5"), P.number(7)) == (31, 5, 1_500_000, 2.5, 7)


def test_children_of_a_profile_without_channels_get_nothing(spark):
    tree = route.Profile("top", [], [route.Profile("child", [route.Channel("c")])])
    df = spark.createDataFrame([(1,)], "odid long")
    assert route.classify(df, tree).first().channels == []


def test_filters_keep_some_rows_and_drop_some(spark):
    entry.queries()
    from flowmill.plans.registry import CONDITIONS, FILTERS

    f = flows(spark, DATA).persist()
    whole = f.count()
    for name, (predicate, _) in FILTERS.items():
        assert 0 < f.filter(predicate()).count() < whole, name
    for name, (condition, _) in CONDITIONS.items():
        assert 0 < sql.where(f, condition).count() < whole, name
    f.unpersist()


def test_conditions_reach_the_scan_and_say_what_is_wrong(spark, tmp_path):
    flows(spark, DATA).write.parquet(str(tmp_path / "f"))
    f = spark.read.parquet(str(tmp_path / "f"))
    assert "GreaterThanOrEqual(e0id1,20000)" in plan(sql.where(f, "%byt >= num('20k')").select("e0id2"))
    assert "GreaterThanOrEqual(e0id8,167772160), LessThan(e0id8,167772192)" in plan(sql.where(f, "in_net(%srcip4, '10.0.0.0/27')").select("e0id2"))
    assert "GreaterThanOrEqual(e0id8" in plan(f.filter(P.in_network("sa4", "10.0.0.0/27")))
    assert sql.problem(f, "%byt > 5") is None and "nosuch" in sql.problem(f, "%nosuch > 5") and "%fl" in sql.problem(f, "%fl > 5")
    (tmp_path / "filter.txt").write_text("%proto = proto('udp')\n AND %byt > num('30k')")
    assert sql.where_file(f, str(tmp_path / "filter.txt")).count() == f.filter("e0id4 = 17 AND e0id1 > 30000").count() > 0
    assert sql.columns_of("%httph LIKE '%dp' AND %dp = 1") == "`e16982id501` LIKE '%dp' AND `e0id11` = 1"


def test_top_n_scans_once(spark):
    top = plan(aggregate.top_n(flows(spark, DATA), "sa4", "byt"))
    assert top.count("FileScan") == 1 and top.count("Exchange hashpartitioning(e0id8") == 1


def test_consolidated_series_differ(spark):
    series = stats.consolidate(stats.by_window(flows(spark, DATA)), ("odid",), "bytes_total", 300_000, 24)
    assert series.filter("bytes_total_avg < bytes_total_max").count() > 10


def test_users_are_carried_over_slices(spark):
    """Against a look at the whole log for each flow, with slices from an hour to all of time."""
    log = spark.createDataFrame([(1, 100, 1, "a"), (1, 5000, 0, "a"), (1, 90_000, 1, "b"), (2, 50, 1, "c")], "ip long, time long, action int, name string")
    starts = [(ip, at * 1000) for ip in (1, 2, 3, None) for at in (0, 99, 100, 4999, 5000, 80_000, 90_000, 400_000)]
    f = spark.createDataFrame(starts, "e0id8 long, e0id152 long")
    want = {}
    for ip, at in starts:
        past = [(t, a, n) for i, t, a, n in log.collect() if i == ip and t * 1000 <= at]
        want[ip, at] = max(past)[2] if past and max(past)[1] == 1 else ""
    for step in (3600, 86_400, 1 << 40):
        assert {(r.e0id8, r.e0id152): r.srcName for r in enrich.user_at(f, log, slice_seconds=step).collect()} == want


def test_losses_do_not_depend_on_slices(spark):
    rows = [("x", k, (4294967290 + 3 * k + (5 if k > 7 else 0)) % (1 << 32), 3) for k in range(20)] + [("y", 1, 10, 4)]
    df = spark.createDataFrame(rows, "source string, n long, seq long, records long")
    for step in (1, 4, 1000):
        assert {r.source: (r.received, r.lost) for r in stats.losses(df, "source", "seq", "records", "n", step).collect()} == {"x": (60, 5), "y": (4, 0)}


def test_countries_of_ipv6(spark):
    wide = lambda x: bytearray(bytes.fromhex(x.ljust(32, "0")))
    blocks = spark.createDataFrame([(wide("20010db8"), wide("20010db8ff"), 7), (wide("20010db900"), wide("20010dba00"), 8)], "lo binary, hi binary, code int")
    f = spark.createDataFrame([(wide("20010db801"),), (wide("20010db9ffff"),), (wide("fe80"),), (None,)], "e0id27 binary")
    assert sorted(r.srcCountry for r in enrich.country(f, blocks, "sa6").collect()) == [0, 0, 7, 8]


def test_formats(spark):
    df = spark.createDataFrame([(1000, 3500, 6, 167772161, None, 80, None, 10, 5000, 18, None)], "e0id152 long, e0id153 long, e0id4 int, e0id8 long, e0id12 long, e0id7 int, e0id11 int, e0id2 long, e0id1 long, e0id6 int, e0id27 binary")
    line = lambda form: formats.lines(df, form).first().line
    assert line("line4") == "1970-01-01 00:00:01.000 2.500 TCP 10.0.0.1:80 -> NULL:0 10 5000 1"
    assert line("fmt:%srcip4 %byt %bps%%flg|%sa6 %none") == "10.0.0.1 5000 16000%.A..S.|NULL NULL"
    assert formats.projected(df, "fmt:%byt %none %byt %dstip4").columns == ["byt", "da4"]
    assert formats.table(df, "fmt:%byt %flg").splitlines() == [" byt     flg", "5000  .A..S.", "1 rows"]


def test_writers(spark, tmp_path):
    f = flows(spark, DATA).filter("odid = 1").withColumn("window_start", S.window_start(F.col("e0id153"), 7 * 86_400_000))
    lifecycle.write_flows(f, str(tmp_path / "f"), records=200)
    stored = spark.read.parquet(str(tmp_path / "f"))
    assert stored.count() == f.count() and stored.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 200
    assert "PartitionFilters: [isnotnull(window_start" in plan(lifecycle.between(spark, str(tmp_path / "f"), 0, 1))
    lifecycle.compact(spark, str(tmp_path / "f"), str(tmp_path / "c"), 28 * 86_400_000)
    whole = spark.read.parquet(str(tmp_path / "c"))
    assert whole.count() == f.count() and whole.select("window_start").distinct().count() < stored.select("window_start").distinct().count()
    url = "jdbc:derby:memory:flows;create=true"
    few = f.select(F.col("e0id1").alias("BYT"), F.col("e0id4").alias("PR")).limit(20)
    sinks.to_jdbc(few, url, "256", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    assert spark.read.jdbc(url, "Template256", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}).count() == 20
    records = sinks.json_records(f)
    messages = sinks.kafka_rows(records, 4)
    assert messages.count() == f.count() and {r.partition for r in messages.select("partition").distinct().collect()} == {0, 1, 2, 3}
    assert messages.select(F.col("value").cast("string").alias("json")).exceptAll(records).count() == 0
    sinks.write_json_windows(f, str(tmp_path / "j"), 86_400_000, times=True)
    days = {p.name for p in (tmp_path / "j").iterdir() if p.is_dir()}
    assert "window=199601010000" in days and spark.read.json(str(tmp_path / "j")).count() == f.count()


def test_stream_is_stored(spark, tmp_path):
    f = flows(spark, DATA)
    f.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = pipeline.flow_stream(spark, str(tmp_path / "in"), f.schema).filter(P.compare("proto", "=", 6))
    pipeline.store(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == f.filter("e0id4 = 6").count()


def test_late_flows_are_left_out(spark, tmp_path):
    f = flows(spark, DATA).limit(1)
    at = lambda ms: f.withColumn("e0id153", F.lit(ms).cast("long"))
    for k, ms in enumerate((10 * 3_600_000, 20 * 3_600_000, 3_600_000)):  # the third comes 19 hours late
        at(ms).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = pipeline.windowed(pipeline.flow_stream(spark, str(tmp_path / "in"), f.schema), late="1 hour")
    query = stream.writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert 3_600_000 not in {r.window_start for r in spark.table("late").collect()} and spark.table("late").count() >= 1


def test_a_busy_domain_is_written_by_several_tasks(spark, tmp_path):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    flows(spark, DATA).filter("odid = 1").repartition(8).write.parquet(str(tmp_path / "in"))
    f = spark.read.parquet(str(tmp_path / "in"))
    before = spark.conf.get(key)
    spark.conf.set(key, "8k")
    try:
        lifecycle.write_flows(f, str(tmp_path / "out"), ("odid",))
    finally:
        spark.conf.set(key, before)
    assert len(list((tmp_path / "out" / "odid=1").glob("*.parquet"))) > 1
    stored = spark.read.parquet(str(tmp_path / "out")).select(f.columns)
    assert stored.exceptAll(f).count() == 0 and f.exceptAll(stored).count() == 0
