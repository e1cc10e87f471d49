"""Null keys, empty tables, repeated rows, hot keys and clashing names, which the Parquet tables do not have."""

import collections

import pytest

from keystrata.functions import keys, text, units
from keystrata.operators import joins, metering, pruning, sorting
from keystrata.plans import report
from keystrata.sources import relations

R = [(1, "a"), (1, "b"), (None, "c"), (2147483647, "d"), (4294967295, "e"), (7, "f"), (7, "f")]
S = [(1, "p"), (1, "q"), (None, "r"), (4294967295, "s"), (7, "t"), (9, "u")]
WANT = sorted((k, x, k, y) for k, x in R for j, y in S if k is not None and k == j)


def sides(spark, r=R, s=S):
    return spark.createDataFrame(r, "r long, x string"), spark.createDataFrame(s, "s long, y string")


@pytest.mark.parametrize("algorithm", sorted(joins.HINTS))
def test_joins_never_match_null_and_pair_repeats_fully(spark, algorithm):
    r, s = sides(spark)
    assert sorted(map(tuple, joins.equi_join(r, s, "r", "s", algorithm).collect())) == WANT
    assert joins.equi_join(r.limit(0), s, "r", "s", algorithm).count() == 0


def test_range_joins_give_the_same_rows(spark):
    r, s = sides(spark)
    assert sorted(map(tuple, pruning.range_joined(r, s, "r", "s", 5).collect())) == WANT
    assert sorted(map(tuple, pruning.range_pruned_join(r, s, "r", "s").collect())) == WANT
    runs = pruning.run_pair_join(r, s, "r", "s", ["r", "x"], ["s", "y"], 2)
    assert sorted(tuple(x)[2:] for x in runs.collect()) == WANT
    empty = r.limit(0)
    assert pruning.range_joined(empty, s, "r", "s", 5).count() == pruning.range_pruned_join(empty, s, "r", "s").count() == 0
    assert pruning.run_pair_join(empty, s, "r", "s", ["r"], ["s"], 2).count() == 0


def test_ranks_of_hot_and_repeated_keys(spark):
    """Half of the rows have one key, and whole rows repeat; the names in use are taken."""
    data = [(5 if i % 2 else i, i % 3, i) for i in range(4000)]
    df = spark.createDataFrame(data, "k long, _part long, _place long").repartition(4)
    ranked = sorting.with_rank(df, ["k"], parts=16)
    got = sorted(map(tuple, ranked.select("rank", "k", "_part", "_place").collect()))
    assert [g[0] for g in got] == list(range(1, 4001)) and [g[1] for g in got] == sorted(d[0] for d in data)
    assert collections.Counter(g[1:] for g in got) == collections.Counter(data)
    sizes = sorting.staged(df.repartitionByRange(16, "k", "_place")).inputFiles()
    assert len(sizes) > 8
    assert sorting.with_rank(df.limit(0), ["k"]).count() == 0
    assert sorted(r.row_no for r in relations.slice_rows(df, ["k", "_place"], 3990, 4100).collect()) == list(range(3990, 4001))


def test_bounds_and_ranges(spark):
    df = spark.createDataFrame([(5 if i % 2 else i,) for i in range(4000)] + [(None,)], "k long")
    bounds = sorting.range_bounds(df, "k", 8)
    assert bounds == sorted(set(bounds)) and 5 in bounds and len(bounds) <= 7
    part = {r.k: r.p for r in df.distinct().withColumn("p", sorting.range_part(df["k"], bounds)).collect()}
    assert part[None] == 0 and all(p == sum(b <= k for b in bounds) for k, p in part.items() if k is not None)
    assert sorting.range_bounds(df.limit(0), "k", 8) == []


def test_run_pairs_match_a_plain_comparison(spark):
    stats = lambda rows: spark.createDataFrame(rows, "run long, lowest_key long, highest_key long, n long")
    r = [(0, 0, 5, 3), (1, 5, 5, 3), (2, 5, 900, 3), (3, 901, 1000, 3)]
    s = [(0, -50, -3, 2), (1, 5, 7, 2), (2, 8, 8, 2), (3, 950, 5000, 2)]
    want = sorted((a[0], b[0], max(a[1], b[1]), min(a[2], b[2])) for a in r for b in s if a[1] <= b[2] and b[1] <= a[2])
    assert sorted(map(tuple, pruning.run_pairs(stats(r), stats(s)).collect())) == want
    assert pruning.run_pairs(stats(r), stats([])).count() == 0


def test_lookup_and_downsampling_with_clashing_names(spark):
    rows, dim = spark.createDataFrame([(1, 10), (None, 11), (3, 12)], "dim_key long, first_match long"), spark.createDataFrame([(1, 2, 7), (1, 1, 8), (None, 0, 9)], "k long, o long, v long")
    got = sorted(map(tuple, joins.lookup_first(rows, dim, "dim_key", "k", ["o"], ["v"]).collect()), key=str)
    assert got == sorted([(1, 10, 8), (None, 11, None), (3, 12, None)], key=str)
    e = spark.sql("SELECT timestamp_ntz'2024-01-01 00:10:00' AS ts, 1L AS id, 5L AS _last, 7L AS u UNION ALL SELECT timestamp_ntz'2024-01-01 00:10:00', 2L, 6L, 7L")
    assert [(r.u, r.id, r._last) for r in metering.downsample_last(e, ["u"], "ts", "id", "hour").collect()] == [(7, 2, 6)]


def test_text_relations_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(12, "a"), (7, "b" * 100_000), (None, None), (-4, "e|f")], "k long, v string")
    relations.write_delimited(df, f"{tmp_path}/lines", ["k", "v"])
    loaded = relations.read_delimited(spark, f"{tmp_path}/lines")
    assert sorted(r.key for r in loaded.collect()) == [-4, 0, 7, 12] and max(len(r.value) for r in loaded.collect()) == 100_003
    relations.write_relation(loaded, f"{tmp_path}/out", "key")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
    relations.write_report(df.select("k"), f"{tmp_path}/report")
    assert spark.read.option("header", True).csv(f"{tmp_path}/report").columns == ["k"]
    assert relations.size_estimate(df, "v", 1.0).first().sampled == 4


def test_functions_of_null_and_odd_values(spark):
    df = spark.createDataFrame([(None, None), ("12|x", -1234567), (" 7abc|", 0), ("|c", 999), ("99999999999999999999|", 1000), ("0x1F|", 5), ("017|", 5), ("-0x10|", 5), ("1.5e3J", 5)], "t string, n long")
    out = [tuple(r) for r in df.select(keys.text_key(df.t), text.thousands(df.n), text.text_to_long(df.t), text.text_to_double(df.t)).collect()]
    assert out == [
        (None, None, None, None), (12, "(1,234,567)", 12, 12.0), (7, "0", 7, 7.0), (0, "999", 0, 0.0), (0, "1,000", 0, 1e20), (0, "5", 31, 0.0), (17, "5", 15, 17.0), (0, "5", -16, 0.0), (1, "5", 1, 1500.0),
    ]
    n = df.n
    got = [tuple(r) for r in df.select(units.busy_percent(n, n), units.temperature_limit(n.cast("bigint")), metering.tsc_mhz(n, n, n - n)).limit(1).collect()]
    assert got == [(None, 100, None)]


def test_reports(spark):
    o = spark.range(2500).withColumnRenamed("id", "k")
    assert [tuple(r) for r in report.partition_report({"R": o, "S": o.limit(0)}, 1000, 2).collect()] == [("R", 2500, 1000, 3, 2), ("S", 0, 1000, 0, 0)]
    entries = {r.entry: r.value for r in report.join_report(spark, {"sort": o.orderBy("k"), "join": joins.equi_join(o, o.withColumnRenamed("k", "j"), "k", "j")}).collect()}
    assert entries["Total Join Count"] == 2500 and {"Total Sort Time", "Total Join Time", "Total Total Time"} <= set(entries)
    row = report.formatted(spark.range(1).selectExpr(*[f"id + 1 AS {c}" for c in report.SENSOR_COLUMNS]), report.SENSOR_PATTERNS).first()
    assert len(row) == 21 and row.voltage == "1.000000" and row.system_time == "1"
    with pytest.raises(ValueError):
        sorting.merge_passes(5, 1)
