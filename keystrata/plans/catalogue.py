"""The named queries: each a callable (spark, sf_dir) -> DataFrame with its SQL for the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits, keys, text, units
from ..operators import joins, metering, pruning, sorting
from ..sources import relations
from ..sources.shared import shared_folder, staged
from . import report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLE[name] = sql
        return query

    return add


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [relations.table(spark, sf_dir, n) for n in names]


# Joins ---------------------------------------------------------------------------------------------------------

CUSTOMER_ORDERS = "SELECT c_custkey, o_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey"
ORDERS_LINEITEM = "SELECT o_orderkey, l_orderkey, l_linenumber, l_partkey, o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
ORDERS_LINEITEM_COLUMNS = ["o_orderkey", "l_orderkey", "l_linenumber", "l_partkey", "o_custkey"]


@register("smj_customer_orders", CUSTOMER_ORDERS)
def smj_customer_orders(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "orders")
    return joins.equi_join(c, o, "c_custkey", "o_custkey", "sort_merge").select("c_custkey", "o_custkey", "c_name", "o_orderkey")


def _orders_lineitem(algorithm: str, swapped: bool = False) -> Query:
    def query(spark, sf_dir):
        o, l = _t(spark, sf_dir, "orders", "lineitem")
        sides = (l, o, "l_orderkey", "o_orderkey") if swapped else (o, l, "o_orderkey", "l_orderkey")
        return joins.equi_join(*sides, algorithm).select(*ORDERS_LINEITEM_COLUMNS)

    return query


register("smj2_orders_lineitem", ORDERS_LINEITEM)(_orders_lineitem("sort_merge"))
register("smj2_orders_lineitem_swapped", ORDERS_LINEITEM)(_orders_lineitem("sort_merge", swapped=True))
register("tsmj_orders_lineitem", ORDERS_LINEITEM)(_orders_lineitem("parallel_sort_merge"))
register("ghj_orders_lineitem", ORDERS_LINEITEM)(_orders_lineitem("grace_hash", swapped=True))
register("hhj_orders_lineitem", ORDERS_LINEITEM)(_orders_lineitem("hybrid_hash", swapped=True))
register("bnlj_orders_lineitem", ORDERS_LINEITEM)(_orders_lineitem("block_nested_loop", swapped=True))


@register("smj_presorted", ORDERS_LINEITEM)
def smj_presorted(spark, sf_dir):
    """Inputs dealt and sorted on the key first; the join adds no exchange of its own."""
    o, l = _t(spark, sf_dir, "orders", "lineitem")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    o, l = o.repartition(n, "o_orderkey").sortWithinPartitions("o_orderkey"), l.repartition(n, "l_orderkey").sortWithinPartitions("l_orderkey")
    return joins.equi_join(o, l, "o_orderkey", "l_orderkey", "sort_merge").select(*ORDERS_LINEITEM_COLUMNS)


RUN_ROWS = 2000


@register(
    "psmj_plan1_run_scan",
    f"""WITH r AS (SELECT o_orderkey, o_custkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // {RUN_ROWS} AS r_run FROM orders),
    s AS (SELECT l_orderkey, l_linenumber, (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) // {RUN_ROWS} AS s_run FROM lineitem)
    SELECT r_run, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM r JOIN s ON o_orderkey = l_orderkey GROUP BY r_run""",
)
def psmj_plan1_run_scan(spark, sf_dir):
    o, l = _t(spark, sf_dir, "orders", "lineitem")
    o = o.select("o_orderkey", "o_custkey")
    l = l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    joined = pruning.run_pair_join(o, l, "o_orderkey", "l_orderkey", ["o_orderkey"], order, RUN_ROWS)
    return joined.groupBy("r_run").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


@register("psmj_plan2_shared", "SELECT o_orderkey, c_custkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def psmj_plan2_shared(spark, sf_dir):
    o, c = _t(spark, sf_dir, "orders", "customer")
    return joins.equi_join(o, c, "o_custkey", "c_custkey", "shared_scan").select("o_orderkey", "c_custkey", "o_custkey", "c_mktsegment")


@register("psmj_plan3_range", ORDERS_LINEITEM)
def psmj_plan3_range(spark, sf_dir):
    """Both sides cut by the same key bounds, joined on (range, key)."""
    o, l = _t(spark, sf_dir, "orders", "lineitem")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return pruning.range_joined(o, l, "o_orderkey", "l_orderkey", n).select(*ORDERS_LINEITEM_COLUMNS)


@register("psmjrp_join_by_range", "SELECT o_orderkey // 1000 AS key_range, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def psmjrp_join_by_range(spark, sf_dir):
    o, l = _t(spark, sf_dir, "orders", "lineitem")
    joined = joins.equi_join(o, l, "o_orderkey", "l_orderkey", "parallel_sort_merge", partitions=8)
    return joined.groupBy(F.floor(F.col("o_orderkey") / F.lit(1000)).cast("bigint").alias("key_range")).agg(F.count(F.lit(1)).alias("n"))


@register("bnlj_part_lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, p_partkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def bnlj_part_lineitem(spark, sf_dir):
    l, p = _t(spark, sf_dir, "lineitem", "part")
    return joins.equi_join(l, p, "l_partkey", "p_partkey", "block_nested_loop").select("l_orderkey", "l_linenumber", "l_partkey", "p_partkey", "p_brand")


@register("ghj_supplier_lineitem", "SELECT l_orderkey, l_linenumber, l_suppkey, s_suppkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def ghj_supplier_lineitem(spark, sf_dir):
    l, s = _t(spark, sf_dir, "lineitem", "supplier")
    return joins.equi_join(l, s, "l_suppkey", "s_suppkey", "grace_hash").select("l_orderkey", "l_linenumber", "l_suppkey", "s_suppkey", "s_name")


@register("hhj_nation_customer", "SELECT c_custkey, c_nationkey, n_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def hhj_nation_customer(spark, sf_dir):
    c, n = _t(spark, sf_dir, "customer", "nation")
    return joins.equi_join(c, n, "c_nationkey", "n_nationkey", "hybrid_hash").select("c_custkey", "c_nationkey", "n_nationkey", "n_name")


@register("ghj_partition_sizes", "SELECT l_suppkey % 16 AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def ghj_partition_sizes(spark, sf_dir):
    return joins.partition_sizes(relations.table(spark, sf_dir, "lineitem"), "l_suppkey", 16)


@register("join_cardinality", "SELECT count(DISTINCT o_orderkey) AS n_keys, count(*) AS n_rows FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def join_cardinality(spark, sf_dir):
    return joins.join_cardinality(*_t(spark, sf_dir, "orders", "lineitem"), "o_orderkey", "l_orderkey")


@register("self_join_mn", "SELECT a.l_orderkey, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey GROUP BY 1")
def self_join_mn(spark, sf_dir):
    l = relations.table(spark, sf_dir, "lineitem").select("l_orderkey")
    return joins.equi_join(l, l.withColumnRenamed("l_orderkey", "other_key"), "l_orderkey", "other_key", "sort_merge").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@register("concat_projection", "SELECT n_nationkey AS key, (n_nationkey || '|' || n_name || '|') || (r_regionkey || '|' || r_name || '|') AS value FROM nation JOIN region ON n_nationkey = r_regionkey")
def concat_projection(spark, sf_dir):
    n, r = _t(spark, sf_dir, "nation", "region")
    left = n.select(F.concat_ws("|", "n_nationkey", "n_name", F.lit("")).alias("value"))
    right = r.select(F.concat_ws("|", "r_regionkey", "r_name", F.lit("")).alias("value"))
    return joins.concat_join(left, right)


@register(
    "lookup_first_match",
    """SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 2 THEN 0 ELSE p_size END AS power, CASE WHEN s_nationkey % 3 = 2 THEN 0 ELSE p_partkey END AS latency
    FROM supplier LEFT JOIN (SELECT p_size, min(p_partkey) AS p_partkey FROM part GROUP BY p_size) p ON s_nationkey = p_size""",
)
def lookup_first_match(spark, sf_dir):
    """State rows take the values of the first matching dimension row; flag 2 zeroes them."""
    s, p = _t(spark, sf_dir, "supplier", "part")
    found = joins.lookup_first(s, p, "s_nationkey", "p_size", ["p_partkey"], ["p_size", "p_partkey"])
    zero = F.col("s_nationkey") % 3 == 2
    return found.select("s_suppkey", F.when(zero, F.lit(0)).otherwise(F.col("p_size")).alias("power"), F.when(zero, F.lit(0)).otherwise(F.col("p_partkey")).alias("latency"))


# Sorts and runs --------------------------------------------------------------------------------------------------

SORTED_ORDERS = "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS rank FROM orders"


@register("ext_sort_orders", SORTED_ORDERS)
def ext_sort_orders(spark, sf_dir):
    o = relations.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return sorting.with_rank(o, ["o_custkey", "o_orderkey"])


@register("ext_sort_total_order", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey")
def ext_sort_total_order(spark, sf_dir):
    return sorting.external_sort(relations.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"])


@register("sort_topk", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY l_partkey DESC, l_orderkey, l_linenumber, l_suppkey LIMIT 100")
def sort_topk(spark, sf_dir):
    l = relations.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return sorting.top_k(l, [F.desc("l_partkey"), "l_orderkey", "l_linenumber", "l_suppkey"], 100)


RUNS_SQL = "SELECT {key} AS k, (row_number() OVER (ORDER BY {order}) - 1) // 1000 AS run FROM {table}"


@register("run_stats", f"SELECT run, min(k) AS lowest_key, max(k) AS highest_key, count(*) AS n FROM ({RUNS_SQL.format(key='o_custkey', order='o_custkey, o_orderkey', table='orders')}) GROUP BY run")
def run_stats(spark, sf_dir):
    o = relations.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return sorting.run_stats(sorting.make_runs(o, ["o_custkey", "o_orderkey"], 1000), "o_custkey")


STATS_SQL = f"""WITH r AS (SELECT run, min(k) lo, max(k) hi FROM ({RUNS_SQL.format(key='o_custkey', order='o_custkey, o_orderkey', table='orders')}) GROUP BY run),
    s AS (SELECT run, min(k) lo, max(k) hi FROM ({RUNS_SQL.format(key='c_custkey', order='c_custkey', table='customer')}) GROUP BY run) """


def _stats(spark, sf_dir):
    o, c = _t(spark, sf_dir, "orders", "customer")
    r = sorting.run_stats(sorting.make_runs(o.select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], 1000), "o_custkey")
    return r, sorting.run_stats(sorting.make_runs(c.select("c_custkey"), ["c_custkey"], 1000), "c_custkey")


@register("run_pair_pruning", STATS_SQL + "SELECT r.run AS r_run, s.run AS s_run, greatest(r.lo, s.lo) AS lowest, least(r.hi, s.hi) AS highest FROM r JOIN s ON r.lo <= s.hi AND s.lo <= r.hi")
def run_pair_pruning(spark, sf_dir):
    return pruning.run_pairs(*_stats(spark, sf_dir))


@register("run_skip_counts", STATS_SQL + "SELECT r.run AS r_run, count(*) FILTER (r.lo <= s.hi AND s.lo <= r.hi) AS n_read, count(*) FILTER (r.lo > s.hi OR s.lo > r.hi) AS n_skipped FROM r CROSS JOIN s GROUP BY 1")
def run_skip_counts(spark, sf_dir):
    return pruning.pair_counts(*_stats(spark, sf_dir))


@register("range_pruned_join", "SELECT l_orderkey, l_linenumber, l_suppkey, c_custkey FROM lineitem JOIN customer ON l_suppkey = c_custkey")
def range_pruned_join(spark, sf_dir):
    l, c = _t(spark, sf_dir, "lineitem", "customer")
    return pruning.range_pruned_join(l, c, "l_suppkey", "c_custkey").select("l_orderkey", "l_linenumber", "l_suppkey", "c_custkey")


@register(
    "run_descriptors_sorted",
    f"SELECT run, min(k) AS lowest_key, max(k) AS highest_key, count(*) AS n FROM ({RUNS_SQL.format(key='o_custkey', order='o_custkey, o_orderkey', table='orders')}) GROUP BY run ORDER BY lowest_key, run",
)
def run_descriptors_sorted(spark, sf_dir):
    return sorting.sorted_descriptors(run_stats(spark, sf_dir))


@register(
    "merge_pass_counts",
    """WITH RECURSIVE f AS (SELECT unnest([2, 3, 8, 16, 64])::BIGINT AS fan_in, ceil((SELECT count(*) FROM lineitem) / 1000)::BIGINT AS n_runs),
    p AS (SELECT fan_in, n_runs, n_runs AS now, 0::BIGINT AS passes FROM f UNION ALL SELECT fan_in, n_runs, (now + fan_in - 1) // fan_in, passes + 1 FROM p WHERE now > 1)
    SELECT fan_in, n_runs, max(passes) AS passes FROM p GROUP BY fan_in, n_runs""",
)
def merge_pass_counts(spark, sf_dir):
    return sorting.merge_report(relations.table(spark, sf_dir, "lineitem"), 1000, [2, 3, 8, 16, 64])


# Sources ---------------------------------------------------------------------------------------------------------


@register("delimited_key_parse", "SELECT o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' AS value, o_orderkey AS key1, o_custkey AS key2 FROM orders")
def delimited_key_parse(spark, sf_dir):
    lines = relations.table(spark, sf_dir, "orders").select(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", F.lit("")).alias("value"))
    one = relations.with_text_key(lines, "value", 1).withColumnRenamed("key", "key1")
    return relations.with_text_key(one, "value", 2).withColumnRenamed("key", "key2")


@register(
    "atoi_keys",
    r"""SELECT p_partkey, p_name AS field, coalesce(try_cast(nullif(regexp_extract(p_name, '^[ \t\n\r\f]*([+-]?[0-9]+)', 1), '') AS BIGINT), 0) AS from_name,
    coalesce(try_cast(nullif(regexp_extract('  -' || p_size || 'x', '^[ \t\n\r\f]*([+-]?[0-9]+)', 1), '') AS BIGINT), 0) AS from_size FROM part""",
)
def atoi_keys(spark, sf_dir):
    p = relations.table(spark, sf_dir, "part")
    dressed = F.concat(F.lit("  -"), F.col("p_size").cast("string"), F.lit("x"))
    return p.select("p_partkey", F.col("p_name").alias("field"), keys.c_atoi(F.col("p_name")).alias("from_name"), keys.c_atoi(dressed).alias("from_size"))


TEXT_RELATIONS = ["o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|'", "l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|'"]


@register("text_load", f"SELECT {TEXT_RELATIONS[0]} AS value, o_custkey AS key FROM orders")
def text_load(spark, sf_dir):
    """A delimited file is written, read line by line, keyed by its second field, and loaded as a sorted relation."""
    lines, loaded = shared_folder(spark, "lines"), shared_folder(spark, "relation")
    relations.write_delimited(relations.table(spark, sf_dir, "orders"), lines, ["o_orderkey", "o_custkey", "o_orderstatus"])
    relations.write_relation(relations.read_delimited(spark, lines, key_pos=2), loaded, "key")
    return spark.read.parquet(loaded)


@register("text_join_output", f"SELECT o_orderkey AS key, ({TEXT_RELATIONS[0]}) || ({TEXT_RELATIONS[1]}) AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def text_join_output(spark, sf_dir):
    """Two delimited files joined on their first fields; every task writes its share of the output, which is read back."""
    paths = [shared_folder(spark, x) for x in ("r", "s", "joined")]
    o, l = _t(spark, sf_dir, "orders", "lineitem")
    relations.write_delimited(o, paths[0], ["o_orderkey", "o_custkey", "o_orderstatus"])
    relations.write_delimited(l, paths[1], ["l_orderkey", "l_linenumber", "l_partkey"])
    relations.write_relation(joins.concat_join(spark.read.text(paths[0]), spark.read.text(paths[1])), paths[2])
    return spark.read.parquet(paths[2])


@register("staged_scan", "SELECT l_returnflag, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY 1")
def staged_scan(spark, sf_dir):
    """A scan of a staged copy."""
    copy = staged(relations.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber"))
    return copy.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


@register("page_slice", "SELECT o_orderkey, row_no, (row_no - 1) // 40 AS page_no FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_no FROM orders) WHERE row_no BETWEEN 81 AND 200")
def page_slice(spark, sf_dir):
    return relations.slice_pages(relations.table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 40, 2, 5)


@register("tuple_count", "SELECT count(*) AS n FROM lineitem")
def tuple_count(spark, sf_dir):
    return relations.tuple_count(relations.table(spark, sf_dir, "lineitem"))


# Metering ----------------------------------------------------------------------------------------------------------

SERIES = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
BY, ORDER = ["user_id"], ["ts", "event_id"]


@register(
    "energy_power",
    f"""WITH e AS (SELECT event_id, user_id, value - lag(value) {SERIES} AS d, epoch_us(ts) - lag(epoch_us(ts)) {SERIES} AS us FROM events)
    SELECT event_id, user_id, round(d, 6) + 0e0 AS delta, us AS micros, round(d / (nullif(us, 0) / 1e6), 6) + 0e0 AS power, round(d * 0.00027777777778::DOUBLE, 9) + 0e0 AS wh FROM e""",
)
def energy_power(spark, sf_dir):
    e = relations.table(spark, sf_dir, "events").select("event_id", "user_id", "value", "ts")
    e = e.select("event_id", "user_id", metering.lag_delta("value", BY, ORDER).alias("d"), metering.elapsed_micros("ts", BY, ORDER).alias("micros"))
    zero = F.lit(0.0)
    return e.select(
        "event_id", "user_id", (F.round("d", 6) + zero).alias("delta"), "micros",
        (F.round(metering.rate(F.col("d"), F.col("micros")), 6) + zero).alias("power"),
        (F.round(units.joule_to_watt_hour(F.col("d")), 9) + zero).alias("wh"),
    )


COUNTER_SQL = "(event_id * 2654435761) % 4294967296"


@register(
    "counter_wrap_delta",
    f"SELECT event_id, user_id, ((d % 4294967296) + 4294967296) % 4294967296 AS delta FROM (SELECT event_id, user_id, c - lag(c) {SERIES} AS d FROM (SELECT *, {COUNTER_SQL} AS c FROM events))",
)
def counter_wrap_delta(spark, sf_dir):
    e = relations.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.expr(COUNTER_SQL).alias("c"))
    return e.select("event_id", "user_id", metering.wrap_delta("c", BY, ORDER).alias("delta"))


@register(
    "process_power_clamp",
    """SELECT event_id, CASE WHEN p BETWEEN 0 AND 100 THEN round(p, 6) + 0e0 ELSE 0e0 END AS process_power FROM
    (SELECT event_id, (CASE WHEN value - 5 BETWEEN 0 AND 100 THEN value - 5 ELSE 0e0 END) / 100e0 * ((user_id % 40)::DOUBLE - 4e0) AS p FROM events)""",
)
def process_power_clamp(spark, sf_dir):
    e = relations.table(spark, sf_dir, "events")
    power = metering.process_power(F.col("value") - 5, (F.col("user_id") % 40).cast("double"), 4.0)
    return e.select("event_id", (F.round(power, 6) + F.lit(0.0)).alias("process_power"))


@register(
    "duty_cycle",
    """WITH e AS (SELECT event_id, (user_id % 30)::DOUBLE AS power FROM events),
    r AS (SELECT *, greatest(power - 10, 0) AS o, greatest(10 - power, 0) AS s FROM e),
    q AS (SELECT *, CASE WHEN power > 10 THEN (CASE WHEN o > 10 THEN 0.75e0 ELSE o / power END) ELSE s / 10 END AS ratio FROM r),
    p AS (SELECT *, floor(ratio * 100)::BIGINT AS part FROM q)
    SELECT event_id, power, o AS power_over, s AS power_supply, round(ratio, 9) + 0e0 AS ratio, CASE WHEN power > 10 THEN part ELSE 100 - part END AS time_sleep,
    CASE WHEN power > 10 THEN 100 - part ELSE part END AS time_execute FROM p""",
)
def duty_cycle(spark, sf_dir):
    e = relations.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 30).cast("double").alias("power"))
    c = metering.duty_cycle(F.col("power"), 10.0, 100)
    c["ratio"] = F.round(c["ratio"], 9) + F.lit(0.0)
    return e.select("event_id", "power", *[v.alias(k) for k, v in c.items() if k not in ("suspends", "executes")])


@register(
    "downsample_last",
    """SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS bucket, unnest(arg_max({'ts': ts, 'event_id': event_id, 'value': value}, (ts, event_id)))
    FROM events GROUP BY user_id, date_trunc('hour', ts)""",
)
def downsample_last(spark, sf_dir):
    e = relations.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return metering.downsample_last(e, ["user_id"], "ts", "event_id", "hour")


@register("cpu_total_running", f"SELECT event_id, user_id, sum(event_id % 97) {SERIES[:-1]} ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM events")
def cpu_total_running(spark, sf_dir):
    e = relations.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_id") % 97).alias("used"))
    return e.select("event_id", "user_id", metering.running_total("used", BY, ORDER).alias("total"))


@register(
    "io_rate",
    f"""WITH e AS (SELECT event_id, user_id, b - lag(b) {SERIES} AS d, epoch_us(ts) - lag(epoch_us(ts)) {SERIES} AS us FROM (SELECT *, event_id * 1048576 * 3 AS b FROM events))
    SELECT event_id, user_id, CASE WHEN us = 0 THEN 0e0 ELSE round(floor(d / 1048576)::DOUBLE / (us::DOUBLE / 1e6), 6) + 0e0 END AS mb_s FROM e""",
)
def io_rate(spark, sf_dir):
    e = relations.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_id") * 1048576 * 3).alias("b"))
    e = e.select("event_id", "user_id", metering.lag_delta("b", BY, ORDER).alias("d"), metering.elapsed_micros("ts", BY, ORDER).alias("us"))
    return e.select("event_id", "user_id", (F.round(metering.io_rate(F.col("d"), F.col("us")), 6) + F.lit(0.0)).alias("mb_s"))


@register(
    "process_usage",
    f"""WITH e AS (SELECT event_id, user_id, event_id - lag(event_id) {SERIES} AS dp, epoch_us(ts) - lag(epoch_us(ts)) {SERIES} AS us FROM events)
    SELECT event_id, user_id, round(dp::DOUBLE * 100 / nullif(us, 0), 9) + 0e0 AS usage FROM e WHERE us IS NULL OR us >= 250000""",
)
def process_usage(spark, sf_dir):
    e = relations.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    e = e.select("event_id", "user_id", "ts", metering.lag_delta("event_id", BY, ORDER).alias("dp"), metering.elapsed_micros("ts", BY, ORDER).alias("us"))
    e = metering.min_gap_samples(e, BY, "ts", ORDER)
    return e.select("event_id", "user_id", (F.round(metering.usage_percent(F.col("dp"), F.col("us")), 9) + F.lit(0.0)).alias("usage"))


@register(
    "disk_averages",
    f"""WITH e AS (SELECT event_id, user_id, ts, user_id % 5 AS n, event_id * 4096 AS bytes, event_id * 70000 AS ticks FROM events),
    d AS (SELECT *, bytes - lag(bytes) {SERIES} AS db, ticks - lag(ticks) {SERIES} AS dt FROM e)
    SELECT event_id, user_id, CASE WHEN n = 0 THEN -1e0 ELSE round(floor(dt / 10000) / n, 6) + 0e0 END AS avg_ms,
    CASE WHEN n = 0 THEN 0e0 ELSE round(CASE WHEN dt IS NULL THEN NULL ELSE greatest(db, 0)::DOUBLE END / nullif(floor(greatest(dt, 1) / 10000), 0), 6) + 0e0 END AS bytes_per_ms FROM d""",
)
def disk_averages(spark, sf_dir):
    e = relations.table(spark, sf_dir, "events")
    e = e.select("event_id", "user_id", "ts", (F.col("user_id") % 5).alias("count"), (F.col("event_id") * 4096).alias("bytes"), (F.col("event_id") * 70000).alias("ticks"))
    e = metering.disk_averages(e, BY, ORDER)
    return e.select("event_id", "user_id", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("avg_ms", "bytes_per_ms")])


@register(
    "frequency_ratio",
    f"""WITH e AS (SELECT event_id, user_id, ts, event_id * 7 AS a, event_id * 9 AS m, event_id * 11 + 1 AS t FROM events),
    d AS (SELECT event_id, user_id, a - lag(a) {SERIES} AS a, m - lag(m) {SERIES} AS m, t - lag(t) {SERIES} AS t FROM e)
    SELECT event_id, user_id, round(a::DOUBLE / nullif(m, 0), 9) + 0e0 AS ratio_max, round(a::DOUBLE / nullif(t, 0), 9) + 0e0 AS ratio_tsc FROM d""",
)
def frequency_ratio(spark, sf_dir):
    e = relations.table(spark, sf_dir, "events")
    k = F.col("event_id")
    e = e.select("event_id", "user_id", "ts", (k * 7).alias("acnt"), (k * 9).alias("mcnt"), (k * 11 + 1).alias("tsc"))
    e = metering.frequency_ratio(e, BY, ORDER)
    return e.select("event_id", "user_id", *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in ("ratio_max", "ratio_tsc")])


# Register decoding ---------------------------------------------------------------------------------------------------

REGISTER_SQL = "(event_id * 1099511627 + user_id * 65537)"


@register(
    "bit_fields",
    f"""WITH e AS (SELECT event_id, user_id, {REGISTER_SQL} AS v FROM events)
    SELECT event_id, v & 15 AS f0, (v >> 8) & 31 AS f1, (v >> 16) & 15 AS f2, bit_count((v >> 4) & 65535)::BIGINT AS ones, (v | 240) AS with_set, (v - (v & 240)) AS with_clear,
    1e0 / pow(2, v & 15) AS power_unit, round(pow(2, (v >> 17) & 31) * (1 + ((v >> 22) & 3) / 4e0) / pow(2, (v >> 16) & 15), 6) + 0e0 AS time_window, 100 - ((v >> 16) & 127) AS temperature,
    ((v >> 32) & 65535) / 8192e0 AS voltage FROM e""",
)
def bit_fields(spark, sf_dir):
    e = relations.table(spark, sf_dir, "events").select("event_id", F.expr(REGISTER_SQL).alias("v"))
    v = F.col("v")
    window = units.time_window(v, (17, 21), (22, 23), units.unit_scale(v, 16, 19))
    return e.select(
        "event_id",
        bits.bit_extract(v, 0, 3).alias("f0"),
        bits.bit_extract(v, 12, 8).alias("f1"),
        bits.bit_extract(v, 16, 19).alias("f2"),
        bits.bit_count_range(v, 4, 19).cast("bigint").alias("ones"),
        bits.bit_set(v, 4, 7).alias("with_set"),
        bits.bit_clear(v, 4, 7).alias("with_clear"),
        units.unit_scale(v, 0, 3).alias("power_unit"),
        (F.round(window, 6) + F.lit(0.0)).alias("time_window"),
        units.temperature(F.lit(100), F.lit(1), bits.bit_extract(v, 16, 22)).cast("bigint").alias("temperature"),
        units.voltage(v).alias("voltage"),
    )


TURBO_SQL = ", ".join(f"(v >> {8 * i}) & 255 AS ratio{i}" for i in range(8))


@register("turbo_fields", f"SELECT event_id, {TURBO_SQL} FROM (SELECT event_id, {REGISTER_SQL} AS v FROM events)")
def turbo_fields(spark, sf_dir):
    e = relations.table(spark, sf_dir, "events").select("event_id", F.expr(REGISTER_SQL).alias("v"))
    return e.select("event_id", *bits.byte_fields(F.col("v"), "ratio"))


MODELS = ["SANDY_BRIDGE", "JAKETOWN", "NEHALEM_EP", "ATOM_AVOTON", "HASWELL_E", "CORE_2"]
MODEL_SQL = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODELS)) + " END"


@register(
    "model_decode",
    f"""WITH e AS (SELECT event_id, {MODEL_SQL} AS model, {REGISTER_SQL} AS v FROM events),
    f AS (SELECT *, CASE WHEN model IN ('SANDY_BRIDGE', 'JAKETOWN') THEN 'SANDY_BRIDGE' WHEN model = 'NEHALEM_EP' THEN 'NEHALEM' WHEN model = 'ATOM_AVOTON' THEN 'ATOM_1'
    WHEN model = 'HASWELL_E' THEN 'HASWELL' ELSE 'CORE_1' END AS family, CASE WHEN model IN ('NEHALEM_EP', 'CORE_2') THEN 133333333 ELSE 100000000 END::BIGINT AS bus_hz FROM e)
    SELECT event_id, family, bus_hz, ((v >> 8) & 255) * bus_hz AS nominal_hz, CASE WHEN family = 'NEHALEM' THEN (v & 255)::DOUBLE WHEN family IN ('SANDY_BRIDGE', 'HASWELL') THEN ((v >> 8) & 255)::DOUBLE
    ELSE ((v >> 8) & 31) + 0.5e0 * ((v >> 14) & 1) END AS multiplier FROM f""",
)
def model_decode(spark, sf_dir):
    e = relations.table(spark, sf_dir, "events").select("event_id", F.expr(MODEL_SQL).alias("model"), F.expr(REGISTER_SQL).alias("v"))
    m, v = F.col("model"), F.col("v")
    return e.select("event_id", units.model_family(m).alias("family"), units.bus_hz(m).alias("bus_hz"), units.nominal_hz(v, m).alias("nominal_hz"), units.multiplier(v, m).alias("multiplier"))


@register(
    "unit_rounding",
    """SELECT event_id, (event_id // 4096 + (CASE WHEN event_id % 4096 > 0 THEN 1 ELSE 0 END)) * 4096 AS up, event_id // 4096 * 4096 AS down,
    (event_id // 1000) * 976 + (event_id % 1000) * 976 // 1000 AS ms, (event_id // 10000) * 153 + (event_id % 10000) * 153 // 10000 AS mj FROM events""",
)
def unit_rounding(spark, sf_dir):
    e = relations.table(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select("event_id", keys.round_up(k, 4096).alias("up"), keys.round_down(k, 4096).alias("down"), units.fixed_point(k, 1000, 976).alias("ms"), units.fixed_point(k, 10000, 153).alias("mj"))


@register("explode_states", "SELECT n_regionkey AS region, unnest(list(n_nationkey ORDER BY n_nationkey)) AS frequency FROM nation GROUP BY n_regionkey")
def explode_states(spark, sf_dir):
    """Nested state arrays, built and taken apart."""
    n = relations.table(spark, sf_dir, "nation")
    nested = n.groupBy(F.col("n_regionkey").alias("region")).agg(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").alias("frequency")))).alias("states"))
    return metering.explode_states(nested).drop("state_no")


GATE_SQL = """WITH e AS (SELECT event_id, (user_id % 30)::DOUBLE AS power FROM events),
    r AS (SELECT *, greatest(power - 10, 0) AS o, greatest(10 - power, 0) AS s FROM e),
    q AS (SELECT *, CASE WHEN power > 10 THEN (CASE WHEN o > 10 THEN 0.75e0 ELSE o / power END) ELSE s / 10 END AS ratio FROM r),
    p AS (SELECT *, floor(ratio * 100)::BIGINT AS part FROM q),
    t AS (SELECT *, CASE WHEN power > 10 THEN part ELSE 100 - part END AS ts, CASE WHEN power > 10 THEN 100 - part ELSE part END AS te FROM p) """


@register("duty_cycle_gate", GATE_SQL + "SELECT event_id, ts BETWEEN 1 AND 100 AS suspends, te BETWEEN 1 AND 100 AS executes FROM t")
def duty_cycle_gate(spark, sf_dir):
    e = relations.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 30).cast("double").alias("power"))
    c = metering.duty_cycle(F.col("power"), 10.0, 100)
    return e.select("event_id", c["suspends"].alias("suspends"), c["executes"].alias("executes"))


@register(
    "power_cap_log",
    GATE_SQL
    + """SELECT event_id, printf('%.2f', power * 2) AS package_power, '50.00' AS process_usage, printf('%.2f', power) AS process_power, printf('%.2f', o) AS power_over,
    printf('%.2f', s) AS power_supply, printf('%.2f', ratio) AS ratio, ts::VARCHAR AS time_sleep, te::VARCHAR AS time_execute FROM t""",
)
def power_cap_log(spark, sf_dir):
    """The controller's log with its columns and number formats."""
    e = relations.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 30).cast("double").alias("process_power"))
    c = metering.duty_cycle(F.col("process_power"), 10.0, 100)
    log = e.select("event_id", (F.col("process_power") * 2).alias("package_power"), F.lit(50.0).alias("process_usage"), "process_power", *[v.alias(k) for k, v in c.items()])
    return report.formatted(log, report.POWER_CAP_PATTERNS, ["event_id"])


@register(
    "join_partition_report",
    """WITH RECURSIVE t AS (SELECT 'R' AS name, count(*) AS n FROM orders UNION ALL SELECT 'S', count(*) FROM lineitem),
    p AS (SELECT name, n, ceil(n / 1000)::BIGINT AS runs, ceil(n / 1000)::BIGINT AS now, 0::BIGINT AS passes FROM t UNION ALL SELECT name, n, runs, (now + 7) // 8, passes + 1 FROM p WHERE now > 1)
    SELECT name AS "table", n AS relation_rows, 1000::BIGINT AS run_rows, runs AS partition_num, max(passes) AS merge_pass FROM p GROUP BY name, n, runs""",
)
def join_partition_report(spark, sf_dir):
    o, l = _t(spark, sf_dir, "orders", "lineitem")
    return report.partition_report({"R": o, "S": l}, 1000, 8)


@register("join_count_report", f"SELECT 'Total Join Count' AS entry, count(*) AS value FROM ({ORDERS_LINEITEM})")
def join_count_report(spark, sf_dir):
    """The count of the join's report; its times differ from run to run, so they are left out here."""
    joined = _orders_lineitem("sort_merge")(spark, sf_dir)
    return report.join_report(spark, {"join": joined}).where(F.col("entry") == "Total Join Count")


@register("space_counters", "SELECT event_id, (event_id * 7340033) // 1048576 AS total_mb, (event_id * 1048575) // 1048576 AS free_mb, (event_id * 7340033 - event_id * 1048575) // 1048576 AS used_mb FROM events")
def space_counters(spark, sf_dir):
    e = relations.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7340033).alias("total"), (F.col("event_id") * 1048575).alias("free"))
    return metering.space(e, "total", "free").drop("total", "free")


@register(
    "tsc_frequency",
    f"""WITH e AS (SELECT event_id, user_id, c, lag(c) {SERIES} AS p FROM (SELECT *, {COUNTER_SQL} AS c FROM events))
    SELECT event_id, CASE WHEN c < p THEN (4294967295 - p + c) // 100000 ELSE (c - p) // 100000 END AS mhz FROM e""",
)
def tsc_frequency(spark, sf_dir):
    e = relations.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.expr(COUNTER_SQL).alias("c"))
    before = F.lag("c").over(Window.partitionBy(*BY).orderBy(*ORDER))
    return e.select("event_id", "c", before.alias("p")).select("event_id", metering.tsc_mhz(F.col("p"), F.col("c"), F.lit(100000)).alias("mhz"))


@register(
    "register_decode",
    f"""WITH e AS (SELECT event_id, {MODEL_SQL} AS model, {REGISTER_SQL} AS v FROM events)
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 100 ELSE (v >> 16) & 255 END AS tj_max, (v & 1023) * 100 // nullif(v & 511, 0) AS busy,
    floor((((v >> 8) & 255) + 0.5) * ((v & 1023) % 101) / 100)::BIGINT AS p_state, round(pow(2, (v >> 17) & 31) * ((v >> 22) & 3) / pow(2, (v >> 16) & 15), 6) + 0e0 AS plain_window,
    CASE WHEN (v & 1) <> ((v >> 9) & 1) THEN xor(v, 513) ELSE v END AS swapped, (v & 48) = 48 AS all_set, round(v % 100000 * 0.00027777777778::DOUBLE * 1000, 6) + 0e0 AS mwh,
    CASE model WHEN 'SANDY_BRIDGE' THEN 'Sandy Bridge' WHEN 'JAKETOWN' THEN 'Sandy Bridge-EP/Jaketown' WHEN 'NEHALEM_EP' THEN 'Nehalem/Nehalem-EP' ELSE 'Unknown' END AS code_name,
    CASE WHEN event_id % 8 = 6 THEN 'Intel' ELSE 'Unknown' END AS vendor FROM e""",
)
def register_decode(spark, sf_dir):
    """Limits, busy share, P-state, plane windows, bit helpers and names from registers; every third register is unreadable."""
    e = relations.table(spark, sf_dir, "events").select("event_id", F.expr(MODEL_SQL).alias("model"), F.expr(REGISTER_SQL).alias("v"))
    v, k = F.col("v"), F.col("event_id")
    low = v.bitwiseAND(F.lit(1023))
    window = units.plain_time_window(v, (17, 21), (22, 23), units.unit_scale(v, 16, 19))
    return e.select(
        "event_id",
        units.temperature_limit(F.when(k % 3 != 0, v)).alias("tj_max"),
        units.busy_percent(v.bitwiseAND(F.lit(511)), low).alias("busy"),
        units.busy_p_state(low % 101, bits.bit_extract(v, 8, 15)).alias("p_state"),
        (F.round(window, 6) + F.lit(0.0)).alias("plain_window"),
        bits.bit_swap(v, 0, 9).alias("swapped"),
        bits.bits_all_set(v, 4, 5).alias("all_set"),
        (F.round(units.joule_to_milliwatt_hour((v % 100000).cast("double")), 6) + F.lit(0.0)).alias("mwh"),
        units.code_name(F.col("model")).alias("code_name"),
        units.vendor_name(k % 8).alias("vendor"),
    )


@register(
    "text_formats",
    """WITH e AS (SELECT event_id, (event_id - 5000) * 12345 AS n, value, ts FROM events)
    SELECT event_id, CASE WHEN n < 0 THEN '(' || format('{:,}', -n) || ')' ELSE format('{:,}', n) END AS grouped, printf('%d watt', n) AS watt, n AS parsed,
    event_id % 256 AS from_hex, event_id % 64 AS from_octal, round(value, 3) + 0e0 AS from_text,
    year(ts) || ':' || printf('%02d:%02d:%02d:%02d:%02d', month(ts) - 1, day(ts), hour(ts), minute(ts), second(ts)) AS time_text, date_trunc('second', ts)::TIMESTAMP AS parsed_time FROM e""",
)
def text_formats(spark, sf_dir):
    e = relations.table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") - 5000) * 12345).alias("n"), "value", "ts")
    n, k = F.col("n"), F.col("event_id")
    written = text.time_text(F.col("ts"))
    return e.select(
        "event_id",
        text.thousands(n).alias("grouped"),
        text.patterned(n, "%d watt").alias("watt"),
        text.text_to_long(F.concat(F.lit("  "), n.cast("string"), F.lit("kg"))).alias("parsed"),
        text.text_to_long(F.concat(F.lit("0x"), F.hex(k % 256))).alias("from_hex"),
        text.text_to_long(F.concat(F.lit("0"), F.conv((k % 64).cast("string"), 10, 8))).alias("from_octal"),
        (F.round(text.text_to_double(F.concat(F.col("value").cast("string"), F.lit(" J"))), 3) + F.lit(0.0)).alias("from_text"),
        written.alias("time_text"),
        text.parse_time_text(written).cast("timestamp_ntz").alias("parsed_time"),
    )


# Streaming ------------------------------------------------------------------------------------------------------------


@register(
    "stream_downsample",
    """SELECT user_id, bucket, n, unnest(last) FROM (SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS bucket, count(*) AS n, arg_max({'event_id': event_id, 'value': value}, (ts, event_id)) AS last
    FROM events GROUP BY user_id, date_trunc('hour', ts)) WHERE bucket + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
)
def stream_downsample(spark, sf_dir):
    """Hourly last samples from a stream over the events: the windows that the watermark, ten minutes behind the last
    sample, has passed. Later windows stay open for the samples to come."""
    from ..streaming import sampling

    schema = relations.table(spark, sf_dir, "events").schema
    stream = sampling.sample_stream(spark, f"{sf_dir}/events.parquet", schema)
    folder = shared_folder(spark, "stream")
    sampling.drain(sampling.downsample_stream(stream, "user_id"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@register("stream_duty_cycle", "SELECT event_id, (user_id % 30)::DOUBLE AS power, CASE WHEN power > 10 THEN CASE WHEN power > 20 THEN 75 ELSE floor((power - 10) / power * 100)::BIGINT END ELSE 100 - floor((10 - power) / 10 * 100)::BIGINT END AS time_sleep FROM events")
def stream_duty_cycle(spark, sf_dir):
    from ..streaming import sampling

    schema = relations.table(spark, sf_dir, "events").schema
    stream = sampling.sample_stream(spark, f"{sf_dir}/events.parquet", schema).select("event_id", (F.col("user_id") % 30).cast("double").alias("power"))
    folder = shared_folder(spark, "stream")
    sampling.drain(sampling.duty_cycle_stream(stream, "power", 10.0).select("event_id", "power", "time_sleep"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")
