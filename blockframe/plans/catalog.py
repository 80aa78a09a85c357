"""One query for each function and construct on the example tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..api import assemble
from ..sources import load

MONTHS, MONTH_RANGE, GAP = (301, 381), ["1995-01-01", "2001-08-05"], 345
WEEK_RANGE = ["2023-12-31", "2024-01-28"]
NOW = "2002-01-01 00:00:00"
P = "o_custkey,DATE(o_orderdate)"
B, S = f"Orders.COUNT(o_orderkey|{P})", f"Orders.SUM(o_totalprice|{P})"
STATUS = f"Orders.LATEST(o_orderstatus|{P})"
U = "user_id,DATE(ts)"

CONFIG = {
    "customer": {"key": "c_custkey", "date_key": "__date__", "pointers": {"c_nationkey": "nation.n_nationkey"}},
    "nation": {"key": "n_nationkey", "pointers": {"n_regionkey": "region.r_regionkey"}},
    "region": {"key": "r_regionkey"},
    "orders": {"key": "o_orderkey", "pointers": {"o_custkey": "customer.c_custkey"}, "order_by": ["o_orderdate", "o_orderkey"]},
    "lineitem": {"key": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "pointers": {"l_orderkey": "orders.o_orderkey"}},
}
WEEK_CONFIG = {"user": {"key": "user_id", "date_key": "__date__"}, "events": {"key": "event_id", "pointers": {"user_id": "user.user_id"}, "order_by": ["ts", "event_id"]}}


def monthly(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The star tables, customers being a live table of one snapshot a month, with one month missing."""
    t = load(spark, sf_dir, "customer", "nation", "region", "orders", "lineitem")
    first = t["orders"].groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("first_order"))
    # dealt out first: a table of customers is a few tasks, and a month's snapshot of each is not
    t["customer"] = t["customer"].repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    months = F.explode(F.array_remove(F.sequence(F.lit(MONTHS[0]), F.lit(MONTHS[1] - 1)), GAP)).alias("__date__")
    email = F.concat("c_name", F.lit("@"), "c_mktsegment", F.lit(".example.com"))
    t["customer"] = t["customer"].join(first, "c_custkey", "left").withColumn("email", email).select("*", months)
    return t


def weekly(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Events, and users as a live table of one snapshot a week."""
    events = load(spark, sf_dir, "events")["events"].withColumn("details", F.from_json("props", T.StructType([T.StructField("k", T.IntegerType())])))
    weeks = F.explode(F.sequence(F.lit(WEEK_RANGE[0]).cast("date"), F.lit(WEEK_RANGE[1]).cast("date"), F.expr("interval 7 days"))).alias("__date__")
    return {"events": events, "user": events.select("user_id").distinct().select("user_id", weeks)}


def genders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Building", "female"), ("automobile", "male"), ("MACHINERY", "female")], "name string, gender string")


def _value(df: DataFrame, feature: str, name: str = "value"):
    kind = df.schema[feature].dataType
    value = F.col(f"`{feature}`")
    return (F.round(value, 3) + F.lit(0.0) if isinstance(kind, T.DoubleType) else value).alias(name)


def _months(*features: str, names: list[str] | None = None, **options) -> Callable[[SparkSession, str], DataFrame]:
    features = tuple("".join(f.split()) for f in features)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        extra = {"genders": genders(spark)} if any("GENDER" in f for f in features) else {}
        df = assemble(list(features), monthly(spark, sf_dir), CONFIG, {"customer": "customer.c_custkey", "__date__": MONTH_RANGE}, now=NOW, **extra, **options)
        return df.select("customer", F.col("__dcount__").alias("block"), *(_value(df, f, n) for f, n in zip(features, names or ["value"])))

    return run


def _weeks(feature: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = assemble([feature], weekly(spark, sf_dir), WEEK_CONFIG, {"user": "user.user_id", "__date__": WEEK_RANGE}, "week")
        return df.select("user", F.col("__dcount__").alias("block"), _value(df, "".join(feature.split())))

    return run


# --- the same in SQL -----------------------------------------------------------------

_WITH = f"""
dates AS (SELECT m::int AS t FROM range({MONTHS[0]}, {MONTHS[1]}) r(m) WHERE m <> {GAP}),
scaffold AS (SELECT c_custkey AS k, t FROM customer, dates),
ord AS (SELECT o_custkey AS k, ((year(o_orderdate) - 1970) * 12 + month(o_orderdate))::int AS t, * FROM orders),
b AS (SELECT k, t, count(o_orderkey) AS v FROM ord GROUP BY k, t),
s AS (SELECT k, t, sum(o_totalprice) AS v FROM ord GROUP BY k, t),
st AS (SELECT k, t, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS v FROM ord GROUP BY k, t),
mn AS (SELECT k, t, avg(o_totalprice) AS v FROM ord GROUP BY k, t),
cust AS (SELECT c.*, c.c_custkey AS k, n.n_name, r.r_name, (SELECT min(o_orderdate) FROM orders o WHERE o.o_custkey = c.c_custkey) AS first_order FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey)"""
_BLOCK = "printf('%04d-%02d', (1970 + (t - 1) // 12)::int, ((t - 1) % 12 + 1)::int)"


def _out(value: str, double: bool) -> str:
    return f"round(({value})::double, 3) + 0.0::double" if double else value


def _frame_sql(frame: str, fill: str | None, double: bool = False) -> str:
    """A sparse frame (k, t, v) joined to the scaffold and filled."""
    value = f"coalesce(f.v, {fill})" if fill is not None else "f.v"
    return f"WITH {_WITH}, f AS ({frame}) SELECT k AS customer, {_BLOCK} AS block, {_out(value, double)} AS value FROM scaffold LEFT JOIN f USING (k, t)"


def _grid_sql(frame: str, expression: str, fill: str, double: bool = False) -> str:
    """An expression over windows w on the dense grid of a frame."""
    grid = f"SELECT e.k, d.t, x.v, x.k IS NOT NULL AS has, row_number() OVER (PARTITION BY e.k ORDER BY d.t) AS rn FROM (SELECT DISTINCT k FROM ({frame})) e CROSS JOIN dates d LEFT JOIN ({frame}) x ON x.k = e.k AND x.t = d.t"
    return _frame_sql(f"SELECT k, t, {expression} AS v FROM ({grid})", fill, double)


def _row_sql(value: str, double: bool = False) -> str:
    return f"WITH {_WITH} SELECT k AS customer, {_BLOCK} AS block, {_out(value, double)} AS value FROM scaffold JOIN cust USING (k)"


_W = "PARTITION BY k ORDER BY t"
_ROWS = f"OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BEFORE = f"OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_WEEK_WITH = """
wk AS (SELECT range AS w FROM range(date_diff('day', DATE '1970-01-04', DATE '2023-12-31') // 7, date_diff('day', DATE '1970-01-04', DATE '2023-12-31') // 7 + 5)),
scaffold AS (SELECT u.user_id AS k, wk.w AS t FROM (SELECT DISTINCT user_id FROM events) u, wk),
ev AS (SELECT user_id AS k, date_diff('day', DATE '1970-01-04', ts::date) // 7 AS t, *, coalesce(try_cast(json_extract_string(props, '$.k') AS int), -1) AS ki, coalesce(json_extract_string(props, '$.k'), '0') AS ks FROM events)"""


def _week_sql(aggregate: str, fill: str, double: bool = False) -> str:
    return f"WITH {_WEEK_WITH}, f AS (SELECT k, t, {aggregate} AS v FROM ev GROUP BY k, t) SELECT k AS \"user\", strftime(DATE '1970-01-04' + (7 * t)::int, '%Y-%m-%d') AS block, {_out(f'coalesce(f.v, {fill})', double)} AS value FROM scaffold LEFT JOIN f USING (k, t)"


_B, _S = "SELECT * FROM b", "SELECT * FROM s"
_FIRST = "SELECT sc.k, sc.t, (year(first_order) - 1970) * 12 + month(first_order) AS v FROM scaffold sc JOIN cust USING (k)"

#: three natural classes by trying every pair of cuts; with fewer than three distinct values each is its own class
_CLUSTER_SQL = _frame_sql("SELECT k, t, coalesce(CASE WHEN v <= e1 THEN e1 WHEN v <= e2 THEN e2 ELSE e3 END, v)::int AS v FROM b LEFT JOIN best ON true", "-1").replace(
    ", f AS", """, p AS (SELECT 0 AS i, NULL::double AS v, 0.0::double AS w, 0.0::double AS wx, 0.0::double AS wxx UNION ALL
SELECT row_number() OVER o, v::double, (sum(n) OVER o)::double, (sum(n * v) OVER o)::double, (sum(n * v * v) OVER o)::double FROM (SELECT v, count(*) AS n FROM b GROUP BY v) WINDOW o AS (ORDER BY v)),
cost AS (SELECT x.i AS i, y.i AS j, y.v AS edge, (y.wxx - x.wxx) - (y.wx - x.wx) ** 2 / (y.w - x.w) AS c FROM p x JOIN p y ON x.i < y.i),
best AS (SELECT a.edge AS e1, m.edge AS e2, z.edge AS e3 FROM cost a JOIN cost m ON a.i = 0 AND a.j = m.i JOIN cost z ON m.j = z.i AND z.j = (SELECT max(i) FROM p) ORDER BY a.c + m.c + z.c LIMIT 1), f AS""", 1)

#: name: (query, SQL or None)
CASES: dict[str, tuple[Callable, str | None]] = {
    "readme_time_since_seen": (
        _months("TIME_SINCE_SEEN(Lineitem.SUM(l_quantity|DATE(l_orderkey.o_orderdate),l_orderkey.o_custkey))"),
        _grid_sql("SELECT o.k, o.t, sum(l_quantity) AS v FROM lineitem JOIN ord o ON l_orderkey = o_orderkey GROUP BY o.k, o.t", f"rn - last_value(CASE WHEN v <> 0 THEN rn END IGNORE NULLS) {_ROWS}", "-999"),
    ),
    "fn_count": (_months(B), _frame_sql(_B, "0")),
    "fn_sum": (_months(S), _frame_sql(_S, "0", True)),
    "fn_mean": (_months(f"Orders.MEAN(o_totalprice|{P})"), _frame_sql("SELECT * FROM mn", None, True)),
    "fn_exists": (_months(f"Orders.EXISTS(o_orderkey|{P})"), _frame_sql("SELECT k, t, 1::bigint AS v FROM b", None)),
    "fn_latest": (_months(STATUS), _frame_sql("SELECT * FROM st", "'0'")),
    "fn_count_where": (_months(f'Orders.COUNT_WHERE(o_orderstatus,"F"|{P})'), _frame_sql("SELECT k, t, count(*) AS v FROM ord WHERE o_orderstatus = 'F' GROUP BY k, t", "0")),
    "fn_where": (_months(f'Orders.LATEST(WHERE(o_orderstatus,"F")|{P})'), _frame_sql("SELECT k, t, CASE WHEN v = 'F' THEN v ELSE '0' END AS v FROM st", "'0'")),
    "pointer_group_by": (_months("Lineitem.SUM(l_quantity|DATE(l_orderkey.o_orderdate),l_orderkey.o_custkey)"), _frame_sql("SELECT o.k, o.t, sum(l_quantity) AS v FROM lineitem JOIN ord o ON l_orderkey = o_orderkey GROUP BY o.k, o.t", "0", True)),
    "pointer_one_hop": (_months("customer.c_mktsegment"), _row_sql("c_mktsegment")),
    "pointer_n_hops": (_months("customer.c_nationkey.n_regionkey.r_name"), _row_sql("r_name")),
    "explicit_translation": (_months("Orders{__date__=CMONTH(o_orderdate)}.COUNT(o_orderkey|o_custkey,CMONTH(o_orderdate))"), _frame_sql(_B, "0")),
    "entity_aggregate": (_months("Orders.SUM(o_totalprice|o_custkey)"), f"WITH {_WITH} SELECT k AS customer, {_BLOCK} AS block, round(coalesce(x.v, 0), 3) + 0.0::double AS value FROM scaffold LEFT JOIN (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1) x USING (k)"),
    "output_aggregate": (_months(f"SUM({B}|customer)"), f"WITH {_WITH} SELECT k AS customer, {_BLOCK} AS block, coalesce(x.v, 0)::double AS value FROM scaffold LEFT JOIN (SELECT k, sum(v) AS v FROM scaffold JOIN b USING (k, t) GROUP BY k) x USING (k)"),
    "fn_cmonth": (_months(f"Orders.MEAN(CMONTH(o_orderdate)|{P})"), _frame_sql("SELECT k, t, avg(t) AS v FROM ord GROUP BY k, t", None, True)),
    "fn_cmonthsince": (_months(f"Orders.MEAN(CMONTHSINCE(o_orderdate)|{P})"), _frame_sql(f"SELECT k, t, avg(round_even(floor((epoch(TIMESTAMP '{NOW}') - epoch(o_orderdate)) / 86400) / 30, 0)) AS v FROM ord GROUP BY k, t", None, True)),
    "fn_dt_day_of_the_week": (_months(f"Orders.MEAN(DT_DAY_OF_THE_WEEK(o_orderdate)|{P})"), _frame_sql("SELECT k, t, avg(isodow(o_orderdate)) AS v FROM ord GROUP BY k, t", None, True)),
    "fn_dt_day_of_the_month": (_months(f"Orders.MEAN(DT_DAY_OF_THE_MONTH(o_orderdate)|{P})"), _frame_sql("SELECT k, t, avg(day(o_orderdate)) AS v FROM ord GROUP BY k, t", None, True)),
    "fn_dt_month_of_the_year": (_months(f"Orders.MEAN(DT_MONTH_OF_THE_YEAR(o_orderdate)|{P})"), _frame_sql("SELECT k, t, avg(month(o_orderdate)) AS v FROM ord GROUP BY k, t", None, True)),
    "dt_month_of_a_block": (_months("DT_MONTH_OF_THE_YEAR(__date__)"), _row_sql("((t - 1) % 12 + 1)::int")),
    "fn_date_month": (_months("DATE(customer.first_order)"), _row_sql("coalesce((year(first_order) - 1970) * 12 + month(first_order), -1)::int")),
    "fn_date_week": (_weeks(f"Events.COUNT(event_id|{U})"), _week_sql("count(event_id)", "0")),
    "fn_shift": (_months(f"SHIFT({B},1)"), _frame_sql("SELECT k, t + 1 AS t, v FROM b", "0")),
    "fn_get": (_months(f"GET({B})"), _frame_sql(_B, "0")),
    "fn_minusprev": (_months(f"MINUSPREV({S})"), _frame_sql("SELECT k, t, sum(v) AS v FROM (SELECT k, t, v FROM s UNION ALL SELECT k, t + 1, -v FROM s) GROUP BY k, t", "0", True)),
    "fn_acc": (
        _months(f"ACC({B})"),
        _frame_sql(f"SELECT k, t, CASE WHEN t < {MONTHS[1] - 1} THEN sum(v) OVER ({_W} RANGE BETWEEN 79 PRECEDING AND CURRENT ROW) ELSE v END::bigint AS v FROM (SELECT e.k, m.t, coalesce(b.v, 0) AS v FROM (SELECT DISTINCT k FROM b) e CROSS JOIN (SELECT range::int AS t FROM range({MONTHS[0]}, {MONTHS[1]})) m LEFT JOIN b ON b.k = e.k AND b.t = m.t)", "0"),
    ),
    "fn_rank": (_months(f"RANK({S})"), _frame_sql("SELECT k, t, (rank() OVER (PARTITION BY t ORDER BY v) + (count(*) OVER (PARTITION BY t, v) - 1) / 2.0) / count(*) OVER (PARTITION BY t) AS v FROM s WHERE v >= 0", "0", True)),
    "fn_rank_ties": (_months(f"RANK({B})"), _frame_sql("SELECT k, t, (rank() OVER (PARTITION BY t ORDER BY v) + (count(*) OVER (PARTITION BY t, v) - 1) / 2.0) / count(*) OVER (PARTITION BY t) AS v FROM b", "0", True)),
    "fn_tsinceseen": (_months(f"Orders.TSINCESEEN(DATE(o_orderdate),DATE(o_orderdate)|{P})"), f"WITH {_WITH} SELECT sc.k AS customer, {_BLOCK.replace('t -', 'sc.t -')} AS block, coalesce(sc.t - max(b.t), -99999)::bigint AS value FROM scaffold sc LEFT JOIN b ON b.k = sc.k AND b.t <= sc.t GROUP BY sc.k, sc.t"),
    "fn_math_divide": (_months(f"MATH_DIVIDE({S},{B})"), f"WITH {_WITH} SELECT k AS customer, {_BLOCK} AS block, {_out('coalesce(s.v, 0) / (coalesce(b.v, 0) + 0.001::double)', True)} AS value FROM scaffold LEFT JOIN s USING (k, t) LEFT JOIN b USING (k, t)"),
    "fn_greaterthan": (_months(f"GREATERTHAN({B},1)"), _frame_sql("SELECT k, t, v > 1 AS v FROM b", "false")),
    "fn_math_equal": (_months(f"MATH_EQUAL({B},2)"), _frame_sql("SELECT k, t, v = 2 AS v FROM b", "false")),
    "fn_math_notnull": (_months(f"MATH_NOTNULL({S})"), _frame_sql("SELECT k, t, v IS NOT NULL AS v FROM s", "false")),
    "fn_accumulate": (_months(f"ACCUMULATE({B})"), _grid_sql(_B, f"(sum(coalesce(v, 0)) {_ROWS})::bigint", "0")),
    "fn_accumulate_n": (_months(f"ACCUMULATE({B},3)"), _grid_sql(_B, f"(sum(coalesce(v, 0)) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))::bigint", "0")),
    "fn_time_since": (_months("TIME_SINCE(customer.first_order)"), _grid_sql(_FIRST, f"coalesce(rn - min(CASE WHEN has AND t >= v THEN rn END) {_ROWS}, -9999)", "0")),
    "fn_time_since_seen": (_months(f"TIME_SINCE_SEEN({B})"), _grid_sql(_B, f"rn - last_value(CASE WHEN v <> 0 THEN rn END IGNORE NULLS) {_ROWS}", "-999")),
    "fn_future_until": (_months(f"FUTURE_UNTIL({B})"), _grid_sql(_B, f"rn - last_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) {_ROWS}", "-999")),
    "fn_future_within": (_months(f"FUTURE_WITHIN({B},3)"), _grid_sql(_B, f"coalesce(max(coalesce(v <> 0, false)) OVER ({_W} RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING), false)", "false")),
    "fn_window_sum": (_months(f"WINDOW_SUM({S},3)"), _grid_sql(_S, f"sum(v) OVER ({_W} RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)", "0", True)),
    "fn_window_first": (_months(f"WINDOW_FIRST({S},3)"), _grid_sql(_S, f"first_value(CASE WHEN v <> 0 THEN v END IGNORE NULLS) OVER ({_W} RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)", "0", True)),
    "fn_window_last": (_months(f"WINDOW_LAST({S},3)"), _grid_sql(_S, f"last_value(CASE WHEN v <> 0 THEN v END IGNORE NULLS) OVER ({_W} RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)", "0", True)),
    "fn_window_count_notna": (_months(f"WINDOW_COUNT_NOTNA({B},6)"), _grid_sql(_B, f"count(CASE WHEN v <> 0 THEN 1 END) OVER ({_W} RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)", "0")),
    "fn_strend": (_months(f"STREND({S})"), _grid_sql(_S, f"coalesce(v, 0) - coalesce(sum(coalesce(v, 0)) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) / 5", "-99999", True)),
    "fn_trend_diff": (_months(f"TREND_DIFF({S},3)"), _grid_sql(_S, f"coalesce(v, 0) - coalesce(sum(v) OVER ({_W} RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING), 0)", "0", True)),
    "fn_cp_changed": (_months(f"CP_CHANGED({B})"), _grid_sql(_B, f"coalesce(v <> 0, false) AND v IS DISTINCT FROM last_value(CASE WHEN v <> 0 THEN v END IGNORE NULLS) {_BEFORE}", "false")),
    "fn_first": (_months(f"FIRST({S})"), _grid_sql(_S, f"first_value(CASE WHEN v <> 0 THEN v END IGNORE NULLS) {_ROWS}", "0", True)),
    "fn_last": (_months(f"LAST({STATUS})"), _grid_sql("SELECT * FROM st", f"last_value(CASE WHEN v <> '' THEN v END IGNORE NULLS) {_ROWS}", "'0'")),
    "fn_last_before": (_months(f"LAST_BEFORE({STATUS})"), _grid_sql("SELECT * FROM st", f"last_value(CASE WHEN v <> '' THEN v END IGNORE NULLS) {_BEFORE}", "'0'")),
    "fn_round_float": (_months(f"ROUND_FLOAT({S},0)"), _frame_sql("SELECT k, t, round_even(v, 0)::int AS v FROM s", "-1")),
    "fn_round_cluster": (_months(f"ROUND_CLUSTER({B},3)"), _CLUSTER_SQL),
    "fn_round_cluster_compat": (_months(f'ROUND_CLUSTER({B},3,"compat")'), _frame_sql("SELECT k, t, v::int AS v FROM b", "-1")),
    "fn_email_domain": (_months("EMAIL_DOMAIN(customer.email)"), _row_sql("lower(c_mktsegment) || '.example.com'")),
    "fn_domain_ext": (_months("DOMAIN_EXT(EMAIL_DOMAIN(customer.email))"), _row_sql("'example.com'")),
    "fn_people_gender": (_months("PEOPLE_GENDER(customer.c_mktsegment)"), _row_sql("CASE lower(c_mktsegment) WHEN 'building' THEN 'female' WHEN 'automobile' THEN 'male' WHEN 'machinery' THEN 'female' ELSE 'unknown' END")),
    "fn_get_json": (_weeks(f"Events.SUM(GET_JSON(props,'[\"k\"]')|{U})"), _week_sql("sum(ki)::double", "0", True)),
    "fn_json_get": (_weeks(f"Events.LATEST(JSON_GET(props,'[\"k\"]')|{U})"), _week_sql("arg_min(ks, (ts, event_id))", "'0'")),
    "fn_dict_get": (_weeks(f"Events.LATEST(DICT_GET(details,'[\"k\"]')|{U})"), _week_sql("arg_min(ks, (ts, event_id))", "'0'")),
    "mock_mode": (_months(B, mock=True), f"WITH {_WITH} SELECT k AS customer, {_BLOCK} AS block, 54321 AS value FROM scaffold"),
}

_WIDE = ["fn_count", "fn_sum", "fn_strend", "fn_accumulate", "fn_window_sum", "fn_trend_diff", "fn_cp_changed", "fn_first", "fn_future_within", "pointer_n_hops", "readme_time_since_seen", "fn_minusprev"]
_WIDE_FEATURES = [B, S, f"STREND({S})", f"ACCUMULATE({B})", f"WINDOW_SUM({S},3)", f"TREND_DIFF({S},3)", f"CP_CHANGED({B})", f"FIRST({S})", f"FUTURE_WITHIN({B},3)", "customer.c_nationkey.n_regionkey.r_name", "TIME_SINCE_SEEN(Lineitem.SUM(l_quantity|DATE(l_orderkey.o_orderdate),l_orderkey.o_custkey))", f"MINUSPREV({S})"]
CASES["wide_table"] = (
    _months(*_WIDE_FEATURES, names=_WIDE),
    "SELECT q0.customer, q0.block, " + ", ".join(f"q{i}.value AS {n}" for i, n in enumerate(_WIDE)) + " FROM " + " JOIN ".join(f"({CASES[n][1]}) q{i}" + (" USING (customer, block)" if i else "") for i, n in enumerate(_WIDE)),
)

QUERIES = {name: query for name, (query, _) in CASES.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in CASES.items() if sql is not None}
