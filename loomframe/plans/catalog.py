"""One query an operator, over whole tables, each with the same in SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..functions import casts, linalg
from ..functions import distributions as D
from ..functions import statistics as S
from ..operators import frame, grouping, joins, ordered, parallel, series
from ..plans import predicates as P
from ..session import load, scratch
from ..sources import csv as csv_source
from ..sources import json as json_source
from ..sources import parquet as parquet_source
from ..streaming import events as event_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    """events with `nv`, the value where the type is not error, else null."""
    return load(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.when(F.col("event_type") != "error", F.col("value")).alias("nv"))


EV = "(SELECT event_id, user_id, event_type, value, CASE WHEN event_type <> 'error' THEN value END AS nv FROM events)"


def r(c, digits: int = 4):
    """Rounded as SQL does: what a negative number leaves of itself is -0.0, which F.round loses."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.abs(c), digits) * F.signum(c)


# projection and slicing


@query("q01_select", "SELECT p_name, p_partkey, p_retailprice FROM part")
def _(s, d):
    return frame.select(load(s, d, "part"), "p_name", "p_partkey", "p_retailprice")


@query("q02_drop", "SELECT p_partkey, p_name, p_type, p_size, p_retailprice FROM part")
def _(s, d):
    return frame.drop(load(s, d, "part"), "p_brand", "no_such_column")


@query("q03_rename", "SELECT p_partkey AS key, p_name FROM part")
def _(s, d):
    return frame.rename(load(s, d, "part").select("p_partkey", "p_name"), "p_partkey", "key")


@query("q04_assign", "SELECT o_orderkey, round(o_totalprice * 2, 2) AS double_price FROM orders")
def _(s, d):
    return frame.assign(load(s, d, "orders"), "double_price", r(F.col("o_totalprice") * 2, 2)).select("o_orderkey", "double_price")


@query("q05_apply", "SELECT o_orderkey, lower(o_orderpriority) AS o_orderpriority FROM orders")
def _(s, d):
    return frame.apply(load(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", F.lower)


@query("q06_pipe", "SELECT o_orderkey, round(o_totalprice / 2, 4) AS half FROM orders WHERE o_orderstatus = 'O'")
def _(s, d):
    return frame.pipe(load(s, d, "orders"), lambda x: frame.where(x, P.col("o_orderstatus").eq("O")), None, lambda x: frame.add_column(x, "half", r(F.col("o_totalprice") / 2, 4)), lambda x: x.select("o_orderkey", "half"))


@query("q07_head", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 10")
def _(s, d):
    return ordered.head(load(s, d, "events").select("event_id", "value"), 10, "event_id")


@query("q08_tail", "SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 10")
def _(s, d):
    return ordered.tail(load(s, d, "events").select("event_id", "value"), 10, "event_id")


@query("q09_position", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders")
def _(s, d):
    return ordered.with_position(load(s, d, "orders").select("o_orderkey"), "o_orderkey", "pos")


@query("q10_sample", "SELECT event_id, value FROM events ORDER BY md5(concat_ws('-', CAST(event_id AS VARCHAR), '42')), event_id LIMIT 100")
def _(s, d):
    return ordered.sample(load(s, d, "events").select("event_id", "value"), 100, 42, "event_id")


@query("q10b_info", "SELECT 'event_id' AS \"column\", 'bigint' AS dtype, count(*) AS rows, count(*) - count(event_id) AS nulls FROM " + EV + " UNION ALL SELECT 'nv', 'double', count(*), count(*) - count(nv) FROM " + EV)
def _(s, d):
    return frame.info(events(s, d).select("event_id", "nv"))


@query("q10c_add_values", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(s, d):
    names = load(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return frame.add_values(load(s, d, "customer").select("c_custkey", "c_nationkey"), "n_name", names, "c_nationkey").select("c_custkey", "n_name")


# predicates, nulls lowest


def _filtered(name: str, predicate: P.Predicate, where: str, columns: str = "event_id, nv"):
    @query(name, f"SELECT {columns} FROM {EV} WHERE {where}")
    def _(s, d):
        return frame.where(events(s, d), predicate).select(*columns.split(", "))


nv, kind = P.col("nv"), P.col("event_type")
_filtered("q11_eq", kind.eq("click"), "event_type = 'click'", "event_id, event_type")
_filtered("q12_ne", nv.ne(50.0), "nv IS NULL OR nv <> 50")
_filtered("q13_gt", nv.gt(50.0), "nv > 50")
_filtered("q14_gte", nv.gte(50.0), "nv >= 50")
_filtered("q15_lt", nv.lt(50.0), "nv IS NULL OR nv < 50")
_filtered("q16_lte", nv.lte(50.0), "nv IS NULL OR nv <= 50")
_filtered("q17_in", kind.isin("click", "purchase"), "event_type IN ('click', 'purchase')", "event_id, event_type")
_filtered("q17b_in_null", nv.isin(1.0, None), "nv = 1 OR nv IS NULL")
_filtered("q18_is_null", nv.is_null(), "nv IS NULL", "event_id, event_type")
_filtered("q18b_is_not_null", nv.is_not_null(), "nv IS NOT NULL")
_filtered("q18c_eq_null", nv.eq(None), "nv IS NULL", "event_id, event_type")
_filtered("q22_and_or_not", P.not_(P.or_(nv.lt(20.0), P.and_(kind.eq("click"), nv.gte(80.0)))), "NOT ((nv IS NULL OR nv < 20) OR (event_type = 'click' AND coalesce(nv >= 80, FALSE)))")
_filtered("q22b_sql_nulls", P.and_(nv.ne(50.0), P.not_(kind.eq("view"))), "(nv IS NULL OR nv <> 50) AND event_type <> 'view'")


@query("q19_contains", "SELECT p_partkey FROM part WHERE contains(p_name, 'a')")
def _(s, d):
    return frame.where(load(s, d, "part"), P.col("p_name").contains("a")).select("p_partkey")


@query("q20_starts_with", "SELECT p_partkey FROM part WHERE starts_with(p_type, 'S')")
def _(s, d):
    return frame.where(load(s, d, "part"), P.col("p_type").starts_with("S")).select("p_partkey")


@query("q21_matches", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[Tt]h[aeiou]+ [a-m]')")
def _(s, d):
    return frame.where(load(s, d, "documents"), P.col("text").matches("[Tt]h[aeiou]+ [a-m]")).select("doc_id")


@query("q23_bool_mask", "SELECT event_id, value FROM events WHERE value > 25 AND event_type <> 'error'")
def _(s, d):
    e = events(s, d)
    return frame.where_mask(e.select("event_id", "value"), e.select("event_id", (F.col("nv") > 25).alias("keep")), "event_id", "keep")


@query("q24_drop_null_rows", f"SELECT event_id, nv FROM {EV} WHERE nv IS NOT NULL")
def _(s, d):
    return frame.drop_null_rows(events(s, d), "nv").select("event_id", "nv")


# grouped aggregates


def _grouped(name: str, fn: str, sql: str):
    @query(name, f"SELECT l_returnflag, l_linestatus, {sql} AS l_extendedprice FROM lineitem GROUP BY ALL")
    def _(s, d):
        out = grouping.group(load(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"l_extendedprice": fn}, ordered=False)
        return out.withColumn("l_extendedprice", r(F.col("l_extendedprice"), 2)) if fn != "count" else out


for _n, _f, _s in (("q25_sum", "sum", "round(sum(l_extendedprice), 2)"), ("q26_mean", "mean", "round(avg(l_extendedprice), 2)"), ("q27_min", "min", "round(min(l_extendedprice), 2)"), ("q28_max", "max", "round(max(l_extendedprice), 2)"), ("q29_count", "count", "count(l_extendedprice)"), ("q30_std", "std", "round(stddev_samp(l_extendedprice), 2)")):
    _grouped(_n, _f, _s)


@query("q31_first", f"SELECT user_id, arg_min(nv, event_id) FILTER (nv IS NOT NULL) AS nv FROM {EV} GROUP BY user_id")
def _(s, d):
    return grouping.group(events(s, d), ["user_id"], {"nv": "first"}, by="event_id", ordered=False)


@query("q32_last", f"SELECT user_id, arg_max(nv, event_id) FILTER (nv IS NOT NULL) AS nv FROM {EV} GROUP BY user_id")
def _(s, d):
    return grouping.group(events(s, d), ["user_id"], {"nv": "last"}, by="event_id", ordered=False)


@query("q33_std_of_one", "SELECT o_orderkey, CASE WHEN count(o_totalprice) = 1 THEN 0.0 ELSE stddev_samp(o_totalprice) END AS o_totalprice FROM orders GROUP BY o_orderkey")
def _(s, d):
    return grouping.group(load(s, d, "orders"), ["o_orderkey"], {"o_totalprice": "std"}, ordered=False)


@query("q34_null_key", f"SELECT k, count(value) AS n FROM (SELECT nullif(event_type, 'error') AS k, value FROM {EV}) GROUP BY k")
def _(s, d):
    return grouping.group(events(s, d).withColumn("k", F.nullif(F.col("event_type"), F.lit("error"))), ["k"], {"value": "count"}, names={"value": "n"})


@query("q35_text_sum", "SELECT c_mktsegment, CAST(sum(TRY_CAST(t AS DOUBLE)) AS DOUBLE) AS t FROM (SELECT c_mktsegment, CASE WHEN c_acctbal > 0 THEN CAST(c_nationkey AS VARCHAR) ELSE 'none' END AS t FROM customer) GROUP BY c_mktsegment")
def _(s, d):
    c = load(s, d, "customer").select("c_mktsegment", F.when(F.col("c_acctbal") > 0, F.col("c_nationkey").cast("string")).otherwise("none").alias("t"))
    return grouping.group(c, ["c_mktsegment"], {"t": "sum"}, ordered=False)


@query("q36_size", "SELECT o_orderpriority, o_orderstatus, count(*) AS size FROM orders GROUP BY ALL")
def _(s, d):
    return grouping.size(load(s, d, "orders"), "o_orderpriority", "o_orderstatus")


@query("q37_transform", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS transform_o_totalprice FROM orders")
def _(s, d):
    return grouping.group_transform(load(s, d, "orders"), ["o_custkey"], "o_totalprice", F.avg).select("o_orderkey", r(F.col("transform_o_totalprice"), 6).alias("transform_o_totalprice"))


@query("q37b_transform_rows", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS DOUBLE) AS place FROM orders")
def _(s, d):
    o = load(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return grouping.group_transform_rows(o, ["o_custkey"], "o_totalprice", lambda x: x.rank(method="min"), "double", "place").select("o_orderkey", "place")


@query("q38_group_apply", "SELECT o_custkey, round(max(o_totalprice) - min(o_totalprice), 2) AS spread, count(*) AS n FROM orders GROUP BY o_custkey")
def _(s, d):
    def spread(g):
        import pandas as pd

        return pd.DataFrame({"o_custkey": [g.o_custkey.iloc[0]], "spread": [round(g.o_totalprice.max() - g.o_totalprice.min(), 2)], "n": [len(g)]})

    return grouping.group_apply(load(s, d, "orders").select("o_custkey", "o_totalprice"), ["o_custkey"], spread, "o_custkey long, spread double, n long")


# whole-column statistics


def _whole(name: str, expression, sql: str, digits: int | None = 4):
    @query(name, f"SELECT {f'round({sql}, {digits})' if digits is not None else sql} AS v FROM {EV}")
    def _(s, d):
        c = expression()
        return events(s, d).agg((r(c, digits) if digits is not None else c).alias("v"))


_whole("q39_series_sum", lambda: F.sum("nv"), "sum(nv)", 2)
_whole("q40_series_mean", lambda: F.avg("nv"), "avg(nv)")
_whole("q41_series_median", lambda: series.quantile("nv", 0.5), "quantile_cont(nv, 0.5)")
_whole("q42_series_var", lambda: F.var_samp("nv"), "var_samp(nv)")
_whole("q43_series_std", lambda: F.stddev_samp("nv"), "stddev_samp(nv)")
_whole("q44_series_min", lambda: F.min("nv"), "min(nv)")
_whole("q45_series_max", lambda: F.max("nv"), "max(nv)")
_whole("q46_arg_min", lambda: series.arg_min("nv", "event_id"), "arg_min(event_id, (nv, event_id)) FILTER (nv IS NOT NULL)", None)
_whole("q46b_arg_max", lambda: series.arg_max("nv", "event_id"), "arg_max(event_id, (nv, -event_id)) FILTER (nv IS NOT NULL)", None)
_whole("q47_quantile", lambda: series.quantile("nv", 0.3), "quantile_cont(nv, 0.3)")


@query("q48_describe", f"SELECT count(nv) AS count, count(*) - count(nv) AS nulls, round(avg(nv), 4) AS mean, round(quantile_cont(nv, 0.5), 4) AS median, round(stddev_samp(nv), 4) AS std, round(var_samp(nv), 4) AS var, min(nv) AS min, max(nv) AS max, round(quantile_cont(nv, 0.25), 4) AS q25, round(quantile_cont(nv, 0.75), 4) AS q75 FROM {EV}")
def _(s, d):
    out = series.describe(events(s, d), "nv")
    return out.select(*(r(F.col(c)).alias(c) if c in ("mean", "median", "std", "var", "q25", "q75") else F.col(c) for c in out.columns))


# joins


def _customers(s, d):
    """Customers in debt, and all orders: an outer join has rows of either side alone."""
    c = load(s, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    o = load(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return c, o


_CO = "(SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_acctbal < 0) c {} JOIN (SELECT o_custkey AS k, o_orderkey FROM orders WHERE o_orderstatus = 'F') o ON c.k IS NOT DISTINCT FROM o.k"


def _joined(name: str, how: str, sql: str):
    @query(name, f"SELECT coalesce(c.k, o.k) AS k, name, o_orderkey FROM {_CO.format(sql)}")
    def _(s, d):
        return joins.join(*_customers(s, d), "k", how)


for _n, _h, _s in (("q49_inner", "inner", "INNER"), ("q50_left", "left", "LEFT"), ("q51_right", "right", "RIGHT"), ("q52_outer", "outer", "FULL")):
    _joined(_n, _h, _s)


@query("q53_null_keys", f"WITH a AS (SELECT nullif(event_type, 'error') AS k, count(*) AS n FROM {EV} GROUP BY 1), b AS (SELECT nullif(event_type, 'error') AS k, sum(user_id) AS t FROM {EV} GROUP BY 1) SELECT a.k AS k, n, CAST(t AS BIGINT) AS t FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def _(s, d):
    e = events(s, d).withColumn("k", F.nullif(F.col("event_type"), F.lit("error")))
    return joins.join(e.groupBy("k").agg(F.count("*").alias("n")), e.groupBy("k").agg(F.sum("user_id").alias("t")), "k")


@query("q54_composite_keys", "SELECT l.l_partkey AS l_partkey, l.l_suppkey AS l_suppkey, l.q AS q, r.m AS m FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) l JOIN (SELECT l_partkey, l_suppkey, max(l_discount) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) r ON l.l_partkey = r.l_partkey AND l.l_suppkey = r.l_suppkey")
def _(s, d):
    items = load(s, d, "lineitem")
    keys = ["l_partkey", "l_suppkey"]
    return joins.join(items.groupBy(*keys).agg(F.sum("l_quantity").alias("q")), items.where("l_returnflag = 'R'").groupBy(*keys).agg(F.max("l_discount").alias("m")), keys)


@query("q55_suffixes", "SELECT n.r AS r, n.name AS name_n, t.name AS name_r FROM (SELECT n_regionkey AS r, n_name AS name FROM nation) n JOIN (SELECT r_regionkey AS r, r_name AS name FROM region) t ON n.r = t.r")
def _(s, d):
    n = load(s, d, "nation").select(F.col("n_regionkey").alias("r"), F.col("n_name").alias("name"))
    return joins.join(n, load(s, d, "region").select(F.col("r_regionkey").alias("r"), F.col("r_name").alias("name")), "r", suffixes=("_n", "_r"))


@query("q55b_orders_lineitem", "SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def _(s, d):
    both = joins.join(load(s, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority"), load(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_extendedprice"), "k")
    return both.groupBy("o_orderpriority").agg(F.count("*").alias("n"), r(F.sum("l_extendedprice"), 2).alias("total"))


@query("q56_concat", "SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _(s, d):
    return frame.concat(load(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")), None, load(s, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key")))


@query("q57_concat_missing", "SELECT c_acctbal AS bal, c_custkey AS key, CAST(NULL AS VARCHAR) AS name FROM customer UNION ALL SELECT NULL, s_suppkey, s_name FROM supplier")
def _(s, d):
    return frame.concat(load(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("bal")), load(s, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key")))


# ranks, running and rolling values, fills


def _ranked(name: str, method: str, sql: str):
    @query(name, f"SELECT p_partkey, CAST({sql} AS DOUBLE) AS rank_p_size FROM part")
    def _(s, d):
        return ordered.rank(load(s, d, "part").select("p_partkey", "p_size"), "p_size", method).select("p_partkey", "rank_p_size")


_ranked("q58_rank_min", "min", "rank() OVER (ORDER BY p_size)")
_ranked("q59_rank_dense", "dense", "dense_rank() OVER (ORDER BY p_size)")
_ranked("q60_rank_max", "max", "rank() OVER (ORDER BY p_size) + count(*) OVER (PARTITION BY p_size) - 1")
_ranked("q61_rank_average", "average", "rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2")


@query("q62_rank_nulls", f"SELECT event_id, CASE WHEN nv IS NOT NULL THEN CAST(rank() OVER (ORDER BY nv NULLS LAST) AS DOUBLE) END AS rank_nv FROM {EV}")
def _(s, d):
    return ordered.rank(events(s, d).select("event_id", "nv"), "nv").select("event_id", "rank_nv")


@query("q63_cumsum", "SELECT event_id, round(sum(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 2) AS total FROM events")
def _(s, d):
    return ordered.cumulative_sum(load(s, d, "events").select("event_id", "value"), "value", "event_id", "total").select("event_id", r(F.col("total"), 2).alias("total"))


@query("q63b_cumsum_nulls", f"SELECT event_id, round(sum(nv) OVER (ORDER BY event_id), 2) AS total FROM {EV}")
def _(s, d):
    return ordered.cumulative_sum(events(s, d).select("event_id", "nv"), "nv", "event_id", "total").select("event_id", r(F.col("total"), 2).alias("total"))


@query("q64_cumprod", "SELECT event_id, round(product(1 + value / 1e7) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS total FROM events")
def _(s, d):
    e = load(s, d, "events").select("event_id", (1 + F.col("value") / 1e7).alias("g"))
    return ordered.cumulative_product(e, "g", "event_id", "total").select("event_id", r(F.col("total"), 6).alias("total"))


@query("q65_rolling_mean", "SELECT event_id, CASE WHEN row_number() OVER (ORDER BY event_id) >= 7 THEN round(avg(value) OVER (ORDER BY event_id ROWS 6 PRECEDING), 4) ELSE 0.0 END AS m FROM events")
def _(s, d):
    return ordered.rolling_mean(load(s, d, "events").select("event_id", "value"), "value", "event_id", 7, "m").select("event_id", r(F.col("m")).alias("m"))


@query("q66_rolling_std", "SELECT event_id, CASE WHEN row_number() OVER (ORDER BY event_id) >= 7 THEN round(stddev_samp(value) OVER (ORDER BY event_id ROWS 6 PRECEDING), 3) ELSE 0.0 END AS m FROM events")
def _(s, d):
    return ordered.rolling_std(load(s, d, "events").select("event_id", "value"), "value", "event_id", 7, "m").select("event_id", r(F.col("m"), 3).alias("m"))


@query("q67_zscore", "SELECT event_id, round((value - avg(value) OVER ()) / stddev_samp(value) OVER (), 4) AS z FROM events")
def _(s, d):
    return ordered.z_score(load(s, d, "events").select("event_id", "value"), "value", "z").select("event_id", r(F.col("z")).alias("z"))


@query("q68_fill_forward", f"SELECT event_id, last_value(nv IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nv FROM {EV}")
def _(s, d):
    return ordered.fill_forward(events(s, d).select("event_id", "nv"), "nv", "event_id")


@query("q69_fill_backward", f"SELECT event_id, first_value(nv IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM {EV}")
def _(s, d):
    return ordered.fill_backward(events(s, d).select("event_id", "nv"), "nv", "event_id")


@query("q70_fill_null", f"SELECT event_id, coalesce(nv, -1.0) AS nv FROM {EV}")
def _(s, d):
    return frame.fill_null(events(s, d).select("event_id", "nv"), "nv", -1.0)


@query("q71_mask", f"SELECT event_id, CASE WHEN nv > 50 THEN NULL ELSE nv END AS nv FROM {EV}")
def _(s, d):
    return frame.mask(events(s, d).select("event_id", "nv"), "nv", F.col("nv") > 50)


_X = "(SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN 'NaN'::DOUBLE ELSE value END AS x FROM events)"


def _with_nan(s, d):
    return load(s, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "error", None).when(F.col("event_type") == "view", float("nan")).otherwise(F.col("value")).alias("x"))


@query("q72_sort", f"SELECT event_id, row_number() OVER (ORDER BY x IS NULL DESC, isnan(x) ASC, x DESC, user_id ASC, event_id) - 1 AS pos FROM {_X}")
def _(s, d):
    return ordered.sort_position(_with_nan(s, d), [("x", False), ("user_id", True)], "pos", "event_id").select("event_id", "pos")


@query("q72b_sort_nulls_last", f"SELECT event_id, row_number() OVER (ORDER BY x IS NULL ASC, isnan(x) DESC, x ASC, event_id) - 1 AS pos FROM {_X}")
def _(s, d):
    return ordered.sort_position(_with_nan(s, d), [("x", True, True)], "pos", "event_id").select("event_id", "pos")


@query("q72c_top", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def _(s, d):
    return ordered.sort(load(s, d, "part").select("p_partkey", "p_retailprice"), ("p_retailprice", False), stable_by="p_partkey").limit(20)


# descriptive statistics


def _stat(name: str, expression, sql: str, digits: int = 4):
    @query(name, f"SELECT l_returnflag, round({sql}, {digits}) AS v FROM lineitem GROUP BY l_returnflag")
    def _(s, d):
        return load(s, d, "lineitem").groupBy("l_returnflag").agg(r(expression(F.col("l_extendedprice"), F.col("l_quantity")), digits).alias("v"))


_stat("q73_mean", lambda x, y: S.mean(x), "coalesce(avg(l_extendedprice), 0)", 2)
_stat("q74_median", lambda x, y: S.median(x), "coalesce(quantile_cont(l_extendedprice, 0.5), 0)")
_stat("q76_variance", lambda x, y: S.variance(y), "coalesce(var_samp(l_quantity), 0)")
_stat("q77_std", lambda x, y: S.std(y), "coalesce(stddev_samp(l_quantity), 0)")
_stat("q78_skewness", lambda x, y: S.skewness(x), "coalesce(skewness(l_extendedprice), 0)")
_stat("q79_kurtosis", lambda x, y: S.kurtosis(x), "coalesce(kurtosis(l_extendedprice), 0)")
_stat("q80_covariance", lambda x, y: S.covariance(x, y), "coalesce(covar_samp(l_extendedprice, l_quantity), 0)", 2)
_stat("q81_correlation", lambda x, y: S.correlation(x, y), "corr(l_extendedprice, l_quantity)", 6)
_stat("q82_iqr", lambda x, y: S.iqr(x), "quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)")
_stat("q82b_quantile", lambda x, y: S.quantile(x, 0.9), "quantile_cont(l_extendedprice, 0.9)")


@query("q75_modes", "SELECT l_quantity FROM (SELECT l_quantity, rank() OVER (ORDER BY count(*) DESC) AS k FROM lineitem GROUP BY l_quantity) WHERE k = 1")
def _(s, d):
    return S.modes(load(s, d, "lineitem"), "l_quantity")


# arrays, one a row


def _vector(name: str, expression, sql: str):
    @query(name, f"SELECT vec_id, {sql} AS v FROM (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings)")
    def _(s, d):
        e = load(s, d, "embeddings").select("vec_id", A.values(F.col("embedding")).alias("x"))
        return e.select("vec_id", expression(F.col("x")).alias("v"))


def _rounded(c):
    return F.transform(c, lambda e: r(e, 5))


_vector("q83_array_add", lambda x: _rounded(A.zipped("add", x, x)), "list_transform(x, lambda e: round(e + e, 5))")
_vector("q83b_array_sub", lambda x: _rounded(A.zipped("sub", x, F.reverse(x))), "list_transform(range(1, len(x) + 1), lambda i: round(x[i] - x[len(x) + 1 - i], 5))")
_vector("q84_array_mul", lambda x: _rounded(A.zipped("mul", x, x)), "list_transform(x, lambda e: round(e * e, 5))")
_vector("q84b_array_div", lambda x: F.transform(A.zipped("div", x, A.mapped("abs", x)), lambda e: F.when(F.isnan(e), 0.0).otherwise(F.round(e, 5))), "list_transform(x, lambda e: CASE WHEN e = 0 THEN 0 ELSE round(e / abs(e), 5) END)")
_vector("q85_scalar", lambda x: _rounded(A.with_scalar("sub", A.with_scalar("div", A.with_scalar("mul", A.with_scalar("add", x, 1.0), 3.0), 2.0), 0.5)), "list_transform(x, lambda e: round((e + 1) * 3 / 2 - 0.5, 5))")
_vector("q86_power", lambda x: _rounded(A.power(x, 2.0)), "list_transform(x, lambda e: round(pow(e, 2), 5))")
_vector("q87_abs_neg", lambda x: _rounded(A.mapped("neg", A.mapped("abs", x))), "list_transform(x, lambda e: round(-abs(e), 5))")
_vector("q88_sqrt", lambda x: _rounded(A.mapped("sqrt", A.mapped("abs", x))), "list_transform(x, lambda e: round(sqrt(abs(e)), 5))")
_vector("q88b_exp", lambda x: _rounded(A.mapped("exp", x)), "list_transform(x, lambda e: round(exp(e), 5))")
_vector("q88c_log", lambda x: F.transform(A.mapped("log", x), lambda e: F.when(F.isnan(e) | (F.abs(e) == float("inf")), -999.0).otherwise(F.round(e, 5))), "list_transform(x, lambda e: CASE WHEN e <= 0 THEN -999 ELSE round(ln(e), 5) END)")
_vector("q89_sum", lambda x: r(A.total(x), 5), "round(list_sum(x), 5)")
_vector("q89b_mean", lambda x: r(A.mean(x), 5), "round(list_avg(x), 5)")
_vector("q89c_min_max", lambda x: F.array(r(F.array_min(x), 5), r(F.array_max(x), 5)), "[round(list_min(x), 5), round(list_max(x), 5)]")
_vector("q90_compare", lambda x: F.size(F.filter(A.zipped("gt", x, F.reverse(x)), lambda b: b)).cast("long"), "len(list_filter(range(1, len(x) + 1), lambda i: x[i] > x[len(x) + 1 - i]))")
_vector("q91_dot", lambda x: r(A.dot(x, F.reverse(x)), 5), "round(list_inner_product(x, list_reverse(x)), 5)")
_vector("q92_norm", lambda x: r(A.norm(x), 5), "round(sqrt(list_inner_product(x, x)), 5)")
_vector("q92b_axis_sum", lambda x: _rounded(A.reduced("sum", x, (4, 16), 1)), "[round(list_sum(x[1:16]), 5), round(list_sum(x[17:32]), 5), round(list_sum(x[33:48]), 5), round(list_sum(x[49:64]), 5)]")
_vector("q92c_at", lambda x: r(A.at(x, (8, 8), 3, 5), 5), "round(x[30], 5)")
_vector("q92d_put", lambda x: _rounded(A.put(x, (8, 8), (0, 0), 9.0)), "list_prepend(9.0, list_transform(x[2:], lambda e: round(e, 5)))")
_vector("q93_slice", lambda x: _rounded(A.sliced(x, 64, 10, 40, 3)), "list_transform(range(11, 41, 3), lambda i: round(x[i], 5))")
_vector("q93b_slice_back", lambda x: _rounded(A.sliced(x, 64, None, None, -1)), "list_transform(list_reverse(x), lambda e: round(e, 5))")


# arrays, an element a row


def _matrix(s, d) -> A.Long:
    e = load(s, d, "embeddings")
    n = e.agg(F.max("vec_id") + 1).first()[0]
    return A.Long(e.select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("i1", "v")).select("i0", F.col("i1").cast("long").alias("i1"), F.col("v").cast("double").alias("v")), (n, 64))


_M = "(SELECT vec_id AS i0, unnest(range(64)) AS i1, unnest(embedding)::DOUBLE AS v FROM embeddings)"


@query("q94_flatten", f"SELECT i0 * 64 + i1 AS i0, round(v, 5) AS v FROM {_M}")
def _(s, d):
    return _matrix(s, d).flatten().map(lambda v: r(v, 5)).df


@query("q95_reshape", f"SELECT (i0 * 64 + i1) // 32 AS i0, i1 % 32 AS i1, round(v, 5) AS v FROM {_M}")
def _(s, d):
    m = _matrix(s, d)
    return m.reshape(m.shape[0] * 2, 32).map(lambda v: r(v, 5)).df


@query("q96_transpose", f"SELECT i1 AS i0, i0 AS i1, round(v, 5) AS v FROM {_M}")
def _(s, d):
    return _matrix(s, d).transpose().map(lambda v: r(v, 5)).df


@query("q96b_slice", f"SELECT i0, (60 - i1) // 4 AS i1, round(v, 5) AS v FROM {_M} WHERE i1 >= 20 AND i1 <= 60 AND (60 - i1) % 4 = 0")
def _(s, d):
    return _matrix(s, d).slice(slice(None), slice(60, 19, -4)).map(lambda v: r(v, 5)).df


@query("q97_matmul", f"WITH m AS {_M} SELECT a.i1 AS i0, b.i1 AS i1, round(sum(a.v * b.v), 4) AS v FROM m a JOIN m b ON a.i0 = b.i0 GROUP BY a.i1, b.i1")
def _(s, d):
    m = _matrix(s, d)
    return m.transpose().matmul(m).map(lambda v: r(v, 4)).df


@query("q98_broadcast_add", f"WITH m AS {_M} SELECT m.i0 AS i0, m.i1 AS i1, round(m.v - c.v, 5) + 0.0 AS v FROM m JOIN (SELECT i1, avg(v) AS v FROM m GROUP BY i1) c ON m.i1 = c.i1")
def _(s, d):
    m = _matrix(s, d)
    return m.combine("sub", m.reduce("mean", 0)).map(lambda v: r(v, 5) + 0.0).df


@query("q98b_axis_max", f"SELECT i0, round(max(v), 5) AS v FROM {_M} GROUP BY i0")
def _(s, d):
    return _matrix(s, d).reduce("max", 1).map(lambda v: r(v, 5)).df


@query("q98c_frobenius", f"SELECT round(sqrt(sum(v * v)), 4) AS v FROM {_M}")
def _(s, d):
    return _matrix(s, d).norm().select(r(F.col("v")).alias("v"))


# casts and files


@query("q99_casts", "SELECT o_orderkey, CAST(trunc(-o_totalprice) AS BIGINT) AS i, CAST(o_orderkey AS DOUBLE) AS f, o_orderkey <> 1 AS b, CAST(o_orderkey AS VARCHAR) AS t, o_orderkey AS back, strftime(make_timestamp(o_orderkey * 1000000), '%Y-%m-%d %H:%M:%S') AS ts FROM orders")
def _(s, d):
    o = load(s, d, "orders").select("o_orderkey", "o_totalprice")
    key, long = F.col("o_orderkey"), T.LongType()
    return o.select(
        "o_orderkey", casts.cast(-F.col("o_totalprice"), T.DoubleType(), "int64").alias("i"), casts.cast(key, long, "float64").alias("f"), casts.cast(key.cast("string"), T.StringType(), "int64").cast("boolean").alias("_"),
        (casts.cast(key - 1, long, "bool")).alias("b"), casts.cast(key, long, "string").alias("t"), casts.cast(key.cast("string"), T.StringType(), "int64").alias("back"), F.date_format(casts.cast(key, long, "time"), "yyyy-MM-dd HH:mm:ss").alias("ts"),
    ).drop("_")


@query("q100_csv_round_trip", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def _(s, d):
    csv_source.write_csv(load(s, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path := scratch(s, "csv"))
    return csv_source.read_csv(s, path)


@query("q101_json_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(s, d):
    json_source.write_json(load(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path := scratch(s, "json"))
    return json_source.read_json(s, path)


@query("q101b_json_columns", "SELECT n_nationkey, n_name FROM nation")
def _(s, d):
    json_source.write_json_columns(load(s, d, "nation").select("n_nationkey", "n_name"), path := scratch(s, "json"), "n_nationkey")
    return json_source.read_json(s, path, "columns")


@query("q101c_parquet_round_trip", "SELECT s_suppkey, s_name FROM supplier")
def _(s, d):
    parquet_source.write_parquet(load(s, d, "supplier"), path := scratch(s, "parquet"))
    return parquet_source.read_parquet(s, path, ["s_suppkey", "s_name"])


# distributions


def _spread(name: str, expression, sql: str | None, digits: int = 6):
    @query(name, sql and f"SELECT event_id, round(CAST({sql} AS DOUBLE), {digits}) AS v FROM (SELECT event_id, value / 100 AS x FROM events)")
    def _(s, d):
        return load(s, d, "events").select("event_id", (F.col("value") / 100).alias("x")).select("event_id", r(expression(F.col("x")), digits).alias("v"))


_half = lambda x: x / (1 + F.abs(x))  # noqa: E731  into (-1, 1)
_p = lambda x: (1 + _half(x)) / 2  # noqa: E731  into (0, 1)
_spread("q102_normal_pdf", D.Normal(0.5, 2.0).pdf, "exp(-(x - 0.5) * (x - 0.5) / 8) / (2 * sqrt(2 * pi()))")
_spread("q103_uniform_cdf", D.Uniform(0.1, 0.9).cdf, "CASE WHEN x <= 0.1 THEN 0 WHEN x >= 0.9 THEN 1 ELSE (x - 0.1) / 0.8 END")
_spread("q103b_uniform_pdf", D.Uniform(0.1, 0.9).pdf, "CASE WHEN x BETWEEN 0.1 AND 0.9 THEN 1.25 ELSE 0 END")
_spread("q104_exponential_cdf", D.Exponential(1.5).cdf, "CASE WHEN x < 0 THEN 0 ELSE 1 - exp(-1.5 * x) END")
_spread("q104b_exponential_ppf", lambda x: D.Exponential(1.5).ppf(_p(x)), "-ln(1 - (1 + x / (1 + abs(x))) / 2) / 1.5")
_spread("q105_binomial_pmf", lambda x: D.Binomial(12, 0.3).pdf(F.pmod(F.floor(x * 10), F.lit(13)).cast("double")), "(SELECT factorial(12) / (factorial(k) * factorial(12 - k)) * pow(0.3, k) * pow(0.7, 12 - k) FROM (SELECT CAST(((floor(x * 10) % 13) + 13) % 13 AS INTEGER) AS k))")
_spread("q106_poisson_pmf", lambda x: D.Poisson(3.5).pdf(F.pmod(F.floor(x * 10), F.lit(15)).cast("double")), "(SELECT exp(-3.5) * pow(3.5, k) / factorial(k) FROM (SELECT CAST(((floor(x * 10) % 15) + 15) % 15 AS INTEGER) AS k))")
#: Of x, the standard normal probability between 0 and z, by its series; z in DuckDB's SQL.
_inner = lambda z: f"exp(-({z}) * ({z}) / 2) / 2 * list_sum(list_transform(range(0, 120), lambda k: pow({z}, 2 * k + 1) / exp((k + 0.5) * ln(2) + lgamma(k + 1.5))))"
_spread("q106b_normal_cdf", D.Normal(0.5, 2.0).cdf, f"0.5 + {_inner('((x - 0.5) / 2)')}")
_spread("q106c_normal_ppf", lambda x: D.Normal(0.5, 2.0).ppf(_p(x)), None)
_spread("q106d_t_cdf", D.StudentT(5.0).cdf, "0.5 + (atan(x / sqrt(5)) + sin(atan(x / sqrt(5))) * cos(atan(x / sqrt(5))) * (1 + 2 * pow(cos(atan(x / sqrt(5))), 2) / 3)) / pi()")
_spread("q106e_chi2_cdf", lambda x: D.ChiSquared(3.0).cdf(F.abs(x)), f"2 * {_inner('sqrt(abs(x))')} - sqrt(2 * abs(x) / pi()) * exp(-abs(x) / 2)")
_spread("q106f_poisson_cdf", lambda x: D.Poisson(3.5).cdf(F.abs(x) * 5), "list_sum(list_transform(range(0, CAST(floor(abs(x) * 5) AS BIGINT) + 1), lambda k: exp(k * ln(3.5) - 3.5 - lgamma(k + 1.0))))")
_spread("q106g_binomial_cdf", lambda x: D.Binomial(12, 0.3).cdf(F.abs(x) * 5), "list_sum(list_transform(range(0, least(12, CAST(floor(abs(x) * 5) AS BIGINT)) + 1), lambda k: exp(lgamma(13.0) - lgamma(k + 1.0) - lgamma(13.0 - k) + k * ln(0.3) + (12 - k) * ln(0.7))))")
_spread("q106h_normal_round_trip", lambda x: D.Normal(0.5, 2.0).cdf(D.Normal(0.5, 2.0).ppf(_p(x))), "(1 + x / (1 + abs(x))) / 2")


@query("q107_arange", "SELECT i AS i0, round(CAST(2.0 + i * 0.25 AS DOUBLE), 6) AS v FROM range(32) t(i)")
def _(s, d):
    return A.arange(s, 2.0, 10.0, 0.25).map(lambda v: r(v, 6)).df


@query("q108_linspace", "SELECT i AS i0, round(CAST(-1.0 + i * 0.02 AS DOUBLE), 6) AS v FROM range(101) t(i)")
def _(s, d):
    return A.linspace(s, -1.0, 1.0, 101).map(lambda v: r(v, 6)).df


@query("q109_full", "SELECT i // 4 AS i0, i % 4 AS i1, CAST(3.5 AS DOUBLE) AS v FROM (SELECT CAST(i AS BIGINT) AS i FROM range(12) t(i))")
def _(s, d):
    return A.full(s, 2.5, 3, 4).combine("add", A.ones(s, 3, 4)).combine("add", A.zeros(s, 3, 4)).df


@query("q109b_random")
def _(s, d):
    return A.random(s, 7, 100, 10).combine("add", A.random_normal(s, 8, 0.0, 1.0, 100, 10)).df


@query("q109c_random_range", "SELECT CAST(1000 AS BIGINT) AS n, true AS within, true AS again, true AS spread")
def _(s, d):
    u, again, z = A.random(s, 7, 100, 10).df, A.random(s, 7, 100, 10).df, A.random_normal(s, 8, 0.0, 1.0, 100, 10).df
    same = u.join(again.withColumnRenamed("v", "w"), ["i0", "i1"]).where("v = w").agg(F.count("*").alias("same"))
    told = u.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    wide = z.agg(F.abs(F.avg("v")).alias("m"), F.stddev_samp("v").alias("sd"))
    return told.crossJoin(same).crossJoin(wide).select("n", ((F.col("low") >= 0) & (F.col("high") < 1)).alias("within"), (F.col("same") == F.col("n")).alias("again"), ((F.col("m") < 0.2) & F.col("sd").between(0.8, 1.2)).alias("spread"))


# parallel


@query("q110_parallel_map", f"SELECT event_id, nv * 2 AS nv FROM {EV}")
def _(s, d):
    return parallel.Pool().map(events(s, d).select("event_id", "nv"), "nv", lambda v: v * 2)


@query("q111_parallel_reduce", "SELECT CAST(sum(user_id) AS BIGINT) AS v FROM events")
def _(s, d):
    return s.createDataFrame([(parallel.Pool().reduce(load(s, d, "events"), "user_id", 0, lambda a, b: a + b),)], "v long")


@query("q112_parallel_filter", f"SELECT event_id, nv FROM {EV} WHERE nv > 30")
def _(s, d):
    return parallel.Pool().filter(events(s, d).select("event_id", "nv"), "nv", F.col("nv") > 30)


@query("q113_fold", "SELECT round(sum(value), 2) AS value FROM events")
def _(s, d):
    return series.fold(load(s, d, "events"), "value", "event_id", F.lit(0.0), lambda a, x: a + x).select(r(F.col("value"), 2).alias("value"))


# linear algebra on Gram matrices of embeddings by label


#: Of an embedding.
DIMENSIONS = 64


def _grams(s, d):
    """By label, the Gram matrix of all DIMENSIONS plus the identity."""
    e = load(s, d, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    g = linalg.gram(e, "label", "x").withColumn("v", F.col("v") + F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return g.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "v"))), lambda t: t["v"]).alias("m"))


@query("q114_det")
def _(s, d):
    return _grams(s, d).select("label", r(linalg.det(F.col("m")), 4).alias("det"))


@query("q115_inv")
def _(s, d):
    return _grams(s, d).select("label", linalg.inv(F.col("m")).alias("inv"))


@query("q116_solve")
def _(s, d):
    return _grams(s, d).select("label", linalg.solve(F.col("m"), F.slice("m", 1, DIMENSIONS)).alias("x"))


@query("q117_svd")
def _(s, d):
    return _grams(s, d).select("label", linalg.svd(F.col("m"), DIMENSIONS, DIMENSIONS)["s"].alias("s"))


#: A flat row-major matrix's row i.
_row = lambda m, i: F.slice(m, i * DIMENSIONS + 1, F.lit(DIMENSIONS))
_places = lambda: F.sequence(F.lit(0), F.lit(DIMENSIONS - 1))


def _times(m, x):
    """The matrix times a vector."""
    return F.transform(_places(), lambda i: A.dot(_row(m, i), x))


@query("q114b_det_of_inverse", "SELECT label, CAST(1 AS DOUBLE) AS product FROM embeddings GROUP BY label")
def _(s, d):
    small = _grams(s, d).select("label", F.transform("m", lambda v: v / 100).alias("m"))  # or the determinant leaves the doubles
    return small.select("label", r(linalg.det(F.col("m")) * linalg.det(linalg.inv(F.col("m"))), 5).alias("product"))


@query("q115b_inverse_residual", "SELECT label, CAST(0 AS DOUBLE) AS off FROM embeddings GROUP BY label")
def _(s, d):
    both = _grams(s, d).select("label", "m", linalg.inv(F.col("m")).alias("w"))
    off = F.transform(_places(), lambda i: F.array_max(F.transform(_places(), lambda j: F.abs(A.dot(_row(F.col("m"), i), _row(F.col("w"), j)) - F.when(i == j, 1.0).otherwise(0.0)))))
    return both.select("label", r(F.array_max(off), 5).alias("off"))  # both are symmetric, so rows serve as columns


@query("q116b_solve_residual", "SELECT label, CAST(0 AS DOUBLE) AS off FROM embeddings GROUP BY label")
def _(s, d):
    b = F.slice("m", 1, DIMENSIONS)
    both = _grams(s, d).select("label", "m", linalg.solve(F.col("m"), b).alias("x"))
    return both.select("label", r(F.array_max(F.zip_with(_times(F.col("m"), F.col("x")), F.slice("m", 1, DIMENSIONS), lambda p, q: F.abs(p - q))), 5).alias("off"))


@query("q117b_svd_sums", f"SELECT label, round(sum(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) + {DIMENSIONS}, 3) AS trace FROM embeddings GROUP BY label")
def _(s, d):
    found = _grams(s, d).select("label", linalg.svd(F.col("m"), DIMENSIONS, DIMENSIONS)["s"].alias("s"))
    return found.select("label", r(A.total(F.col("s")), 3).alias("trace"))  # singular values of a positive matrix add up to its trace


@query("q118_tumbling", "SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def _(s, d):
    out = event_stream.tumbling(load(s, d, "events"), "ts", "1 day", ["event_type"], "value")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", r(F.col("total"), 2).alias("total"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Filter by a predicate, group, aggregate, sort."""
    items = frame.where(load(s, d, "lineitem"), P.and_(P.col("l_quantity").gte(10), P.col("l_returnflag").eq("A")))
    return grouping.group(items, ["l_linestatus"], {"l_extendedprice": "mean", "l_quantity": "count"})


query("q00_flagship", "SELECT l_linestatus, round(avg(l_extendedprice), 2) AS l_extendedprice, count(l_quantity) AS l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_returnflag = 'A' GROUP BY l_linestatus")(lambda s, d: flagship(s, d).withColumn("l_extendedprice", r(F.col("l_extendedprice"), 2)))
