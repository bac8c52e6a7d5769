"""The engine on small frames: shared fixtures, nulls and NaN, properties."""

from __future__ import annotations

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions import arrays as A
from loomframe.functions import casts, linalg
from loomframe.functions import distributions as D
from loomframe.functions import statistics as S
from loomframe.operators import frame, grouping, joins, ordered, parallel, series
from loomframe.plans import predicates as P
from loomframe.sources import csv as csv_source
from loomframe.sources import json as json_source
from loomframe.sources import parquet as parquet_source
from loomframe.streaming import events

NAN = float("nan")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_columns_become_a_frame(spark):
    df = frame.from_columns(spark, {"name": ["a", "b", "c"], "id": [1, 2, 3]}, position="pos")
    assert frame.shape(df) == (3, 3) and ordered.row(df, 1, "pos")["name"] == "b"
    assert frame.from_columns(spark, {"x": [1, 2.5, None]}).schema["x"].dataType == T.DoubleType()
    for bad in ({"a": [1], "b": [1, 2]}, {"": [1]}):
        with pytest.raises(ValueError):
            frame.from_columns(spark, bad)
    with pytest.raises(TypeError):
        frame.from_columns(spark, {"a": [1, "x"]})
    assert frame.shape(frame.empty(spark)) == (0, 0)
    with pytest.raises(IndexError):
        ordered.row(df, 3, "pos")


def test_projection_errors(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    for call in (lambda: frame.select(df, "z"), lambda: frame.rename(df, "z", "y"), lambda: grouping.group(df, ["z"], {"a": "sum"})):
        with pytest.raises(KeyError):
            call()
    for call in (lambda: frame.select(df, "a", "a"), lambda: frame.rename(df, "a", "b"), lambda: frame.add_column(df, "a", F.lit(1)), lambda: grouping.group(df, ["a"], {"a": "sum"})):
        with pytest.raises(ValueError):
            call()
    assert frame.rename(df, "a", "a").columns == ["a", "b"]
    assert rows(frame.info(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"))) == [("a", "int", 2, 0), ("b", "string", 2, 1)]


def test_predicates(spark):
    df = spark.createDataFrame([(21, "A"), (35, "B"), (40, "B")], "age int, dept string")
    assert frame.where(df, P.and_(P.col("age").gte(30), P.col("dept").eq("B"))).count() == 2
    one = spark.createDataFrame([(36, "Engineering", True)], "age int, dept string, alive boolean")
    assert frame.where(one, P.col("age").gte(30) & P.col("dept").isin("Engineering", "Data") & ~P.col("alive").eq(False)).count() == 1
    assert frame.where(one, P.col("dept").starts_with("Sales")).count() == 0
    with pytest.raises(ValueError):
        P.col("a").matches("(")


@pytest.mark.parametrize(
    "predicate, kept",
    [
        (P.col("x").lt(5), [1, 3]), (P.col("x").lte(5), [1, 2, 3]), (P.col("x").ne(5), [1, 3, 4]), (P.col("x").eq(5), [2]), (P.col("x").gt(5), [4]),
        (P.col("x").eq(None), [3]), (P.col("x").ne(None), [1, 2, 4]), (P.col("x").isin(1, None), [1, 3]), (P.col("x").isin(), []), (P.not_(P.col("x").eq(5)), [1, 3, 4]),
        (P.not_(P.col("x").lt(5)), [2, 4]), (P.and_(), [1, 2, 3, 4]), (P.or_(), []), (P.and_(P.col("x").eq(5), None), []), (P.or_(P.col("x").eq(5), None), [2]), (P.not_(None), []),
        (P.col("x").is_null(), [3]), (P.col("x").is_not_null(), [1, 2, 4]),
    ],
)
def test_nulls_lie_below_all(spark, predicate, kept):
    df = spark.createDataFrame([(1, 1), (2, 5), (3, None), (4, 9)], "id int, x int")
    assert [r.id for r in frame.where(df, predicate).orderBy("id").collect()] == kept


def test_sql_nulls_and_pushdown(spark, tmp_path):
    df = spark.createDataFrame([(1, 1), (2, None)], "id int, x int")
    assert [r.id for r in frame.where(df, P.col("x").lt(5), "sql").collect()] == [1]
    df.write.parquet(str(tmp_path / "p"))
    plan = frame.where(spark.read.parquet(str(tmp_path / "p")), P.col("x").gt(3))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,3)" in plan


def test_null_rows_keep_nan(spark):
    df = spark.createDataFrame([(1, 1.0), (2, NAN), (3, None), (4, -0.0)], "i int, x double")
    assert [r.i for r in frame.drop_null_rows(df, "x").orderBy("i").collect()] == [1, 2, 4]
    assert [r.x for r in frame.fill_null(df, "x", 7.0).orderBy("i").collect()][2] == 7.0
    with pytest.raises(KeyError):
        frame.drop_null_rows(df, "nope")


def test_sort_places_nulls_and_nan(spark):
    df = spark.createDataFrame([(1, 1.0), (2, NAN), (3, None), (4, 5.0)], "i int, x double")
    order = lambda *key: [r.i for r in ordered.sort(df, key).collect()]
    assert (order("x", True), order("x", False), order("x", True, True), order("x")) == ([3, 2, 1, 4], [3, 4, 1, 2], [2, 1, 4, 3], [3, 4, 1, 2])
    big = spark.createDataFrame([(9223372036854775000,), (9223372036854774999,)], "x long")
    assert rows(ordered.sort(big, ("x", True)))[0] == (9223372036854774999,)


@pytest.mark.parametrize("method, want", [("dense", [1, 1, 2, 3]), ("min", [1, 1, 3, 4]), ("max", [2, 2, 3, 4]), ("average", [1.5, 1.5, 3, 4])])
def test_ranks(spark, method, want, monkeypatch):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([10.0, 10.0, 20.0, 30.0, None])], "i int, x double")
    for size in (2_000_000, 2):
        monkeypatch.setattr(ordered, "BUCKET_ROWS", size)
        assert [r.rank_x for r in ordered.rank(df, "x", method).orderBy("i").collect()] == [*want, None]
    with pytest.raises(ValueError):
        ordered.rank(df, "x", "odd")


@pytest.mark.parametrize("bucket", [2_000_000, 7])
def test_running_values_do_not_depend_on_buckets(spark, bucket, monkeypatch):
    default = ordered.bucketed
    monkeypatch.setattr(ordered, "bucketed", lambda df, by: default(df, by, bucket))
    monkeypatch.setattr(ordered, "BUCKET_ROWS", max(bucket, 1) if bucket > 100 else 12)
    values = [None if i % 5 == 0 else float(i % 7) for i in range(40)]
    df = spark.createDataFrame([(i, v, float(i)) for i, v in enumerate(values)], "i int, x double, y double").repartition(4)
    at = lambda d, c: [r[c] for r in d.orderBy("i").collect()]
    assert at(ordered.with_position(df, "i"), "_pos") == list(range(40))
    assert at(ordered.cumulative_sum(df, "y", "i", "s"), "s") == [float(i * (i + 1) // 2) for i in range(40)]
    one = df.withColumn("g", F.lit(2.0))
    assert at(ordered.cumulative_product(one, "g", "i", "s"), "s") == [2.0 ** (i + 1) for i in range(40)]
    forward, last = [], None
    for v in values:
        last = v if v is not None else last
        forward.append(last)
    backward, last = [], None
    for v in reversed(values):
        last = v if v is not None else last
        backward.append(last)
    assert at(ordered.fill_forward(df, "x", "i"), "x") == forward
    assert at(ordered.fill_backward(df, "x", "i"), "x") == backward[::-1]
    assert at(ordered.rolling_mean(df, "y", "i", 3, "m"), "m") == [0.0, 0.0] + [float(i - 1) for i in range(2, 40)]
    assert at(ordered.rolling_std(df, "y", "i", 3, "m", True), "m")[:3] == [None, None, 1.0]
    assert at(ordered.sort_position(df, [("x", False), ("i", True)], "p"), "p") == [sorted(range(40), key=lambda i: (values[i] is not None, -(values[i] or 0), i)).index(k) for k in range(40)]
    with pytest.raises(ValueError):
        ordered.rolling_mean(df, "y", "i", 0, "m")


def test_backward_fill_reads_each_row_once(spark):
    df = spark.createDataFrame([(None, 1, 7.0), (1.0, 1, None), (1.0, 2, 5.0), (2.0, 1, None), (2.0, 2, None), (float("nan"), 1, 9.0), (float("nan"), 2, None)], "i double, j int, x double")
    out = ordered.fill_backward(df, "x", "i", ties=("j",))
    assert [r.x for r in out.orderBy("i", "j").collect()] == [7.0, 5.0, 5.0, 9.0, 9.0, 9.0, None]
    # a frame up to the last row is read anew for each row, which grows with the square of a bucket
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()


def test_slices_of_rows(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "i int").repartition(3)
    assert rows(ordered.head(df, 3, "i")) == [(0,), (1,), (2,)] and rows(ordered.tail(df, 2, "i")) == [(8,), (9,)]
    assert ordered.head(df, -1, "i").count() == 0 and ordered.tail(df, 99, "i").count() == 10
    assert rows(ordered.sample(df, 4, 1, "i")) == rows(ordered.sample(df.coalesce(1), 4, 1, "i")) and ordered.sample(df, 10, 1, "i").count() == 10
    with pytest.raises(ValueError):
        ordered.sample(df, 11, 1, "i")
    z = ordered.z_score(spark.createDataFrame([(5.0,), (5.0,)], "x double"), "x", "z")
    assert rows(z.select("z")) == [(0.0,), (0.0,)]
    text = spark.createDataFrame([("b",), ("",), ("ab",), ("é",)], "s string")
    assert [r.s for r in ordered.with_position(text, "s").orderBy("_pos").collect()] == ["", "ab", "b", "é"]


def test_group_aggregates(spark):
    df = spark.createDataFrame([("A", 100.0, 20), ("A", 200.0, 30), ("B", 300.0, 40), (None, None, 1)], "dept string, salary double, age long")
    out = grouping.group(df, ["dept"], {"salary": "mean", "age": "count"})
    assert out.columns == ["dept", "age", "salary"] and rows(out) == [(None, 1, None), ("A", 2, 150.0), ("B", 1, 300.0)]
    assert rows(grouping.group(df, ["dept"], {"salary": "std"}))[2] == ("B", 0.0)
    assert rows(grouping.group(df, ["dept"], {"salary": "first", "age": "sum"}, by="age"))[1] == ("A", 50, 100.0)
    text = spark.createDataFrame([("1.5",), ("abc",), ("2.5",), (None,)], "s string").withColumn("k", F.lit(1))
    assert rows(grouping.group(text, ["k"], {"s": "sum"})) == [(1, 4.0)] and rows(grouping.group(text, ["k"], {"s": "mean"})) == [(1, 2.0)]
    assert rows(grouping.size(df, "dept")) == [(None, 1), ("A", 2), ("B", 1)]
    with pytest.raises(ValueError):
        grouping.group(df, ["dept"], {"age": "middle"})
    moved = grouping.group_transform_rows(df, ["dept"], "age", lambda s: s - s.min(), "long")
    assert sorted(r.transform_age for r in moved.collect()) == [0, 0, 0, 10]


def test_quantiles_of_a_column_share_a_table_of_values(spark):
    df = spark.createDataFrame([(1, None), (1, 1.0), (1, 2.0), (1, 4.0), (2, None)], "k int, x double")
    spread, whole = df.groupBy("k").agg(S.iqr(F.col("x")).alias("v")), series.describe(df, "x")
    for out in (spread, whole):
        assert out._jdf.queryExecution().executedPlan().toString().count("partial_percentile(") == 1
    assert sorted(rows(spread)) == [(1, 1.5), (2, 0.0)]
    assert rows(whole.select("q25", "median", "q75")) == [(1.5, 2.0, 3.0)]


def _many_groups(spark):
    def value(i):
        return (None if i % 11 == 0 else f"k{i % 11}", None if i % 13 == 5 else 2**53 + 1 + i, float("nan") if i % 17 == 3 else i / 4, None if i % 19 == 2 else i % 2 == 0)

    big = [("big", i, 1.0, True) for i in range(50)]
    return spark.createDataFrame([*map(value, range(200)), *big, ("one", 7, None, None)], "k string, n long, x double, b boolean").repartition(3)


@pytest.mark.parametrize("batch", [1, 3, 10000])
def test_group_apply_takes_many_groups_at_a_time(spark, batch):
    import pandas as pd

    def told(g):
        if g.k.iloc[0] == "k1":
            return pd.DataFrame()
        g["n"] = g["n"] - 1  # the frame is the function's own
        kinds = f"{g.dtypes.n} {g.dtypes.x} {g.dtypes.b} {list(g.index)[-1]}"
        return pd.DataFrame({"kinds": kinds, "k": g.k.iloc[0], "n": g.n.max() if len(g) > 1 else None, "x": g.x.sum(), "m": [len(g), g.b.isna().sum()]})

    df, schema = _many_groups(spark), "k string, n long, x double, m long, kinds string"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        out = grouping.group_apply(df, ["k"], told, schema)
        got = sorted(map(repr, rows(out)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(map(repr, rows(df.groupBy("k").applyInPandas(told, schema))))
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="columns"):
        grouping.group_apply(df, ["k"], lambda g: g.rename(columns={"x": "y"}), df.schema).collect()
    lists = df.groupBy("k").agg(F.collect_list("n").alias("n"))
    assert grouping.group_apply(lists, ["k"], lambda g: g, lists.schema).count() == lists.count()


@pytest.mark.parametrize("batch", [1, 3, 10000])
def test_group_transform_rows_takes_many_groups_at_a_time(spark, batch):
    df = _many_groups(spark).withColumn("id", F.expr("coalesce(n, 0) * 1000 + coalesce(x, 0)")).withColumn("at", F.lit("2024-01-02 03:04:05").cast("timestamp")).cache()
    calls = {
        "n": (lambda s: s.astype("object").where(s.notna(), None).map(lambda v: None if v is None else v - 1), "long"),
        "x": (lambda s: s.rank(method="min"), "double"), "b": (lambda s: [str(s.dtype)] * len(s), "string"),
    }
    for name, (fn, kind) in calls.items():
        schema = f"k string, n long, x double, b boolean, {df.select('id').schema.simpleString()[7:-1].replace(':', ' ')}, at timestamp, out {kind}"
        want = df.groupBy("k").applyInPandas((lambda fn, name: lambda g: g.assign(out=list(fn(g[name]))))(fn, name), schema)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        try:
            out = grouping.group_transform_rows(df, ["k"], name, fn, kind, "out")
            got = sorted(map(repr, rows(out.select("k", "b", "at", "out"))))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == sorted(map(repr, rows(want.select("k", "b", "at", "out")))), name
        assert sorted(map(repr, rows(out.drop("out")))) == sorted(map(repr, rows(df)))  # the rows as they were
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="values for"):
        grouping.group_transform_rows(df, ["k"], "x", lambda s: s[:1], "double").collect()


def test_joins(spark):
    left = spark.createDataFrame([("a||b", "c", 10), ("a", "b||c", 20)], "k1 string, k2 string, v1 long")
    right = spark.createDataFrame([("a||b", "c", 100), ("a", "b||c", 200)], "k1 string, k2 string, v2 long")
    assert sorted(rows(joins.join(left, right, ["k1", "k2"]))) == [("a", "b||c", 20, 200), ("a||b", "c", 10, 100)]
    x = spark.createDataFrame([(1, "l"), (None, "ln")], "k int, v string")
    y = spark.createDataFrame([(1, "r"), (None, "rn"), (3, "r3")], "k int, v string")
    assert rows(joins.join(x, y, "k", ordered=True)) == [(None, "ln", "rn"), (1, "l", "r")]
    assert rows(joins.join(x, y, "k", "right", ordered=True))[2] == (3, None, "r3") == rows(joins.join(x, y, "k", "outer", ordered=True))[2]
    turned = joins.join(y, x, "k", "left", suffixes=("_y", "_x")).select("k", "v_x", "v_y")
    assert sorted(map(str, rows(turned))) == sorted(map(str, rows(joins.join(x, y, "k", "right"))))
    for bad in (lambda: joins.join(x, y, "k", "semi"), lambda: joins.join(x, y, []), lambda: joins.join(x.withColumnRenamed("v", "v_y").withColumn("v", F.lit(1)), y, "k", suffixes=("", "_y"))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        joins.join(x, y.withColumn("k", F.col("k").cast("double")), "k")
    plan = joins.join(x, y, "k")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_concat(spark):
    a, b = spark.createDataFrame([(1, "x")], "a long, b string"), spark.createDataFrame([(2, 0.5)], "a long, c double")
    assert frame.concat(a, None, b).columns == ["a", "b", "c"] and sorted(rows(frame.concat(a, b)), key=str) == [(1, "x", None), (2, None, 0.5)]
    with pytest.raises(TypeError):
        frame.concat(a, b.withColumn("a", F.lit("t")))


def test_series(spark):
    df = spark.createDataFrame([(0, 1), (1, None), (2, 3)], "pos int, x long")
    assert rows(series.describe(df, "x"))[0][:4] == (2, 1, 2.0, 2.0)
    assert rows(df.agg(series.arg_max("x", "pos"))) == [(2,)] and series.total(df, "x") == 4
    assert rows(series.append(df, df, "x", "pos").orderBy("pos").select("pos")) == [(i,) for i in range(6)]
    assert rows(series.fold(df, "x", "pos", F.lit(0).cast("long"), lambda s, v: s * 10 + v)) == [(13,)]
    assert rows(series.set_at(df, "x", "pos", 1, 9).orderBy("pos").select("x")) == [(1,), (9,), (3,)]
    for call in (lambda: series.mean(df.where("pos = 1"), "x"), lambda: series.variance(df.where("pos = 0"), "x"), lambda: series.quantile("x", 2)):
        with pytest.raises(ValueError):
            call()
    got = rows(series.map_or_error(df, "x", lambda v: 6 // (v - 1), "long", "y", "e").orderBy("pos").select("y", "e"))
    assert got[0][0] is None and "zero" in got[0][1] and got[1] == (None, None) and got[2] == (3, None)
    with pytest.raises(TypeError):
        series.series_at(df, "x", T.StringType())


def test_casts(spark):
    one = lambda v, kind, target: spark.createDataFrame([(v,)], f"x {kind}").select(casts.cast(F.col("x"), T._parse_datatype_string(kind), target)).first()[0]
    assert (one(-1.9, "double", "int64"), one("12", "string", "int64"), one("1e3", "string", "float64"), one("T", "string", "bool"), one(0, "long", "bool"), one(True, "boolean", "int64")) == (-1, 12, 1000.0, True, False, 1)
    assert one("2024-02-03", "string", "time").day == 3 and one("2024-02-03T04:05:06Z", "string", "time").hour == 4 and one(86400, "long", "time").day == 2
    assert one(None, "string", "int64") is None
    for v, kind, target in (("1.9", "string", "int64"), ("yes", "string", "bool"), ("12f", "string", "float64"), ("soon", "string", "time")):
        with pytest.raises(PySparkException):
            one(v, kind, target)
    with pytest.raises(TypeError):
        casts.cast(F.col("x"), T.TimestampType(), "int64")


def test_statistics(spark):
    df = spark.createDataFrame([(x, 2 * x, 1.0) for x in (1.0, 2.0, 3.0, 4.0, 10.0)], "a double, b double, c double")
    a, b, c = map(F.col, "abc")
    got = df.agg(S.skewness(a), S.kurtosis(a), S.quantile(a, 0.25), S.std(a), S.covariance(a, b), S.correlation(a, b), S.correlation(a, c), S.skewness(c), S.iqr(a)).first()
    assert [None if x is None else round(x, 4) for x in got] == [1.6971, 3.152, 2.0, 3.5355, 25.0, 1.0, None, 0.0, 2.0]
    none = df.where("a > 99").agg(S.mean(a), S.median(a), S.variance(a), S.kurtosis(a)).first()
    assert tuple(none) == (0.0, 0.0, 0.0, 0.0)
    assert rows(S.modes(spark.createDataFrame([(1,), (2,), (2,), (3,), (3,)], "x int"), "x")) == [(2,), (3,)]


DISTRIBUTIONS = [D.Normal(1, 2), D.Uniform(-1, 3), D.Exponential(2), D.StudentT(5), D.ChiSquared(3), D.ChiSquared(1), D.StudentT(1)]


def test_distribution_tables(spark):
    df = spark.createDataFrame([(0.0,)], "x double")
    at = lambda c: df.select(c).first()[0]
    known = [(D.Normal().cdf(F.lit(1.96)), 0.9750021), (D.StudentT(5).cdf(F.lit(2.015048)), 0.95), (D.StudentT(5).cdf(F.lit(0.0)), 0.5), (D.ChiSquared(3).cdf(F.lit(7.814728)), 0.95), (D.ChiSquared(1).cdf(F.lit(3.841459)), 0.95), (D.Poisson(3.5).cdf(F.lit(2.0)), 0.3208472), (D.Binomial(10, 0.3).cdf(F.lit(3.0)), 0.6496107), (D.Poisson(3.5).pdf(F.lit(2.0)), 0.1849594), (D.Binomial(10, 0.3).pdf(F.lit(3.0)), 0.2668279), (D.StudentT(5).pdf(F.lit(0.0)), 0.3796067), (D.ChiSquared(3).pdf(F.lit(1.0)), 0.2419707)]
    for c, want in known:
        assert math.isclose(at(c), want, abs_tol=1e-6)
    assert at(D.Poisson(3.5).ppf(F.lit(0.5))) == 3.0 and at(D.Binomial(10, 0.3).ppf(F.lit(0.5))) == 3.0
    assert D.StudentT(1).variance != D.StudentT(1).variance and D.ChiSquared(3).mean == 3 and D.Normal(0, -1).sigma == 1 and D.Binomial(5, 2).p == 1


@pytest.mark.parametrize("d", DISTRIBUTIONS, ids=str)
def test_quantiles_invert(spark, d):
    df = spark.createDataFrame([(p,) for p in (0.01, 0.2, 0.5, 0.9, 0.999)], "p double")
    for r in df.select("p", d.cdf(d.ppf(F.col("p"))).alias("q")).collect():
        assert math.isclose(r.p, r.q, abs_tol=1e-9)
    if math.isfinite(d.mean) and math.isfinite(d.variance):
        m = spark.range(20_000).select(d.sample(3).alias("x")).agg(F.avg("x")).first()[0]
        assert abs(m - d.mean) < 5 * math.sqrt(d.variance / 20_000)


def matrix(spark, values):
    n = len(values[0])
    df = spark.createDataFrame([(i * n + j, float(v)) for i, r in enumerate(values) for j, v in enumerate(r)], "i0 long, v double")
    return A.from_flat(df, (len(values), n))


def dense(x):
    return {tuple(r)[:-1]: r.v for r in x.df.select(*x.axes, "v").collect()}


def test_long_arrays(spark):
    a, b = matrix(spark, [[1, 2], [3, 4]]), matrix(spark, [[5, 6], [7, 8]])
    assert dense(a.combine("add", b))[1, 1] == 12 and dense(a.matmul(b))[0, 0] == 19
    six = matrix(spark, [[1, 2, 3], [4, 5, 6]])
    assert dense(six.reshape(3, 2))[2, 1] == 6 and six.transpose().shape == (3, 2) and dense(six.transpose())[1, 0] == 2
    assert dense(six.transpose().transpose()) == dense(six) == dense(six.reshape(6).reshape(2, 3)) and dense(six.flatten())[(5,)] == 6
    row = matrix(spark, [[10, 20, 30]])
    assert dense(six.combine("add", row))[1, 2] == 36 and dense(six.combine("mul", row.reshape(3)))[0, 1] == 40
    outer = matrix(spark, [[1], [2]]).combine("mul", row)
    assert outer.shape == (2, 3) and dense(outer)[1, 2] == 60
    assert dense(six.reduce("sum", 0)) == {(0,): 5, (1,): 7, (2,): 9} and dense(six.reduce("max")) == {(0,): 6} and dense(six.reduce("mean", 1))[(0,)] == 2
    cube = six.reshape(1, 2, 3)
    assert dense(cube.reduce("min", 1)) == {(0, 0): 1, (0, 1): 2, (0, 2): 3}
    assert dense(six.slice(slice(None, None, -1), slice(0, 3, 2))) == {(0, 0): 4, (0, 1): 6, (1, 0): 1, (1, 1): 3}
    assert six.norm().first()[0] == math.sqrt(91) and dense(six.scalar("div", 0.0))[0, 0] == float("inf")
    with pytest.raises(ValueError):
        A.broadcast_shape((2, 3), (4,))
    with pytest.raises(ValueError):
        six.matmul(six)
    assert [A.arange(spark, 0, 1, 0).size, A.arange(spark, 5, 0, -2).size, A.linspace(spark, 0, 1, 0).size] == [0, 3, 0]
    assert dense(A.linspace(spark, 2, 3, 1)) == {(0,): 2.0} and dense(linalg.block_matmul(a, b, 1))[0, 0] == 19
    assert [round(x, 4) for x in linalg.singular_values(matrix(spark, [[3, 1], [0, 2]]), 2)] == [3.2566, 1.8424]


def test_row_arrays(spark):
    df = spark.createDataFrame([([1.0, -4.0, 0.0], [2.0, 0.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(A.zipped("div", F.col("a"), F.col("b")), A.mapped("log", F.col("a")), A.dot(F.col("a"), F.col("b")), A.sliced(F.col("a"), 3, -2, None), A.reduced("max", F.col("a"), (1, 3), 1), A.zipped("gt", F.col("a"), F.col("b")), A.mean(F.col("a"))).first()
    assert got[0][:2] == [0.5, float("-inf")] and math.isnan(got[0][2]) and got[1][0] == 0 and math.isnan(got[1][1]) and got[1][2] == float("-inf")
    assert tuple(got[2:]) == (2.0, [-4.0, 0.0], [1.0], [False, False, False], -1.0)
    with pytest.raises(PySparkException):
        df.select(A.zipped("add", F.col("a"), F.array(F.lit(1.0)))).collect()
    with pytest.raises(IndexError):
        A.at(F.col("a"), (3,), 3)


def test_small_linear_algebra(spark):
    df = spark.createDataFrame([([3.0, 1.0, 1.0, 2.0], [9.0, 8.0], [1.0, 2.0, 2.0, 4.0])], "a array<double>, b array<double>, s array<double>")
    got = df.select(linalg.det(F.col("a")), linalg.solve(F.col("a"), F.col("b")), linalg.inv(F.col("a")), linalg.det(F.col("s")), linalg.svd(F.array(*map(F.lit, [3.0, 1.0, 0.0, 2.0])), 2, 2)).first()
    assert math.isclose(got[0], 5) and [round(x, 9) for x in got[1]] == [2, 3] and [round(x, 6) for x in got[2]] == [0.4, -0.2, -0.2, 0.6] and got[3] == 0
    u, s, vt = got[4]
    assert [round(sum(u[i * 2 + k] * s[k] * vt[k * 2 + j] for k in range(2)), 6) for i in range(2) for j in range(2)] == [3, 1, 0, 2]
    with pytest.raises(PySparkException):
        df.select(linalg.inv(F.col("s"))).collect()


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv(spark, tmp_path):
    path = write(tmp_path / "a.csv", "z,x,y,b,t\nNA,9223372036854775807,NaN,T,é\n,-9223372036854775808,-Inf,0,\"a,b\"\n")
    df = csv_source.read_csv(spark, path)
    assert [f"{c}:{t}" for c, t in df.dtypes] == ["b:boolean", "t:string", "x:bigint", "y:double", "z:bigint"]
    assert [r.y for r in df.collect()] == [None, float("-inf")] and [r.t for r in df.collect()] == ["é", "a,b"]
    kept = csv_source.read_csv(spark, path, csv_source.CsvOptions(keep_nan=True))
    assert math.isnan(kept.collect()[0].y)
    some = csv_source.read_csv(spark, path, csv_source.CsvOptions(columns=("x", "nope"), max_rows=1, infer=False))
    assert rows(some) == [("9223372036854775807",)]
    bare = csv_source.read_csv(spark, write(tmp_path / "b.csv", "skip;me\n1;a\n2;b\n"), csv_source.CsvOptions(delimiter=";", header=False, skip_rows=1))
    assert bare.columns == ["col_0", "col_1"] and bare.count() == 2
    chunks = list(csv_source.read_csv_chunks(spark, write(tmp_path / "c.csv", "id,name\n1,a\n2,b\n3,c\n4,d\n"), 2))
    assert [len(c) for c in chunks] == [2, 2] and len(list(csv_source.read_csv_chunks(spark, path, 0))) == 1
    df = spark.createDataFrame([(1, None), (2, "q\"x")], "id long, s string")
    csv_source.write_csv(df, str(tmp_path / "out"), null="NULL", one_file=True)
    back = csv_source.read_csv(spark, str(tmp_path / "out"), csv_source.CsvOptions(nulls=("NULL",)))
    assert sorted(rows(back)) == [(1, None), (2, "q\"x")]


def test_json(spark, tmp_path):
    df = json_source.read_json(spark, write(tmp_path / "a.json", '[{"id": 1, "name": "x"}, {"id": 2, "more": null}]'))
    assert df.count() == 2 and "name" in df.columns
    turned = json_source.read_json(spark, write(tmp_path / "b.json", '{"id": [1, 2], "name": ["x"]}'), "columns")
    assert rows(turned) == [(1, "x"), (2, None)]
    assert rows(json_source.read_json_text(spark, '[{"a": 1}]')) == [(1,)]
    text = json_source.to_json(spark.createDataFrame([(2, "b"), (1, None)], "i int, s string"), "columns", "i").first()[0]
    assert text == '{"i":[1,2],"s":[null,"b"]}'
    with pytest.raises(ValueError):
        json_source.read_json(spark, "x", "rows")


def test_parquet_and_buckets(spark, tmp_path):
    df = spark.range(100).withColumn("k", F.col("id") % 7)
    parquet_source.write_parquet(df, str(tmp_path / "p"), ["k"])
    assert parquet_source.read_parquet(spark, str(tmp_path / "p"), ["id"]).count() == 100
    parquet_source.save_bucketed(df, "bucketed_test", ["k"], 4, mode="overwrite")
    plan = spark.table("bucketed_test").groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_inspection(spark):
    df = spark.createDataFrame([(2, None, 1.5), (1, "x", None)], "i int, s string, x double").withColumn("t", F.timestamp_seconds(F.lit(0)))
    assert frame.dtypes(df) == {"i": "int64", "s": "string", "x": "float64", "t": "time"}
    assert frame.preview(df.drop("t"), "i") == "i\ts\tx\n1\tx\t<null>\n2\t<null>\t1.5"


def test_parallel_frames(spark):
    df = spark.createDataFrame([(20, "a"), (30, "b"), (40, "c")], "age long, name string")
    pool = parallel.Pool(2)
    assert pool.apply(df, "age", lambda c: c + 1).first().age == 21 and pool.where(df, P.col("age").gt(25)).count() == 2


def test_parallel(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, None)], "x long")
    pool = parallel.Pool(2)
    doubled = pool.map(df, "x", lambda c: c * 2)
    assert pool.reduce(doubled, "x", 100, lambda a, b: a + b) == 130 and pool.filter(doubled, "x", F.col("x") > 5).count() == 3
    assert pool.reduce(df.where("x > 99"), "x", 7, max) == 7 and parallel.Pool(0).workers >= 1
    seen = spark.sparkContext.accumulator(0)
    pool.for_each(df, "x", lambda values: seen.add(len(values)))
    assert seen.value == 6


def test_a_stream_of_events(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 10:00:00' ts, 'a' k, 1.0 v union all select timestamp'2024-01-01 10:30:00', 'a', 2.0").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = events.tumbling(events.stream_parquet(spark, str(tmp_path / "in")), "ts", "1 hour", ["k"], "v")
    q = out.writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.k, r.n, r.total) for r in spark.table("sums").collect()] == [("a", 2, 3.0)]


def test_long_preview(spark):
    rows = [(i, j, 5 * i + j) for i in range(3) for j in range(5)]
    x = A.Long(spark.createDataFrame(rows[::-1], "i0 long, i1 long, v long"), (3, 5))
    assert x.preview() == "Long(shape=[3, 5], size=15, data=[0 1 2 3 4 5 6 7 8 9 10 11 ...])"
    assert x.slice(slice(0, 1)).preview() == "Long(shape=[1, 5], size=5, data=[0 1 2 3 4])"


@pytest.mark.parametrize("bucket", [2_000_000, 12])
def test_running_values_carry_over_null_beginnings(spark, bucket, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET_ROWS", bucket)
    values = [None if 40 <= i < 75 or i < 3 else float(i % 5 + 1) for i in range(120)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").repartition(5)
    assert (bucket > 100) == (ordered.bucketed(df, "i").select("__bucket").distinct().count() == 1)
    sums, products, s, p = [], [], None, None
    for v in values:
        s, p = (s, p) if v is None else ((s or 0.0) + v, (1.0 if p is None else p) * v)
        sums.append(s)
        products.append(p)
    at = lambda d, c: [r[c] for r in d.orderBy("i").collect()]
    assert at(ordered.cumulative_sum(df, "x", "i", "s"), "s") == sums
    assert at(ordered.cumulative_product(df, "x", "i", "s"), "s") == pytest.approx(products)


def test_order_follows_ties_and_any_column_names(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 5)
    data = [(i // 4, i % 4, None if i % 3 else float(i), i) for i in range(40)]
    df = spark.createDataFrame(data, "before int, edge int, __bucket double, __pos int").repartition(3)
    got = {r["__pos"]: r for r in ordered.cumulative_sum(df, "__pos", "before", "__own", ties=("edge",)).collect()}
    assert [got[i]["__own"] for i in range(40)] == [i * (i + 1) // 2 for i in range(40)] and ordered.with_position(df, "before", "n", "edge").columns == [*df.columns, "n"]
    filled = {r["__pos"]: r["__bucket"] for r in ordered.fill_forward(df, "__bucket", "before", ties=("edge",)).collect()}
    assert [filled[i] for i in range(40)] == [float(i - i % 3) for i in range(40)]
    ranked = {r["__pos"]: r["rank_before"] for r in ordered.rank(df, "before").collect()}
    assert [ranked[i] for i in range(40)] == [i // 4 * 4 + 1.0 for i in range(40)]


def test_texts_with_a_common_prefix_fill_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 50)
    names = [f"Customer#{i:09d}" for i in range(600)]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(4)
    sizes = [r["count"] for r in ordered.bucketed(df, "name").groupBy("__bucket").count().collect()]
    assert len(sizes) >= 6 and max(sizes) <= 200
    assert [r["_pos"] for r in ordered.with_position(df, "name").orderBy("name").collect()] == list(range(600))
    two = spark.createDataFrame([(i % 2,) for i in range(600)], "v int")
    assert {(r["v"], r["rank_v"]) for r in ordered.rank(two, "v", "max").collect()} == {(0, 300.0), (1, 600.0)}


def test_json_lines_come_back_whole(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(10)], "a long, b string")
    json_source.write_json(df, str(tmp_path / "lines"))
    assert sorted(map(tuple, json_source.read_json(spark, str(tmp_path / "lines")).collect())) == [(i, f"n{i}") for i in range(10)]
    (tmp_path / "array.json").write_text('[{"a": 1, "b": "x"},\n {"a": 2}]')
    assert sorted(map(tuple, json_source.read_json(spark, str(tmp_path / "array.json")).collect())) == [(1, "x"), (2, None)]
    (tmp_path / "one.json").write_text('\n{\n "a": 1,\n "b": "x"\n}')
    assert json_source.read_json(spark, str(tmp_path / "one.json")).collect() == [(1, "x")]
