"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Each is run once to warm up and then three times into a sink that keeps nothing; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from loomframe.functions import arrays as A  # noqa: E402
from loomframe.operators import frame, grouping, joins  # noqa: E402
from loomframe.plans import catalog  # noqa: E402
from loomframe.plans import predicates as P  # noqa: E402
from loomframe.session import load, session  # noqa: E402

DATA = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

#: From the catalogue, besides the workloads of the baseline.
NAMED = ("q00_flagship", "q30_std", "q37_transform", "q48_describe", "q55b_orders_lineitem", "q62_rank_nulls", "q63_cumsum", "q65_rolling_mean", "q68_fill_forward", "q79_kurtosis", "q97_matmul")


def workloads():
    items = lambda s: load(s, DATA, "lineitem")
    out = {
        "column_map": lambda s: items(s).select((F.col("l_quantity") * 2).alias("v")),
        "column_fold": lambda s: items(s).agg(F.sum("l_quantity").alias("v")),
        "filter": lambda s: frame.where(items(s), P.col("l_quantity").gt(30)),
        "group_aggregate": lambda s: grouping.group(items(s), ["l_returnflag"], {"l_extendedprice": "mean", "l_quantity": "count"}),
        "equi_join": lambda s: joins.join(load(s, DATA, "orders").withColumnRenamed("o_orderkey", "k"), items(s).withColumnRenamed("l_orderkey", "k"), "k").groupBy().count(),
        "array_add": lambda s: load(s, DATA, "embeddings").select(A.zipped("add", F.col("embedding"), F.col("embedding")).alias("v")),
        "matrix_multiply_256": lambda s: A.random(s, 1, 256, 256).matmul(A.random(s, 2, 256, 256)).df,
    }
    return out | {n: (lambda s, n=n: catalog.QUERIES[n](s, DATA)) for n in NAMED}


def main() -> None:
    spark = session(CPUS, "bench", **{"spark.sql.shuffle.partitions": str(CPUS), "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name, make in workloads().items():
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            make(spark).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(DATA.rstrip("/")), "cpus": CPUS, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
