"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one line of JSON."""

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright import session
from gridwright.operators import graph, regions, segment
from gridwright.plans import catalog

KEYS = ("graph_euclid4", "graph_euclid8", "connected_components4", "segment_adaptive", "merge_tree", "hist_pooling", "components", "saliency", "segment_sparse")
RUNS = 3
#: One synthetic image of SIDE x SIDE pixels with three channels, beside the driver's small ones.
SIDE = 1024


def _large(spark: SparkSession) -> DataFrame:
    y, x = F.floor(F.col("id") / SIDE).cast("int"), (F.col("id") % SIDE).cast("int")
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 20000
    f = F.array(*[(F.sin(F.col(a) / n) + 1) / 2 + noise for a, n in (("y", 40), ("x", 55), ("y", 90))])
    return spark.range(SIDE * SIDE).select(F.lit(0).cast("long").alias("image_id"), y.alias("y"), x.alias("x"), "id").withColumn("f", f)


def _parts(pixels: DataFrame) -> DataFrame:
    return segment.connected_components(graph.graph(pixels, 4, "euclid", SIDE), pixels, SIDE, 0.03)


LARGE = {
    "large_graph_euclid4": lambda p: graph.graph(p, 4, "euclid", SIDE),
    "large_connected_components4": _parts,
    "large_components": lambda p: regions.components(_parts(p)),
    "large_hist_pooling": lambda p: regions.hist_pooling(p, p.select("image_id", "y", "x", F.floor(F.col("id") / 4096).alias("label")))[0],
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session.local(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    pixels = session.save(_large(spark), "bench-image")
    runs = {k: lambda k=k: catalog.QUERIES[k](spark, sf_dir) for k in KEYS} | {k: lambda f=f: f(pixels) for k, f in LARGE.items()}
    for key, run in runs.items():
        times = []
        for _ in range(RUNS + 1):  # the first one warms up
            began = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[key] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "total of medians, large images apart", "value": round(sum(took[k] for k in KEYS), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
