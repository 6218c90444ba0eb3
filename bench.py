
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactframe import Contract
from pactframe import functions as f
from pactframe.operators.combinators import All, Maybe
from pactframe.operators.markers import Optional, Required
from pactframe.queries import QUERIES

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
#: Rows of the four shapes.
ROWS = 4_000_000


def shapes(spark: SparkSession) -> dict[str, tuple[Contract, DataFrame]]:
    base = spark.range(ROWS).withColumn("s", F.concat(F.lit("name"), F.col("id") % 1000))
    i, s = F.col("id"), F.col("s")
    flat = base.select(s.alias("name"), (i % 90).alias("age"), (i % 2 == 0).alias("active"), (i / 7).alias("score"))
    config = base.select(s.alias("name"), (i % 70000).cast("string").alias("port"), F.lit(None).cast("string").alias("host"), F.array(s, s).alias("tags"), F.when(i % 3 == 0, "auto").otherwise("manual").alias("mode"))
    nested = base.select(s.alias("entity_id"), F.struct((i % 300).cast("string").alias("brightness"), F.array(i % 256, i % 255, i % 300).alias("rgb")).alias("data"))
    return {
        "flat": (Contract({Required("name"): str, Required("age"): int, Required("active"): bool, Required("score"): float}), flat),
        "config": (Contract({Required("name"): str, Optional("port", default="8080"): All(f.Coerce(int), f.Range(1, 65535)), Optional("host", default="localhost"): str, Optional("tags"): [str], Required("mode"): f.In(["auto", "manual", "off"])}), config),
        "nested": (Contract({Required("entity_id"): str, Required("data"): {Required("brightness"): All(f.Coerce(int), f.Range(0, 255)), Required("rgb"): [f.Range(0, 255)]}}), nested),
        "record": (Contract({Required("name"): str, Required("age"): f.Range(0, 120), Required("active"): bool, Required("score"): Maybe(float)}), flat),
    }


def run(df: DataFrame) -> float:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return round(time.time() - began, 3)


def main() -> None:
    spark = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found, rates = {}, {}
    for name, query in QUERIES.items():
        run(query(spark, SF))  # compiles
        found[name] = run(query(spark, SF))
    for name, (contract, df) in shapes(spark).items():
        run(contract.apply(df.limit(1000)))
        found[f"shape_{name}"] = run(contract.apply(df))
        rates[name] = round(ROWS / found[f"shape_{name}"])
    print(json.dumps({"metric": "contract_queries_total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": float(SF.rstrip("/").rpartition("sf")[2] or 0), "rows_per_s": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
