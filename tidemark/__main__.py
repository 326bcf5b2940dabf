"""python -m tidemark queries | sql NAME | run NAME SF_DIR [ROWS] | streams
| update STATES OBSERVATIONS OUT | reset OUT OBSERVATIONS | state STATES | predict STATES | regime STATES | factor NAME STATES | history SNAPSHOTS N

STATES are engine checkpoints as Parquet (entity, config_id, step, engine), OBSERVATIONS (entity, day, ord, stream_key, z).
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import constants
from tidemark.operators import filters
from tidemark.plans import catalog

_ENGINE = "struct<n:long,ll:double,anomalies:long,x:array<double>,p:array<array<double>>,bank:struct<mu:array<double>>>"


def opened(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoints with the engine's fields as columns."""
    return spark.read.parquet(path).withColumn("e", F.from_json("engine", _ENGINE)).select("entity", "config_id", "step", "e.*")


def state(rows: DataFrame) -> DataFrame:
    """Every factor with its deviation, a row for each engine."""
    cols = [F.round(F.col("x")[i], 4).alias(k) for i, k in enumerate(constants.FACTORS)]
    return rows.select("entity", "config_id", "step", "n", *cols, *[F.round(F.sqrt(F.col("p")[i][i]), 4).alias(f"sd_{k}") for i, k in enumerate(constants.FACTORS)])


def predicted(rows: DataFrame) -> DataFrame:
    """The factors a step ahead."""
    f = filters.transition()
    cols = [sum((float(f[i, j]) * F.col("x")[j] for j in range(len(f)) if f[i, j]), F.lit(0.0)) for i in range(len(f))]
    return rows.select("entity", "config_id", *[F.round(v, 6).alias(k) for v, k in zip(cols, constants.FACTORS)])


def regime(rows: DataFrame) -> DataFrame:
    return rows.select("entity", "config_id", *[F.round(F.col("bank.mu")[i], 4).alias(r) for i, r in enumerate(constants.REGIMES)])


def factor(rows: DataFrame, name: str) -> DataFrame:
    """A factor's value and deviation, its monthly decay, the factors it moves with, and the streams that see it."""
    i = constants.FACTORS.index(name)
    rho = lambda j: F.col("p")[i][j] / F.sqrt(F.col("p")[i][i] * F.col("p")[j][j])
    others = F.filter(F.array(*[F.struct(F.lit(k).alias("factor"), F.round(rho(j), 4).alias("rho")) for j, k in enumerate(constants.FACTORS) if j != i]), lambda o: F.abs(o["rho"]) > 0.1)
    seen = [k for k, v in constants.STREAM_LOADINGS.items() if name in v]
    return rows.select("entity", "config_id", F.round(F.col("x")[i], 6).alias("value"), F.round(F.sqrt(F.col("p")[i][i]), 6).alias("sd"), F.lit(round(constants.PERSISTENCE[name] ** 22, 4)).alias("monthly"), others.alias("moves_with"), F.array(*[F.lit(k) for k in seen]).alias("streams"))


def history(snapshots: DataFrame, n: int) -> DataFrame:
    """The last n snapshots of each engine."""
    w = Window.partitionBy("entity", "config_id").orderBy(F.desc("step"))
    return snapshots.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k")


def main(args: list[str]) -> int:
    spark = SparkSession.builder.getOrCreate
    base = {"base": filters.Config()}
    match args:
        case ["queries"]:
            print("\n".join(catalog.QUERIES))
        case ["sql", name]:
            print(catalog.ORACLES.get(name, "no SQL"))
        case ["streams"]:
            for k, v in constants.STREAM_LOADINGS.items():
                print(k, constants.STREAM_NOISE[k] * constants.FREQUENCY_SCALE[k], v)
        case ["run", name, sf_dir, *rows]:
            catalog.QUERIES[name](spark(), sf_dir).show(int(rows[0]) if rows else 20, truncate=False)
        case ["update", states, observations, out]:
            s = spark()
            filters.checkpoints(s.read.parquet(observations), base, s.read.parquet(states)).write.parquet(out)
        case ["reset", out, observations]:
            entities = spark().read.parquet(observations).select("entity").distinct()
            entities.select("entity", F.lit("base").alias("config_id"), F.lit(0).alias("step"), F.lit(filters.Replay(base["base"]).state()).alias("engine")).write.parquet(out)
        case ["state", path]:
            state(opened(spark(), path)).show(truncate=False)
        case ["predict", path]:
            predicted(opened(spark(), path)).show(truncate=False)
        case ["regime", path]:
            regime(opened(spark(), path)).show(truncate=False)
        case ["factor", name, path]:
            factor(opened(spark(), path), name).show(truncate=False)
        case ["history", path, n]:
            history(spark().read.parquet(path), int(n)).show(truncate=False)
        case _:
            print(__doc__)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
