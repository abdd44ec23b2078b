"""A stored inverted file of vectors that honours filters.

Centroids are trained on a bounded sample; every row is stored in the folder of its nearest one, with its other columns. A search reads the cells
nearest to the query and applies its filter there; while too few rows pass it, or until the cells left out provably hold none of the nearest if it is to be exact, it reads on.
"""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import similarity

#: Rows that centroids are trained on at most, drawn by hash of the key.
SAMPLE = 100_000
#: Rows that a task sorts by cell and writes, about.
TASK_ROWS = 50_000


def _scaled(vector: Column) -> Column:
    """A vector of length 1; null for null, empty or zero vectors."""
    v = vector.cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(v, lambda x: x / length))


def _distance(v: Column, center: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(v, center, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def build(rows: DataFrame, key: str, vector: str, path: str, cells: int | None = None, sample: int = SAMPLE, seed: int = 1) -> None:
    """Writes the index of ``rows`` below ``path``, with all their columns. Rows without a direction (null, empty or zero vectors) lie in a cell of their own, -1, whose similarity is that of a missing vector.

    ``cells`` defaults to the square root of the rows. All vectors have one length.
    """
    spark, scaled = rows.sparkSession, rows.withColumn("_unit", _scaled(F.col(vector)))
    n = scaled.where("_unit is not null").count()
    cells = max(1, min(n, cells or round(math.sqrt(n))))
    if n:
        share = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, sample / n))
        model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="_v").fit(scaled.where("_unit is not null").where(share).select(array_to_vector("_unit").alias("_v")))
        centers = [(j, [float(x) for x in c]) for j, c in enumerate(model.clusterCenters())]
    else:
        centers = []
    center = spark.createDataFrame(centers, "cell int, center array<double>")
    if n:
        near = model.setPredictionCol("cell").transform(scaled.withColumn("_v", F.when(F.col("_unit").isNotNull(), array_to_vector("_unit"))).where("_unit is not null")).drop("_v")
        placed = near.withColumn("cell", F.col("cell").cast("int"))
    else:
        placed = scaled.limit(0).withColumn("cell", F.lit(-1))
    every = placed.drop("_unit").unionByName(scaled.where("_unit is null").drop("_unit").withColumn("cell", F.lit(-1)))
    spark.createDataFrame([], every.schema).write.mode("overwrite").parquet(f"{path}/schema")  # an index of no rows has no other file that tells it
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), n // TASK_ROWS)
    every.repartition(tasks, "cell", F.pmod(F.xxhash64(key), F.lit(max(8, n // TASK_ROWS // 8)))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    stored = _rows(spark, path).where("cell >= 0").join(F.broadcast(center), "cell")  # a row a cell; of rows made by the driver Spark knows no size, and moves the vectors to them
    reach = stored.groupBy("cell").agg(F.max(_distance(_scaled(F.col(vector)), F.col("center"))).alias("reach"), F.count("*").alias("rows"))
    center.join(reach, "cell", "left").select("cell", "center", F.coalesce("reach", F.lit(0.0)).alias("reach"), F.coalesce("rows", F.lit(0)).alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/rows")


class Index:
    """A stored index. Its centroids, one row a cell, are held by the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.rows = _rows(spark, path)
        self.centers = spark.read.parquet(f"{path}/centers").collect()

    def nearest(self, key: str, vector: str, query: list[float], k: int, where: Column | None = None, probes: int = 8, exact: bool = False) -> DataFrame:
        """``key, score`` of the ``k`` rows most similar to the query among those that pass ``where``; equal scores go by key.

        ``probes`` cells are read first. While fewer than ``k`` rows pass the filter, or for ``exact`` until no cell left can hold a nearer one, twice as many are read. A cell holds none nearer than
        the query's distance to its centroid less the cell's reach. If all are read, the result is exact.
        """
        length = math.sqrt(sum(x * x for x in query))
        unit = [x / length for x in query] if length else query
        ends = sorted((math.dist(unit, c.center) if length else 0.0, c.cell, c.reach) for c in self.centers if c.rows)
        passing = self.rows if where is None else self.rows.where(where)
        while True:
            probes = min(probes, len(ends))
            cells = [cell for _, cell, _ in ends[:probes]]
            read = passing if probes == len(ends) else passing.where(F.col("cell").isin(cells))
            found = read.where(F.col(vector).isNotNull()).select(key, similarity(F.col(vector), query).alias("score")).orderBy(F.desc("score"), key).limit(k)
            if probes == len(ends):
                return found
            got = found.collect()  # k rows at most
            if len(got) == k:
                far = math.sqrt(max(0.0, 2 - 2 * (2 * got[-1].score - 1)))
                if not exact or all(d - reach > far + 1e-9 for d, _, reach in ends[probes:]):
                    return found.sparkSession.createDataFrame(got, found.schema)
            probes *= 2
