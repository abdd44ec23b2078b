"""A stored table that merges by key without being rewritten: rows lie in folders by a hash of their key, and a merge writes anew only folders in which a row really changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.state import merge_replace

#: The column of a row's folder.
FOLDER = "key_bucket"


@dataclass
class BucketedTable:
    """Rows of ``schema`` below ``path``, each known by its ``keys``. ``buckets`` stays the same for the life of a table; at a few hundred MB a folder a merge of few rows costs few folders."""

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: list[str]
    buckets: int = 256

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.schema.names).withColumn(FOLDER, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _stored(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField(FOLDER, T.IntegerType())]))
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(FOLDER, T.IntegerType())])).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop(FOLDER)

    def merge(self, delta: DataFrame, order: Column | None = None) -> int:
        """Rows of the delta replace those of equal keys; of several in the delta, the last by ``order``. Returns how many folders were written: a repeated batch writes none.

        Only the delta's folders are read. A merge that fails leaves the table as it was, as folders are put in place when all are written.
        """
        if order is not None:
            delta = delta.withColumn("_turn", F.row_number().over(Window.partitionBy(*self.keys).orderBy(order.desc()))).where("_turn = 1")
        last = self._placed(delta).dropDuplicates(self.keys)
        met = [r[FOLDER] for r in last.select(FOLDER).distinct().collect()]  # no more than there are folders
        old = self._stored().where(F.col(FOLDER).isin(met))
        news = last.subtract(old)
        folders = [r[FOLDER] for r in news.select(FOLDER).distinct().collect()]
        if folders:
            touched = merge_replace(old.where(F.col(FOLDER).isin(folders)), last.where(F.col(FOLDER).isin(folders)), self.keys)
            touched.repartition(FOLDER).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(FOLDER).parquet(self.path)
        return len(folders)
