"""Connected components of a table of links, and tables kept in the shared folder."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.session import shared_dir

#: Rows of the input to a file of a kept table, where there are more partitions than that.
FILE_ROWS = 4096


class Kept:
    """Tables written once to the folder all executors share, and removed when they have served. ``files`` (None: one a partition)
    bounds the files of a table: each costs a task, and on a local disk Hadoop starts processes for it."""

    def __init__(self, spark):
        self.spark, self.folder = spark, f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        self.count, self.paths, self.files = 0, {}, None

    def bound(self, rows: int) -> None:
        """Let the files of the next tables follow the rows of the input, not the number of shuffle partitions."""
        self.files = max(-(-rows // FILE_ROWS), 2 * self.spark.sparkContext.defaultParallelism)

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        (df.coalesce(self.files) if self.files else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def _remove(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def forget(self, *tables: DataFrame) -> None:
        for df in tables:
            self._remove(self.paths.pop(id(df))[1])


def components(links: DataFrame, kept: Kept) -> DataFrame:
    """Smallest node of the component of every node in ``links`` (a, b), as a kept table (node, label).

    Alternating star contraction: every node hands its larger neighbours, then its smaller ones, to the
    smallest node around it, until every node hangs on one root that hangs on none. Both halves of a round run in one
    job with one shuffle each, and the round tells itself whether the links it got were such stars ("open": they were not).
    """
    around = Window.partitionBy("u")
    edges, held = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), []
    while True:
        both = edges.select("u", "v").union(edges.select("v", "u"))
        seen = both.withColumns({"least": F.min("v").over(around), "most": F.max("v").over(around)})
        seen = seen.withColumns({"m": F.least("least", "u"), "open": (F.col("least") < F.col("u")) & (F.col("least") < F.col("most"))})
        # an open node without larger neighbours still has to say that it is open
        large = seen.where("v > u or open and most < u and v = m").select(F.greatest("u", "v").alias("u"), "m", "open").where("u <> m")
        # equal links meet at their larger end
        large = large.repartition("u").groupBy("u", F.col("m").alias("v")).agg(F.bool_or("open").alias("open")).withColumn("m", F.min("v").over(around))
        edges = kept.keep(large.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), "open"))
        kept.forget(*held)
        held = [edges]
        if edges.where("open").isEmpty():
            break
    out = kept.keep(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v")).distinct())
    kept.forget(edges)
    return out
