"""Written tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def columns(df: DataFrame) -> list:
    """All columns, whatever characters their names have."""
    return [df[f"`{c.replace('`', '``')}`"] for c in df.columns]


def chosen(docs: DataFrame, key: Column, keepers: DataFrame) -> DataFrame:
    """The rows of docs whose key and doc_id stand in keepers (key, doc_id), one for each.

    Of several such rows one with the longest text stays; a hash of the text and the other columns breaks ties. Each
    task reduces its rows to one of each key and doc_id before they are dealt, so repeated rows cost a row per task.
    """
    same = lambda df, k, *more: df.select(k.alias("key"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), *more)
    doc, rest = F.col("doc"), [c for c in docs.columns if c not in ("doc_id", "text")]
    order = [F.char_length(doc["text"]).desc(), F.xxhash64(doc["text"], *([F.to_json(F.struct(*[doc[c] for c in rest]))] if rest else []))]
    rows = same(docs, key, F.struct(*columns(docs)).alias("doc"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("key", "id", "none").orderBy(*order))).where("k = 1")
    return rows.join(same(keepers, F.col("key")), ["key", "id", "none"], "left_semi").select("doc.*")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one where that is unset and all tasks run on this machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lumenfold-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Folders of all operator calls of this process that are not deleted yet.
ROOTS: list[str] = []


def clear(spark: SparkSession) -> None:
    """Deletes the intermediate tables of all calls so far; their results must have been written."""
    while ROOTS:
        delete(spark, ROOTS.pop())


class Scratch:
    """Intermediate tables of one operator call; reading one back has no lineage behind it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/lumenfold-{uuid.uuid4().hex}", 0
        ROOTS.append(self.root)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes the files of a table made by keep() that no later step reads."""
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if self.root.rsplit("/", 1)[1] in folder:
                delete(self.spark, folder)
