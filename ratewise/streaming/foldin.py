"""Fold new users in from a stream of ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import hash_bucket
from ..operators.filters import highest_rating
from ..operators.model import Model
from ..plans.train import fold_users

#: Writers of one bucket of arriving ratings, so that one busy user is not one file and task.
WRITERS = 4


class UserFoldIn:
    """Keeps a rating history and the user parameters that follow from it under one folder.

    Users are dealt to ``buckets`` by hash. ``history/batch=k`` holds what arrived, ``pairs/batch=k``
    the same by bucket, ``users/batch=k`` the parameters of the users that occur in batch k, by
    bucket. A batch reads the pairs of its own users' buckets and writes nothing but its own
    partitions, which a replay overwrites, so a restart after a lost batch changes nothing. Item
    parameters never change, and neither do those of users without a rating of a known item.

    ``compact`` merges the batches so far into one generation under ``merged``; later batches read
    that and what came after it. ``options`` go to the fold, such as ``method="expected"``.
    """

    def __init__(self, model: Model, folder: str, lr: float = 0.01, n_epochs: int = 20, buckets: int = 64, **options):
        self.model, self.folder, self.lr, self.n_epochs = model, folder, lr, n_epochs
        self.buckets, self.options = buckets, options
        self._types: dict[str, str] = {"user_id": model.users().schema["user_id"].dataType.simpleString()}
        self._types["item_id"] = model.items().schema["item_id"].dataType.simpleString()

    # --- folders ---------------------------------------------------------------------------------

    def _numbers(self, spark: SparkSession, pattern: str) -> dict[int, str]:
        """Batch number -> folder for ``pattern`` (one listing on the driver, names only)."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{pattern}")
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        names = [status.getPath() for status in found or []]
        return {int(name.getName().split("=")[1]): name.toString() for name in names}

    def _generation(self, spark: SparkSession) -> int:
        """The last batch of the newest complete generation, -1 without one."""
        done = self._numbers(spark, "merged/ready/upto=*")
        return max(done, default=-1)

    def _schema(self, name: str) -> str:
        if name == "pairs":
            return f"user_id {self._types['user_id']}, item_id {self._types['item_id']}, rating double, bucket int"
        return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.model.users().schema) + ", bucket int"

    def _read(self, spark: SparkSession, name: str, up_to: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Rows of ``pairs`` or ``users`` with the ``batch`` they are of; other buckets are not opened."""
        last = self._generation(spark)
        schema = self._schema(name)
        base = f"{self.folder}/merged/{name}/upto={last}"
        rows = spark.createDataFrame([], f"{schema}, batch int")
        if last >= 0:
            merged = spark.read.schema(schema).option("basePath", base).parquet(base)
            rows = merged.withColumn("batch", F.lit(last))
        later = [
            path for number, path in sorted(self._numbers(spark, f"{name}/batch=*").items())
            if number > last and (up_to is None or number <= up_to)
        ]
        if later:
            batches = spark.read.schema(f"{schema}, batch int").option("basePath", f"{self.folder}/{name}").parquet(*later)
            rows = batches if last < 0 else rows.unionByName(batches)
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def _bucket(self):
        return hash_bucket("foldin", self.buckets, "user_id")

    # --- batches ---------------------------------------------------------------------------------

    def history(self, spark: SparkSession, up_to: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The ratings so far, the highest of every pair."""
        return highest_rating(self._read(spark, "pairs", up_to, buckets).drop("bucket"))

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id <= self._generation(spark):
            return  # a replay of a batch that has been merged
        log = f"{self.folder}/history/batch={batch_id}"
        batch.select("user_id", "item_id", F.col("rating").cast("double").alias("rating")).write.mode("overwrite").parquet(log)
        arrived = spark.read.parquet(log).withColumn("bucket", self._bucket())
        by_bucket = arrived.repartition("bucket", hash_bucket("writer", WRITERS, "item_id"))
        by_bucket.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/pairs/batch={batch_id}")
        met = [row[0] for row in arrived.select("bucket").distinct().collect()]  # at most ``buckets``
        touched = arrived.select("user_id").distinct()
        complete = self.history(spark, batch_id, met).join(touched, "user_id", "left_semi")
        fresh = fold_users(self.model, complete, self.lr, self.n_epochs, **self.options)
        fresh = fresh.select(*self.model.users().columns).withColumn("bucket", self._bucket())
        fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/users/batch={batch_id}")

    def _newest(self, spark: SparkSession, up_to: int | None = None) -> DataFrame:
        """The latest parameters of every folded user."""
        values = [c for c in self.model.users().columns if c != "user_id"]
        newest = self._read(spark, "users", up_to).groupBy("user_id").agg(
            F.max_by(F.struct(*values), F.col("batch")).alias("_p")
        )
        return newest.select("user_id", *[F.col(f"_p.{c}").alias(c) for c in values])

    def current(self, spark: SparkSession) -> Model:
        """The model with the latest parameters of every user."""
        base, newest = self.model.users(), self._newest(spark)
        old = base.join(newest.select("user_id"), "user_id", "left_anti")
        users = old.unionByName(newest.select(*base.columns))
        tables = dict(self.model.tables, users=users)
        return Model(self.model.kind, tables, dict(self.model.meta, n_users=users.count()), self.model.history)

    def compact(self, spark: SparkSession) -> int:
        """Merge all batches so far into one generation and return the number of its last batch.

        The generation counts once its marker is written; a run that was lost before is written
        anew. Call it between batches. Folders of merged batches are no longer read and may be
        removed.
        """
        last = max(self._numbers(spark, "users/batch=*"), default=-1)
        if last <= self._generation(spark):
            return self._generation(spark)
        pairs = self.history(spark, last).select("user_id", "item_id", "rating").withColumn("bucket", self._bucket())
        pairs = pairs.repartition("bucket", hash_bucket("writer", WRITERS, "item_id"))
        users = self._newest(spark, last).withColumn("bucket", self._bucket()).repartition("bucket")
        for name, rows in (("pairs", pairs), ("users", users)):
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/merged/{name}/upto={last}")
        spark.range(1).write.mode("overwrite").parquet(f"{self.folder}/merged/ready/upto={last}")
        return last

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run on a streaming DataFrame ``user_id, item_id, rating``."""
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
