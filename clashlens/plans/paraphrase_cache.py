"""A paraphrase cache that outlives the job (P-7, A-3): a bucketed table with committed snapshots.

A snapshot is a folder of Parquet files bucketed and sorted by sentence, so a look-up joins it without
shuffling it. It exists once a commit file names it: ``commits/<version>`` is created last, and creating it
fails if there is one already, so of two writers one wins and the other has to look up again. A job that dies
before that leaves a folder that no commit names and the cache as it was. A look-up without misses writes
nothing; one with misses writes the next snapshot, the old rows and the fresh ones.
"""

from __future__ import annotations

import hashlib
import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clashlens.config import NUM_PARAPHRASES
from clashlens.plans.training import builtin_paraphrases
from clashlens.session import ensure_checkpoint_dir

KIND = "sentence string, rank int, paraphrase string"


class ParaphraseCache:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _fs(self):
        return self._at("commits").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last commit; 0 if there is none."""
        at = self._at("commits")
        if not self._fs().exists(at):
            return 0
        return max((int(f.getPath().getName()) for f in self._fs().listStatus(at) if f.getPath().getName().isdigit()), default=0)

    def _table_name(self, folder: str) -> str:
        return f"paraphrases_{hashlib.sha256(f'{self.path}/{folder}'.encode()).hexdigest()[:24]}"

    def read(self, version: int | None = None) -> DataFrame:
        """(sentence, rank, paraphrase) of a snapshot, by default the last one."""
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], KIND)
        folder, buckets = self.spark.read.text(f"{self.path}/commits/{v}").collect()[0][0].split()
        name = self._table_name(folder)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({KIND}) USING parquet CLUSTERED BY (sentence) SORTED BY (sentence) "
                       f"INTO {int(buckets)} BUCKETS LOCATION '{self.path}/data/{folder}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        (rows.repartition(self.buckets, "sentence").write.bucketBy(self.buckets, "sentence").sortBy("sentence")
         .option("path", f"{self.path}/data/{folder}").saveAsTable(self._table_name(folder)))
        return folder

    def _commit(self, version: int, folder: str) -> None:
        out = self._fs().create(self._at("commits", str(version)), False)      # not if it is there
        out.write(bytearray(f"{folder} {self.buckets}".encode()))
        out.close()

    def lookup(self, requests: DataFrame, n: int = NUM_PARAPHRASES, generator: Callable[[DataFrame], DataFrame] | None = None,
               col: str = "sentence") -> DataFrame:
        """(sentence, rank, paraphrase, from_cache) for each distinct requested sentence, rank <= n.

        A sentence is a hit when the cache holds at least n ranks for it, or was asked for as many before and got
        fewer (its last rank is then marked by an empty row of rank 0, which isn't returned). Misses are generated once.
        """
        gen = generator or (lambda s: builtin_paraphrases(s, n))
        ensure_checkpoint_dir(self.spark)
        version = self.version()
        cache = self.read(version)
        wanted = requests.select(F.col(col).alias("sentence")).where(F.col(col).isNotNull()).distinct().repartition(self.buckets, "sentence")
        # rank 0 holds how many were asked for
        had = cache.groupBy("sentence").agg(F.max(F.when(F.col("rank") == 0, F.col("paraphrase").cast("int"))).alias("asked")).where(F.col("asked") >= n)
        misses = wanted.join(had, "sentence", "left_anti").checkpoint(eager=True)
        if not misses.isEmpty():
            fresh = gen(misses).where(F.col("rank") <= n).select("sentence", F.col("rank").cast("int").alias("rank"), "paraphrase")
            asked = misses.select("sentence", F.lit(0).alias("rank"), F.lit(str(n)).alias("paraphrase"))
            kept = cache.join(misses, "sentence", "left_anti")
            self._commit(version + 1, self._write(kept.unionByName(fresh).unionByName(asked)))
            cache = self.read(version + 1)
        out = cache.where((F.col("rank") > 0) & (F.col("rank") <= n)).join(wanted, "sentence", "left_semi")
        return (out.join(misses.withColumn("_new", F.lit(True)), "sentence", "left")
                .select("sentence", "rank", "paraphrase", F.col("_new").isNull().alias("from_cache")))
