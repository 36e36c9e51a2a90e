"""A folder that results of requests are appended to, each request once.

A batch is written beside the others under a name that nobody reads, and then renamed,
which is the commit.  A writer that is killed before leaves nothing that counts; run
again, it asks only for what is missing.  Two writers at a time may both answer a request:
readers take the answer of the earlier batch, so that there is one all the same."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def request_key(*columns: str) -> Column:
    """The name of a request: a digest of what is asked, context and settings included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


class Ledger:
    """Rows with a column ``request`` in numbered batches under a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """The committed batches in order."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.folder))]
        return sorted(n for n in names if re.fullmatch(r"batch-\d{9}-[0-9a-f]{32}", n))

    def read(self) -> DataFrame | None:
        """All committed rows, one a request, or None before the first batch."""
        found = self.batches()
        if not found:
            return None
        rows = self.spark.read.parquet(*[f"{self.folder}/{n}" for n in found])
        if len({n[:15] for n in found}) == len(found):
            return rows  # no two writers at a time, so no request twice
        batch = F.regexp_extract(F.input_file_name(), r"/(batch-\d{9}-[0-9a-f]{32})/", 1)
        first = rows.withColumn("_batch", batch).groupBy("request").agg(F.min_by(F.struct(*rows.columns), "_batch").alias("r"))
        return first.select("r.*")

    def missing(self, requests: DataFrame) -> DataFrame:
        """The requests without a committed answer, each once."""
        done = self.read()
        once = requests.dropDuplicates(["request"])
        return once if done is None else once.join(done.select("request"), "request", "left_anti")

    def append(self, requests: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> int:
        """Answers the missing requests and commits the answers; how many there were.

        ``answer`` turns requests into rows that keep ``request``, one each; a request that
        it gives no row for stays missing."""
        seen = self.batches()
        name = uuid.uuid4().hex
        staged = f"{self.folder}/_staged-{name}"
        answer(self.missing(requests)).dropDuplicates(["request"]).write.parquet(staged)
        n = self.spark.read.parquet(staged).count()
        if not n:
            self._fs.delete(self._path(staged), True)
            return 0
        number = int(seen[-1][6:15]) + 1 if seen else 1
        if not self._fs.rename(self._path(staged), self._path(f"{self.folder}/batch-{number:09d}-{name}")):
            raise OSError(f"the batch can't be committed: {staged}")
        return n
