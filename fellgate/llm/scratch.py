"""Tables that a job writes to the shared folder and reads again, to cut its lineage.

The folder is the one that the cluster names in ``spark.checkpoint.dir``; only
where that is unset (a local session, as in tests) is a local one made.  A
lost executor then costs no more than its tasks of the running stage.
"""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession

from fellgate.sources.shared import delete, fresh_path

#: Batches that go to Python workers hold so much at most, where the session has no setting of its own; the default of 64 MB
#: takes several times that for each worker and task.
BATCH, _BATCH_KEY, _BATCH_DEFAULT = "16m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Seconds between two collections of garbage, after which Spark deletes the shuffle files of plans that are no longer referred to.
COLLECT = 4.0
_collected = 0.0


class Scratch:
    """Written tables of one job. ``keep`` writes one, ``drop`` deletes those that nothing reads any more,
    ``clear`` all; what is left goes when the program ends, as a lazy result may read it until then."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._paths = spark, {}
        if spark.conf.get(_BATCH_KEY, _BATCH_DEFAULT) == _BATCH_DEFAULT:
            spark.conf.set(_BATCH_KEY, BATCH)

    def keep(self, df: DataFrame) -> DataFrame:
        path = fresh_path(self.spark)
        df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = (path, table)
        del df
        if time.monotonic() - _collected > COLLECT:
            self.collect()
        return table

    def collect(self) -> None:
        """Let Spark delete the shuffle files of plans that nothing refers to."""
        global _collected
        gc.collect()
        self.spark._jvm.System.gc()
        _collected = time.monotonic()

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path, _ = self._paths.pop(id(table))
            delete(self.spark, path)

    def clear(self, *but: DataFrame) -> None:
        """Delete all tables except these."""
        kept = {id(x) for x in but}
        self.drop(*(table for key, (_, table) in list(self._paths.items()) if key not in kept))
