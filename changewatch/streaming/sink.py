"""A keyed sink for streams: batches become versions of a table, and one that comes twice changes nothing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changewatch.sources import files, state_log


def upsert(root: str, table: str, schema: T.StructType, keys: Sequence[str], order: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: of each key the last row of the batch by ``order`` becomes a version of the table below ``root``.

    A batch's folder and publication have its number. A batch that was published
    and is run again is passed over; one that died before is written anew.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, run_id = batch.sparkSession, f"batch-{number:012d}"
        if any(r == run_id for _, r in files.published(spark, root)):
            return
        files.remove(spark, files.home_of(root, run_id))
        rest = [c for c in schema.names if c not in keys]
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(*schema.names)
        state_log.append(spark, last, root, run_id, table)
        files.publish(spark, root, run_id)

    return write
