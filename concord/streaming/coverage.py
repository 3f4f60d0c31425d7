"""Coverage of Task2 units while instances arrive: counts per unit and side, kept by the stream's own state.

State is one row per unit, not per instance.  Rows that arrive again are counted once within the watermark, if the
stream has an event time and ``delay`` is given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from concord.operators import cohort

INSTANCE = "instance_id bigint, dataset string, perturbation_type string, cell_line string, perturbation_gene string, time string, dose string, arrived timestamp"


def running_coverage(stream: DataFrame, delay: str | None = None) -> DataFrame:
    """n_chem_instances and n_gen_instances per unit; complete or update output mode."""
    if delay:
        stream = stream.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["instance_id"])
    return cohort.coverage(cohort.membership(stream))


def coverage_over_time(stream: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Arrivals per unit and tumbling window; append output mode closes a window once the watermark has passed it."""
    members = cohort.membership(stream.withWatermark("arrived", delay))
    return members.groupBy(F.window("arrived", window).alias("w"), *cohort.UNIT2).agg(F.count("*").alias("n_instances")).select(F.col("w.start").alias("start"), *cohort.UNIT2, "n_instances")


def to_table(counted: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch's changed units as Parquet under ``path/batch=N``; a batch that is run again replaces its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counted.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
