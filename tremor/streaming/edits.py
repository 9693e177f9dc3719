"""Scenario edits as a stream (K5, K6): the last write per label is keyed state, and only
the scenarios that an edit touched are propagated again.

An edit is ``(scenario_id, seq, op, region, sector, magnitude)`` as in
:func:`~tremor.operators.scenario.apply_edits`; edits may come late and in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import propagate
from ..operators.economy import Economy
from ..operators.scenario import apply_edits, shock_levels
from ..session import cut_lineage

LABEL = ["region", "sector"]


def last_writes(edits: DataFrame, key: str = "scenario_id", value: str = "magnitude") -> DataFrame:
    """The edit log reduced to the newest edit per (key, label) and the newest ``clear``
    per key: a log again, with the same result. On a stream this is one built-in
    aggregation; its state has a row per label ever edited, however many edits come.
    Of edits with one ``seq`` for one label the last by (op, value) counts."""
    cleared = F.col("op") == "clear"
    label = [F.when(~cleared, F.col(c)).alias(c) for c in LABEL]
    newest = F.max(F.struct("seq", "op", F.col(value).alias("v")))
    return (edits.select(key, "seq", "op", *label, value).groupBy(key, *LABEL).agg(newest.alias("e"))
            .select(key, "e.seq", "e.op", *LABEL, F.col("e.v").alias(value)))


def follow(edits: DataFrame, eco: Economy, path: str, checkpoint: str, methods: Sequence[str] = ("ghosh",),
           available_now: bool = True) -> StreamingQuery:
    """Keep ``{path}/log`` (reduced edits) and ``{path}/impacts`` (Δx by scenario) up to date.

    A batch replaces its own folder of the log, so one that is run again after a failure
    changes nothing. The scenarios it touched are rebuilt from the log, propagated in one
    loop, and replace their partitions; other scenarios are neither read nor written. A
    scenario left without shocks has no impact: its partition holds one row with null
    labels, which :func:`impacts` leaves out. Edits of labels that the economy lacks move
    nothing; a magnitude outside [0, 1] ends the stream with the validation's error."""
    def step(batch: DataFrame, number: int) -> None:
        spark = eco.X.sparkSession  # the batch has a session of its own
        folder = f"{path}/log/batch={number}"
        batch.write.mode("overwrite").parquet(folder)
        stored = spark.read.schema(batch.schema).parquet(folder)
        if stored.isEmpty():
            return
        touched = stored.select("scenario_id").distinct()
        log = spark.read.schema(batch.schema).parquet(f"{path}/log")
        mine = log.join(touched, "scenario_id", "left_semi")
        shocks = cut_lineage(apply_edits(last_writes(mine)))
        known = cut_lineage(shock_levels(eco.X, shocks).select("scenario_id", *LABEL, "magnitude"))
        marker = touched.select(F.lit(None).cast("string").alias("method"), *[F.lit(None).cast("string").alias(c) for c in LABEL],
                                F.lit(None).cast("double").alias("delta_x"), "scenario_id")
        out = marker
        if not known.isEmpty():
            solved = propagate.impacts(eco, known, list(methods)).select("method", *LABEL, "delta_x", "scenario_id")
            out = solved.unionByName(marker)
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scenario_id")
         .parquet(f"{path}/impacts"))

    writer = last_writes(edits).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(step)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def impacts(spark, path: str) -> DataFrame:
    """(method, scenario_id, region, sector, delta_x) as of the last batch."""
    schema = "method string, region string, sector string, delta_x double, scenario_id string"
    return (spark.read.schema(schema).parquet(f"{path}/impacts").where("method is not null")
            .select("method", "scenario_id", *LABEL, "delta_x"))
