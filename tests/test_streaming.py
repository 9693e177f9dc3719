"""Edits as a stream: any cut into batches gives what the whole log gives."""

import pytest

from tremor.operators import propagate, scenario
from tremor.streaming import edits as ed

SCHEMA = "scenario_id string, seq long, op string, region string, sector string, magnitude double"
FARM, MINE = ("C1", "Farming"), ("C2", "Mining")
LOG = [("a", 1, "add", *FARM, 0.5), ("a", 2, "add", *MINE, 0.2), ("b", 1, "add", *MINE, 0.1), ("c", 1, "add", *FARM, 0.9),
       ("a", 3, "add", *FARM, 0.25), ("b", 2, "delete", *MINE, None), ("b", 3, "add", *FARM, 0.3),
       ("c", 2, "clear", None, None, None), ("a", 5, "delete", *MINE, None), ("a", 4, "add", *MINE, 0.7)]


def table(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_reduced_log_gives_the_same_shocks(spark):
    log = spark.createDataFrame(LOG, SCHEMA)
    cols = ["scenario_id", "region", "sector", "magnitude"]
    want = table(scenario.apply_edits(log), cols)
    assert want == [("a", *FARM, 0.25), ("b", *FARM, 0.3)]
    assert table(scenario.apply_edits(ed.last_writes(log)), cols) == want
    assert table(scenario.apply_edits(ed.last_writes(ed.last_writes(log.limit(4)).unionByName(log))), cols) == want


def test_impacts_follow_the_edits(spark, eco, tmp_path):
    """Two runs of the stream, cut where a scenario changes, is emptied, and is left alone."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    cols = ["scenario_id", "region", "sector"]
    for cut in (slice(0, 4), slice(4, None)):
        spark.createDataFrame(LOG[cut], SCHEMA).coalesce(1).write.mode("append").json(source)
        query = ed.follow(spark.readStream.schema(SCHEMA).json(source), eco, out, state)
        assert query.awaitTermination(150)
        upto = spark.createDataFrame(LOG[:cut.stop] if cut.stop else LOG, SCHEMA)
        want = propagate.impacts(eco, scenario.apply_edits(upto), ["ghosh"])
        got = {tuple(r[c] for c in cols): r.delta_x for r in ed.impacts(spark, out).collect()}
        assert got == pytest.approx({tuple(r[c] for c in cols): r.delta_x for r in want.collect()})
