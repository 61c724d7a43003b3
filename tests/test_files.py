"""From files to accuracies gives what the samples themselves give."""

from dataclasses import replace

import pytest

from cohortwave.jobs import alignment_queries as queries
from cohortwave.jobs import pipeline
from cohortwave.sources import recordings
from cohortwave.sources.tables import line_samples


def _write(spark, samples, folder, window=8):
    about = samples.select("recording_id").distinct().selectExpr(
        "concat('s', recording_id) AS stem", "int(recording_id) AS subject", "1 AS session", "1 AS run", "128 AS sampling_rate", f"{window} AS window_length", "0 AS offset", "array('A', 'B', 'C', 'D') AS sensors", "map('NonTarget', 1, 'Target', 2) AS labels", "'db' AS database"
    )
    return recordings.write_recordings(samples.selectExpr("concat('s', recording_id) AS stem", "t", "stim", "x"), about, folder)


def test_written_recordings_are_read_again(spark, small, tmp_path):
    samples = line_samples(spark, small)
    done = _write(spark, samples, f"file://{tmp_path}/files").collect()
    assert sum(r.samples for r in done) == samples.count()
    config, context = pipeline.from_files(spark, f"file://{tmp_path}/files", queries.RAW)
    assert (config.window, config.channels, config.offset) == (8, 4, 0)
    back = {(r.recording_id, r.t): (r.stim, r.x) for r in context["samples"].collect()}
    numbers = {r.subject: r.recording_id for r in context["recordings"].collect()}
    assert sorted(numbers.values()) == list(range(1, len(numbers) + 1)) and sorted(numbers) == [k for k, _ in sorted(numbers.items(), key=lambda p: p[1])]
    assert back == {(numbers[r.recording_id], r.t): (r.stim, r.x) for r in samples.collect()}
    again = _write(spark, samples, f"file://{tmp_path}/files")
    assert again.count() == len(done)
    few = spark.createDataFrame([(2,), (3,)], "subject int")
    assert pipeline.from_files(spark, f"file://{tmp_path}/files", queries.RAW, few)[1]["recordings"].count() == 2
    with pytest.raises(ValueError, match="128"):
        pipeline.from_files(spark, f"file://{tmp_path}/files", replace(queries.RAW, band=(1.0, 16.0, 512.0)))
    _write(spark, samples.where("recording_id = 1").withColumn("recording_id", samples.recording_id + 900), f"file://{tmp_path}/files", 16).collect()
    with pytest.raises(ValueError, match="several kinds"):
        pipeline.from_files(spark, f"file://{tmp_path}/files", queries.RAW)
    with pytest.raises(ValueError, match="no recordings"):
        pipeline.from_files(spark, f"file://{tmp_path}/files", queries.RAW, few.where("false"))


def test_the_chain_gives_accuracies_of_every_mode(spark, small):
    rows = queries.files_to_accuracy(spark, small).collect()
    assert {r.mode for r in rows} == {"alone", "together"} and all(0 <= r.mean <= 1 for r in rows)
    assert len(rows) == 2 * line_samples(spark, small).select("recording_id").distinct().count()
