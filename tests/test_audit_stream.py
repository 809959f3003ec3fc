"""The streamed audit equals the batch audit, whatever is delivered twice or run again."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from marksmith.operators import audit
from marksmith.streaming import audit_stream

SCHEMA = "model_id string, template_id int, fp_id long, asked_at timestamp_ntz, pred array<string>"


def answer(model, fp, day, pred, hour=5):
    return model, 0, fp, dt.datetime(2024, 1, day, hour), pred


LOG = [
    [answer("a", 1, 1, ["x", "</s>"]), answer("a", 2, 1, ["y", "z"]), answer("b", 1, 1, None)],
    [answer("a", 1, 2, ["x"]), answer("a", 2, 2, ["q", "r"], 23), answer("a", 1, 2, ["x"])],
    # delivered again, and late within the watermark; a fingerprint that is not registered
    [answer("a", 2, 2, ["q", "r"], 23), answer("b", 9, 2, ["x"], 23), answer("b", 2, 2, ["y", "r"], 22)],
    [answer("a", 1, 3, ["x", "</s>"])],
    # two days behind the watermark: dropped
    [answer("b", 1, 1, ["x", "</s>"], 7)],
]


@pytest.fixture
def registry(spark):
    return spark.createDataFrame([(1, ["x", "</s>"]), (2, ["q", "r"])], "fp_id long, expected array<string>")


def write_log(spark, folder, files):
    import time
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)  # files are read in the order of their times


def run(spark, log, registry, base, **more):
    return sorted(map(tuple, audit_stream.run_audit_stream(
        spark, str(log), spark.createDataFrame([], SCHEMA).schema, registry, base=str(base),
        files_per_batch=1, **more).collect()))


def test_stream_equals_batch_and_resumes(spark, registry, tmp_path):
    write_log(spark, tmp_path / "log", LOG)
    whole = run(spark, tmp_path / "log", registry, tmp_path / "whole")
    kept = {r[:4]: r for rows in LOG[:-1] for r in rows if r[2] != 9}
    rows = spark.createDataFrame(list(kept.values()), SCHEMA).withColumn("day", F.to_date("asked_at"))
    batch = audit.accuracy(audit.exact_and_partial(rows.join(registry, "fp_id")),
                           ("day", "model_id", "template_id")).collect()
    want = {(f"{r.day} 00:00:00", r.model_id): (r.n, r.n_exact, r.n_missing, r.accuracy,
                                                r.fractional_accuracy) for r in batch}
    got = {(r[0], r[1]): (*r[3:6], *r[7:9]) for r in whole}
    assert got == want
    assert [r[6] for r in whole] == [0, 0, 0, 1, 0]
    assert [r[9] for r in whole] == [True, True, True, True, False]

    # killed between the write of a batch and its commit, then run again on the same base
    def die(batch_id):
        if batch_id == 1:
            raise RuntimeError("killed")

    with pytest.raises(StreamingQueryException):
        run(spark, tmp_path / "log", registry, tmp_path / "killed", after_batch=die)
    assert run(spark, tmp_path / "log", registry, tmp_path / "killed") == whole
    # nothing new: the same audit again
    assert run(spark, tmp_path / "log", registry, tmp_path / "killed") == whole


def test_sums_of_a_registry_beyond_the_broadcast(spark, registry, monkeypatch):
    rows = spark.createDataFrame([r for f in LOG for r in f], SCHEMA)
    small = audit_stream.scored_sums(rows, registry, "1 day").collect()
    from marksmith.operators import joins
    monkeypatch.setattr(audit_stream, "lookup_join",
                        lambda *a, **k: joins.lookup_join(*a, **{**k, "max_broadcast_rows": 0}))
    shuffled = audit_stream.scored_sums(rows, registry, "1 day").collect()
    assert sorted(map(repr, small)) == sorted(map(repr, shuffled))
