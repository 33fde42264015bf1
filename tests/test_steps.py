"""Steps that a killed run leaves, and what makes them anew."""

import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sliceweave.sources.steps import Steps

ROOT = Path(__file__).resolve().parents[1]


def chain(spark, folder, source, factor=1, fail=False):
    """Two steps over a table of numbers: doubled, then summed."""
    steps = Steps(spark, folder)

    def total():
        if fail:
            raise RuntimeError("stopped")
        return doubled.agg(F.sum("v").alias("v"))

    doubled = steps.step("doubled", lambda: spark.read.parquet(source).select((F.col("v") * 2 * factor).alias("v")), [source], {"factor": factor})
    out = steps.step("total", total, after=["doubled"])
    return steps, out.first()["v"]


def test_steps_are_made_once(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "steps")
    spark.range(10).select(F.col("id").alias("v")).write.parquet(source)
    steps, total = chain(spark, folder, source)
    assert (steps.made, total) == (["doubled", "total"], 90)
    steps, total = chain(spark, folder, source)
    assert (steps.made, total) == ([], 90)
    steps, total = chain(spark, folder, source, factor=3)
    assert (steps.made, total) == (["doubled", "total"], 270)
    spark.range(10, 11).select(F.col("id").alias("v")).write.mode("append").parquet(source)
    steps, total = chain(spark, folder, source, factor=3)
    assert (steps.made, total) == (["doubled", "total"], 330)
    with pytest.raises(RuntimeError):
        chain(spark, folder, source, factor=4, fail=True)
    steps, total = chain(spark, folder, source, factor=4)
    assert (steps.made, total) == (["total"], 440)
    assert steps.optional(str(tmp_path / "none"), spark.read.parquet) is None and steps.optional(source, spark.read.parquet).count() == 11


def test_empty_steps_keep_their_schema(spark, tmp_path):
    for made in (["none"], []):
        steps = Steps(spark, str(tmp_path / "steps"))
        assert steps.step("none", lambda: spark.range(3).filter("id > 5").withColumn("s", F.lit("x"))).columns == ["id", "s"]
        assert steps.made == made


def test_a_killed_run_is_taken_up_again(spark, tmp_path):
    """A run that dies while it writes its second step leaves the first one finished and the second one absent."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "steps")
    spark.range(40).select(F.col("id").alias("v")).write.parquet(source)
    script = textwrap.dedent(f"""
        import glob, os, sys, threading, time
        sys.path.insert(0, {str(ROOT)!r})
        from pyspark.sql import functions as F
        from sliceweave.session import build_session
        from sliceweave.sources.steps import Steps
        spark = build_session("killed", "local[2]", **{{"spark.driver.memory": "1g"}})
        steps = Steps(spark, {folder!r})
        doubled = steps.step("doubled", lambda: spark.read.parquet({source!r}).select((F.col("v") * 2).alias("v")), [{source!r}], {{"factor": 1}})

        def die():
            while not glob.glob({folder!r} + "/_temporary-total-*/**/*.parquet", recursive=True):
                time.sleep(0.05)
            os._exit(9)

        threading.Thread(target=die, daemon=True).start()

        def slow(frames):
            for i, frame in enumerate(frames):
                yield frame
                time.sleep(60)

        steps.step("total", lambda: doubled.repartition(4).mapInPandas(slow, "v long"), after=["doubled"])
    """)
    assert subprocess.run([sys.executable, "-c", script], capture_output=True, timeout=240).returncode == 9
    steps = Steps(spark, folder)
    assert steps.state("doubled") and steps.state("total") is None
    assert any(p.name.startswith("_temporary-total-") for p in Path(folder).iterdir())
    steps, total = chain(spark, folder, source)
    assert (steps.made, total) == (["total"], 1560)
    steps.clear_unfinished()
    assert sorted(p.name for p in Path(folder).iterdir() if not p.name.startswith(".")) == ["doubled", "total"]


def test_half_written_steps_are_absent(spark, tmp_path):
    """A table without its manifest, as an old way of writing would leave it, is made anew."""
    folder = str(tmp_path / "steps")
    spark.range(3).write.parquet(f"{folder}/one")
    steps = Steps(spark, folder)
    assert steps.step("one", lambda: spark.range(5)).count() == 5 and steps.made == ["one"]
