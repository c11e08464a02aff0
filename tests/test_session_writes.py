"""Session files are whole: one file a session, its lines in order, whatever the plan of the rows."""

from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from burrow.sources import sessions


@pytest.fixture
def adaptive(spark):
    """Many small shuffle partitions, as of a large table."""
    held = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_one_file_of_a_session_after_a_window(adaptive, tmp_path):
    rows = adaptive.range(0, 3000, 1, 6).select((F.col("id") % 60).alias("session"), F.col("id").alias("frame"))
    rows = rows.withColumn("ms", F.col("frame") - F.min("frame").over(Window.partitionBy("session")))
    lines = rows.select("session", F.col("frame").alias("ord"), F.col("ms").cast("string").alias("value"))
    head = rows.select("session").distinct().select("session", F.lit(-1).cast("long").alias("ord"), F.lit("# head").alias("value"))
    sessions.write_lines(lines.unionByName(head), str(tmp_path / "out"))
    for k in range(60):
        (file,) = (tmp_path / "out" / f"session={k}").glob("*.txt")
        assert file.read_text().split("\n") == ["# head", *(str(60 * i) for i in range(50)), ""]


def test_folders_are_named_as_sparks_writer_names_them(spark, tmp_path):
    rows = spark.createDataFrame([(s, i, f"{i}:{s}") for s in ("a b", "x/y:z=%[1]", "käse", "", None, "c^{d}#e?'\"*\\f") for i in (2, 1)], "session string, ord long, value string")
    sessions.write_lines(rows, str(tmp_path / "own"))
    rows.sortWithinPartitions("session").select("session", "value").write.partitionBy("session").text(str(tmp_path / "sparks"))
    folders = lambda of: sorted(p.name for p in (tmp_path / of).iterdir() if p.is_dir())
    assert folders("own") == folders("sparks")
    (file,) = (tmp_path / "own" / "session=a b").glob("*.txt")
    assert file.read_text() == "1:a b\n2:a b\n"


def test_a_second_write_leaves_nothing_of_the_first(spark, tmp_path):
    lines = lambda *rows: spark.createDataFrame([(s, 0, v) for s, v in rows], "session long, ord long, value string")
    sessions.write_lines(lines((1, "old"), (2, "old")), str(tmp_path / "out"))
    sessions.write_lines(lines((2, "new")), f"file://{tmp_path}/out")
    assert [p.read_text() for p in (tmp_path / "out").rglob("*.txt")] == ["new\n"]
