"""Lines of files by the source of their own, against Spark's text reader."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from burrow.sources import session_source, sessions


@pytest.fixture
def folder(tmp_path):
    for name in ("session=a b", "session=a%2Fb", "session=é+", "session=q;&[x]", "_h", "_h=1", ".d"):
        (tmp_path / name / "deep").mkdir(parents=True)
        (tmp_path / name / "deep" / "part-0.txt").write_bytes("﻿one\r\ntwo\rthree\n\n\r\r\nfünf ﻿".encode())
    (tmp_path / "_z.txt").write_text("hidden\n")
    (tmp_path / "a.tsv").write_text("another\n")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "raw.txt").write_bytes(b"\xff\xfe\tx\n")
    (tmp_path / "long.txt").write_bytes(b"".join(b"%d %s\n" % (i, b"x" * (i * 7919 % 5000)) for i in range(3000)))
    return tmp_path


def plain(spark, path):
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(str(path))
    return t.select(F.col("_metadata.file_path").alias("file"), F.hex("value").alias("line"))


def test_lines_are_those_of_sparks_reader(spark, folder):
    got = session_source.text_lines(spark, str(folder), ".txt")
    want = Counter(map(tuple, plain(spark, folder).collect()))
    assert Counter(map(tuple, got.select("file", F.hex("line")).collect())) == want
    assert got.select("at.file_block_start").distinct().count() > 1  # the long file is read in several pieces


def test_pieces_meet_at_every_byte(spark, tmp_path):
    data = b"\nab\r\n\nc\rd\n" + b"e" * 9 + b"\nlast"
    (tmp_path / "f.txt").write_bytes(data)
    system, path = session_source._opened(str(tmp_path / "f.txt"))
    want = session_source._split_lines(data)
    for size in range(1, len(data) + 2):
        cut = [(b, min(b + size, len(data))) for b in range(0, len(data), size)]
        got = [line for b, e in cut for part in session_source._whole_lines(system, path, b, e) for line in session_source._split_lines(part)]
        assert got == want, size


def test_order_is_the_file_s(spark, folder):
    rows = session_source.text_lines(spark, str(folder), ".txt").where(F.col("file").endswith("long.txt")).orderBy("at").collect()
    assert [int(r["line"].split(" ")[0]) for r in rows] == list(range(3000))


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    """Spark's reader makes a task of every 32 files, and one for every folder to list them."""
    for i in range(1000):
        (tmp_path / f"session={i}").mkdir()
        (tmp_path / f"session={i}" / "part-0.txt").write_text(f"0.5\tstate\t\ts{i}\n")
    lines = sessions.lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism + 1
    assert lines.count() == 1000
    assert sessions.read_event_log(spark, str(tmp_path), "*.txt").select("content").distinct().count() == 1000


def test_patterns_and_unknown_file_systems_are_left_to_spark(spark, folder):
    assert not session_source.can_read(spark, f"{folder}/session=*")
    assert not session_source.can_read(spark, "viewfs://x/y")
    assert session_source.can_read(spark, str(folder))
    assert sessions.lines(spark, f"{folder}/session=a*").count() == plain(spark, f"{folder}/session=a*").where("line != ''").count()


ODD = [
    b'{"frame": 1}\n{"frame": 2, "state": "a"}\n#columns frame zone\n{"frame": 3}\n# frame\tzone\tspeed\n',
    b'{ \xe2\x80\xa8 "frame": 1}\n{no\n{"frame": 2}\n\t\x0b{"frame": 3}\n{"x": "\tinfo\tbody_parts\t[\\"a\\"]"}\n{}\n{\n',
    b'B {"a": 1}\nM {}\nV [1]\nBx\n1\t2\t3\n{"frame": 5}\n5\n5\t\n',
    b'0.000\tinfo\tbody_parts\tnose,tail\n# frame\tzone\tspeed\n1\ta\t2\n7\tinfo\tbody_parts\tear\n',
    b'body_parts:a b\r\n#version 3\r1\t0:01\n-4\t5\n',
    b"1\t2\n2\t3\n",
    b" \n\n",
    b'{"frame": 9, "t": 5, "stage": "x"\n{"frame": 8]}\n{"frame": [8]}\n{"a": 1} {"frame": 2}\n\xff\xfe{\n',
]


@pytest.fixture
def odd(tmp_path):
    for i, data in enumerate([*ODD, b'{"frame": 1, "state": "a"}\n' * 3000, b"#columns frame zone\n" + b"1\ta\n" * 3000]):
        (tmp_path / f"{i}.txt").write_bytes(data)
    return str(tmp_path)


def test_layouts_are_told_by_few_lines(spark, odd):
    few = sessions.layout_lines(spark, odd)
    assert Counter(map(str, sessions._layout(few).collect())) == Counter(map(str, sessions._layout(sessions.lines(spark, odd)).collect()))
    assert sorted(r["count"] for r in few.groupBy("file").count().collect())[-1] < 12


def test_an_object_is_parsed_once(spark, odd):
    d = sessions.state_events(sessions.read_frames(spark, odd))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_a_line_is_an_object_by_its_first_character(spark, odd):
    """What is told by the text is what a parser that gives no null for a bad object would tell."""
    line = F.col("line")
    d = sessions.lines(spark, odd).select(line.rlike(r"^\s*\{").alias("said"), F.from_json(F.when(line.rlike(r"^\s*\{"), line), "struct<frame:string>").isNotNull().alias("parsed"), (F.size(F.split("line", "\t")) > 1).alias("cut"), F.contains("line", F.lit("\t")).alias("tab"))
    assert d.where("said <> parsed OR cut <> tab").isEmpty() and d.where("said").count() > 3000


def test_frames_are_read_once(spark, odd):
    """Layouts come with the lines they tell of: files are listed and opened once, and nothing is joined to every line."""
    plan = sessions.read_frames(spark, odd)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RelationV2") == 1 and "Join" not in plan
