"""Session files: what is written is read back, and every dialect gives the canonical columns."""

import pytest
import recordings
from pyspark.sql import functions as F

from burrow.functions import scalars
from burrow.sources import session_source, sessions, zone_files

RECORDED, HEAD = recordings.recording()
FILE = recordings.hash_file(RECORDED, HEAD)


@pytest.fixture
def every(spark, tmp_path):
    for name, text in (("hash", FILE), ("columns", recordings.column_file(RECORDED, HEAD)), ("plain", recordings.plain_file(RECORDED)), ("bmv", recordings.object_file(RECORDED, HEAD)), ("crlf", FILE.replace("\n", "\r\n"))):
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    (tmp_path / "x.pbanalysis").mkdir()
    (tmp_path / "x.pbanalysis/notes.txt").write_text(recordings.plain_file(RECORDED))
    return str(tmp_path)


def test_every_dialect_gives_the_same_frames(spark, every):
    rows = sessions.read_frames(spark, every).where("segment = 0").orderBy("row_index").collect()
    by = {}
    for r in rows:
        by.setdefault(r["session"].split("/")[-1][:-4], []).append(r)
    assert set(by) == {"hash", "columns", "plain", "bmv", "crlf"}
    for name, own in by.items():
        parts = ("0", "1") if name == "bmv" else recordings.PARTS
        for i, (r, f) in enumerate(zip(own, RECORDED, strict=True)):
            assert (r["frame_number"], r["frame_ts_ms"]) == (f["number"], float(i) if f["ms"] is None else f["ms"])
            assert (r["speed"], r["location"], r["stage"]) == (f["speed"], f["zone"], f["states"][-1] if f["states"] else None)
            assert (r["pose"] and {k: tuple(p) for k, p in r["pose"].items()}) == (f["pose"] and dict(zip(parts, f["pose"])))
            assert r["tracker_off"] == (f["off"] and name != "bmv")
    for name in ("hash", "crlf", "plain"):
        assert [r["mcu_ts_ms"] for r in by[name]] == [f["fw"] for f in RECORDED]
    for name in ("hash", "crlf"):
        assert [r["capture_host_ns"] for r in by[name]] == [f["host"] for f in RECORDED]
        assert [r["other"] for r in by[name]] == [{"more": f["more"]} for f in RECORDED]
    assert [r["other"] for r in by["columns"]] == [{"cam": f["more"]} for f in RECORDED]


def test_a_falling_counter_starts_a_segment(spark, every):
    got = sessions.read_frames(spark, every).where("session LIKE '%bmv%'").orderBy("row_index").collect()
    assert [r["segment"] for r in got] == [0] * len(RECORDED) + [1]


def test_headers_dialects_events_and_counts(spark, every):
    rows = sessions.lines(spark, every)
    name = lambda r: r[0].split("/")[-1][:-4]
    assert {name(r): r["dialect"] for r in sessions.dialect(rows).collect()} == {"hash": "hash", "columns": "columns", "plain": "plain", "bmv": "bmv", "crlf": "hash"}
    heads = {name(r): r["header"] for r in sessions.headers(rows).collect()}
    assert heads["hash"]["start_time"] == HEAD["started"] and heads["hash"]["units"] == '{"px_per_cm": 7}' and heads["crlf"] == heads["hash"]
    assert heads["columns"]["subject_id"] == HEAD["subject"] and heads["bmv"]["target_fps"] == str(HEAD["fps"]) and heads["bmv"]["Subject ID"] == HEAD["subject"]
    assert heads["bmv"]["crop"] == str(HEAD["crop"])
    events = sessions.read_events(spark, every).collect()
    assert [tuple(r)[1:] for r in events] == [(0.02, "print", "task", "hello")]
    assert {name(r): r["frames"] for r in sessions.frame_counts(spark, every).collect()} == {"hash": 5, "crlf": 5, "columns": 5, "plain": 5, "bmv": 6}
    x, y, _ = RECORDED[0]["pose"][1]
    assert sessions.first_point(sessions.read_frames(spark, every), recordings.PARTS[1]).where((F.col("x") == x) & (F.col("y") == y) & (F.col("row_index") == 0)).count() == 4


def test_zones_of_every_payload(spark, every):
    got = zone_files.zones_of(sessions.zone_text(sessions.lines(spark, every)))
    rows = {r["file"].split("/")[-1][:-4]: r for r in got.collect()}
    assert set(rows) == {"hash", "crlf", "columns", "bmv"} and all(r["name"] == HEAD["zone"] for r in rows.values())
    assert rows["bmv"]["points"] == HEAD["corners"]
    px = {r["file"].split("/")[-1][:-4]: r for r in zone_files.to_pixels(got, F.lit(200.0), F.lit(100.0)).collect()}
    assert [[round(c, 9) for c in p] for p in px["hash"]["points"]] == [[2.0 * x, 1.0 * y] for x, y in HEAD["corners"]]
    assert px["columns"]["points"] == rows["columns"]["points"]


def test_scales_from_zones(spark):
    payloads = [
        ("norm", '{"scale": {}, "zones": {"s": {"type": "scale", "points": [[0, 0], [0.5, 0]], "scale_length": "10", "scale_unit": "cm"}}}', 10.0),
        ("drawn", '[{"name": "s", "type": "scale", "points": [[0, 0], [30, 40]], "scale_length": 50, "scale_unit": "mm", "shape_dim": [100, 50], "coord_space": "pixel"}]', 20.0),
        ("short", '[{"name": "s", "type": "scale", "points": [[5, 5], [5, 5.1]], "scale_length": 5}]', 0.0),
        ("none", '[{"name": "a", "type": "polygon", "points": [[5, 5], [6, 7]]}]', 0.0),
        ("broken", "{", None),
        ("blank", '{"scale": {}, "arena": {}, "zones": {}}', None),
    ]
    zones = zone_files.zones_of(spark.createDataFrame([p[:2] for p in payloads], "file string, zones string"))
    got = dict(map(tuple, zone_files.px_per_cm(zones, F.lit(200.0), F.lit(100.0), ["file"]).collect()))
    assert got == {name: want for name, _, want in payloads if want is not None}


def test_round_trip(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/s1.txt").write_text(FILE)
    frames = sessions.read_frames(spark, str(tmp_path / "a")).withColumns({"frame": F.col("frame_number"), "timestamp": F.col("frame_ts_ms").cast("string")})
    sessions.write_frames(frames, str(tmp_path / "b"), ["frame", "timestamp", "speed", "location", "pose", "stage"])
    assert [r["pose"] for r in sessions.read_frames(spark, str(tmp_path / "b")).orderBy("row_index").collect()] == [r["pose"] for r in frames.orderBy("row_index").collect()]
    again = sessions.read_frames(spark, str(tmp_path / "b")).orderBy("row_index").collect()
    assert [(r["frame_number"], r["speed"], r["location"], r["stage"]) for r in again] == [(f["number"], f["speed"], f["zone"], f["states"][-1] if f["states"] else None) for f in RECORDED]


def test_event_log(spark, tmp_path):
    (tmp_path / "log.tsv").write_text("0.100\tstate\t\tinit\nbad line\n1.234\tprint\ttask\thello\n")
    log = sessions.read_event_log(spark, str(tmp_path))
    assert sorted(map(tuple, log.select("t_ms", "type", "content").collect())) == [(100, "state", "init"), (1234, "print", "hello")]
    assert sessions.state_timeline(log).count() == 1


def test_runs_in_three_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"subject": "a"}, {"subject": "b"}]')
    (tmp_path / "b.json").write_text('{\n  "runs": [\n    {"subject": "c"}\n  ]\n}\n')
    (tmp_path / "c.json").write_text('{"subject": "d"}')
    assert sorted(r["subject"] for r in sessions.read_runs(spark, str(tmp_path)).collect()) == ["a", "b", "c", "d"]


def test_staleness_reaches_later_stages(spark):
    inputs = spark.createDataFrame([("f", "new"), ("g", "same")], "file string, digest string")
    stamps = spark.createDataFrame([("f", "ingest", "new"), ("f", "track", "old"), ("f", "measure", "new"), ("g", "ingest", "same"), ("g", "track", "same"), ("g", "measure", "same")], "file string, stage string, digest string")
    assert sorted(map(tuple, sessions.stale(inputs, stamps, ["ingest", "track", "measure"]).collect())) == [("f", "measure"), ("f", "track")]


def test_badges(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "file string, digest string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "1")], "file string, digest string")
    assert dict(map(tuple, sessions.badges(a, b).collect())) == {"x": "OK", "y": "MODIFIED", "z": "MISSING", "w": "UNLISTED"}


def test_scalars(spark):
    rows = [("01:02.500", "n/a", "State:a|b", "abc"), ("1:00:00.000", "7.9", "-", ""), ("1500", "x", "a", "é")]
    df = spark.createDataFrame(rows, "t string, n string, s string, h string")
    got = df.select(scalars.elapsed_ms(F.col("t")), scalars.whole(F.col("n")), scalars.last_state(F.col("s")), scalars.text_hash(F.col("h")), scalars.elapsed_s(F.col("t"))).collect()

    def djb2(s):
        h = 5381
        for b in s.encode():
            h = (h * 33 + b) % 2**32
        return f"{h:08x}"

    assert [r[0] for r in got] == [62500.0, 3600000.0, 1500.0]
    assert [r[1] for r in got] == [None, 7, None]
    assert [r[2] for r in got] == ["b", "", "a"]
    assert [r[3] for r in got] == [djb2(r[3]) for r in rows]
    assert got[2][4] == 1500000.0
    assert df.select(scalars.format_elapsed(F.lit(62500.0))).first()[0] == "01:02.500"


def test_headers_are_read_from_a_few_blocks(spark, every, tmp_path):
    frames, head = recordings.recording(2, 40_000)
    (tmp_path / "long.txt").write_text(recordings.hash_file(frames, head))
    got = {r["file"].split("/")[-1][:-4]: r for r in session_source.listed(spark, every).collect()}
    want = {r["file"].split("/")[-1][:-4]: r["header"] for r in sessions.headers(sessions.lines(spark, every)).collect()}
    assert {k: r["header"] for k, r in got.items() if r["header"]} == want and want["long"]["start_time"] == head["started"]
    assert (tmp_path / "long.txt").stat().st_size > 10**6 and got["long"]["bytes_read"] <= 2 * session_source.BLOCK


def test_single_columns_equal_the_whole_reader(spark, every):
    columns = ["frame_number", "frame_ts_ms", "mcu_ts_ms", "capture_host_ns", "speed", "location", "stage"]
    got = session_source.scan(spark, every, columns)
    want = sessions.read_frames(spark, every).select("session", "row_index", *columns)
    key = lambda r: (r["session"].split("/")[-1], r["row_index"])
    assert sorted((key(r), tuple(r)[2:]) for r in got.collect()) == sorted((key(r), tuple(r)[2:]) for r in want.collect())
    assert session_source.scan(spark, every, ["speed"]).columns == ["session", "row_index", "speed"]


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert session_source.listed(spark, str(tmp_path / "none")).isEmpty() and session_source.scan(spark, str(tmp_path / "none"), ["speed"]).isEmpty()


def test_the_shared_folder_is_never_a_machine_s_own_on_a_cluster(spark, monkeypatch):
    from burrow import scratch

    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        applicationId, master = "app", "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Jvm:
                    @staticmethod
                    def getCheckpointDir():
                        return type("None_", (), {"isDefined": lambda self: False})()

                return Jvm()

    session = type("Session", (), {"conf": Conf(), "sparkContext": Context()})()
    with pytest.raises(RuntimeError):
        scratch.shared_dir(session)
    Context.master = "local[4]"
    assert scratch.shared_dir(session) == scratch.shared_dir(session)
    assert scratch.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_points_without_names_are_named_by_place(spark, tmp_path):
    text = "\n".join(x for x in FILE.split("\n") if not x.startswith("#body_parts"))
    (tmp_path / "a.txt").write_text(text)
    row = sessions.read_frames(spark, str(tmp_path)).where("row_index = 0").first()
    assert {k: tuple(p) for k, p in row["pose"].items()} == {str(i): p for i, p in enumerate(RECORDED[0]["pose"])}
    assert sessions.first_point(sessions.read_frames(spark, str(tmp_path))).where("row_index = 0").first()["x"] == RECORDED[0]["pose"][0][0]


def test_states_that_frames_turn_to(spark):
    rows = [("s", i, float(i), v) for i, v in enumerate([None, "a", None, "a", "b", None, "a", "a"])]
    got = sessions.state_events(spark.createDataFrame(rows, "session string, row_index long, frame_ts_ms double, stage string")).collect()
    assert sorted((r["t_ms"], r["name"]) for r in got) == [(1.0, "a"), (4.0, "b"), (6.0, "a")]


def test_scratch_tables_go(spark):
    import os

    from burrow import scratch

    scratch.clear(spark)
    kept = scratch.written(spark.range(3), "kept", keep=True)
    with scratch.released():
        gone = scratch.written(spark.range(4), "gone")
        assert gone.count() == 4
    folder = scratch.shared_dir(spark)
    assert [n for n in os.listdir(folder) if n.startswith("gone-")] == [] and kept.count() == 3
    assert scratch.clear(spark) == 1 and [n for n in os.listdir(folder) if n.startswith("kept-")] == []


def test_new_poses_keep_the_header(spark, tmp_path):
    """A corrected pose stream is read back with its new poses and what the old file's header said."""
    (tmp_path / "old").mkdir()
    (tmp_path / "old/s1.txt").write_text(FILE.replace("#units", "#tracker before\n#units"))
    frames = sessions.read_frames(spark, str(tmp_path / "old")).withColumn("session", F.lit("s1"))
    moved = frames.withColumn("pose", F.transform_values("pose", lambda _, p: F.struct((p["x"] + 1).alias("x"), p["y"].alias("y"), p["conf"].alias("conf"))))
    session_source.write_poses(spark, str(tmp_path / "old"), moved, str(tmp_path / "new"), recordings.PARTS, "after")
    again = sessions.read_frames(spark, str(tmp_path / "new")).orderBy("row_index").collect()
    assert [(r["frame_number"], r["location"], r["stage"], r["speed"]) for r in again] == [(f["number"], f["zone"], f["states"][-1] if f["states"] else None, f["speed"]) for f in RECORDED]
    assert [r["pose"] and {k: tuple(p) for k, p in r["pose"].items()} for r in again] == [f["pose"] and {k: (x + 1, y, c) for k, (x, y, c) in zip(recordings.PARTS, f["pose"])} for f in RECORDED]
    head = sessions.headers(sessions.lines(spark, str(tmp_path / "new"))).first()["header"]
    assert head["tracker"] == "after" and head["start_time"] == HEAD["started"] and head["units"] == '{"px_per_cm": 7}'
    zones = zone_files.zones_of(sessions.zone_text(sessions.lines(spark, str(tmp_path / "new")))).collect()
    assert [z["name"] for z in zones] == [HEAD["zone"]]
