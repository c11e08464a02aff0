"""Session files as a data source of their own, for what needs little of them: headers, or single columns.

``spark.read.format("session_files")`` reads no more of a file than asked for. With ``what`` = ``head`` a reader stops at the first frame, block by block, so
listing a folder costs some kilobytes a file whatever the files hold. With ``what`` = ``cells`` it cuts a frame's line only up to the last wanted
column and keeps the wanted ones. With ``what`` = ``lines`` it gives all lines, those of a large file in several tasks, and with ``what`` = ``marked`` also which of them
a file's layout is told by. Files are spread over tasks by their sizes. Paths may be of any file system that pyarrow knows.

It also writes: rows (folder, value), a folder's rows one after another, become the lines of one file in each folder. A file gets its name when it is whole, so
a task that runs twice leaves one file; a job that fails leaves none. Where there are as many files as sessions, this spares what Spark's writer does for each.

Defined results: as ``sessions`` has them; a file without frames has all its lines as head; what stands behind the first frame is no header; an empty
folder gives no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from urllib.parse import quote, urlsplit
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from burrow.functions.scalars import elapsed_ms, escaped, format_elapsed, is_absent, last_state, number
from burrow.sources import sessions

BLOCK = 1 << 14
BATCH = 20_000
#: Bytes of files that one task reads, or one file.
TASK_BYTES = 64 << 20
#: Of lines: bytes that one read asks for and a batch holds, bytes that opening a file is worth, least bytes of a task.
CHUNK, OPEN_BYTES, LEAST_BYTES = 1 << 20, 1 << 15, 1 << 20
#: Characters of a file's name that may have to be escaped.
_ODD = re.compile(r"[^A-Za-z0-9/;:@&=+$,!*'()~_.-]")
_FRAME = re.compile(r"\s*-*\d+\s*\t([^\t]*)")
_TABBED, _HASHED = re.compile(r"#\s*[^\t]+\t"), re.compile(r"#columns\s+(.*)")
_HASH_MARK = re.compile(r"#(?:columns|version|session_start|session_id|sync|zone_config_begin)\b")
_BMV = re.compile(r"[BMV] [\[{]")
_OBJECT = re.compile(r'\s*\{.*"')
#: Lines that may say something of their file's layout (all that ``sessions`` looks for), and those that surely say only that it has JSON frames.
_MARK = re.compile(rb'#|body_parts:|[BMV] |\s*\{|.*\tinfo\tbody_parts\t')
_OF_JSON = re.compile(rb'(?!.*\tinfo\tbody_parts\t)[ \t]*\{[\t\x20-\x7e]*"')


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class _Pieces(InputPartition):
    """Pieces of files: path, first byte, byte behind the last."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        super().__init__(0)
        self.pieces = pieces


def _is_frame(line: str) -> bool:
    if line.lstrip().startswith("{"):
        return True
    m = _FRAME.match(line)
    return bool(m) and m[1].strip().lower() not in sessions.EVENT_WORDS


class _Layout:
    """What the lines before the frames say about their columns."""

    def __init__(self):
        self.columns: list[str] | None = None
        self.hash = self.bmv = self.in_zones = False

    def see(self, line: str) -> None:
        self.hash |= bool(_HASH_MARK.match(line))
        self.bmv |= bool(_BMV.match(line))
        if self.columns is None and line.startswith("#"):
            if m := _HASHED.match(line):
                self.columns = m[1].split()
            elif _TABBED.match(line):
                names = [n for c in line.lstrip("#").split("\t") if (n := c.strip())]
                self.columns = names if len(names) >= 3 else None

    def places(self, wanted: list[str]) -> list[int]:
        """Of each wanted column its place, the later one of two, or -1."""
        if self.columns is None:
            return [sessions.BASE_COLUMNS.index(c) if c in sessions.BASE_COLUMNS else -1 for c in wanted]
        table = sessions.HASH_ALIASES if self.hash else sessions.ALIASES
        names = {o: n for n, others in table.items() for o in others}
        own = [names.get(c.strip().lower(), c.strip().lower()) for c in self.columns]
        return [len(own) - 1 - own[::-1].index(c) if c in own else -1 for c in wanted]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.what = options["path"], options.get("what", "head")
        self.wanted = [c for c in options.get("columns", "").split(",") if c]
        self.pattern, self.exclude = options.get("suffix", ".txt"), re.compile(options.get("exclude", r"\.pbanalysis/"))

    def partitions(self) -> list[InputPartition]:
        system, root = _opened(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f for f in found if f.is_file and f.path.endswith(self.pattern) and not self.exclude.search(f.path)), key=lambda f: f.path)
        out: list[list[str]] = []
        room = 0
        for f in files:
            size = min(f.size, BLOCK) if self.what == "head" else f.size
            if not out or size > room:
                out.append([])
                room = TASK_BYTES
            out[-1].append(f.path)
            room -= size
        return [_Files(paths) for paths in out] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        for path in partition.paths:
            yield from (self._head if self.what == "head" else self._cells)(system, path)

    @staticmethod
    def _lines(stream) -> Iterator[tuple[str, int]]:
        """Lines and how many bytes have been read so far."""
        rest, seen = b"", 0
        while block := stream.read(BLOCK):
            seen += len(block)
            *whole, rest = (rest + block).split(b"\n")
            for line in whole:
                yield line.decode("utf-8", "replace").rstrip("\r"), seen
        if rest:
            yield rest.decode("utf-8", "replace").rstrip("\r"), seen

    def _head(self, system: fs.FileSystem, path: str) -> Iterator[pa.RecordBatch]:
        lines, seen, in_zones = [], 0, False
        with system.open_input_file(path) as stream:
            for line, seen in self._lines(stream):
                in_zones = line.startswith("#zone_config_begin") or in_zones and not line.startswith("#zone_config_end")
                if line.strip():
                    lines.append(line)
                if not in_zones and line.strip() and _is_frame(line):
                    break
        n = len(lines)
        yield pa.RecordBatch.from_arrays([pa.array([_uri(path)] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(lines, pa.string()), pa.array([seen] * n, pa.int64())], names=["file", "at", "line", "bytes_read"])

    def _cells(self, system: fs.FileSystem, path: str) -> Iterator[pa.RecordBatch]:
        layout, at, last, index = _Layout(), None, 0, 0
        rows: list[list] = []
        with system.open_input_file(path) as stream:
            for line, _ in self._lines(stream):
                if not line.strip():
                    continue
                layout.in_zones = line.startswith("#zone_config_begin") or layout.in_zones and not line.startswith("#zone_config_end")
                if layout.in_zones or not _is_frame(line):
                    layout.see(line)
                    continue
                if line.lstrip().startswith("{"):
                    if layout.columns is not None or layout.hash or not _OBJECT.match(line):
                        continue
                    cells = _object(line, self.wanted)
                    if cells is None:
                        continue
                else:
                    if layout.bmv and layout.columns is None and "\t" not in line:
                        continue
                    if at is None:
                        at = layout.places(self.wanted)
                        last = max(at, default=-1) + 1
                    got = line.split("\t", last)
                    cells = [got[i] if 0 <= i < len(got) else None for i in at]
                rows.append([index, *cells])
                index += 1
                if len(rows) == BATCH:
                    yield self._batch(path, rows)
                    rows = []
        if rows:
            yield self._batch(path, rows)

    def _batch(self, path: str, rows: list[list]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array([_uri(path)] * len(rows), pa.string()), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], names=["file", "row_index", *self.wanted])


class _LineReader(DataSourceReader):
    """All lines, as Spark's text reader gives them: lines end in LF, CR LF or CR, hidden files are left out, a mark of byte order is no text."""

    def __init__(self, options: dict):
        self.path, self.pattern, self.tasks = options["path"], options.get("suffix", ".txt"), int(options.get("tasks", 1))
        self.marked = options["what"] == "marked"

    def partitions(self) -> list[InputPartition]:
        system, root = _opened(self.path)
        info = system.get_file_info(root)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(self.pattern) and not _is_hidden(f.path[len(root) :]))
        # as many tasks as asked for, unless they would be too large or too small
        most = max(LEAST_BYTES, min(TASK_BYTES, sum(size + OPEN_BYTES for _, size in files) // max(1, self.tasks)))
        out: list[list[tuple[str, int, int]]] = []
        room = 0
        for path, size in files:
            for begin in range(0, max(size, 1), most):
                end = min(begin + most, size)
                if not out or end - begin + OPEN_BYTES > room:
                    out.append([])
                    room = most
                out[-1].append((path, begin, end))
                room -= end - begin + OPEN_BYTES
        return [_Pieces(pieces) for pieces in out] or [_Pieces([])]

    def read(self, partition: _Pieces) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        held, size, rows = [], 0, 0
        for path, begin, end in partition.pieces:
            name, n, told = pa.scalar(_escaped_uri(self.path, path), pa.string()), 0, False
            for data in _whole_lines(system, path, begin, end):
                lines = _split_lines(data)
                if not lines:
                    continue
                columns = [pa.repeat(name, len(lines)), pa.repeat(pa.scalar(begin, pa.int64()), len(lines)), pa.array(range(n, n + len(lines)), pa.int64()), _text(lines)]
                if self.marked:
                    marks, told = _marks(lines, told)
                    columns.append(pa.array(marks, pa.bool_()))
                held.append(columns)
                n += len(lines)
                # a row has its file's name too
                size, rows = size + len(data) + len(lines) * len(path), rows + len(lines)
                if rows >= BATCH or size >= 8 * CHUNK:
                    yield self._batch(held)
                    held, size, rows = [], 0, 0
        if held:
            yield self._batch(held)

    def _batch(self, held: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held)], names=["file", "begin", "at", "line", *["mark"] * self.marked])


def _is_hidden(path: str) -> bool:
    """Whether Spark leaves a file out for its name or a folder's."""
    return any(n.startswith(".") or n.startswith("_") and "=" not in n for n in path.split("/")) or path.endswith("._COPYING_")


def _whole_lines(system: fs.FileSystem, path: str, begin: int, end: int) -> Iterator[bytes]:
    """The lines whose first byte lies in a piece, some at a time; only the last one may be without its end."""
    with system.open_input_file(path) as stream:
        here = max(begin - 1, 0)
        stream.seek(here)
        skipping, held = begin > 0, []
        while here < end and (block := stream.read(CHUNK)):
            cut = block.rfind(b"\n") + 1
            if not cut:
                held.append(block)
                continue
            data, held = b"".join([*held, block[:cut]]), [block[cut:]]
            first, here = here, here + len(data)
            if skipping:  # the line that began before
                skipped, skipping = data.index(b"\n") + 1, False
                data, first = data[skipped:], first + skipped
            if first >= end:
                return
            if here > end:
                data = data[: data.index(b"\n", end - 1 - first) + 1]
            if data:
                yield data.removeprefix(b"\xef\xbb\xbf") if first == 0 else data
        if here < end and not skipping and (data := b"".join(held)):
            yield data.removeprefix(b"\xef\xbb\xbf") if here == 0 else data


def _split_lines(data: bytes) -> list[bytes]:
    if b"\r" in data:
        data = data.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    lines = data.split(b"\n")
    return lines if lines[-1] else lines[:-1]


def _marks(lines: list[bytes], told: bool) -> tuple[list[bool], bool]:
    """Of each line whether it may say something of the layout; of those that say only that there are JSON frames the first, unless it has been told."""
    marks = []
    for line in lines:
        mark = bool(_MARK.match(line))
        if mark and _OF_JSON.match(line):
            mark, told = not told, True
        marks.append(mark)
    return marks, told


def _text(lines: list[bytes]) -> pa.Array:
    """Bytes as text, as they are."""
    held = pa.array(lines, pa.binary())
    return pa.StringArray.from_buffers(len(held), held.buffers()[1], held.buffers()[2])


def _escaped_uri(root: str, path: str) -> str:
    """A file's name as Spark has it in ``_metadata.file_path``."""
    path = _ODD.sub(lambda m: m[0] if ord(m[0]) > 127 and not m[0].isspace() and unicodedata.category(m[0]) != "Cc" else quote(m[0]), path)
    u = urlsplit(root)
    return f"file:{path}" if u.scheme in ("", "file") else f"{u.scheme}://{u.netloc}{path}" if path.startswith("/") else f"{u.scheme}://{path}"


def _uri(path: str) -> str:
    return f"file://{path}" if path.startswith("/") else path


def _object(line: str, wanted: list[str]) -> list[str | None] | None:
    """Wanted fields of a JSON frame as text."""
    try:
        found = json.loads(line)
    except ValueError:
        return None
    out = []
    for c in wanted:
        v = next((found[k] for k in sessions._JSON.get(c, ()) if found.get(k) is not None), None)
        out.append(v if v is None or isinstance(v, str) else json.dumps(v))
    return out


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = _opened(self.path)
        name, at, out = uuid.uuid4().hex, None, None

        def close() -> None:
            if out is not None:
                out.close()
                system.move(f"{root}/{at}/.{name}", f"{root}/{at}/part-00000.txt")

        for batch in iterator:
            folders, values = batch.column("folder"), batch.column("value").fill_null("")
            # where a folder's rows begin
            cuts = [0, *(i + 1 for i in pc.indices_nonzero(pc.not_equal(folders[1:], folders[:-1])).to_pylist()), len(folders)] if len(folders) else []
            # the lines of each folder as one text
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts or [0], pa.int32()), values), "\n")
            for folder, text in zip(folders.take(pa.array(cuts[:-1], pa.int64())).to_pylist(), texts):
                if folder != at:
                    close()
                    at = folder
                    system.create_dir(f"{root}/{at}")
                    out = system.open_output_stream(f"{root}/{at}/.{name}")
                out.write(text.as_buffer())
                out.write(b"\n")
        close()
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        system, root = _opened(self.path)
        system.create_dir(root)
        system.open_output_stream(f"{root}/_SUCCESS").close()

    def abort(self, messages: list) -> None:
        system, root = _opened(self.path)
        system.delete_dir_contents(root, missing_dir_ok=True)


class SessionFiles(DataSource):
    """Options: path, what (head, cells, lines or marked), columns (canonical names, comma-joined), suffix, exclude, tasks. Written are rows of folder and value."""

    @classmethod
    def name(cls) -> str:
        return "session_files"

    def schema(self) -> str:
        if self.options.get("what", "head") == "head":
            return "file string, at long, line string, bytes_read long"
        if self.options["what"] in ("lines", "marked"):
            return "file string, begin long, at long, line string" + ", mark boolean" * (self.options["what"] == "marked")
        return ", ".join(["file string", "row_index long", *(f"{c} string" for c in self.options.get("columns", "").split(",") if c)])

    def reader(self, schema) -> DataSourceReader:
        return (_LineReader if self.options.get("what") in ("lines", "marked") else _Reader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            system, root = _opened(self.options["path"])
            system.delete_dir_contents(root, missing_dir_ok=True)
        return _Writer(dict(self.options))


def can_write(path: str) -> bool:
    """Whether pyarrow knows the path's file system."""
    try:
        _opened(path)
    except (ValueError, NotImplementedError, OSError):
        return False
    return True


def can_read(spark: SparkSession, path: str) -> bool:
    """Whether a path is one file or folder of a file system that both Spark and pyarrow know by its name."""
    if re.search(r"[*?\[\]{},\\]", path):
        return False
    if "://" not in path and not path.startswith("file:"):  # a name of Spark's default file system
        return path.startswith("/") and spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:")
    return can_write(path)


def text_lines(spark: SparkSession, path: str, suffix: str, marked: bool = False) -> DataFrame:
    """file, at (first byte of the piece, number in it), line of all files below a path whose names end so; marked: with mark, whether a line may tell its file's layout."""
    spark.dataSource.register(SessionFiles)
    what = "marked" if marked else "lines"
    d = spark.read.format("session_files").options(what=what, path=path, suffix=suffix, tasks=str(2 * spark.sparkContext.defaultParallelism)).load()
    return d.select("file", F.struct(F.col("begin").alias("file_block_start"), F.col("at").alias("id")).alias("at"), "line", *["mark"] * marked)


def head_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, at, line, bytes_read of what stands before the first frame of every session file, and that frame."""
    spark.dataSource.register(SessionFiles)
    return spark.read.format("session_files").option("what", "head").option("path", path).load()


def listed(spark: SparkSession, path: str) -> DataFrame:
    """file, header, bytes_read: what each file's header says, from its first blocks."""
    rows = head_lines(spark, path)
    seen = rows.groupBy("file").agg(F.max("bytes_read").alias("bytes_read"))
    heads = sessions.headers(rows.withColumn("at", F.struct(F.lit(0).cast("long").alias("file_block_start"), F.col("at").alias("id"))).drop("bytes_read"))
    return seen.join(heads, "file", "left").select("file", "header", "bytes_read")


def _typed(name: str) -> Column:
    c = F.col(f"c_{name}")
    text = F.when(~is_absent(c), c)
    if name == "frame_number":
        return number(c).cast("long")
    if name == "frame_ts_ms":
        return F.coalesce(elapsed_ms(c), F.col("row_index").cast("double"))
    if name in ("pose_ts_ms", "mcu_ts_ms"):
        return elapsed_ms(c)
    if name == "capture_host_ns":
        return text.try_cast("long")
    if name == "speed":
        return number(c)
    return F.nullif(last_state(text), F.lit("")) if name == "stage" else text


def scan(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """session, row_index and the wanted canonical columns of all frames, as ``sessions.read_frames`` gives them; poses stay text."""
    spark.dataSource.register(SessionFiles)
    cells = spark.read.format("session_files").options(what="cells", path=path, columns=",".join(columns)).load()
    cells = cells.select(F.col("file").alias("session"), "row_index", *(F.col(c).alias(f"c_{c}") for c in columns))
    return cells.select("session", "row_index", *(_typed(c).alias(c) for c in columns))


#: Header lines that a new pose stream writes anew.
REPLACED = r"^#(?:columns|body_parts|tracker|schema)\b"


def write_poses(spark: SparkSession, source: str, frames: DataFrame, path: str, parts: list[str], tracker: str) -> None:
    """Session files with new poses below path, a folder a session: the header of the file of that name in ``source`` carried over, but for tracker, parts and columns.

    frames has session (the file's name without folder and ending), frame_number, frame_ts_ms, pose (a map of x, y, conf by part) and any of location, stage and
    speed. Only headers in ``#key value`` lines are carried; of a file that isn't there only the new lines are written.
    """
    write_poses_of(head_lines(spark, source), frames, path, parts, tracker)


def write_poses_of(heads: DataFrame, frames: DataFrame, path: str, parts: list[str], tracker: str) -> None:
    """``write_poses`` with the headers given as ``head_lines`` gives them."""
    heads = heads.withColumn("session", F.regexp_extract("file", r"([^/]*)\.[^./]*$", 1))
    in_zones = F.sum(F.col("line").startswith("#zone_config_begin").cast("int") - F.col("line").startswith("#zone_config_end").cast("int")).over(Window.partitionBy("file").orderBy("at"))
    carried = heads.withColumn("open", in_zones).where((F.col("line").startswith("#") | (F.col("open") > 0)) & ~F.col("line").rlike(REPLACED))
    carried = carried.join(frames.select("session").distinct(), "session", "left_semi").select("session", (F.col("at") - (1 << 40)).alias("ord"), F.col("line").alias("value"))
    named = [("location", "zone"), ("stage", "state"), ("speed", "speed")]
    more = [(c, n) for c, n in named if c in frames.columns]
    new = [f"#tracker {tracker}", f"#body_parts {json.dumps(parts)}", "#columns " + " ".join(["frame", "elapsed", "pose", *(n for _, n in more)])]
    own = frames.select("session").distinct().select("session", F.explode(F.array(*(F.struct(F.lit(i - len(new)).cast("long").alias("ord"), F.lit(v).alias("value")) for i, v in enumerate(new)))).alias("l")).select("session", "l.*")
    number_ = lambda v: F.coalesce(F.when(~F.isnan(v), F.format_string("%.4f", v)), F.lit("null"))
    point = lambda p: F.concat(F.lit("["), F.concat_ws(",", *(number_(F.try_element_at("pose", F.lit(p))[c]) for c in ("x", "y", "conf"))), F.lit("]"))
    pose = F.when(F.col("pose").isNull(), "na").otherwise(F.concat(F.lit("["), F.concat_ws(",", *(F.when(F.map_contains_key("pose", F.lit(p)), point(p)).otherwise("[]") for p in parts)), F.lit("]")))
    plain = lambda c: F.when(F.col(c).isNull(), "none").otherwise(F.format_string("%.4f", c)) if c == "speed" else F.coalesce(escaped(F.col(c)), F.lit("na"))
    cells = [F.col("frame_number").cast("string"), format_elapsed(F.col("frame_ts_ms")), pose, *(plain(c) for c, _ in more)]
    rows = frames.select("session", F.col("frame_number").cast("long").alias("ord"), F.concat_ws("\t", *cells).alias("value"))
    sessions.write_lines(carried.unionByName(own).unionByName(rows), path)
