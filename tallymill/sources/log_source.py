"""Agent logs as a Spark data source: whole lines with their byte offsets, read in place, as a table or as a stream.

A file is cut into byte ranges, and a range yields the lines that begin in it, so a line's offset is known where it is
read and nothing is shuffled to number it. As a stream, an offset says of each file how many bytes of whole lines were
taken, its size and time, and a hash of the bytes before that place (the anchor). A file that only grew is read on from
there: its new bytes and the anchor are all that is read. One that was cut or rewritten is read anew in its next
generation. An offset has one entry a file, so a root with very many files is better read as several streams.

Options: `path` (a root with `sessions` and `archived_sessions`, any file system that pyarrow opens), `pattern` (a glob of
names), `rangeBytes`, `only` (a JSON list of relative names: nothing else is listed or read), and for streams `state` (a folder that keeps what was committed, for restarts).
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "agent_log_lines"
LINE_BYTES, DEPTH, ANCHOR, BLOCK = 16 << 20, 64, 256, 1 << 16
PLACES = ("sessions", "archived_sessions")
_SCHEMA = "file string, relative string, place string, generation int, source_offset bigint, value string"
_ARROW = pa.schema([("file", pa.string()), ("relative", pa.string()), ("place", pa.string()), ("generation", pa.int32()), ("source_offset", pa.int64()), ("value", pa.string())])
#: Bytes of lines in one Arrow batch.
BATCH = 4 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:/", "file:///", 1))


@dataclass
class Range(InputPartition):
    """Lines of a file that begin at bytes from `start` to before `end`; `until` is the end of what may be read."""

    relative: str
    place: str
    generation: int
    start: int
    end: int
    until: int


class _Logs:
    def __init__(self, options: dict):
        self.root, self.pattern = options["path"], options.get("pattern", "*.jsonl")
        self.range_bytes, self.only = int(options.get("rangeBytes", 64 << 20)), set(json.loads(options["only"])) if "only" in options else None
        self.files, self.top = opened(self.root)

    def listed(self) -> dict[str, tuple[str, int, int]]:
        """place, size and time by relative name; an archived file with an active namesake, empty or not, is left out."""
        found: dict[str, tuple[str, int, int]] = {}
        for place in PLACES:
            top = f"{self.top}/{place}"
            if self.only is not None:
                infos = self.files.get_file_info([f"{top}/{r}" for r in sorted(self.only)])
                found = {i.path[len(top) + 1 :]: (place, i.size, i.mtime_ns or 0) for i in infos if i.is_file} | found
                continue
            for info in self.files.get_file_info(fs.FileSelector(top, allow_not_found=True, recursive=True)):
                relative = info.path[len(top) + 1 :]
                if info.is_file and fnmatch.fnmatch(info.base_name, self.pattern) and relative.count("/") < DEPTH and not info.base_name.startswith(("_", ".")):
                    found.setdefault(relative, (place, info.size, info.mtime_ns or 0))
        return found

    def name(self, place: str, relative: str) -> str:
        return f"{self.top}/{place}/{relative}"

    def bytes(self, place: str, relative: str, start: int, end: int) -> bytes:
        with self.files.open_input_file(self.name(place, relative)) as f:
            f.seek(start)
            return f.read(end - start)

    def whole(self, place: str, relative: str, start: int, size: int) -> int:
        """The end of the last whole line after `start`, looking from the end."""
        while size > start:
            at = max(start, size - BLOCK)
            last = self.bytes(place, relative, at, size).rfind(b"\n")
            if last >= 0:
                return at + last + 1
            size = at
        return start

    def anchor(self, place: str, relative: str, upto: int) -> str:
        return hashlib.sha256(self.bytes(place, relative, max(0, upto - ANCHOR), upto)).hexdigest()

    def ranges(self, relative: str, place: str, generation: int, start: int, end: int) -> list[Range]:
        cuts = [*range(start, end, self.range_bytes), end] if start < end else []
        return [Range(relative, place, generation, a, z, end) for a, z in zip(cuts, cuts[1:])]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        """Lines in batches. A line end takes one carriage return with it; lines over 16 MiB and those that are no UTF-8 are mended or left out."""
        name = self.name(part.place, part.relative)
        rows: list[tuple[int, str]] = []
        held = 0

        def batch() -> pa.RecordBatch:
            n = len(rows)
            offsets, values = zip(*rows, strict=True)
            same = [pa.array([v] * n, t) for v, t in ((name, pa.string()), (part.relative, pa.string()), (part.place, pa.string()), (part.generation, pa.int32()))]
            return pa.RecordBatch.from_arrays([*same, pa.array(offsets, pa.int64()), pa.array(values, pa.string())], schema=_ARROW)

        with self.files.open_input_file(name) as f:
            for at, line in _lines(f, part):
                if len(line) <= LINE_BYTES:
                    rows.append((at, line.removesuffix(b"\r").decode("utf-8", "replace")))
                    held += len(line)
                if held > BATCH:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


def _lines(f: pa.NativeFile, part: Range) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the whole lines that begin in the range; of a longer line than is kept, its first bytes too many."""
    at = part.start
    rest, skip = b"", False
    if at > 0:
        f.seek(at - 1)
        skip = f.read(1) != b"\n"  # the line under way belongs to the range before
    f.seek(at)
    place = at
    while at < part.until and (place < part.end or skip):
        block = f.read(min(BLOCK * 16, part.until - at))
        if not block:
            return
        at += len(block)
        pieces = (rest + block).split(b"\n")
        rest = pieces.pop()
        for piece in pieces:
            if skip:
                skip = False
            elif place < part.end:
                yield place, piece
            place += len(piece) + 1
            if place >= part.end and not skip:
                return
        if len(rest) > LINE_BYTES:
            # too long to keep: go on to its end without holding it
            found = _end(f, at, part.until)
            skip, place, at, rest = False, found, found, b""
            f.seek(at)


def _end(f: pa.NativeFile, at: int, until: int) -> int:
    """Where the line that byte `at` is in ends."""
    f.seek(at)
    while at < until:
        block = f.read(min(BLOCK * 16, until - at))
        if not block:
            return until
        if (found := block.find(b"\n")) >= 0:
            return at + found + 1
        at += len(block)
    return until


class _Table(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> Sequence[Range]:
        logs = _Logs(self.options)
        return [part for r, (place, size, _) in sorted(logs.listed().items()) for part in logs.ranges(r, place, 0, 0, size)] or [Range("", "", 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.end:
            yield from _Logs(self.options).read(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.logs = options, _Logs(options)
        self.known: dict[str, dict] = self._kept()

    def _state(self) -> tuple[fs.FileSystem, str]:
        files, top = opened(self.options["state"])
        return files, f"{top}/offset.json"

    def _kept(self) -> dict:
        files, name = self._state()
        if files.get_file_info(name).type == fs.FileType.NotFound:
            return {}
        with files.open_input_file(name) as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        now = {}
        for relative, (place, size, moment) in sorted(self.logs.listed().items()):
            was = self.known.get(relative)
            if was is not None and (was["size"], was["time"], was["place"]) == (size, moment, place):
                now[relative] = was
                continue
            begin, generation = (was["taken"], was["generation"]) if was is not None else (0, 0)
            cut = was is not None and (size < was["size"] or (size == was["size"] and moment != was["time"]))
            if cut or (was is not None and self.logs.anchor(place, relative, begin) != was["anchor"]):
                begin, generation = 0, generation + 1
            taken = self.logs.whole(place, relative, begin, size)
            now[relative] = {"place": place, "size": size, "time": moment, "generation": generation, "taken": taken, "anchor": self.logs.anchor(place, relative, taken)}
        return now

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        self.known = end
        parts = []
        for relative, to in sorted(end.items()):
            was = start.get(relative)
            begin = was["taken"] if was is not None and was["generation"] == to["generation"] else 0
            if begin < to["taken"]:
                parts += self.logs.ranges(relative, to["place"], to["generation"], begin, to["taken"])
        return parts

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from _Logs(self.options).read(partition)

    def commit(self, end: dict) -> None:
        files, name = self._state()
        files.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with files.open_output_stream(f"{name}.new") as f:
            f.write(json.dumps(end).encode())
        files.move(f"{name}.new", name)


class AgentLogLines(DataSource):
    """`spark.read` and `spark.readStream` of NAME."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Table(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def lines(spark: SparkSession, root: str, pattern: str = "*.jsonl", only: list[str] | None = None, **options: int) -> DataFrame:
    """All whole lines of the logs below a root, or of some files, which alone are looked at then."""
    spark.dataSource.register(AgentLogLines)
    reader = spark.read.format(NAME).options(path=root, pattern=pattern, **options)
    return (reader if only is None else reader.option("only", json.dumps(only))).load()


def tailed(spark: SparkSession, root: str, state: str, pattern: str = "*.jsonl", **options: int) -> DataFrame:
    """The lines as a stream; `state` is a folder of its own for what was committed."""
    spark.dataSource.register(AgentLogLines)
    return spark.readStream.format(NAME).options(path=root, pattern=pattern, state=state, **options).load()
