"""A streaming source of lines from files that grow: each trigger reads only what was appended since the last one.

An offset names a manifest, a table below the `state` folder with the bytes of each file that are whole lines so far; the
checkpoint holds that name alone, however many files there are. An unfinished last line is held back until its line end
comes, or, with `settle`, until the file has not been touched for so many seconds: then it counts as finished.

Files are read where tasks run, from the byte where the last trigger ended. How many lines stand before that byte is noted
by the tasks beside the manifests; a note that is lost is made good by counting the file's line ends again. A trigger
that is repeated after a failure reads the same bytes and gives the same lines.

Options: path (a folder, or a URI of a store that pyarrow.fs reads), names (a pattern of file names), state (a folder that
driver and executors share, one for each stream), settle (seconds; none by default), partition_bytes.

Defined results: lines end at a line feed, one carriage return before it is cut off; bytes that are no UTF-8 are replaced; a
line of more than MOST_LINE characters is cut to one more than that, so that readers refuse it; a file that has become
shorter is read again from its start; a file that is gone gives nothing more; archives (.zst) are finished files and are left
to the batch scan.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from turnloom.sources.lines import MOST_LINE

SCHEMA = "file string, modified long, pos long, value string"
_STEP = 1 << 20
#: Opening a file counts as so many bytes where files are dealt into tasks.
_OPEN = 64 << 10
_ROWS = pa.schema([("file", pa.string()), ("modified", pa.int64()), ("pos", pa.int64()), ("value", pa.string())])
_FILES = pa.schema([("file", pa.string()), ("end", pa.int64()), ("size", pa.int64()), ("modified", pa.int64())])


@dataclass
class Part(InputPartition):
    """Files to read in one task, as (file, modified, first byte, end, lines before or None), and where their counts go."""

    files: list[tuple[str, int, int, int, int | None]]
    notes: str


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def whole_lines(store: pafs.FileSystem, file: str, size: int) -> int:
    """The bytes of a file up to and with its last line end; looked for from the end, so little is read."""
    with store.open_input_file(file) as f:
        stop = size
        while stop > 0:
            start = max(0, stop - _STEP // 16)
            at = f.read_at(stop - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            stop = start
    return 0


def lines_of(store: pafs.FileSystem, file: str, start: int, end: int) -> Iterator[str]:
    """The lines between two bytes; no more than a line and a step are held at once."""
    most, pending = 4 * (MOST_LINE + 1), b""

    def text(line: bytes) -> str:
        return line.removesuffix(b"\r")[:most].decode("utf-8", "replace")[: MOST_LINE + 1]

    with store.open_input_file(file) as f:
        for at in range(start, end, _STEP):
            *done, rest = f.read_at(min(_STEP, end - at), at).split(b"\n")
            for line in done:
                yield text(pending + line)
                pending = b""
            pending = (pending + rest)[:most]
    if pending:
        yield text(pending)


def count_lines(store: pafs.FileSystem, file: str, end: int) -> int:
    with store.open_input_file(file) as f:
        return sum(f.read_at(min(_STEP, end - at), at).count(b"\n") for at in range(0, end, _STEP))


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.state = options["path"], options["state"].rstrip("/")
        self.names, self.partition_bytes = options.get("names", "*"), int(options.get("partition_bytes", 64 << 20))
        self.settle = float(options["settle"]) if "settle" in options else None
        self.newest: tuple[str, dict] | None = None

    # The state folder: NUMBER-ID.manifest (files and ends), .lines (lines before each end), .PART.notes (counts of a trigger's tasks).

    def _state(self) -> tuple[pafs.FileSystem, str, list[str]]:
        store, root = _store(self.state)
        store.create_dir(root, recursive=True)
        return store, root, sorted(x.base_name for x in store.get_file_info(pafs.FileSelector(root)) if x.is_file)

    def _table(self, name: str) -> list[dict]:
        store, root = _store(self.state)
        if not name or store.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
            return []
        return pq.read_table(f"{root}/{name}", filesystem=store).to_pylist()

    def _manifest(self, name: str) -> dict[str, dict]:
        return {x["file"]: x for x in self._table(f"{name}.manifest" if name else "")}

    def initialOffset(self) -> dict:
        return {"manifest": ""}

    def latestOffset(self) -> dict:
        state, root, there = self._state()
        manifests = [x.removesuffix(".manifest") for x in there if x.endswith(".manifest")]
        if self.newest is None and manifests:
            self.newest = manifests[-1], self._manifest(manifests[-1])
        known = self.newest[1] if self.newest else {}
        store, folder = _store(self.path)
        found, now = {}, time.time()
        for x in store.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True)):
            if not x.is_file or not fnmatch(x.base_name, self.names) or x.base_name.endswith(".zst"):
                continue
            modified = (x.mtime_ns or 0) // 1000
            settled = self.settle is not None and now - modified / 1e6 >= self.settle
            old = known.get(x.path)
            if old and (old["size"], old["modified"]) == (x.size, modified) and (not settled or old["end"] == x.size):
                found[x.path] = old
                continue
            found[x.path] = {"file": x.path, "end": x.size if settled else whole_lines(store, x.path, x.size), "size": x.size, "modified": modified}
        ends = lambda files: {f: x["end"] for f, x in files.items() if x["end"]}
        if self.newest and ends(found) == ends(known):
            return {"manifest": self.newest[0]}
        if not ends(found):
            return self.initialOffset()
        name = f"{1 + max([0, *(int(x.split('-')[0]) for x in manifests)]):09d}-{uuid.uuid4().hex}"
        with state.open_output_stream(f"{root}/{name}.tmp") as out:
            pq.write_table(pa.Table.from_pylist(list(found.values()), schema=_FILES), out)
        state.move(f"{root}/{name}.tmp", f"{root}/{name}.manifest")
        self.newest = name, found
        return {"manifest": name}

    def _lines_before(self, start: str) -> dict[str, int]:
        """How many lines stand before each file's end in a manifest, as far as that was noted."""
        store, root, there = self._state()
        if not start:
            return {}
        if f"{start}.lines" in there:
            return {x["file"]: x["lines"] for x in self._table(f"{start}.lines")}
        earlier = [x for x in there if x.endswith(".lines") and x < start]
        known = {x["file"]: x["lines"] for x in self._table(earlier[-1])} if earlier else {}
        # An older count holds only for a file that has not grown since it was made.
        before = self._manifest(earlier[-1].removesuffix(".lines")) if earlier else {}
        ends = self._manifest(start) if known else {}
        known = {f: n for f, n in known.items() if before.get(f, {}).get("end") == ends.get(f, {}).get("end")}
        for x in there:
            if x.startswith(start) and x.endswith(".notes"):
                with store.open_input_stream(f"{root}/{x}") as f:
                    known |= json.loads(f.read())
        table = pa.Table.from_pylist([{"file": f, "lines": n} for f, n in known.items()], schema=pa.schema([("file", pa.string()), ("lines", pa.int64())]))
        with store.open_output_stream(f"{root}/{start}.lines") as out:
            pq.write_table(table, out)
        return known

    def partitions(self, start: dict, end: dict) -> list[Part]:
        if start == end:
            return []
        old, new = self._manifest(start["manifest"]), self._manifest(end["manifest"])
        if end["manifest"] and not new:
            raise RuntimeError(f"the manifest {end['manifest']} is gone from {self.state}: the state folder belongs to the checkpoint")
        lines = self._lines_before(start["manifest"])
        parts, held = [], 0
        for file, x in sorted(new.items()):
            done = old.get(file, {"end": 0})["end"]
            first = 0 if x["end"] < done else done
            if x["end"] == first:
                continue
            cost = x["end"] - first + _OPEN
            if not parts or held + cost > self.partition_bytes:
                parts.append(Part([], f"{end['manifest']}.{len(parts)}.notes"))
                held = 0
            parts[-1].files.append((file, x["modified"], first, x["end"], lines.get(file) if first else 0))
            held += cost
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        counts: dict[str, int] = {}
        rows, held = [], 0
        for file, modified, first, end, before in partition.files:
            pos = count_lines(store, file, first) if before is None else before
            for line in lines_of(store, file, first, end):
                rows.append({"file": file, "modified": modified, "pos": pos, "value": line})
                pos, held = pos + 1, held + len(line)
                if held > _STEP:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)
                    rows, held = [], 0
            counts[file] = pos
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)
        state, root = _store(self.state)
        with state.open_output_stream(f"{root}/{partition.notes}") as out:
            out.write(json.dumps(counts).encode())

    def commit(self, end: dict) -> None:
        """Drops what only triggers before this one needed."""
        store, root, there = self._state()
        if end["manifest"]:
            for x in there:
                if int(x.split("-")[0]) < int(end["manifest"].split("-")[0]) - 1:
                    store.delete_file(f"{root}/{x}")


class GrowingLines(DataSource):
    """The source by its name; stream_growing_lines() of the streaming module registers it."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> GrowingReader:
        return GrowingReader(self.options)
