"""Files that grow between triggers give the lines of one batch scan, each once."""

import os
import time

from pyspark.sql import functions as F

from turnloom.plans.export import write_small_files
from turnloom.sources import growing
from turnloom.sources.lines import scan
from turnloom.streaming.ingest import stream_growing_lines


def trigger(spark, home, work, **kind):
    stream = stream_growing_lines(spark, f"{home}/projects", "claude-code", f"{work}/state", **kind)
    stream.writeStream.format("parquet").option("path", f"{work}/rows").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return [tuple(r) for r in spark.read.parquet(f"{work}/rows").select("agent", "home", "session_id", "file", "pos", "value").collect()]


def batch(spark, home):
    return sorted(tuple(r) for r in scan(spark, f"{home}/projects", "claude-code").select("agent", "home", "session_id", "file", "pos", "value").collect())


def append(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "ab") as f:
        f.write(data)


def test_growing_files(spark, tmp_path):
    home, work = tmp_path / "home", tmp_path / "work"
    a, b, c = (str(home / f"projects/p/{x}.jsonl") for x in "abc")
    append(a, b'{"n": 0}\n{"n": 1}\n{"n"')
    append(b, '{"é": "𝄞"}\n'.encode() * 3)
    append(str(home / "projects/p/notes.txt"), b"not of the layout\n")
    got = trigger(spark, home, work)
    assert sorted(x[5] for x in got if x[3] == a) == ['{"n": 0}', '{"n": 1}'] and len(got) == 5
    assert trigger(spark, home, work) == got  # nothing new
    append(a, b': 2}\r\n\n{"n": 4}\n')
    append(c, b'{"half": ')
    got = trigger(spark, home, work)
    assert sorted(got) == [x for x in batch(spark, home) if x[3] != c]
    for i in range(3):
        append(b, b'{"more": %d}\n' % i)
        append(c, b'%d}\n{"half": ' % i)
        trigger(spark, home, work)
    append(c, b"9}\n")
    assert sorted(trigger(spark, home, work)) == batch(spark, home)
    # What is kept beside the checkpoint doesn't grow with the number of triggers.
    assert len({x.split(".")[0] for x in os.listdir(work / "state")}) <= 4
    # Without the notes of line counts they are counted again.
    for x in os.listdir(work / "state"):
        if not x.endswith(".manifest"):
            os.remove(work / "state" / x)
    append(b, b"last, and no JSON\n")
    assert sorted(trigger(spark, home, work)) == batch(spark, home)


def test_unfinished_line_settles(spark, tmp_path):
    home, work = tmp_path / "home", tmp_path / "work"
    append(str(home / "projects/p/a.jsonl"), b'{"n": 0}\n{"n": 1}')
    assert len(trigger(spark, home, work, settle=3600)) == 1
    os.utime(home / "projects/p/a.jsonl", (time.time() - 7200,) * 2)
    assert sorted(trigger(spark, home, work, settle=3600)) == batch(spark, home)


def test_repeated_trigger(tmp_path):
    """The same two offsets give the same lines, from a reader that knows nothing but the state folder."""
    options = {"path": str(tmp_path / "in"), "state": str(tmp_path / "state"), "names": "*.jsonl"}
    append(str(tmp_path / "in/x.jsonl"), b"a\nb\n")
    first = growing.GrowingReader(options)
    assert first.latestOffset() == first.latestOffset()
    one = first.latestOffset()
    read = lambda reader, a, b: [tuple(r.values()) for p in reader.partitions(a, b) for x in reader.read(p) for r in x.to_pylist()]
    lines = read(first, first.initialOffset(), one)
    append(str(tmp_path / "in/x.jsonl"), b"c\nd")
    two = first.latestOffset()
    again = growing.GrowingReader(options)
    assert again.latestOffset() == two
    assert read(again, again.initialOffset(), one) == lines and [x[2:] for x in lines] == [(0, "a"), (1, "b")]
    assert [x[2:] for x in read(again, one, two)] == [(2, "c")] == [x[2:] for x in read(first, one, two)]
    with open(tmp_path / "in/x.jsonl", "wb") as f:
        f.write(b"z\n")
    three = again.latestOffset()
    assert [x[2:] for x in read(again, two, three)] == [(0, "z")]


def test_long_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "MOST_LINE", 10)
    monkeypatch.setattr(growing, "_STEP", 16)
    path = tmp_path / "x"
    path.write_bytes(("é" * 500 + "\nshort\n" + "y" * 11 + "\n" + "tail").encode())
    store, name = growing._store(str(path))
    size = path.stat().st_size
    assert list(growing.lines_of(store, name, 0, size)) == ["é" * 11, "short", "y" * 11, "tail"]
    assert growing.whole_lines(store, name, size) == size - 4 and growing.count_lines(store, name, size) == 3


def test_many_small_files_share_batches_and_spread_over_tasks(tmp_path, monkeypatch):
    options = {"path": str(tmp_path / "in"), "state": str(tmp_path / "state"), "names": "*.jsonl"}
    for i in range(60):
        append(str(tmp_path / f"in/{i:02d}.jsonl"), b"a\nb\n")
    reader = growing.GrowingReader(options)
    first, last = reader.initialOffset(), reader.latestOffset()
    rows = lambda parts: [[x.num_rows for x in reader.read(p)] for p in parts]
    assert rows(reader.partitions(first, last)) == [[120]]
    monkeypatch.setattr(growing, "_OPEN", 6 << 20, raising=False)
    assert rows(reader.partitions(first, last)) == [[20]] * 6


def test_small_files_hold_the_lines_in_order(spark, tmp_path):
    rows = [(f"s/{i % 7}" if i % 5 else None, i, f'{{"é": {i}}}' if i % 11 else None) for i in range(70)]
    frame = spark.createDataFrame(rows, "session string, pos long, value string").orderBy(F.rand(1))
    assert write_small_files(frame, str(tmp_path / "out")) == 8
    assert write_small_files(frame, str(tmp_path / "out")) == 8  # again, with the same result
    found = {x: (tmp_path / "out" / x).iterdir() for x in os.listdir(tmp_path / "out")}
    found = {x: [(f.name, f.read_text()) for f in files] for x, files in found.items()}
    names = {s: f"session={'__HIVE_DEFAULT_PARTITION__' if s is None else s.replace('/', '%2F')}" for s, _, _ in rows}
    assert found == {name: [("part-0", "".join(f"{v or ''}\n" for t, _, v in rows if t == s))] for s, name in names.items()}
