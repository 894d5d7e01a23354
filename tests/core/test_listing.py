"""Files that are listed and read by tasks give what Spark's own scan gives."""

import io
import json
import os
from collections import Counter
from urllib.parse import unquote

import duckdb
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__
from turnloom.sources import integrity, listing
from turnloom.sources.lines import scan

NAMES = "rollout-*.jsonl*"


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    root = tmp_path_factory.mktemp("home")
    entry = b'{"n": %d}\n'
    pack = zstandard.ZstdCompressor()
    files = {
        "a/plain": entry * 2 % (1, 2), "a/b/c/no end": entry[:-1] % 3, "a/b/cut": b'{"n": 1}\n{"n"', "a/returns": b"{}\r\n{}\r{}\n\r\n\n{}\r", "bytes": b'{"\xff\xfe": 1}\n"\xe9"\n', "per%20cent é+": entry % 4,
        "mark": b"\xef\xbb\xbf{}\n\xef\xbb\xbf{}\n", "only mark": b"\xef\xbb\xbf", "blank": b"\n\n", "empty": b"", "a/.hidden": entry % 5, "_under/x": entry % 6, "_key=1/x": entry % 7, ".dot/x": entry % 8,
        "large": b"".join(entry % i for i in range(120_000)), "long": b'"' + b"x" * (3 << 20) + b'"\n{}',
    }
    files = {f"{os.path.dirname(k)}/rollout-2026-01-01T00-00-00-{os.path.basename(k)}.jsonl": v for k, v in files.items() if "hidden" not in k} | {"a/.rollout-hidden.jsonl": files["a/.hidden"], "a/notes.txt": b"{}\n"}
    packed = {"good": pack.compress(b"{}\n{}\n"), "frames": pack.compress(b"{}\n") + pack.compress(b"{}\n"), "half": pack.compress(b"".join(entry % i for i in range(120_000)))[:-3000], "nothing": b"no archive at all"}
    files |= {f"z/rollout-2026-01-01T00-00-00-{k}.jsonl.zst": v for k, v in packed.items()}
    for name, data in files.items():
        os.makedirs(root / "sessions" / os.path.dirname(name.lstrip("/")), exist_ok=True)
        (root / "sessions" / name.lstrip("/")).write_bytes(data)
    return str(root)


def test_lines_of_the_scan(spark, home):
    found = listing.listed(spark, f"{home}/", NAMES)
    kept = lambda lines, name=str: Counter((name(r.file), name(r.session_id), *r[2:]) for r in lines.selectExpr("file", "session_id", "agent", "home", "file_time", "pos", "cast(value as binary)").where("not endswith(file, 'half.jsonl.zst')").collect())
    got = kept(listing.scan_listed(found, f"{home}/", "codex"))
    assert got == kept(scan(spark, home, "codex"), unquote) and sum(got.values()) > 120_000
    states = lambda lines, name=str, **more: sorted((name(r.file), name(r.session_id), r.agent, r.home, r.length, r.n_lines if "half" not in r.file else r.n_lines > 0, r.state) for r in integrity.partial_files(spark, home, "codex", lines, **more).collect())
    got = states(listing.scan_listed(found, home, "codex"), listing=found)
    assert got == states(scan(spark, home, "codex"), unquote)  # Spark writes odd characters as %XX
    assert {"whole", "cut line", "cut archive", "unreadable"} <= {x[-1] for x in got}


def test_uri_and_missing_folder(spark, home):
    found = listing.listed(spark, f"file://{home}", NAMES)
    lines = listing.scan_listed(found, f"file://{home}", "codex").where("session_id = 'plain'")
    assert [r.file for r in lines.collect()] == [f"{home}/sessions/a/rollout-2026-01-01T00-00-00-plain.jsonl"] * 2
    assert listing.listed(spark, home, "none-*").count() == 0
    with pytest.raises(Exception, match="/gone"):
        listing.listed(spark, f"{home}/gone", NAMES)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"\r", b"\n", b"a", b"\xef\xbb\xbf", b"bc"]), max_size=30), st.integers(3, 9))
def test_steps_cut_no_line(parts, step):
    data, kept = b"".join(parts), listing._STEP
    listing._STEP = step
    try:
        assert list(listing.file_lines(pa.PythonFile(io.BytesIO(data), mode="r"))) == data.removeprefix(b"\xef\xbb\xbf").splitlines()
    finally:
        listing._STEP = kept


def test_driver_plans_no_file_of_its_own_for_each_session(spark, tmp_path):
    rows = [(i, turn, "user", f"text {turn}\r\n\"é\"" if turn else None) for i in range(400) for turn in range(i % 3 + 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    sql = duckdb.connect()
    sql.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    found = __spark_entry__.queries()["partial_reads"](spark, str(tmp_path))
    assert Counter(map(tuple, found.collect())) == Counter(sql.execute(__spark_entry__.oracle_sql()["partial_reads"]).fetchall())
    assert len(found.inputFiles()) < 100  # the tables that name the sessions' files
