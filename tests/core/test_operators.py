"""Catalog, membership, lookup, pairing and streaming against small expected tables."""

import pytest
from pyspark.sql import functions as F

from turnloom.operators import catalog, lookup, membership, pairing
from turnloom.sources.lines import scan_homes
from turnloom.sources.tables import with_turn_columns
from turnloom.streaming import ingest

KEYS = "agent string, home string, session_id string"


def test_listing_order(spark):
    rows = spark.createDataFrame([("b", "h", "1", "2026-01-01"), ("a", "h", "2", None), ("a", "h", "1", "2026-01-01"), ("c", "h", "9", "2026-02-01")], KEYS + ", updated_at string")
    assert [(r.agent, r.session_id) for r in catalog.listing(rows).collect()] == [("c", "9"), ("a", "1"), ("b", "1"), ("a", "2")]
    assert catalog.selected(rows, 3).first().agent == "b"


def test_membership(spark):
    recorded = spark.createDataFrame([("a", "h", s, d) for s, d in [("same", "/d"), ("repo", "/x"), ("conflict", "/x"), ("conflict", "/o"), ("missing", "/gone"), ("none", None), ("plain", "/plain"), ("start", "/gone")]], KEYS + ", directory string")
    identity = spark.createDataFrame([("/d", "/d", "/r"), ("/x", "/x", "/r"), ("/o", "/o", "/q"), ("/plain", "/plain", None)], "directory string, canonical string, common_dir string")
    starts = spark.createDataFrame([("a", "h", "start", "/x"), ("a", "h", "conflict", "/d")], KEYS + ", start_directory string")
    rows = membership.membership(recorded, identity, "/d", "/r", starts).withColumn("why", membership.reject_reason()).collect()
    assert {r.session_id: r.member for r in rows} == {"same": True, "repo": True, "conflict": False, "missing": False, "none": False, "plain": False, "start": True}
    assert {r.session_id: r.why for r in rows if r.why} == {"conflict": membership.CONFLICT, "missing": membership.MISSING, "none": membership.NO_REPOSITORY, "plain": membership.UNRESOLVED}
    differs = {r.session_id: r.other_directory for r in membership.differs_from(recorded, identity, "/d").collect()}
    assert differs["same"] is False and differs["repo"] is True and differs["missing"] is False


def test_places(spark):
    rows = spark.createDataFrame([("1", "/repo", None, "dev", "c1"), ("2", "/repo/.worktrees/w", None, "dev", "c1"), ("3", "/lost", None, "x", "c2"), ("4", None, None, None, None), ("5", "/repo/.agent/worktrees/z/sub", None, "gone", "c9")], "session_id string, start_directory string, repo_path string, branch string, commit string")
    placed = membership.place(rows, spark.createDataFrame([("/repo", "main")], "directory string, branch string"), spark.createDataFrame([("/repo",)], "root string"))
    assert {r.session_id: (r.place, r.branch_moved) for r in placed.collect()} == {"1": ("present", True), "2": ("recoverable", False), "3": ("unrecoverable", False), "4": ("unrecoverable", False), "5": ("recoverable", False)}
    refs = spark.createDataFrame([("/repo", "dev"), ("/repo", "origin/dev"), ("/repo", "c1")], "root string, ref string")
    free = membership.recovery_reference(placed, refs, spark.createDataFrame([], "root string, branch string")).collect()
    assert {r.session_id: r.start_ref for r in free} == {"2": "dev", "5": "HEAD"}
    busy = membership.recovery_reference(placed, refs, spark.createDataFrame([("/repo", "dev")], "root string, branch string")).collect()
    assert {r.session_id: r.start_ref for r in busy} == {"2": "origin/dev", "5": "HEAD"}


def test_lookup(spark):
    known = spark.createDataFrame([("a", "h", "abcdef01"), ("b", "h", "abcdef02"), ("a", "h", "abcdef"), ("a", "h", "xy")], KEYS)
    asked = spark.createDataFrame([("ABCDEF",), ("abcdef0",), ("abcdef01",), ("xy",), ("x",), ("  ",), ("nope123",)], "query string")
    got = {r.query: (r.status, r.session_id, r.hint) for r in lookup.id_status(asked, known).collect()}
    assert got == {
        "ABCDEF": ("found", "abcdef", None), "abcdef0": ("ambiguous", None, "--agent"), "abcdef01": ("found", "abcdef01", None), "xy": ("found", "xy", None),
        "x": ("not-found", None, "a prefix needs at least 6 characters"), "  ": ("not-found", None, "a prefix needs at least 6 characters"), "nope123": ("not-found", None, None),
    }
    files = spark.createDataFrame([("/r/one/f.jsonl",), ("/rx/f.jsonl",), ("/r",)], "path string")
    roots = spark.createDataFrame([("/r/", "a"), ("/r/one", "b")], "root string, agent string")
    assert {r.path: r.agents for r in lookup.owner_by_path(files, roots).collect()} == {"/r/one/f.jsonl": ["a", "b"], "/rx/f.jsonl": [], "/r": ["a"]}


def test_pairing(spark):
    calls = spark.createDataFrame([("a", "h", "s", "c1"), ("a", "h", "s", "c2"), ("a", "h", "s", None)], KEYS + ", call_id string")
    results = spark.createDataFrame([("a", "h", "s", "c1", 1, "old"), ("a", "h", "s", "c1", 5, ""), ("a", "h", "t", "c2", 1, "other session")], KEYS + ", call_id string, pos long, body string")
    assert {r.call_id: (r.body, r.result_recorded) for r in pairing.paired(calls, results).collect()} == {"c1": ("", True), "c2": (None, False), None: (None, False)}


def test_one_spelling(spark):
    rows = spark.createDataFrame([("/a", 2, "x"), ("/link", 1, "y"), ("/b", 3, "z")], "path string, rank long, v string")
    aliases = spark.createDataFrame([("/link", "/a")], "path string, canonical string")
    assert sorted(r.v for r in membership.one_spelling(rows, aliases, "path", "rank").collect()) == ["y", "z"]


def test_streams(spark, tmp_path):
    turns = with_turn_columns(spark.range(200).select(F.lit("a").alias("agent"), F.lit("h").alias("home"), (F.col("id") % 7).cast("string").alias("session_id"), F.col("id").alias("idx"), F.lit("user").alias("role"), F.lit("message").alias("kind"), F.concat(F.lit("token=abc"), F.col("id")).alias("text"), F.concat(F.lit("2026-01-01T00:00:00."), F.lpad(F.col("id").cast("string"), 3, "0")).alias("ts")))
    source = str(tmp_path / "turns")
    turns.repartition(5).write.parquet(source)
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 2).parquet(source)
    got = ingest.available_now(ingest.stream_catalog(stream), str(tmp_path / "c1"), "complete")
    batch = catalog.sessions(turns)
    assert {(r.session_id, r.updated_at, r.turn_count) for r in got.collect()} == {(r.session_id, r.updated_at, r.turn_count) for r in batch.collect()}
    clean = ingest.available_now(ingest.stream_redacted(stream), str(tmp_path / "c2"))
    assert clean.where("text <> 'token=[REDACTED]'").count() == 0 and clean.count() == 200
    versions = str(tmp_path / "versions")
    write = ingest.upsert_snapshots(versions)
    rows = lambda *r: spark.createDataFrame(r, KEYS + ", updated_at string")
    write(rows(("a", "h", "1", "2026-01-01"), ("a", "h", "2", "2026-01-05")), 0)
    write(rows(("a", "h", "1", "2026-01-03"), ("a", "h", "2", "2026-01-02")), 1)
    assert {(r.session_id, r.updated_at) for r in spark.read.parquet(f"{versions}/version=1").collect()} == {("1", "2026-01-03"), ("2", "2026-01-05")}


def test_whole_registry_without_llm():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len([n for n in names if not n.startswith(("op", "pipeline"))]) >= 45


def test_changed_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("x", "a/y"):
        (tmp_path / name).write_text(name)
    before = catalog.file_digests(spark, str(tmp_path)).collect()
    frame = lambda rows: spark.createDataFrame(rows, "path string, sha256 string")
    assert catalog.changed_files(frame(before), catalog.file_digests(spark, str(tmp_path))).count() == 0
    (tmp_path / "x").write_text("other")
    assert sorted(r.side for r in catalog.changed_files(frame(before), frame(catalog.file_digests(spark, str(tmp_path)).collect())).collect()) == ["after", "before"]


def test_homes(spark, tmp_path):
    home = tmp_path / "h" / "sessions" / "2026" / "01" / "01"
    home.mkdir(parents=True)
    (home / "rollout-2026-01-01T00-00-00-abc.jsonl").write_text('{"timestamp":"2026-01-01T00:00:00Z","type":"session_meta","payload":{"id":"abc"}}\n')
    rows, missing = scan_homes(spark, [("codex", "h", str(tmp_path / "h")), ("codex", "h", str(tmp_path / "h")), ("pi", "gone", str(tmp_path / "gone"))])
    assert [(r.agent, r.session_id, r.pos) for r in rows.collect()] == [("codex", "abc", 0)]
    assert [(r.agent, r.home) for r in missing.collect()] == [("pi", "gone")]
    good, lost = rows.select("agent", "home"), spark.createDataFrame([("pi", "bad")], "agent string, home string")
    catalog.check_not_all_failed(good, lost.where("false"))
    with pytest.raises(RuntimeError, match="pi bad"):
        catalog.check_not_all_failed(good, lost)
