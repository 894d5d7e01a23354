"""Readers against hand-computed turns."""

import json

import pytest

from turnloom.operators import branch
from turnloom.sources import claude, codex, pi, tables
from turnloom.sources.lines import checked, identified, scan, unreadable

SHAPE = "agent string, home string, session_id string, file string, pos long, value string, file_time string"
NOW = "2026-01-01T00:00:00.000Z"


def lines(spark, layout, *files):
    rows = []
    for n, entries in enumerate(files):
        for pos, e in enumerate(entries):
            rows.append((layout, "/h", f"s{n}", f"/h/f{n}.jsonl", pos, e if isinstance(e, str) else json.dumps(e), NOW))
    return spark.createDataFrame(rows, SHAPE)


def said(df):
    out = {}
    for r in df.orderBy("session_id", "idx").collect():
        out.setdefault(r.session_id, []).append((r.idx, r.role, r.kind, r.tool_name or r.text))
    return out


def stamp(n):
    return f"2026-01-0{1 + n // 24}T{n % 24:02d}:00:00Z"


def claude_entry(uuid, parent, type_, content, n=0, **more):
    return {"type": type_, "uuid": uuid, "parentUuid": parent, "isSidechain": False, "sessionId": "x", "cwd": "/repo", "gitBranch": "main", "timestamp": stamp(n), "message": {"role": type_, "content": content}, **more}


def test_claude(spark):
    use = {"type": "tool_use", "id": "c1", "name": "Edit", "input": {"file_path": "/repo/a.py", "token": "abcdefgh", "n": 3, "deep": {"x": [1, 2]}}}
    result = {"type": "tool_result", "tool_use_id": "c1", "content": [{"type": "text", "text": "one\ntwo"}], "is_error": False}
    chain = [
        claude_entry("a", None, "user", "Fix it\nplease password=hunter2", 0),
        claude_entry("b", "a", "assistant", [{"type": "thinking", "thinking": "no"}, {"type": "text", "text": "first"}, {"type": "text", "text": "second"}, use, {"type": "text", "text": "after"}], 1),
        claude_entry("c", "b", "user", [result], 2),
        claude_entry("d", "c", "user", "<bash-input>ls</bash-input>", 3),
        claude_entry("e", "d", "assistant", [{"type": "tool_use", "id": "c2", "name": "Bash", "input": {"command": "ls"}}], 4),
        claude_entry("s", "a", "user", "side talk", 5, isSidechain=True),
        claude_entry("f", "e", "user", "[bracketed] summary", 6, isCompactSummary=True),
    ]
    branched = [claude_entry("a", None, "user", "root"), claude_entry("b", "a", "assistant", "dead end"), claude_entry("c", "a", "assistant", "live"), claude_entry("d", "c", "user", "leaf")]
    cut = [claude_entry("a", None, "user", "whole"), '{"type": "user", "uuid'] 
    missing = [claude_entry("a", None, "user", "root"), claude_entry("b", "gone", "user", "lost")]
    cycle = [claude_entry("a", "b", "user", "x"), claude_entry("b", "a", "user", "y"), claude_entry("c", "b", "user", "z")]
    twice = [claude_entry("a", None, "user", "x"), claude_entry("a", None, "user", "y")]
    turns, catalog, rejects = claude.turns(lines(spark, "claude-code", chain, branched, cut, missing, cycle, twice))
    got = said(turns)
    assert got["s0"] == [
        (0, "user", "message", "Fix it\nplease password=[REDACTED]"), (1, "agent", "message", "first\nsecond"), (2, "agent", "tool-call", "Edit"), (3, "agent", "message", "after"),
        (4, "agent", "tool-call", "Bash"), (5, "agent", "summary", "[bracketed] summary"),
    ]
    assert got["s1"] == [(0, "user", "message", "root"), (1, "agent", "message", "live"), (2, "user", "message", "leaf")]
    assert set(got) == {"s0", "s1"}
    edit = turns.where("tool_name = 'Edit'").first()
    assert edit.arguments_text == "'/repo/a.py', '[REDACTED]', 3, {\"x\":[1,2]}"
    assert edit.outcome_line.endswith("→ 2 lines (content dropped: imported session, may be stale)") and edit.effect == "mutating" and edit.result_recorded and edit.changed_paths == ["/repo/a.py"]
    bash = turns.where("tool_name = 'Bash'").first()
    assert bash.outcome_line == "Bash('ls') → no result recorded" and bash.result_recorded is False and bash.effect == "unknown"
    rows = {r.session_id: r for r in catalog.collect()}
    assert rows["s0"].title == "Fix it" and rows["s0"].turn_count == 6 and rows["s0"].repo_paths == ["/repo"] and rows["s0"].branch == "main"
    assert rows["s2"].title == claude.UNREADABLE and rows["s2"].turn_count == 0 and rows["s2"].start_directory == "/repo" and rows["s2"].branch == "main"
    reasons = {r.session_id: r.reason for r in rejects.collect()}
    assert set(reasons) == {"s2", "s3", "s4", "s5"} and "missing parent gone" in reasons["s3"] and "cycle" in reasons["s4"] and "duplicate" in reasons["s5"]


def event(type_, n, **payload):
    return {"timestamp": stamp(n), "type": type_, "payload": payload}


def item(n, **fields):
    return event("event_msg", n, type="item_completed", item=fields)


META = event("session_meta", 0, id="abc", timestamp=stamp(0), cwd="/repo", git={"commit_hash": "0123456789", "branch": "dev"})


def test_codex(spark):
    older = [
        META, event("event_msg", 1, type="user_message", message="\n  Do it \nnow"), event("event_msg", 1, type="agent_message", message="[ok]"),
        event("response_item", 2, type="function_call", name="exec_command", arguments='{"cmd":"ls","api_key":"zzz"}', call_id="k1"),
        event("response_item", 3, type="function_call_output", call_id="k1", output="a\nb\nc"),
        event("response_item", 4, type="custom_tool_call", name="apply_patch", input="*** Begin\n*** Update File: src/a.py\n+x", call_id="k2"),
        event("response_item", 5, type="reasoning"), event("strange", 6), "not json", event("compacted", 7, message="so far"),
    ]
    items = [
        META, event("response_item", 1, type="function_call", name="shell", arguments="{}", call_id="r"),
        item(2, type="UserMessage", content=[{"type": "text", "text": "hello"}]), item(3, type="AgentMessage", content=[{"type": "Text", "text": "hi"}, {"type": "Text", "text": "there"}]),
        item(4, type="CommandExecution", command=["ls", "-l"], aggregated_output="x\ny"), item(5, type="FileChange", changes={"b.py": {"type": "add", "content": "1"}, "a.py": {"type": "update"}}),
        item(6, type="Extension", kind="web.search", action={"queries": ["one", "two"]}, results=[1, 2, 3]), item(7, type="McpToolCall", server="srv", tool="do", arguments={"a": 1}, status="ok", result={"content": [{}, {}]}),
        item(8, type="CollabAgentToolCall", tool="spawn", status="done", receiver_agents=["x"], agents_states={"x": {}}), item(9, type="ImageView", path="/p.png"), item(10, type="Reasoning"), item(11, type="UserMessage", content=[{"type": "image"}]),
    ]
    mixed = [META, event("event_msg", 1, type="user_message", message="old"), event("response_item", 2, type="function_call", name="read_file", arguments="{}", call_id="q"), *items[2:4], event("response_item", 8, type="function_call", name="grep", arguments="{}", call_id="z")]
    rows = codex.entries(lines(spark, "codex", older, items, mixed))
    turns = codex.turns(rows)
    got = said(turns)
    assert got["s0"] == [(0, "user", "message", "\n  Do it \nnow"), (1, "agent", "message", "[ok]"), (2, "agent", "tool-call", "exec_command"), (3, "agent", "tool-call", "apply_patch"), (4, "agent", "summary", "so far")]
    by = {(r.session_id, r.tool_name): r for r in turns.where("tool_name is not null").collect()}
    call = by["s0", "exec_command"]
    assert call.arguments_text == '{"cmd":"ls","api_key":"[REDACTED]"}' and call.outcome_line == 'exec_command({"cmd":"ls","api_key":[REDACTED]}) → 3 lines, body dropped' and call.result_recorded and call.body_dropped
    assert by["s0", "apply_patch"].result_recorded is False and by["s0", "apply_patch"].changed_paths == ["src/a.py"] and by["s0", "apply_patch"].effect == "mutating"
    assert [t for *_, t in got["s1"]] == ["hello", "hi\nthere", "exec", "apply_patch", "web.search", "srv.do", "spawn", "view_image"]
    assert by["s1", "exec"].arguments_text == "ls -l" and by["s1", "apply_patch"].outcome_line.endswith("→ 2 file(s) changed") and by["s1", "apply_patch"].changed_paths == ["b.py", "a.py"]
    assert by["s1", "apply_patch"].arguments_text == "*** Add File: b.py\n1\n*** Update File: a.py" and by["s1", "web.search"].outcome_line == "web.search(one two) → 3 result(s) dropped"
    assert by["s1", "srv.do"].outcome_line == 'srv.do({"a":1}) → ok, 2 result(s) dropped' and by["s1", "spawn"].body_dropped and by["s1", "view_image"].effect == "read-only"
    assert [t for *_, t in got["s2"]] == ["old", "read_file", "hello", "hi\nthere"]
    rows = {r.session_id: r for r in codex.catalog(rows).collect()}
    assert (rows["s0"].title, rows["s0"].turn_count, rows["s0"].skipped, rows["s0"].truncated, rows["s0"].recorded_id, rows["s0"].branch) == ("Do it", 5, 1, True, "abc", "dev")
    for s in rows:
        assert rows[s].turn_count == len(got[s])
    assert rows["s1"].updated_at == "2026-01-01T11:00:00.000Z" and rows["s1"].repo_path == "/repo"


def pi_entry(id_, parent, n, **more):
    return {"type": "message", "id": id_, "parentId": parent, "timestamp": stamp(n), **more}


def test_pi(spark):
    head = {"type": "session", "version": 1, "id": "p1", "timestamp": stamp(0), "cwd": "/repo"}
    call = {"type": "toolCall", "id": "t1", "name": " Write ", "arguments": {"path": "/x", "secret": "s3"}}
    plain = [
        head, pi_entry("a", None, 1, message={"role": "user", "content": "Hello"}), pi_entry("b", "a", 2, message={"role": "assistant", "content": [{"type": "thinking", "text": "t"}, {"type": "text", "text": "one"}, call, {"type": "text", "text": "two"}]}),
        pi_entry("c", "b", 3, message={"role": "toolResult", "toolCallId": "t1", "content": [{"type": "text", "text": "x\ny"}]}), {"type": "model_change", "id": "m", "parentId": "c", "timestamp": stamp(4)}, {"type": "odd", "id": "o", "parentId": "m", "timestamp": stamp(5)},
        {"type": "session_info", "id": "i", "parentId": "o", "timestamp": stamp(6), "name": "My name"},
    ]
    kept = [
        head, pi_entry("a", None, 1, message={"role": "user", "content": "old"}), pi_entry("b", "a", 2, message={"role": "user", "content": "kept"}),
        {"type": "compaction", "id": "k", "parentId": "b", "timestamp": stamp(3), "summary": "sum", "firstKeptEntryId": "b"}, pi_entry("d", "k", 4, message={"role": "user", "content": "new"}),
    ]
    tail = [*kept[:3], {**kept[3], "retainedTail": [{"role": "user", "content": "tail one"}, {"role": "assistant", "content": [{"type": "text", "text": "tail two"}]}]}, kept[4]]
    headless = kept[1:]
    turns, catalog, rejects = pi.turns(lines(spark, "pi", plain, kept, tail, headless))
    got = said(turns)
    assert got["s0"] == [(0, "user", "message", "Hello"), (1, "agent", "message", "one"), (2, "agent", "tool-call", " Write "), (3, "agent", "message", "two")]
    assert [t for *_, t in got["s1"]] == ["sum", "kept", "new"] and got["s1"][0][2] == "summary"
    assert [t for *_, t in got["s2"]] == ["sum", "tail one", "tail two", "new"]
    write = turns.where("tool_name is not null").first()
    assert write.arguments_text == '{"path":"/x","secret":"[REDACTED]"}' and write.effect == "mutating" and write.changed_paths == ["/x"]
    assert write.outcome_line == 'Write ({"path":"/x","secret":[REDACTED]}) → 2 lines (content dropped: imported session, may be stale)'
    rows = {r.session_id: r for r in catalog.collect()}
    assert rows["s0"].title == "My name" and rows["s0"].updated_at == "2026-01-01T06:00:00.000Z" and rows["s1"].title == "old" and rows["s3"].title == "(unreadable) f3.jsonl"
    assert {r.session_id for r in rejects.collect()} == {"s3"}


def test_document(spark):
    doc = {"kind": "thread", "id": "d1", "topic": "T", "opened": stamp(0), "touched": stamp(1), "workspace": "/w", "vcs": {"commit": "abc", "branch": "b", "touchedPaths": ["x", "", "x"]}, "vault": "SECRET",
           "exchanges": [{"stamp": stamp(0), "speaker": "human", "shape": "said", "words": "hi"}, {"stamp": stamp(1), "speaker": "bot", "shape": "ran", "ran": {"tool": "t", "args": "a", "outcome": "ok", "impact": "writes", "body": "SECRET"}}, {"speaker": "bot", "shape": "recap", "words": "sum"}]}
    turns, sessions = tables.document_turns(spark.createDataFrame([(json.dumps(doc),)], "value string"))
    rows = turns.orderBy("idx").collect()
    assert [(r.role, r.kind, r.effect) for r in rows] == [("user", "message", None), ("agent", "tool-call", "mutating"), ("agent", "summary", None)]
    assert "SECRET" not in str(rows) and sessions.first().changed_paths == ["x"]


def test_lines(spark, tmp_path):
    home = tmp_path / "home" / "projects" / "-repo"
    home.mkdir(parents=True)
    (home / "one.jsonl").write_text("\n".join(json.dumps(claude_entry(str(i), str(i - 1) if i else None, "user", f"t{i}")) for i in range(5)) + "\n\n")
    rows = scan(spark, str(tmp_path), "claude-code")
    first = rows.orderBy("pos").first()
    assert (first.session_id, first.pos, first.home) == ("one", 0, str(tmp_path / "home")) and rows.count() == 6
    assert identified(rows).first().layout == "claude-code"
    bad = spark.createDataFrame([("a", "/h", "s", "f", i, v, NOW) for i, v in enumerate(['{"a":1} x', "[1]", "{'a':1}", '{"a":1},{"b":2}', "3", '{"a":1,"a":2}', " ", '{"a":'])], SHAPE)
    assert [r.good for r in checked(bad).orderBy("pos").collect()] == [False, False, False, False, False, True, False]


@pytest.mark.parametrize("depth", [3, 70])
def test_deep_branches(spark, depth):
    chain = [claude_entry(f"n{i}", f"n{i - 1}" if i else None, "user", f"t{i}") for i in range(depth)]
    chain.insert(depth // 2, claude_entry("dead", "n0", "user", "dead"))
    turns, _, rejects = claude.turns(lines(spark, "claude-code", chain))
    assert [t for *_, t in said(turns)["s0"]] == [f"t{i}" for i in range(depth)] and rejects.count() == 0


def test_archives_times_and_files_that_cannot_be_read(spark, tmp_path):
    import gzip
    from datetime import datetime, timedelta

    import zstandard

    folder = tmp_path / "sessions" / "2026"
    folder.mkdir(parents=True)
    name = lambda n, end: folder / f"rollout-2026-01-02T03-04-05-id{n}.jsonl{end}"
    name(1, "").write_text('{"a":1}\r\n{"b":2}\n\n{"c":3}')
    name(2, ".zst").write_bytes(zstandard.ZstdCompressor().compress(b'{"a":1}\n{"b":2}\n'))
    name(3, ".gz").write_bytes(gzip.compress(b'{"x":1}')[:9] + b"broken")
    name(4, "").write_text("")
    rows = scan(spark, str(tmp_path), "codex")
    assert sorted((r.session_id, r.pos, r.value) for r in rows.collect() if r.session_id != "") == [("id1", 0, '{"a":1}'), ("id1", 1, '{"b":2}'), ("id1", 2, ""), ("id1", 3, '{"c":3}'), ("id2", 0, '{"a":1}'), ("id2", 1, '{"b":2}')]
    lost = unreadable(spark, str(tmp_path), "codex", rows).collect()
    assert [(r.agent, r.home) for r in lost] == [("codex", str(tmp_path))] and lost[0].reason.endswith("id3.jsonl.gz")
    assert scan(spark, str(tmp_path), "codex", modified_after=datetime.now() + timedelta(days=2)).count() == 0


def test_stream_of_files_is_the_scan(spark, tmp_path):
    from turnloom.streaming import ingest

    folder = tmp_path / "home" / "projects" / "p"
    folder.mkdir(parents=True)
    for n in range(3):
        (folder / f"s{n}.jsonl").write_text("".join(f'{{"n":{i}}}\n' for i in range(n + 1)) + ("no json" if n == 1 else ""))
    batch = scan(spark, str(tmp_path), "claude-code")
    stream = ingest.available_now(ingest.stream_lines(spark, str(tmp_path), "claude-code", files_per_trigger=1), str(tmp_path / "out"))
    assert stream.drop("good").columns == batch.columns
    assert sorted(map(tuple, stream.drop("good").collect())) == sorted(map(tuple, batch.collect()))
    assert [r.value for r in stream.where("not good").collect()] == ["no json"]


def test_entries_off_the_live_path(spark):
    chain = [
        claude_entry("a", None, "user", "root"), claude_entry("b", "a", "assistant", "dead end", 1), claude_entry("s", "a", "user", "aside", 2, isSidechain=True),
        {"type": "summary", "summary": "no id"}, claude_entry("c", "a", "assistant", "live", 3), claude_entry("d", "c", "user", "leaf", 4),
    ]
    path, off = claude.paths(lines(spark, "claude-code", chain))
    assert sorted(r.pos for r in path.collect()) == [0, 4, 5]
    assert sorted((r.pos, r.type, r.reason) for r in off.collect()) == [(1, "assistant", "other branch"), (2, "user", "sidechain"), (3, "summary", "no id")]
    assert [(r.skipped, r.types) for r in branch.skipped(off).collect()] == [(3, ["assistant", "summary", "user"])]
    head = {"type": "session", "id": "s0", "timestamp": stamp(0), "cwd": "/repo"}
    entry = lambda i, up, type_="message": {"type": type_, "id": i, "parentId": up, "timestamp": stamp(1), "message": {"role": "user", "content": i}}
    path, off = pi.paths(lines(spark, "pi", [head, entry("a", None), entry("b", "a", "label"), entry("c", "a"), entry("d", "c")]))
    assert sorted(r.pos for r in path.collect()) == [1, 3, 4]
    assert [(r.pos, r.type, r.reason) for r in off.collect()] == [(2, "label", "other branch")]
    path, off = claude.paths(lines(spark, "claude-code", [claude_entry("a", "gone", "user", "lost")]))
    assert path.count() == 0 and [(r.pos, r.reason) for r in off.collect()] == [(0, "other branch")]
