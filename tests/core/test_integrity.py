"""Files that are cut or unreadable give a reject or are marked as truncated."""

import json

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from turnloom.sources import codex, integrity
from turnloom.sources.lines import scan


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=3), st.booleans(), st.booleans(), st.data())
def test_frames(parts, checksum, sized, data):
    pack = zstandard.ZstdCompressor(write_checksum=checksum, write_content_size=sized, level=3)
    whole = b"".join(pack.compress(x * 200) for x in parts)
    assert integrity.archive_is_whole(whole)
    ends = {len(b"".join(pack.compress(x * 200) for x in parts[:k])) for k in range(1, len(parts))}
    cut = data.draw(st.integers(0, len(whole) - 1))
    assert integrity.archive_is_whole(whole[:cut]) == (cut in ends)
    assert not integrity.archive_is_whole(whole + b"more")
    skipped = (0x184D2A53).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"12345"
    assert integrity.archive_is_whole(skipped + whole) and integrity.archive_is_whole(whole + skipped)


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    folder = tmp_path_factory.mktemp("home") / "sessions" / "2026" / "01" / "01"
    folder.mkdir(parents=True)
    entry = lambda n: json.dumps({"timestamp": "2026-01-01T00:00:00Z", "type": "event_msg", "payload": {"type": "user_message", "message": f"text {n}"}})

    def text(name, n=60_000):
        return (json.dumps({"timestamp": "2026-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": name}}) + "\n" + "".join(entry(i) + "\n" for i in range(n))).encode()

    pack = zstandard.ZstdCompressor()
    files = {
        "whole.jsonl": text("whole", 3), "nofinalend.jsonl": text("nofinalend", 3)[:-1], "cutline.jsonl": text("cutline", 3)[:-9], "crlf.jsonl": text("crlf", 3).replace(b"\n", b"\r\n"), "empty.jsonl": b"", "blank.jsonl": b"\n\n",
        "good.jsonl.zst": pack.compress(text("good")), "frames.jsonl.zst": pack.compress(text("frames")) + pack.compress(b'{"timestamp":"","type":"compacted","payload":{}}\n'),
        "half.jsonl.zst": pack.compress(text("half"))[:-3000], "nothing.jsonl.zst": b"no archive at all",
    }
    for name, data in files.items():
        (folder / f"rollout-2026-01-01T00-00-00-{name}").write_bytes(data)
    return str(folder.parents[3])


def test_states(spark, home):
    lines = scan(spark, home, "codex")
    files = integrity.partial_files(spark, home, "codex", lines).cache()
    got = {r.session_id: r.state for r in files.collect()}
    assert got == {
        "whole": "whole", "nofinalend": "whole", "cutline": "cut line", "crlf": "whole", "blank": "whole", "good": "whole", "frames": "whole", "half": "cut archive", "nothing": "unreadable",
    }
    assert {(r.session_id, r.reason.split(":")[0]) for r in integrity.rejects(files).collect()} == {("half", "file did not come whole (cut archive)"), ("nothing", "file did not come whole (unreadable)")}
    half = files.where("session_id = 'half'").first()
    assert 0 < half.n_lines < 60_001
    listed = integrity.with_truncation(codex.catalog(codex.entries(lines)), files)
    assert {r.session_id: r.truncated for r in listed.collect()} == {"whole": False, "nofinalend": False, "cutline": True, "crlf": False, "good": False, "frames": False, "half": True}


def test_fewer_bytes_than_stored(spark, home):
    """As after a failure in the middle of a plain file."""
    lines = scan(spark, home, "codex").where("session_id <> 'whole' or pos < 2")
    got = {r.session_id: r.state for r in integrity.partial_files(spark, home, "codex", lines).collect()}
    assert got["whole"] == "cut short" and got["crlf"] == "whole"
