"""op4: exact round trips, and a parser that survives damage."""

import hashlib
import struct
import zlib

import pytest

from turnloom.llm import mpeg_audio as M


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 1020, 1021, 1022, 5000, 200_000])
def test_round_trip(n):
    raw = bytes((i * 7 + i // 255) % 256 for i in range(n))
    data = M.pack(raw)
    stream = M.parse(data)
    payload = M.unpack(data, stream)
    assert payload[:n] == raw and set(payload[n:]) <= {255} and len(payload) % 576 == 0 and payload
    assert stream.damaged == stream.resyncs == stream.skipped == 0 and stream.checked == len(stream.offsets) == stream.table["frames"]
    assert stream.offsets[-1] + stream.headers[-1].length == len(data)
    assert stream.seconds == len(stream.offsets) * 1152 / 44100


def test_payload_that_looks_like_tags_and_headers():
    for raw in (b"TAG" * 400, b"ID3\4" * 500, b"\xff\xfb\x90\xc4" * 900):
        data = M.pack(raw)
        assert M.unpack(data, M.parse(data)).rstrip(b"\xff") == raw.rstrip(b"\xff")


def test_known_headers():
    h = M.header(bytes((0xFF, 0xFB, 0x90, 0x00)))
    assert (h.kbps, h.rate, h.length, h.samples, h.side, h.mono) == (128, 44100, 417, 1152, 32, False)
    h = M.header(bytes((0xFF, 0xF3, 0x82, 0xC0)))
    assert (h.kbps, h.rate, h.length, h.samples, h.side) == (64, 22050, 209, 576, 9)
    h = M.header(bytes((0xFF, 0xFF, 0x40, 0x00)))
    assert (h.layer, h.kbps, h.length, h.samples) == (1, 128, 136, 384)
    assert M.header(b"\xff\xfb\xf0\x00") is None and M.header(b"\xff\xea\x90\x00") is None and M.header(b"\xff") is None
    assert M.crc16(b"123456789") == 0xAEE7


def test_damage():
    data = M.pack(bytes(range(256)) * 40)
    whole = M.parse(data)
    second = whole.offsets[1]
    broken = data[:second] + b"\0" + data[second + 1 :]
    stream = M.parse(broken)
    assert stream.resyncs == 1 and stream.skipped == whole.headers[1].length and len(stream.offsets) == len(whole.offsets) - 1
    side = data[: second + 10] + b"\1" + data[second + 11 :]
    assert M.parse(side).damaged == 1
    assert [o - 5 for o in M.parse(b"junk!" + data).offsets] == whole.offsets
    tagged = M.parse(data + b"TAG" + b"A title".ljust(30, b"\0") + bytes(95))
    assert tagged.tags["title"] == "A title" and tagged.offsets == whole.offsets
    assert M.parse(b"").offsets == M.parse(b"\xff" * 50).offsets == []


def test_query(spark):
    docs = [(1, None), (2, ""), (3, "é" * 1000), (4, "x" * 576), (5, "é" * 1000), (None, "a"), (6, "long " * 60_000)]
    frame = spark.createDataFrame([(d, t, b"m") for d, t in docs], "doc_id long, text string, media binary")
    rows = {r.doc_id: r for r in M.stored_features(frame).collect()}
    for doc, text in docs:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = rows[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(M.pack(raw)), hashlib.sha256(M.pack(raw)).hexdigest())
    assert rows[3][1:] == rows[5][1:] and rows[1][1:] == rows[2][1:]
    assert M.stored_features(frame.limit(0)).count() == 0


def crc_of_bits(bits):
    crc = 0xFFFF
    for bit in bits:
        crc = ((crc << 1) ^ (0x8005 if (crc >> 15) ^ int(bit) else 0)) & 0xFFFF
    return crc


def protected(head, allocation, body_bits):
    """A frame of a foreign stream: header, checksum over the bits given, and these bits, filled up to its length."""
    size = M.header(head).length
    text = "".join(f"{b:08b}" for b in head[2:4]) + allocation
    body = int((body_bits + "0" * 8 * size)[: 8 * (size - 6)], 2).to_bytes(size - 6, "big")
    return head + crc_of_bits(text).to_bytes(2, "big") + body


def test_checksums_of_layers_one_and_two():
    one = bytes((0xFF, 0xFE, 0x80, 0x00))  # layer I, 256 kbit/s, 44.1 kHz, stereo
    allocation = "".join(f"{(3 * i) % 15:04b}" for i in range(64))
    joint = bytes((0xFF, 0xFE, 0x80, 0x50))  # joint stereo, bound 8
    shared = "".join(f"{(5 * i) % 15:04b}" for i in range(2 * 8 + 24))
    mono = bytes((0xFF, 0xFE, 0x80, 0xC0))
    alone = "".join(f"{(7 * i) % 15:04b}" for i in range(32))
    for head, bits in ((one, allocation), (joint, shared), (mono, alone)):
        frame = protected(head, bits, bits + "10" * 100)
        stream = M.parse(frame * 3)
        assert (stream.checked, stream.damaged, len(stream.offsets), stream.samples) == (3, 0, 3, 3 * 384)
        assert M.parse(frame * 2 + frame[:7] + bytes([frame[7] ^ 4]) + frame[8:]).damaged == 1
    two = bytes((0xFF, 0xFC, 0xA0, 0x00))  # layer II, 192 kbit/s, 44.1 kHz, stereo: the table of 30 subbands
    sizes = [4] * 11 + [3] * 12 + [2] * 7
    values = [(i * 5 + c) % 3 for i in range(30) for c in range(2)]
    allocation = "".join(f"{v:0{sizes[n // 2]}b}" for n, v in enumerate(values))
    chosen = "".join("10" for v in values if v)
    frame = protected(two, allocation + chosen, allocation + chosen + "1" * 50)
    stream = M.parse(frame * 4)
    assert (stream.checked, stream.damaged, len(stream.offsets)) == (4, 0, 4)
    broken = bytearray(frame * 4)
    broken[2 * len(frame) + 8] ^= 16
    assert M.parse(bytes(broken)).damaged == 1
    low = bytes((0xFF, 0xF4, 0x80, 0xC0))  # MPEG-2 layer II, mono
    allocation = "".join(f"{i % 4:0{n}b}" for i, n in enumerate([4] * 4 + [3] * 7 + [2] * 19))
    chosen = "01" * sum(bool(i % 4) for i in range(30))
    assert M.parse(protected(low, allocation + chosen, allocation + chosen) * 3).damaged == 0


def test_free_bit_rate():
    head = bytes((0xFF, 0xFB, 0x00, 0xC4))
    padded = bytes((0xFF, 0xFB, 0x02, 0xC4))
    frames = [head + bytes(396), padded + bytes(397), head + bytes(396), head + bytes(396)]
    stream = M.parse(b"".join(frames) + b"TAG" + bytes(125))
    assert stream.offsets == [0, 400, 801, 1201] and stream.samples == 4 * 1152 and stream.resyncs == 0


def test_tables_and_tags_of_others():
    frame = bytes((0xFF, 0xFB, 0x90, 0x00)) + bytes(413)
    vbri = frame[:36] + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 417 * 5, 4, 2, 2, 2, 2) + struct.pack(">HH", 417, 417) + frame[66:]
    assert len(vbri) == 417
    stream = M.parse(vbri + frame * 4)
    assert (stream.table["frames"], stream.table["seek"], stream.table["frames_an_entry"], stream.table_agrees) == (4, [834, 834], 2, True)
    assert M.parse(vbri + frame * 3).table_agrees is False and M.parse(frame * 3).table_agrees is None
    assert "(not so)" in M.feature(M.parse(vbri + frame * 3))
    old = b"TT2" + (6).to_bytes(3, "big") + b"\0Title" + b"TXX" + (8).to_bytes(3, "big") + b"\0key\0val"
    tagged = b"ID3\2\0\0" + bytes((0, 0, 0, len(old))) + old + frame * 3
    assert M.parse(tagged).tags == {"TT2": "Title", "key": "val"} and M.parse(tagged).offsets[0] == 10 + len(old)
    body = b"TIT2" + (4).to_bytes(4, "big") + b"\0\0" + b"\0a\xffb"
    sent = body.replace(b"\xff", b"\xff\0")
    unsynchronised = b"ID3\3\0\x80" + bytes((0, 0, 0, len(sent))) + sent + frame * 3
    assert M.parse(unsynchronised).tags == {"TIT2": "a\u00ffb"} and len(M.parse(unsynchronised).offsets) == 3


def test_any_media_column(spark):
    frame = bytes((0xFF, 0xFB, 0x90, 0x00)) + bytes(413)
    media = [(1, None), (2, b""), (3, b"no audio at all"), (4, frame * 10), (5, M.pack(b"own")), (None, b"\xff" * 5000), (7, b"ID3\4\0\0\x7f\x7f\x7f\x7f")]
    rows = {r.doc_id: r for r in M.media_features(spark.createDataFrame(media, "doc_id long, media binary")).collect()}
    assert rows[1].feature is None and rows[1].media_bytes is None
    assert [rows[d].feature for d in (2, 3, None, 7)] == ["no frames"] * 4
    assert (rows[4].n_bytes, rows[4].payload_sha256, rows[4].media_bytes, rows[4].seconds) == (None, None, 4170, 10 * 1152 / 44100)
    assert rows[5].n_bytes == 3 and rows[4].seek_offsets == [417 * i for i in range(10)]
