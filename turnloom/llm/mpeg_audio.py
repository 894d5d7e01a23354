"""Media columns: MPEG audio.

parse() reads any MPEG-1/2/2.5 layer I-III stream: ID3v2.2-2.4 and ID3v1 tags, Xing/Info and VBRI tables with their
seek tables, which are compared with the frames found, frame headers (free bit rates too) with resynchronisation after
damage, CRC-16 checks of all three layers, exact durations (samples over rate) and frame seek offsets.

pack() stores bytes in such a stream without loss: layer III mono frames whose side information says that they hold no
main data, so a player hears silence and the bytes are ancillary data. Frames are CRC-protected; all but the last have
the highest bit rate, and the last the lowest that fits, so the stream has a variable bit rate and a Xing table.

Defined results: null text is empty; the payload is the text's UTF-8 bytes and bytes 255 up to a positive multiple of
576; equal texts give equal streams; a media column may hold any bytes: a null stream has null features, one without
frames the feature "no frames", and one that pack() did not write null payload columns; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from turnloom.llm.tokens_np import strings
from turnloom.session import written

UNIT = 576
# Fixed values of the format: kbit/s by (MPEG-1?, layer), sample rates by version bits, samples a frame.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    crc: bool
    kbps: int
    rate: int
    mode: int
    bound: int
    length: int
    samples: int
    side: int

    @property
    def mono(self) -> bool:
        return self.mode == 3

    @property
    def body(self) -> int:
        """Where a frame's data begins: after header, checksum and side information."""
        return 4 + 2 * self.crc + self.side


@lru_cache(maxsize=4096)
def header(head: bytes) -> Header | None:
    """What four bytes say as a frame header; None if they are none. With a free bit rate the length is the padding."""
    if len(head) < 4 or head[0] != 255 or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3)
    rate_index, bits = head[2] >> 2 & 3, head[2] >> 4
    if version == 1 or layer == 4 or rate_index == 3 or bits == 15:
        return None
    first = version == 3
    kbps, rate, pad = BITRATES[first, layer][bits], RATES[version][rate_index], head[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    length = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + pad
    if not kbps:
        length = 4 * pad if layer == 1 else pad
    mode = head[3] >> 6
    bound = 4 * (1 + (head[3] >> 4 & 3)) if mode == 1 else 32
    mono = mode == 3
    side = 0 if layer != 3 else (17 if mono else 32) if first else (9 if mono else 17)
    return Header(version, layer, not head[1] & 1, kbps, rate, mode, bound, length, samples, side)


@lru_cache(maxsize=4096)
def crc16(covered: bytes) -> int:
    """The frame checksum: polynomial 8005, starting from FFFF."""
    crc = 0xFFFF
    for byte in covered:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


#: Bits of each subband's allocation in layer II: by table, for the subbands that it has.
_ALLOCATION = {
    "A": (4,) * 11 + (3,) * 12 + (2,) * 4, "B": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "C": (4,) * 2 + (3,) * 6, "D": (4,) * 2 + (3,) * 10, "low": (4,) * 4 + (3,) * 7 + (2,) * 19,
}


def _allocation(head: Header) -> tuple[int, ...]:
    each = head.kbps // (1 if head.mono else 2)
    if head.version != 3:
        return _ALLOCATION["low"]
    if (head.rate == 48000 and each >= 56) or 56 <= each <= 80:
        return _ALLOCATION["A"]
    if head.rate != 48000 and (each >= 96 or not each):
        return _ALLOCATION["B"]
    return _ALLOCATION["C" if head.rate != 32000 and each <= 48 else "D"]


def covered_bits(head: Header, body: bytes) -> int:
    """How many bits behind the checksum it covers: side information, or allocations (and in layer II selections)."""
    channels = 1 if head.mono else 2
    if head.layer == 3:
        return 8 * head.side
    if head.layer == 1:
        return 4 * 32 if head.mono else 4 * (2 * head.bound + 32 - head.bound)
    word, size, at, chosen = int.from_bytes(body, "big"), 8 * len(body), 0, 0
    for band, bits in enumerate(_allocation(head)):
        for _ in range(channels if band < head.bound else 1):
            at += bits
            some = size >= at and word >> (size - at) & ((1 << bits) - 1)
            chosen += bool(some) * (1 if band < head.bound else channels)
    return at + 2 * chosen


def checksum(head: Header, frame: bytes) -> int:
    """The checksum that a protected frame should have."""
    if head.layer == 3:
        return crc16(frame[2:4] + frame[6 : head.body])
    bits = covered_bits(head, frame[6 : 6 + 96])
    whole, rest = divmod(bits, 8)
    crc = crc16(frame[2:4] + frame[6 : 6 + whole])
    for i in range(rest):
        crc ^= (frame[6 + whole] >> (7 - i) & 1) << 15
        crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _syncsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _id3v2(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Text frames of the tag at a place, and where it ends."""
    end = at + 10 + _syncsafe(data[at + 6 : at + 10]) + 10 * bool(data[at + 5] & 16)
    major, flags, tags, i = data[at + 3], data[at + 5], {}, 0
    body = data[at + 10 : end]
    if flags & 128:  # unsynchronised: a zero stands behind each 255
        body = body.replace(b"\xff\0", b"\xff")
    if flags & 64 and major >= 3:
        i = _syncsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    name_size, head_size = (3, 6) if major == 2 else (4, 10)
    while i + head_size <= len(body) and body[i : i + name_size].strip(b"\0"):
        raw_size = body[i + name_size : i + 2 * name_size]
        size = _syncsafe(raw_size) if major == 4 else int.from_bytes(raw_size, "big")
        name, raw = body[i : i + name_size].decode("latin-1"), body[i + head_size : i + head_size + size]
        if name.startswith("T") and raw:
            text = raw[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(raw[0], "utf-8"), "replace")
            key, _, value = text.partition("\0") if name in ("TXXX", "TXX") else (name, "", text)
            tags[key] = value.strip("\0")
        i += head_size + size
    return tags, end


@dataclass
class Stream:
    """What a stream holds; offsets are those of its frames, without the frame of the table."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, int | str | bytes | list[int]] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    checked: int = 0
    damaged: int = 0
    resyncs: int = 0
    skipped: int = 0
    #: Bytes from the frame of the table to the end of the last frame.
    audio_bytes: int = 0

    @property
    def table_agrees(self) -> bool | None:
        """Whether the table's numbers of frames and bytes are those found; None without such numbers."""
        told = [(self.table[k], n) for k, n in (("frames", len(self.offsets)), ("bytes", self.audio_bytes)) if k in self.table]
        return all(a == b for a, b in told) if told else None

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def seconds(self) -> float:
        return sum(h.samples / h.rate for h in self.headers) if len({h.rate for h in self.headers}) > 1 else self.samples / self.headers[0].rate if self.headers else 0.0


def _table(data: bytes, at: int, head: Header) -> dict[str, int | str | bytes | list[int]]:
    """A Xing, Info or VBRI table in the frame at a place; empty if there is none."""
    x = at + 4 + head.side
    if data[x : x + 4] in (b"Xing", b"Info"):
        flags, i = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8
        out: dict[str, int | str | bytes] = {"kind": data[x : x + 4].decode()}
        for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                raw = data[i : i + size]
                out[name] = raw if name == "toc" else int.from_bytes(raw, "big")
                i += size
        return out
    if data[at + 36 : at + 40] == b"VBRI":
        number = lambda i, size: int.from_bytes(data[at + 36 + i : at + 36 + i + size], "big")
        entries, scale, size = number(18, 2), number(20, 2), number(22, 2)
        seek = [number(26 + size * i, size) * scale for i in range(entries)] if size in (1, 2, 3, 4) else []
        return {"kind": "VBRI", "bytes": number(10, 4), "frames": number(14, 4), "frames_an_entry": number(24, 2), "seek": seek}
    return {}


def _like(a: Header, b: Header | None) -> bool:
    return b is not None and (a.version, a.layer, a.rate, not a.kbps) == (b.version, b.layer, b.rate, not b.kbps)


#: A frame with a free bit rate is at most so long.
_LONGEST = 8192


def _free_length(data: bytes, at: int, head: Header) -> int:
    """The length, without padding, of frames with a free bit rate: as far as the next like header is. 0 if none is."""
    ahead = data.find(b"\xff", at + 4, at + _LONGEST)
    while ahead >= 0:
        if _like(head, header(data[ahead : ahead + 4])) and data[ahead + 1] == data[at + 1]:
            return ahead - at - head.length
        ahead = data.find(b"\xff", ahead + 1, at + _LONGEST)
    return 0


def parse(data: bytes) -> Stream:
    """Reads a stream from end to end. Where no frame begins it looks for the next header that another like it follows."""
    out, at, end, lost, known, free, first = Stream(), 0, len(data), False, None, 0, None
    while at < end:
        if at == end - 128 and data[at : at + 3] == b"TAG":
            out.tags |= {k: v.rstrip(b"\0 ").decode("latin-1") for k, v in zip(("title", "artist", "album"), (data[at + 3 : at + 33], data[at + 33 : at + 63], data[at + 63 : at + 93]), strict=True)}
            break
        if data[at : at + 3] == b"ID3" and at + 10 <= end and 2 <= data[at + 3] <= 4:
            tags, at = _id3v2(data, at)
            out.tags |= tags
            continue
        head = header(data[at : at + 4])
        if head is not None and not head.kbps:
            free = free or _free_length(data, at, head)
            head = replace(head, length=head.length + free) if free else None
        sure = head is not None and at + head.length <= end and (known is None or _like(known, head))
        if sure and (lost or known is None) and at + head.length < end:
            after = data[at + head.length : at + head.length + 4]
            sure = _like(head, header(after)) or after[:3] in (b"TAG", b"ID3")
        if not sure:
            out.resyncs += not lost
            lost, ahead = True, data.find(b"\xff", at + 1, end)
            out.skipped += (end if ahead < 0 else ahead) - at
            at = end if ahead < 0 else ahead
            continue
        lost, known = False, head
        if not out.headers and not out.table and (table := _table(data, at, head)):
            out.table = table
        else:
            if head.crc:
                out.checked += 1
                out.damaged += checksum(head, data[at : at + head.length]) != int.from_bytes(data[at + 4 : at + 6], "big")
            out.offsets.append(at)
            out.headers.append(head)
        first = at if first is None else first
        at += head.length
        out.audio_bytes = at - first
    return out


# -- storing bytes ---------------------------------------------------------------------------------------------------

_TOP = 14


def _head(index: int, crc: bool) -> bytes:
    """MPEG-1 layer III, 44.1 kHz, mono, with the bit rate of an index."""
    return bytes((0xFF, 0xFB - crc, index << 4, 0xC4))


def _start(index: int) -> bytes:
    """Header, checksum and empty side information of a protected frame."""
    head, side = _head(index, True), bytes(17)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


_STARTS = {i: _start(i) for i in range(1, 15)}
_ROOM = {i: header(_head(i, True)).length - len(_STARTS[i]) for i in range(1, 15)}


def _txxx(name: str, value: int) -> bytes:
    body = b"\3" + name.encode() + b"\0" + str(value).encode()
    return b"TXXX" + struct.pack(">I", len(body)) + b"\0\0" + body  # below 128 bytes, so sync-safe as it is


def pack(raw: bytes, unit: int = UNIT) -> bytes:
    """A stream that holds the bytes, padded with 255 to a positive multiple of the unit."""
    payload = raw + b"\xff" * (max(1, -(-len(raw) // unit)) * unit - len(raw))
    tag = _txxx("n_bytes", len(raw)) + _txxx("payload_bytes", len(payload))
    tag = b"ID3\4\0\0" + bytes(len(tag) >> s & 127 for s in (21, 14, 7, 0)) + tag
    room = _ROOM[_TOP]
    full, rest = divmod(len(payload), room)
    body = np.zeros((full, room + len(_STARTS[_TOP])), dtype=np.uint8)
    body[:, : len(_STARTS[_TOP])] = np.frombuffer(_STARTS[_TOP], np.uint8)
    body[:, len(_STARTS[_TOP]) :] = np.frombuffer(payload[: full * room], np.uint8).reshape(full, room)
    tail = b""
    if rest:
        index = next(i for i in range(1, 15) if _ROOM[i] >= rest)
        tail = _STARTS[index] + payload[full * room :] + bytes(_ROOM[index] - rest)
    frames, size = full + bool(rest), body.size + len(tail)
    first = header(_head(9, False)).length
    toc = bytes(min(255, (frames * i // 100 * body.shape[1] + first) * 256 // (size + first)) for i in range(100))
    xing = _head(9, False) + bytes(17) + b"Xing" + struct.pack(">III", 15, frames, size + first) + toc + struct.pack(">I", 0)
    return tag + xing + bytes(first - len(xing)) + body.tobytes() + tail


def unpack(data: bytes, stream: Stream) -> bytes | None:
    """The payload of a stream made by pack(); None for others."""
    if not all(stream.tags.get(k, "").isdigit() for k in ("n_bytes", "payload_bytes")):
        return None
    whole = b"".join(data[o + h.body : o + h.length] for o, h in zip(stream.offsets, stream.headers, strict=True))
    return whole[: int(stream.tags["payload_bytes"])]


_SLICE = 8 << 20


def _pack_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, data = strings(batch.column("text"))
        first = 0
        while first < batch.num_rows:
            last = min(batch.num_rows, max(first + 1, int(np.searchsorted(at, at[first] + _SLICE, "right")) - 1))
            media = [pack(data[a:b].tobytes()) for a, b in zip(at[first:last], at[first + 1 : last + 1], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(media, pa.binary())], ["doc_id", "media"])
            first = last


def feature(stream: Stream) -> str:
    """Format, frames, exact duration and checks in one line."""
    if not stream.headers:
        return "no frames"
    h, rates = stream.headers[0], [x.kbps for x in stream.headers]
    return f"mpeg{VERSIONS[h.version]} layer{h.layer} {h.rate}Hz {'mono' if h.mono else 'stereo'} {min(rates)}-{max(rates)}kbps frames={len(rates)} table={stream.table.get('frames', -1)}{'' if stream.table_agrees in (True, None) else ' (not so)'} samples={stream.samples} crc={stream.checked - stream.damaged}/{stream.checked} resyncs={stream.resyncs} last={stream.offsets[-1]}"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "seek_offsets"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64())]
    for batch in batches:
        rows = []
        for value in batch.column("media"):
            data = value.as_py()
            if data is None:
                rows.append((None,) * len(kinds))
                continue
            stream = parse(data)
            payload = unpack(data, stream)
            held = (None,) * 4 if payload is None else (int(stream.tags["n_bytes"]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
            rows.append((*held, len(data), hashlib.sha256(data).hexdigest(), feature(stream), stream.seconds, stream.offsets))
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], names)


def media_column(documents: DataFrame) -> DataFrame:
    """doc_id and media, the stream that holds the text."""
    source = documents.select("doc_id", "text")
    return source.mapInArrow(_pack_all, f"doc_id {dict(source.dtypes)['doc_id']}, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Digests, features, duration in seconds and frame offsets of any streams, as they are stored; what pack() held, too."""
    kind = dict(media.dtypes)["doc_id"]
    return media.mapInArrow(_features, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, seek_offsets array<long>")


def stored_features(documents: DataFrame) -> DataFrame:
    """Stores the documents' streams below the shared folder and returns the features of the stored bytes."""
    return media_features(written(media_column(documents), "media", compression="zstd", **{"parquet.block.size": str(32 << 20)}))
