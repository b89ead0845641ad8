"""MPEG audio columns: lossless payload carriers, a resynchronising reader, durations and seek offsets."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopecast.llm.common import map_batches, store, text_or_empty

# Fixed values of the format: bit rates in kbit/s by (MPEG-1, layer), sample rates, header places.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}
MODES = ("stereo", "joint", "dual", "mono")
CRC_POLYNOMIAL = 0x8005

#: The carrier: MPEG-1 layer III, 48 kHz (frames have no padding), stereo, with checksums.
CARRIER_RATE, CARRIER_SIDE, UNIT = 48000, 32, 64
_OVERHEAD = 4 + 2 + CARRIER_SIDE
#: Text bytes that are turned into streams at a time.
PART_BYTES = 1 << 24


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    kbps: int
    rate: int
    size: int
    samples: int
    mode: str
    side: int


@functools.lru_cache(4096)
def header_of(word: bytes) -> Header | None:
    """The frame header in four bytes, or None. Free-format frames state no size and are not taken."""
    b0, b1, b2, _ = word
    if b0 != 0xFF or b1 & 0xE0 != 0xE0:
        return None
    version, layer_bits, rate_bits, rate_kind = b1 >> 3 & 3, b1 >> 1 & 3, b2 >> 4, b2 >> 2 & 3
    if version == 1 or layer_bits == 0 or rate_bits in (0, 15) or rate_kind == 3 or word[3] & 3 == 2:
        return None
    first, layer = version == 3, 4 - layer_bits
    kbps, rate, pad = BITRATES[first, layer][rate_bits - 1], RATES[version][rate_kind], b2 >> 1 & 1
    mode = MODES[word[3] >> 6]
    if layer == 1:
        size, samples, side = (12000 * kbps // rate + pad) * 4, 384, 0
    elif layer == 2 or first:
        size, samples, side = 144000 * kbps // rate + pad, 1152, 0
    else:
        size, samples, side = 72000 * kbps // rate + pad, 576, 0
    if layer == 3:
        side = (17 if mode == "mono" else 32) if first else (9 if mode == "mono" else 17)
    return Header(VERSIONS[version], layer, not b1 & 1, kbps, rate, size, samples, mode, side)


@functools.lru_cache(4096)
def crc16(data: bytes) -> int:
    """CRC-16 of the format: polynomial 0x8005, start 0xFFFF, high bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ CRC_POLYNOMIAL) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


def _syncsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def _unsyncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _carrier_header(index: int) -> bytes:
    return bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0x04])


@functools.cache
def _carrier_head(index: int) -> bytes:
    """Header, checksum and empty side information of a silent frame."""
    head = _carrier_header(index)
    side = bytes(CARRIER_SIDE)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


@functools.cache
def _room(index: int) -> int:
    return header_of(_carrier_header(index)).size - _OVERHEAD


def pad(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def write(payload: bytes, n_bytes: int) -> bytes:
    """A playable stream that carries the payload, byte for byte.

    The frames are silent, so all their main data are ancillary bytes, and those hold the payload:
    320 kbit/s frames, and a last one of the least rate that has room. Before them stand an ID3v2.3
    tag with checksum, which has the lengths and the payload's CRC-32, and a Xing frame with counts
    and the seek table.
    """
    largest = 14
    room = _room(largest)
    full, rest = divmod(len(payload), room)
    head = np.frombuffer(_carrier_head(largest), np.uint8)
    body = np.empty((full, len(head) + room), np.uint8)
    body[:, :len(head)] = head
    body[:, len(head):] = np.frombuffer(payload, np.uint8, full * room).reshape(full, room)
    sizes = [len(head) + room] * full
    last = b""
    if rest:
        index = next(k for k in range(1, 15) if _room(k) >= rest)
        last = _carrier_head(index) + payload[full * room:] + bytes(_room(index) - rest)
        sizes.append(len(last))
    audio = body.tobytes() + last

    # the seek table: for each hundredth of the time, the place in 256ths of the bytes
    info_index = 4
    info_size = _room(info_index) + _OVERHEAD
    places = np.concatenate([[0], np.cumsum(sizes)]) + info_size
    total = int(places[-1])
    toc = bytes(int(places[k * len(sizes) // 100]) * 256 // total for k in range(100))
    xing = b"Xing" + struct.pack(">III", 0xF, len(sizes), total) + toc + struct.pack(">I", 100)
    info = _carrier_head(info_index) + xing + bytes(_room(info_index) - len(xing))

    note = b"\x00payload\x00" + f"n_bytes={n_bytes};payload_bytes={len(payload)};crc32={zlib.crc32(payload):08x}".encode()
    frames = b"TXXX" + struct.pack(">IH", len(note), 0) + note
    extended = struct.pack(">IHII", 10, 0x8000, 0, zlib.crc32(frames))
    return b"ID3\x03\x00\x40" + _syncsafe(len(extended) + len(frames)) + extended + frames + info + audio


@dataclass
class Stream:
    """What the reader found: exact duration as samples / rate, byte offset of every audio frame."""

    tags: dict[str, str] = field(default_factory=dict)
    tag_crc_ok: bool | None = None
    version: str = ""
    layer: int = 0
    rate: int = 0
    mode: str = ""
    samples: int = 0
    offsets: list[int] = field(default_factory=list)
    bodies: list[tuple[int, int]] = field(default_factory=list)
    checked: int = 0
    failed: int = 0
    skipped: int = 0
    vbr: dict | None = None
    kbps: set[int] = field(default_factory=set)


def _id3v2(data: bytes, at: int, out: Stream) -> int:
    """Read a tag of version 2.2 to 2.4 and return its end."""
    major, flags, size = data[at + 3], data[at + 5], _unsyncsafe(data[at + 6:at + 10])
    body = data[at + 10:at + 10 + size]
    end = at + 10 + size + (10 if flags & 0x10 and major == 4 else 0)
    if flags & 0x80:
        body = body.replace(b"\xff\x00", b"\xff")
    pos = 0
    if flags & 0x40 and major == 3 and len(body) >= 10:
        length, more = struct.unpack_from(">IH", body)
        padding = struct.unpack_from(">I", body, 6)[0]
        pos = 4 + length
        if more & 0x8000 and length >= 10 and len(body) >= 14:
            out.tag_crc_ok = zlib.crc32(body[pos:len(body) - padding]) == struct.unpack_from(">I", body, 10)[0]
    elif flags & 0x40 and major == 4 and len(body) >= 4:
        pos = _unsyncsafe(body[:4])
    wide = major > 2
    step = 10 if wide else 6
    while pos + step <= len(body) and body[pos]:
        name = body[pos:pos + (4 if wide else 3)].decode("latin-1")
        if major == 4:
            length = _unsyncsafe(body[pos + 4:pos + 8])
        else:
            length = int.from_bytes(body[pos + 4:pos + 8], "big") if wide else int.from_bytes(body[pos + 3:pos + 6], "big")
        value = body[pos + step:pos + step + length]
        pos += step + length
        if name.startswith("T") and value:
            coding = ("latin-1", "utf-16", "utf-16-be", "utf-8")[min(value[0], 3)]
            text = value[1:].decode(coding, "replace").rstrip("\x00")
            if name.startswith("TX"):
                name, _, text = text.partition("\x00")
            out.tags[name] = text
    return end


def _vbr(data: bytes, at: int, head: Header) -> dict | None:
    """Xing or Info table behind the side information, or VBRI at its fixed place."""
    pos = at + 4 + (2 if head.protected else 0) + head.side
    kind = data[pos:pos + 4]
    if kind in (b"Xing", b"Info"):
        flags = int.from_bytes(data[pos + 4:pos + 8], "big")
        pos += 8
        out: dict = {"kind": kind.decode().lower()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(data[pos:pos + 4], "big")
                pos += 4
        if flags & 4:
            out["toc"] = list(data[pos:pos + 100])
        return out
    if data[at + 36:at + 40] == b"VBRI":
        n_bytes, frames, entries, scale, width, per = struct.unpack_from(">IIHHHH", data, at + 46)
        table = [int.from_bytes(data[at + 62 + k * width:at + 62 + (k + 1) * width], "big") * scale for k in range(entries)]
        return {"kind": "vbri", "frames": frames, "bytes": n_bytes, "frames_per_entry": per, "toc": table}
    return None


def _confirmed(data: bytes, at: int, head: Header, end: int) -> bool:
    """A header counts if the frame ends at the end of the audio or at a header of the same kind."""
    nxt = at + head.size
    if nxt == end:
        return True
    if nxt + 4 > end:
        return False
    other = header_of(data[nxt:nxt + 4])
    return other is not None and (other.version, other.layer, other.rate) == (head.version, head.layer, head.rate)


def _leads_to(data: bytes, at: int, end: int) -> bool:
    """Frames follow each other from a header to the very end."""
    while at + 4 <= end and (head := header_of(data[at:at + 4])) is not None:
        at += head.size
    return at == end


def read(data: bytes) -> Stream:
    """Parse a stream: tags, frames, variable-rate table, checksums.

    While frames follow each other, a header is trusted where the one before ends. Where there is
    none, bytes are skipped up to a header that another one confirms; a frame that is cut short is
    skipped. The checksum of a protected layer III frame covers the header's last two bytes and the
    side information; those of layers I and II cover coded allocations and are not verified. The
    table frame is no audio and does not count in the duration. Empty or foreign bytes give no frames. The letters
    of a closing tag are frame data where frames that follow each other cover them and end with the stream.
    """
    out = Stream()
    at, end = 0, len(data)
    while data[at:at + 3] == b"ID3" and at + 10 <= end:
        at = _id3v2(data, at, out)
    whole = end
    tagged = end - at >= 128 and data[end - 128:end - 125] == b"TAG"
    end -= 128 * tagged
    synced, first = False, True
    while at + 4 <= end:
        head = header_of(data[at:at + 4])
        if tagged and synced and head is not None and at + head.size > end and _leads_to(data, at, whole):
            tagged, end = False, whole
        if head is None or at + head.size > end or not (synced or _confirmed(data, at, head, end)):
            synced = False
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - at
            at = nxt
            continue
        synced = True
        table = _vbr(data, at, head) if first else None
        lead = 4 + 2 * head.protected + head.side
        if head.protected and head.layer == 3:
            out.checked += 1
            stated = int.from_bytes(data[at + 4:at + 6], "big")
            out.failed += stated != crc16(data[at + 2:at + 4] + data[at + 6:at + lead])
        if first:
            out.version, out.layer, out.rate, out.mode = head.version, head.layer, head.rate, head.mode
            first = False
        if table is not None:
            out.vbr = table
        else:
            out.samples += head.samples
            out.offsets.append(at)
            out.bodies.append((at + lead, at + head.size))
            out.kbps.add(head.kbps)
        at += head.size
    out.skipped += max(0, end - at)
    if tagged:
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93)):
            if text := data[end + a:end + b].rstrip(b"\x00 ").decode("latin-1"):
                out.tags.setdefault(name, text)
    return out


def payload_of(data: bytes, stream: Stream) -> tuple[bytes, int]:
    """(payload, unpadded length) from a carrier stream; raises if any checksum or count is wrong."""
    note = dict(x.split("=") for x in stream.tags["payload"].split(";"))
    length = int(note["payload_bytes"])
    payload = b"".join([data[a:b] for a, b in stream.bodies])[:length]
    if stream.tag_crc_ok is not True or stream.failed or stream.skipped or len(payload) != length:
        raise ValueError("damaged carrier stream")
    if zlib.crc32(payload) != int(note["crc32"], 16) or stream.vbr["frames"] != len(stream.offsets):
        raise ValueError("payload or table does not match")
    return payload, int(note["n_bytes"])


def feature(stream: Stream) -> str:
    """What a catalogue would show: format, exact duration, table, checksums, digest of the seek offsets."""
    seek = zlib.crc32(np.array(stream.offsets, "<i8").tobytes())
    rates = f"{min(stream.kbps)}-{max(stream.kbps)}" if stream.kbps else "-"
    return (
        f"mpeg{stream.version} layer{stream.layer} {stream.rate}Hz {stream.mode} {rates}kbps frames={len(stream.offsets)} "
        f"duration={stream.samples}/{stream.rate} vbr={(stream.vbr or {}).get('kind', '-')} crc={stream.checked - stream.failed}/{stream.checked} seek={seek:08x}"
    )


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media, samples, sample_rate, frame_offsets): each whole text as a carrier stream,
    with its exact duration and the byte offset of every audio frame.

    Null and empty texts are 64 zero bytes. Rows, null ids and repeats stay as they are; other
    columns are not read. Equal texts give equal streams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy()
            at = 0
            while at < batch.num_rows:
                rows = max(1, int(np.searchsorted(np.cumsum(sizes[at:at + 256], dtype=np.int64), PART_BYTES)))
                part = batch.slice(at, rows)
                at += rows
                raw = part.column(1).to_pylist()
                media = [write(pad(r), len(r)) for r in raw]
                seen = [read(m) for m in media]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(media, pa.binary()), pa.array([s.samples for s in seen], pa.int64()),
                        pa.array([s.rate for s in seen], pa.int32()), pa.array([s.offsets for s in seen], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "media", "samples", "sample_rate", "frame_offsets"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    return map_batches(source, run, "doc_id long, media binary, samples long, sample_rate int, frame_offsets array<long>")


def media_features(stored: DataFrame) -> DataFrame:
    """Read stored streams back: payload, digests and feature per row; damage raises."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def one(doc_id: int | None, data: bytes, samples: int, offsets: list[int]) -> tuple:
        stream = read(data)
        payload, n_bytes = payload_of(data, stream)
        if (stream.samples, stream.offsets) != (samples, offsets):
            raise ValueError("stored duration or seek offsets do not match")
        return (
            doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]),
            len(data), hashlib.sha256(data).hexdigest(), feature(stream),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(d.as_py(), m.as_py(), n.as_py(), o.as_py()) for d, m, n, o in zip(*batch.columns)]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(stored.select("doc_id", "media", "samples", "frame_offsets"), run, schema)


def documents_as_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the media table to the shared folder and read its features back."""
    return media_features(store(media_table(docs, id_col, text_col), "media"))
