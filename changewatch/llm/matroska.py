"""Media columns in Matroska: variable-length EBML elements, clusters, lacing and cues, read into packet tables.

``write`` stores bytes as 8-bit samples, 8,000 a second, in a Matroska file;
``packets`` reads any Matroska bytes - known and unknown sizes, simple blocks
and block groups, all three kinds of lacing - into a table of packets with
track, timestamp and byte range.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from changewatch.llm.common import beside, by_bytes

BATCH_BYTES = 2_000_000
UNIT = 64
RATE = 8000
#: Bytes of a packet, packets of a block, blocks of a cluster.
FRAME, LACED, BLOCKS = 512, 8, 8

# fixed values: element ids of the format
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_TRACK = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1, 0x1F43B675, 0xA0, 0x1C53BB6B, 0xBB, 0xB7
SCALE, DURATION, TIMESTAMP, SIMPLE, BLOCK, NUMBER, EACH, CODEC, CUE_TIME, CUE_POSITION, CUE_ON = 0x2AD7B1, 0x4489, 0xE7, 0xA3, 0xA1, 0xD7, 0x23E383, 0x86, 0xB3, 0xF1, 0xF7
_PARENTS = frozenset((SEGMENT, INFO, TRACKS, TRACK, CLUSTER, GROUP, CUES, CUE, CUE_TRACK))
_TOP = frozenset((INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1941A469, 0x1043A770))


class Broken(ValueError):
    """Bytes that are no whole Matroska file."""


def _number(n: int) -> bytes:
    return n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")


def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(kind: int, body: bytes) -> bytes:
    return _number(kind) + _size(len(body)) + body


def _signed(n: int) -> bytes:
    """A difference of sizes in EBML lacing."""
    width = 1
    while not -(1 << 7 * width - 1) < n < 1 << 7 * width - 1:
        width += 1
    return ((n + (1 << 7 * width - 1) - 1) | 1 << 7 * width).to_bytes(width, "big")


def lace(frames: list[bytes], track: int, time: int, kind: str | None = None) -> bytes:
    """The body of a block; kind is none, xiph, fixed or ebml, by default the least that fits."""
    kind = kind or ("none" if len(frames) == 1 else "fixed" if len({*map(len, frames)}) == 1 else "ebml")
    head = _size(track) + struct.pack(">hB", time, 0x80 | {"none": 0, "xiph": 2, "fixed": 4, "ebml": 6}[kind])
    sizes = [len(f) for f in frames]
    if kind == "xiph":
        head += bytes([len(frames) - 1]) + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == "fixed":
        head += bytes([len(frames) - 1])
    elif kind == "ebml":
        head += bytes([len(frames) - 1]) + b"".join([_size(sizes[0]), *(_signed(b - a) for a, b in zip(sizes[:-2], sizes[1:-1], strict=True))][: len(frames) - 1])
    return head + b"".join(frames)


_HEADER = _element(EBML, _element(0x4286, b"\1") + _element(0x42F7, b"\1") + _element(0x42F2, b"\4") + _element(0x42F3, b"\x08") + _element(0x4282, b"matroska") + _element(0x4287, b"\4") + _element(0x4285, b"\2"))
_TRACKS = _element(TRACKS, _element(TRACK, _element(NUMBER, b"\1") + _element(0x73C5, b"\1") + _element(0x83, b"\2") + _element(EACH, _number(FRAME * 1_000_000_000 // RATE)) + _element(CODEC, b"A_PCM/INT/LIT") + _element(AUDIO, _element(0xB5, struct.pack(">f", RATE)) + _element(0x9F, b"\1") + _element(0x6264, b"\x08"))))


def write(payload: bytes) -> bytes:
    """A Matroska file of one audio track whose samples are the payload's bytes; equal payloads, equal files."""
    duration = len(payload) * 1000 / RATE
    body = _element(INFO, _element(SCALE, _number(1_000_000)) + _element(DURATION, struct.pack(">d", duration)) + _element(0x4D80, b"changewatch") + _element(0x5741, b"changewatch")) + _TRACKS
    parts, cues, place = [body], [], len(body)
    for c in range(0, len(payload), FRAME * LACED * BLOCKS):
        time = c * 1000 // RATE
        blocks = [_element(TIMESTAMP, _number(time))]
        for b in range(c, min(len(payload), c + FRAME * LACED * BLOCKS), FRAME * LACED):
            frames = [payload[i : min(i + FRAME, b + FRAME * LACED)] for i in range(b, min(len(payload), b + FRAME * LACED), FRAME)]
            blocks.append(_element(SIMPLE, lace(frames, 1, b * 1000 // RATE - time)))
        cues.append(_element(CUE, _element(CUE_TIME, _number(time)) + _element(CUE_TRACK, _element(CUE_ON, b"\1") + _element(CUE_POSITION, _number(place)))))
        parts.append(_element(CLUSTER, b"".join(blocks)))
        place += len(parts[-1])
    parts.append(_element(CUES, b"".join(cues)))
    return _HEADER + _element(SEGMENT, b"".join(parts))


class Packet(NamedTuple):
    track: int
    timestamp: int
    key: bool
    start: int
    end: int


class Media(NamedTuple):
    packets: list[Packet]
    #: (time, track, place of a cluster in the file)
    cues: list[tuple[int, int, int]]
    tracks: dict[int, str]
    clusters: list[int]
    scale: int
    duration: float


def _vint(data: bytes, at: int, end: int, keep: bool = False) -> tuple[int, int, int]:
    """(value, place after it, width); keep leaves the marker in, as ids have it."""
    if at >= end or not data[at]:
        raise Broken(f"no number at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Broken(f"a number at {at} is cut off")
    n = int.from_bytes(data[at : at + width], "big")
    return n if keep else n & (1 << 7 * width) - 1, at + width, width


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, bool, list[tuple[int, int]]]:
    """(track, time, key, byte ranges) of a block."""
    track, at, _ = _vint(data, at, end)
    if at + 3 > end:
        raise Broken("a block is cut off")
    time, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, time, bool(flags & 0x80), [(at, end)]
    if at >= end:
        raise Broken("a block is cut off")
    count, at, sizes = data[at] + 1, at + 1, []
    if lacing == 2:
        if (end - at) % count:
            raise Broken("frames of a fixed size don't fill their block")
        sizes = [(end - at) // count] * count
    else:
        for i in range(count - 1):
            if lacing == 1:
                n = 0
                while True:
                    if at >= end:
                        raise Broken("a lace is cut off")
                    n, more, at = n + data[at], data[at] == 255, at + 1
                    if not more:
                        break
            else:
                n, at, width = _vint(data, at, end)
                if i:
                    n += sizes[-1] - (1 << 7 * width - 1) + 1
            sizes.append(n)
        sizes.append(end - at - sum(sizes))
        if min(sizes) < 0:
            raise Broken("frames exceed their block")
    out = []
    for n in sizes:
        out.append((at, at + n))
        at += n
    return track, time, bool(flags & 0x80), out


def packets(data: bytes) -> Media:
    """The packet table of a Matroska file; raises Broken. Frames of a lace follow each other by their track's default duration; without one they share their block's timestamp."""
    out = Media([], [], {}, [], 0, 0.0)
    scale, duration, time, base, track, each, codec, cue, cue_on = 1_000_000, 0.0, 0, 0, 0, 0, "", 0, 0
    lasts: dict[int, int] = {}  # nanoseconds of a frame by track
    stack = [(0, len(data))]  # (id, end); an end of -1 is unknown
    at = 0
    while True:
        while len(stack) > 1 and at == stack[-1][1]:
            if stack.pop()[0] == TRACK:
                out.tracks[track], lasts[track], each, codec = codec, each, 0, ""
        if at == len(data):
            break
        end = next(e for _, e in reversed(stack) if e >= 0)
        place = at
        kind, at, _ = _vint(data, at, end, keep=True)
        size, at, width = _vint(data, at, end)
        unknown = size == (1 << 7 * width) - 1
        if unknown and kind not in (SEGMENT, CLUSTER):
            raise Broken(f"element {kind:#x} has no size")
        while stack[-1][1] < 0 and (stack[-1][0] == CLUSTER and kind in _TOP or kind in (EBML, SEGMENT)):
            stack.pop()
        stop = -1 if unknown else at + size
        if stop > end:
            raise Broken(f"element {kind:#x} at {place} ends outside its parent")
        if place == 0 and kind != EBML:
            raise Broken("no header")
        if kind in _PARENTS:
            if kind == SEGMENT:
                base = at
            elif kind == CLUSTER:
                out.clusters.append(place)
            stack.append((kind, stop))
            continue
        if kind in (SIMPLE, BLOCK):
            number, rel, key, ranges = _frames(data, at, stop)
            last = lasts.get(number, 0)
            out.packets.extend(Packet(number, time + rel + (k * last + scale // 2) // max(1, scale), key or kind == BLOCK, a, b) for k, (a, b) in enumerate(ranges))
        elif kind == DURATION:
            duration = struct.unpack(">f" if size == 4 else ">d", data[at:stop])[0] if size in (4, 8) else 0.0
        elif kind == CODEC:
            codec = data[at:stop].decode("ascii", "replace")
        elif kind in (TIMESTAMP, SCALE, NUMBER, EACH, CUE_TIME, CUE_ON, CUE_POSITION):
            n = int.from_bytes(data[at:stop], "big")
            if kind == TIMESTAMP:
                time = n
            elif kind == SCALE:
                scale = n
            elif kind == NUMBER:
                track = n
            elif kind == EACH:
                each = n
            elif kind == CUE_TIME:
                cue = n
            elif kind == CUE_ON:
                cue_on = n
            else:
                out.cues.append((cue, cue_on, base + n))
        at = stop
    return out._replace(scale=scale, duration=duration)


def to_media(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with n_bytes and media: each whole text's UTF-8 bytes, padded with 0 to a positive multiple of 64, as a Matroska file.

    A null text is empty (64 zero bytes). Repeated rows each get their file;
    an empty table gives an empty result; other columns are not read.
    """
    rows = beside(docs, keep, text)
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_bytes(batches, len(keep), BATCH_BYTES):
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            files = [write(r + bytes(-len(r) % UNIT if r else UNIT)) for r in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([len(r) for r in raw], pa.int64()), pa.array(files, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def packet_table(files: DataFrame, *, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each packet: ``keep``, packet_no, track, timestamp, is_key, start_byte, end_byte. Null or broken media have no packets."""
    rows = beside(files, keep, media)
    schema = T.StructType([*files.select(*keep).schema.fields, *(T.StructField(n, T.LongType()) for n in ("packet_no", "track", "timestamp")), T.StructField("is_key", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in ("start_byte", "end_byte"))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(len(keep))):
                try:
                    table = packets(data.as_py() or b"").packets
                except Broken:
                    continue
                if table:
                    cols = list(zip(*table, strict=True))
                    n = len(table)
                    yield pa.RecordBatch.from_arrays([*(pa.array([batch.column(k)[i].as_py()] * n, batch.schema.field(k).type) for k in range(len(keep))), pa.array(range(n), pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def digests(files: DataFrame, *, media: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """``keep`` with payload_bytes, payload_sha256, tail_crc32 (of the last 64 payload bytes), media_bytes, media_sha256 and feature.

    The payload is read back from the packets. feature names tracks, clusters,
    cues that point at a cluster, packets, duration and the samples' mean in
    hundredths. Null media count as no bytes; broken media have the feature
    'broken' and an empty payload.
    """
    rows = beside(files, keep, media)
    schema = T.StructType([*files.select(*keep).schema.fields, T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())])

    def one(data: bytes) -> tuple:
        try:
            m = packets(data)
            payload = b"".join(data[p.start : p.end] for p in m.packets)
            places = set(m.clusters)
            mean = (100 * sum(payload)) // max(1, len(payload))
            feature = f"tracks={len(m.tracks)};clusters={len(m.clusters)};cues={sum(c[2] in places for c in m.cues)};packets={len(m.packets)};ms={round(m.duration * m.scale / 1e6)};mean={mean}"
        except Broken:
            payload, feature = b"", "broken"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(zip(*(one(x.as_py() or b"") for x in batch.column(len(keep))), strict=True)) if batch.num_rows else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(x, k) for x, k in zip(made, kinds, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema)
