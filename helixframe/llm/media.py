"""Matroska media columns: write, parse and measure.

``write`` stores bytes as unsigned 8-bit samples of one PCM track: an EBML
header and a segment of known size with info, track, clusters of laced blocks
and cues.  ``parse`` reads any such file from its bytes: variable-length
element ids and sizes (unknown sizes included), clusters, simple blocks and
block groups with all four lacings, and cues, into a packet table of
timestamps, tracks and byte ranges.

Defined results: a null or empty payload is stored as its padding; payloads of
any length are stored whole; repeated rows are stored each, and equal payloads
give equal files, as nothing in them depends on time or chance; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .bpe import _typed
from .common import map_batches

# Element ids of the format.
EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_MASTERS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_TRACK_POSITIONS}
_TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES}

#: Samples in a frame, frames in a laced block, blocks in a cluster; samples in a second.
FRAME, LACE, BLOCKS, RATE = 1024, 8, 16, 8000
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


def _id(value: int) -> bytes:
    return value.to_bytes((value.bit_length() + 7) // 8, "big")


def _vint(value: int) -> bytes:
    n = 1
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def _signed_vint(value: int) -> bytes:
    n = 1
    while not -((1 << 7 * n - 1) - 1) <= value <= (1 << 7 * n - 1) - 1:
        n += 1
    return (value + (1 << 7 * n - 1) - 1 | 1 << 7 * n).to_bytes(n, "big")


def element(kind: int, body: bytes | int | str) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    elif isinstance(body, str):
        body = body.encode()
    return _id(kind) + _vint(len(body)) + body


def block(track: int, relative: int, frames: list[bytes], lacing: int) -> bytes:
    """The body of a block whose frames are laced in the given way."""
    head = _vint(track) + relative.to_bytes(2, "big", signed=True) + bytes([0x80 | lacing << 1])
    sizes = [len(f) for f in frames]
    if lacing == NO_LACING:
        return head + frames[0]
    head += bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        head += _vint(sizes[0]) + b"".join(_signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1], strict=False)) if len(sizes) > 1 else b""
    return head + b"".join(frames)


def write(payload: bytes) -> bytes:
    """A Matroska file whose track's frames joined are ``payload``."""
    header = element(EBML, element(EBML_VERSION, 1) + element(EBML_READ_VERSION, 1) + element(EBML_MAX_ID, 4) + element(EBML_MAX_SIZE, 8) + element(DOC_TYPE, "matroska") + element(DOC_VERSION, 4) + element(DOC_READ_VERSION, 2))
    info = element(INFO, element(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, "helixframe") + element(WRITING_APP, "helixframe"))
    audio = element(SAMPLING_FREQUENCY, np.array([RATE], ">f4").tobytes()) + element(CHANNELS, 1) + element(BIT_DEPTH, 8)
    tracks = element(TRACKS, element(TRACK_ENTRY, element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(FLAG_LACING, 1) + element(CODEC_ID, "A_PCM/INT/LIT") + element(AUDIO, audio)))
    body, cues = [info, tracks], []
    size = len(info) + len(tracks)
    per_block, per_cluster = FRAME * LACE, FRAME * LACE * BLOCKS
    for at in range(0, len(payload), per_cluster):
        start = at * 1000 // RATE
        blocks = [element(TIMESTAMP, start)]
        for b in range(at, min(at + per_cluster, len(payload)), per_block):
            frames = [payload[f : f + FRAME] for f in range(b, min(b + per_block, len(payload)), FRAME)]
            even = len({len(f) for f in frames}) == 1
            lacing = NO_LACING if len(frames) == 1 else FIXED if even else EBML_LACING
            blocks.append(element(SIMPLE_BLOCK, block(1, b * 1000 // RATE - start, frames, lacing)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, element(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER_POSITION, size))))
        body.append(cluster)
        size += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return header + element(SEGMENT, b"".join(body))


@dataclass
class Media:
    """What ``parse`` finds: packets are (track, timestamp in ms, offset, size, cluster)."""

    doc_type: str = ""
    tracks: dict[int, str] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    lacings: set[int] = field(default_factory=set)


def _read_vint(data: bytes, at: int, keep_mark: bool = False) -> tuple[int, int, bool]:
    """Value, end, and whether all value bits are set (an unknown size)."""
    first = data[at]
    if not first:
        raise ValueError(f"bad variable-length number at {at}")
    n = 9 - first.bit_length()
    value = int.from_bytes(data[at : at + n], "big")
    bare = value & (1 << 7 * n) - 1
    return value if keep_mark else bare, at + n, bare == (1 << 7 * n) - 1


def _frame_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    if lacing == NO_LACING:
        return [end - at], at
    count = data[at] + 1
    at += 1
    if lacing == FIXED:
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    for i in range(count - 1):
        if lacing == XIPH:
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
        elif i == 0:
            n, at, _ = _read_vint(data, at)
            sizes.append(n)
        else:
            begin = at
            n, at, _ = _read_vint(data, at)
            sizes.append(sizes[-1] + n - ((1 << 7 * (at - begin) - 1) - 1))
    return [*sizes, end - at - sum(sizes)], at


def parse(data: bytes) -> Media:
    """Elements, clusters, blocks and cues of a file."""
    out = Media()
    base = scale = 0
    segment = 0
    entry: dict[int, object] = {}
    point: dict[int, int] = {}
    stack: list[tuple[int, int]] = []  # end and id of open masters
    at = 0
    while at < len(data):
        while stack and at >= stack[-1][0]:
            stack.pop()
        begin = at
        kind, at, _ = _read_vint(data, at, keep_mark=True)
        size, at, unknown = _read_vint(data, at)
        if kind in _TOP:  # ends a cluster of unknown size
            while stack and stack[-1][1] != SEGMENT:
                stack.pop()
        end = (stack[-1][0] if stack else len(data)) if unknown else min(at + size, len(data))
        if kind in _MASTERS:
            if kind == SEGMENT:
                segment = at
            elif kind == CLUSTER:
                out.clusters.append(begin - segment)
                base = 0
            elif kind == TRACK_ENTRY:
                entry = {}
            elif kind == CUE_POINT:
                point = {}
            stack.append((end, kind))
            continue
        body = data[at:end]
        number = int.from_bytes(body, "big") if len(body) <= 8 else 0
        if kind == EBML:
            inner = at
            while inner < end:
                k, inner, _ = _read_vint(data, inner, keep_mark=True)
                n, inner, _ = _read_vint(data, inner)
                if k == DOC_TYPE:
                    out.doc_type = data[inner : inner + n].decode()
                inner += n
        elif kind == TIMESTAMP_SCALE:
            scale = number
        elif kind == TIMESTAMP:
            base = number
        elif kind in (TRACK_NUMBER, CODEC_ID):
            entry[kind] = number if kind == TRACK_NUMBER else body.decode()
            if len(entry) == 2:
                out.tracks[entry[TRACK_NUMBER]] = entry[CODEC_ID]
        elif kind in (SIMPLE_BLOCK, BLOCK):
            track, p, _ = _read_vint(data, at)
            relative = int.from_bytes(data[p : p + 2], "big", signed=True)
            lacing = data[p + 2] >> 1 & 3
            out.lacings.add(lacing)
            sizes, p = _frame_sizes(data, p + 3, end, lacing)
            stamp = (base + relative) * (scale or 1_000_000) // 1_000_000
            for n in sizes:
                out.packets.append((track, stamp, p, n, len(out.clusters) - 1))
                p += n
        elif kind in (CUE_TIME, CUE_TRACK, CUE_CLUSTER_POSITION):
            point[kind] = number
            if kind == CUE_CLUSTER_POSITION:
                out.cues.append((point.get(CUE_TIME, 0), point.get(CUE_TRACK, 0), number))
        at = end
    return out


def pad(raw: bytes, unit: int = 64) -> bytes:
    """``raw`` with zero bytes up to a positive multiple of ``unit``."""
    return raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


def features(media: Media, samples: bytes) -> str:
    """Packet and sample figures, whole numbers only."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};last_ms={media.packets[-1][1]};peak={int(np.abs(x).max())};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings}"


def media_columns(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each text stored as media, with its packet table.

    ``key, n_bytes, media binary, packets array<struct<track, timestamp_ms,
    offset, size, cluster>>``.  One narrow stage.
    """
    schema = f"{_typed(docs, key)}, n_bytes long, media binary, packets array<struct<track:int,timestamp_ms:long,`offset`:long,size:int,cluster:int>>"
    names = ("track", "timestamp_ms", "offset", "size", "cluster")

    def make():
        def work(keys, texts):
            raw = [(t or "").encode() for t in texts]
            stored = [write(pad(r)) for r in raw]
            return keys, [len(r) for r in raw], stored, [[dict(zip(names, p, strict=True)) for p in parse(m).packets] for m in stored]

        return work

    return map_batches(docs, [key, text], schema, make)


def media_digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Digests and features of each text's stored media, from the bytes read back through the packet table."""
    schema = f"{_typed(docs, key)}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def one(text: str | None) -> tuple:
        raw = (text or "").encode()
        stored = write(pad(raw))
        media = parse(stored)
        payload = b"".join(stored[o : o + n] for _, _, o, n, _ in media.packets)
        return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(media, payload)

    def make():
        return lambda keys, texts: (keys, *zip(*map(one, texts), strict=True)) if keys else (keys, *[[]] * 7)

    return map_batches(docs, [key, text], schema, make)
