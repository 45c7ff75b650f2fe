"""Matroska: write and parse EBML elements, clusters, laced blocks and cues (pure Python).

``write`` stores 8-bit samples as one PCM track; ``parse`` reads any Matroska
bytes with known or unknown element sizes, SimpleBlocks and BlockGroups, and all
four lacings, into a ``Movie`` with one ``Packet`` per frame.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

# Element ids (fixed values of the format).
EBML, VERSION, READ_VERSION, MAX_ID, MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
LACING, DEFAULT_DURATION, AUDIO, RATE, CHANNELS, BITS = 0x9C, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements of the segment's own level; one of them ends a cluster of unknown size.
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

SAMPLE_RATE = 8000
FRAME = 512
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 32
PCM = "A_PCM/INT/LIT"


class Malformed(ValueError):
    """The bytes are not well-formed Matroska."""


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    offset: int
    size: int
    cluster: int
    keyframe: bool
    lacing: int


@dataclass
class Movie:
    scale: int = 1_000_000
    duration: float = 0.0
    doc_type: str = ""
    segment: int = 0
    tracks: dict = field(default_factory=dict)
    clusters: list = field(default_factory=list)
    cues: list = field(default_factory=list)
    packets: list = field(default_factory=list)


# ---- writing


def _size(n: int) -> bytes:
    for width in range(1, 9):
        if n < (1 << 7 * width) - 1:
            return (n | 1 << 7 * width).to_bytes(width, "big")
    raise Malformed("size")


def element(kind: int, data: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + _size(len(data)) + data


def uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes], lacing: int) -> bytes:
    """Lace sizes in front of the frames: 1 Xiph, 2 fixed, 3 EBML."""
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if lacing == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == 3:
        head += _size(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1]):
            d = b - a
            width = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
            head += (d + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    elif len(set(sizes)) > 1:
        raise Malformed("fixed lacing needs equal sizes")
    return head + b"".join(frames)


def block(track: int, relative: int, frames: list[bytes], lacing: int, key: bool = True) -> bytes:
    lacing = lacing if len(frames) > 1 else 0
    head = _size(track) + struct.pack(">hB", relative, (0x80 if key else 0) | lacing << 1)
    return head + (_laced(frames, lacing) if lacing else frames[0])


def write(payload: bytes, *, frame: int = FRAME, per_block: int = FRAMES_PER_BLOCK, per_cluster: int = BLOCKS_PER_CLUSTER, rate: int = SAMPLE_RATE) -> bytes:
    """A Matroska file with the bytes as unsigned 8-bit mono samples.

    Blocks of equal frames use fixed lacing, a last block with a short frame EBML
    lacing; each cluster gets a cue.
    """
    ms = lambda samples: samples * 1000 // rate
    track = uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(LACING, 1) + element(CODEC, PCM.encode())
    track += element(AUDIO, element(RATE, struct.pack(">d", rate)) + uint(CHANNELS, 1) + uint(BITS, 8))
    info = uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / rate))
    info += element(MUXER, b"lexiloom") + element(WRITER, b"lexiloom")
    body = [element(INFO, info), element(TRACKS, element(TRACK, track))]
    at = sum(map(len, body))
    cues, step = [], frame * per_block
    for begin in range(0, len(payload), step * per_cluster):
        parts = [uint(TIMESTAMP, ms(begin))]
        for b in range(begin, min(begin + step * per_cluster, len(payload)), step):
            chunk = payload[b : b + step]
            frames = [chunk[i : i + frame] for i in range(0, len(chunk), frame)]
            parts.append(element(SIMPLE_BLOCK, block(1, ms(b) - ms(begin), frames, 2 if len(chunk) % frame == 0 else 3)))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, uint(CUE_TIME, ms(begin)) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    head = uint(VERSION, 1) + uint(READ_VERSION, 1) + uint(MAX_ID, 4) + uint(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ, 2)
    return element(EBML, head) + element(SEGMENT, b"".join(body))


# ---- parsing


def _vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int]:
    if at >= len(data) or not data[at]:
        raise Malformed(f"variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Malformed(f"cut off at {at}")
    n = int.from_bytes(data[at : at + width], "big")
    return (n if keep_marker else n & (1 << 7 * width) - 1), width


def children(data: bytes, at: int, end: int):
    """(id, start of the element, start of its data, end of its data; None: unknown) one after another."""
    while at < end:
        kind, a = _vint(data, at, True)
        size, b = _vint(data, at + a, False)
        start = at + a + b
        if size == (1 << 7 * b) - 1:
            yield kind, at, start, None
            return  # the caller goes on from the data
        if start + size > end:
            raise Malformed(f"element at {at} ends behind its parent")
        yield kind, at, start, start + size
        at = start + size


def number(data: bytes, a: int, b: int) -> int:
    if b - a > 8:
        raise Malformed(f"integer of {b - a} bytes at {a}")
    return int.from_bytes(data[a:b], "big")


def real(data: bytes, a: int, b: int) -> float:
    if b - a not in (0, 4, 8):
        raise Malformed(f"number of {b - a} bytes at {a}")
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first begins."""
    if not lacing:
        return [end - at], at
    if at >= end:
        raise Malformed("no lace sizes")
    n, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % n:
            raise Malformed("fixed lacing")
        return [(end - at) // n] * n, at
    sizes = []
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                raise Malformed("lace sizes")
            sizes.append(size + data[at])
            at += 1
    else:
        for i in range(n - 1):
            v, width = _vint(data, at, False)
            sizes.append(v if not i else sizes[-1] + v - ((1 << 7 * width - 1) - 1))
            at += width
    last = end - at - sum(sizes)
    if last < 0 or any(s < 0 for s in sizes):
        raise Malformed("lace sizes")
    return [*sizes, last], at


def _block(movie: Movie, data: bytes, a: int, b: int, base: int, cluster: int, simple: bool) -> None:
    track, width = _vint(data, a, False)
    if a + width + 3 > b:
        raise Malformed(f"block at {a} is cut off")
    relative, flags = struct.unpack_from(">hB", data, a + width)
    lacing = flags >> 1 & 3
    sizes, at = lace_sizes(data, a + width + 3, b, lacing)
    time = (base + relative) * movie.scale
    if not -(1 << 62) < time < 1 << 62:
        raise Malformed(f"timestamp of the block at {a}")
    entry = movie.tracks.get(track, {})
    per_byte = entry.get("ns_per_byte", 0)
    done = 0
    for i, size in enumerate(sizes):
        ahead = min(done * per_byte if per_byte else i * entry.get("default_ns", 0), 1 << 61)
        movie.packets.append(Packet(track, time + int(ahead), at + done, size, cluster, bool(flags & 0x80) if simple else True, lacing))
        done += size


def _track(data: bytes, a: int, b: int) -> tuple[int, dict]:
    entry, n = {"codec": "", "type": 0}, 0
    for kind, _, s, e in children(data, a, b):
        if kind == TRACK_NUMBER:
            n = number(data, s, e)
        elif kind == TRACK_TYPE:
            entry["type"] = number(data, s, e)
        elif kind == CODEC:
            entry["codec"] = data[s:e].decode("ascii", "replace")
        elif kind == DEFAULT_DURATION:
            entry["default_ns"] = number(data, s, e)
        elif kind == AUDIO:
            for k, _, x, y in children(data, s, e):
                if k == RATE:
                    entry["rate"] = real(data, x, y)
                elif k in (CHANNELS, BITS):
                    entry["channels" if k == CHANNELS else "bits"] = number(data, x, y)
    bits = entry.get("rate", 0) * entry.get("channels", 1) * entry.get("bits", 8)
    if entry["codec"].startswith("A_PCM") and 0 < bits < float("inf"):
        entry["ns_per_byte"] = 8e9 / bits
    return n, entry


def _cluster(movie: Movie, data: bytes, start: int, at: int, end: int | None) -> int:
    """Read a cluster's blocks; returns where it ends."""
    base, stop = 0, len(data) if end is None else end
    position = start - movie.segment
    movie.clusters.append(position)
    while at < stop:
        for kind, e, a, b in children(data, at, stop):
            if end is None and kind in TOP_LEVEL:
                return e
            if b is None:
                raise Malformed("unknown size inside a cluster")
            if kind == TIMESTAMP:
                base = number(data, a, b)
            elif kind == SIMPLE_BLOCK:
                _block(movie, data, a, b, base, position, True)
            elif kind == BLOCK_GROUP:
                for k, _, x, y in children(data, a, b):
                    if k == BLOCK:
                        _block(movie, data, x, y, base, position, False)
        at = stop
    return stop


def parse(data: bytes) -> Movie:
    """Read a whole file; raises ``Malformed`` where lengths do not nest."""
    movie, at = Movie(), 0
    while at < len(data):
        kind, _, a, b = next(children(data, at, len(data)))
        if kind == EBML:
            for k, _, x, y in children(data, a, b):
                if k == DOC_TYPE:
                    movie.doc_type = data[x:y].decode("ascii", "replace")
        if kind != SEGMENT:
            if b is None:
                raise Malformed("unknown size at top level")
            at = b
            continue
        movie.segment, pos, end = a, a, len(data) if b is None else b
        while pos < end:
            kind, e, a, b = next(children(data, pos, end))
            if kind == CLUSTER:
                pos = _cluster(movie, data, e, a, b)
                continue
            if b is None:
                raise Malformed("unknown size")
            if kind == INFO:
                for k, _, x, y in children(data, a, b):
                    if k == TIMESTAMP_SCALE:
                        movie.scale = number(data, x, y)
                    elif k == DURATION:
                        movie.duration = real(data, x, y)
            elif kind == TRACKS:
                movie.tracks.update(_track(data, x, y) for k, _, x, y in children(data, a, b) if k == TRACK)
            elif kind == CUES:
                movie.cues += [_cue(data, x, y) for k, _, x, y in children(data, a, b) if k == CUE_POINT]
            pos = b
        at = end
    return movie


def _cue(data: bytes, a: int, b: int) -> tuple[int, int, int]:
    """(time, track, cluster position within the segment)."""
    time = track = place = 0
    for k, _, x, y in children(data, a, b):
        if k == CUE_TIME:
            time = number(data, x, y)
        elif k == CUE_POSITIONS:
            for j, _, p, q in children(data, x, y):
                if j == CUE_TRACK:
                    track = number(data, p, q)
                elif j == CUE_CLUSTER:
                    place = number(data, p, q)
    return time, track, place


def samples(data: bytes, movie: Movie, track: int = 1) -> bytes:
    """A track's frames one after another."""
    return b"".join(data[p.offset : p.offset + p.size] for p in movie.packets if p.track == track)
