"""Media columns: Matroska written and parsed into packet tables.

The reader walks variable-length EBML elements (unknown sizes included), enters
segments, clusters and block groups, undoes Xiph, EBML and fixed lacing, and
gives one packet per frame with track, timestamp, byte range and flags, plus
track and cue tables.  The writer stores 8-bit samples as one PCM track.

Defined results: a null or empty text is stored as one unit of spaces; bytes
that are not Matroska, or end inside an element, give an error message in place
of packets and never fail the job; texts of any length are stored whole; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import batches_of, materialize, text_ids, typed_ids

# Element ids of the format.
EBML, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID_LENGTH, EBML_MAX_SIZE_LENGTH = 0x4286, 0x42F7, 0x42F2, 0x42F3
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83
FLAG_LACING, DEFAULT_DURATION, CODEC_ID, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x9C, 0x23E383, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

UNIT = 192  # samples a stored text is padded to a multiple of
FRAME = 5 * UNIT  # samples of a frame
LACE = 8  # frames of a block at most
CLUSTER_BLOCKS = 32  # blocks of a cluster; 32 * 8 frames of 120 ms stay within 16-bit block times
RATE = 8000
UNKNOWN = -1


class MatroskaError(ValueError):
    """The bytes are not well-formed."""


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    offset: int
    size: int
    cluster: int
    block: int
    lace: int
    keyframe: bool


@dataclass
class Media:
    doc_type: str = ""
    timestamp_scale: int = 1_000_000
    tracks: list[dict] = field(default_factory=list)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time in ns, track, cluster's byte offset
    clusters: int = 0
    blocks: int = 0
    segment_start: int = 0


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """Value and next position of a variable-length integer; all ones: ``UNKNOWN``."""
    if at >= len(data):
        raise MatroskaError(f"ends at {at} before a number")
    first = data[at]
    length = 9 - first.bit_length()
    if length > 8 or at + length > len(data):
        raise MatroskaError(f"bad number at {at}")
    value = int.from_bytes(data[at : at + length], "big")
    if keep_marker:
        return value, at + length
    value &= (1 << (7 * length)) - 1
    return (UNKNOWN if value == (1 << (7 * length)) - 1 else value), at + length


def write_vint(value: int, length: int = 0) -> bytes:
    """A number in the fewest bytes (or ``length``) that do not read as unknown."""
    length = length or next(n for n in range(1, 9) if value < (1 << (7 * n)) - 1)
    return (value | 1 << (7 * length)).to_bytes(length, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + write_vint(len(body)) + body


def _uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Id, body start and body end of the elements in a range.  A body of unknown size reaches to ``end``."""
    while at < end:
        ident, at = read_vint(data, at, keep_marker=True)
        size, at = read_vint(data, at)
        stop = end if size == UNKNOWN else at + size
        if stop > end:
            raise MatroskaError(f"element {ident:x} ends at {stop}, beyond {end}")
        yield ident, at, stop
        at = stop


def lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Frame sizes of a laced block body and where the first frame starts.  ``kind``: 1 Xiph, 2 fixed, 3 EBML."""
    if at >= end:
        raise MatroskaError(f"lace without frames at {at}")
    count, at = data[at] + 1, at + 1
    if kind == 2:
        if (end - at) % count:
            raise MatroskaError(f"fixed lace of {end - at} bytes in {count} frames")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    for i in range(count - 1):
        if kind == 1:
            size = 0
            while True:
                if at >= end:
                    raise MatroskaError("lace sizes end early")
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
        elif i == 0:
            size, at = read_vint(data, at)
        else:
            start = at
            raw, at = read_vint(data, at)
            width = 7 * (at - start)
            raw = (1 << width) - 1 if raw == UNKNOWN else raw
            size = sizes[-1] + raw - ((1 << (width - 1)) - 1)
        sizes.append(size)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise MatroskaError("lace sizes beyond their block")
    return [*sizes, last], at


def _write_lace(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing kind and body: none for one frame, fixed for equal ones, EBML for others."""
    if len(frames) == 1:
        return 0, frames[0]
    head = bytes([len(frames) - 1])
    if len({len(f) for f in frames}) == 1:
        return 2, head + b"".join(frames)
    sizes = [len(f) for f in frames]
    coded = write_vint(sizes[0])
    for a, b in zip(sizes, sizes[1:-1]):
        width = next(n for n in range(1, 9) if abs(b - a) < (1 << (7 * n - 1)) - 1)
        coded += write_vint(b - a + (1 << (7 * width - 1)) - 1, width)
    return 3, head + coded + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """8-bit samples as a file with one PCM track; equal samples give equal bytes."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    header = element(
        EBML,
        _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID_LENGTH, 4) + _uint(EBML_MAX_SIZE_LENGTH, 8)
        + element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2),
    )
    info = element(
        INFO,
        _uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE))
        + element(MUXING_APP, b"wayfare") + element(WRITING_APP, b"wayfare"),
    )
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    track = element(
        TRACK_ENTRY,
        _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1)
        + _uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio,
    )
    parts = [info, element(TRACKS, track)]
    position, cues = sum(map(len, parts)), []
    step = FRAME * 1000 // RATE
    for first in range(0, len(frames), LACE * CLUSTER_BLOCKS):
        start = first * step
        body = [_uint(TIMESTAMP, start)]
        for at in range(first, min(first + LACE * CLUSTER_BLOCKS, len(frames)), LACE):
            kind, laced = _write_lace(frames[at : min(at + LACE, first + LACE * CLUSTER_BLOCKS)])
            body.append(element(SIMPLE_BLOCK, write_vint(1) + struct.pack(">hB", at * step - start, 0x80 | kind << 1) + laced))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, position))))
        parts.append(element(CLUSTER, b"".join(body)))
        position += len(parts[-1])
    return header + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


def _number(data: bytes, at: int, end: int) -> int:
    value = int.from_bytes(data[at:end], "big")
    if value >> 62:
        raise MatroskaError(f"number beyond 62 bits at {at}")
    return value


def _float(data: bytes, at: int, end: int) -> float:
    if end - at not in (0, 4, 8):
        raise MatroskaError(f"float of {end - at} bytes")
    return 0.0 if end == at else struct.unpack(">f" if end - at == 4 else ">d", data[at:end])[0]


def _track(data: bytes, at: int, end: int) -> dict:
    out = {"number": 0, "type": 0, "codec": "", "default_duration_ns": 0, "rate": 0.0, "channels": 1, "bits": 0}
    for ident, a, z in elements(data, at, end):
        if ident == TRACK_NUMBER:
            out["number"] = _number(data, a, z)
        elif ident == TRACK_TYPE:
            out["type"] = _number(data, a, z)
        elif ident == CODEC_ID:
            out["codec"] = data[a:z].decode("ascii", "replace")
        elif ident == DEFAULT_DURATION:
            out["default_duration_ns"] = _number(data, a, z)
        elif ident == AUDIO:
            for inner, b, y in elements(data, a, z):
                if inner == SAMPLING_FREQUENCY:
                    out["rate"] = _float(data, b, y)
                elif inner == CHANNELS:
                    out["channels"] = _number(data, b, y)
                elif inner == BIT_DEPTH:
                    out["bits"] = _number(data, b, y)
    return out


def _block(data: bytes, at: int, end: int, base: int, media: Media, keyframe: bool | None, durations: dict[int, int]) -> None:
    track, at = read_vint(data, at)
    if at + 3 > end:
        raise MatroskaError(f"block header ends at {end}")
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags >> 1 & 3
    sizes, at = ([end - at], at) if not kind else lace_sizes(data, at, end, kind)
    stamp = (base + relative) * media.timestamp_scale
    if not -(1 << 62) < stamp + len(sizes) * durations.get(track, 0) < 1 << 62:
        raise MatroskaError(f"timestamp beyond 62 bits at {at}")
    for lace, size in enumerate(sizes):
        key = bool(flags & 0x80) if keyframe is None else keyframe
        media.packets.append(Packet(track, stamp + lace * durations.get(track, 0), at, size, media.clusters - 1, media.blocks, lace, key))
        at += size
    media.blocks += 1


_IN_SEGMENT = (INFO, TRACKS, CLUSTER, CUES)


def parse(data: bytes) -> Media:
    """All tracks, packets and cues of a file."""
    media = Media()
    seen_header = False
    for ident, at, end in elements(data, 0, len(data)):
        if ident == EBML:
            seen_header = True
            for inner, a, z in elements(data, at, end):
                if inner == DOC_TYPE:
                    media.doc_type = data[a:z].decode("ascii", "replace")
        elif not seen_header:
            raise MatroskaError("no header")
        elif ident == SEGMENT:
            media.segment_start = at
            _segment(data, at, end, media)
    if not seen_header:
        raise MatroskaError("no header")
    return media


def _segment(data: bytes, at: int, end: int, media: Media) -> None:
    durations: dict[int, int] = {}
    while at < end:
        start = at
        ident, at = read_vint(data, at, keep_marker=True)
        size, at = read_vint(data, at)
        stop = end if size == UNKNOWN else at + size
        if stop > end:
            raise MatroskaError(f"element {ident:x} ends at {stop}, beyond {end}")
        if ident == INFO:
            for inner, a, z in elements(data, at, stop):
                if inner == TIMESTAMP_SCALE:
                    media.timestamp_scale = _number(data, a, z)
        elif ident == TRACKS:
            media.tracks += [_track(data, a, z) for inner, a, z in elements(data, at, stop) if inner == TRACK_ENTRY]
            durations = {t["number"]: t["default_duration_ns"] for t in media.tracks}
        elif ident == CLUSTER:
            media.clusters += 1
            stop = _cluster(data, at, stop, size == UNKNOWN, media, durations)
        elif ident == CUES:
            for inner, a, z in elements(data, at, stop):
                if inner == CUE_POINT:
                    _cue(data, a, z, media)
        at = stop
        if at <= start:
            raise MatroskaError(f"no progress at {at}")


def _cluster(data: bytes, at: int, end: int, open_ended: bool, media: Media, durations: dict[int, int]) -> int:
    """Reads a cluster and returns where it ends; one of unknown size ends before the next element of its parent."""
    base = 0
    while at < end:
        ident, body = read_vint(data, at, keep_marker=True)
        if open_ended and ident in _IN_SEGMENT:
            return at
        size, body = read_vint(data, body)
        stop = end if size == UNKNOWN else body + size
        if stop > end:
            raise MatroskaError(f"element {ident:x} ends at {stop}, beyond {end}")
        if ident == TIMESTAMP:
            base = _number(data, body, stop)
        elif ident == SIMPLE_BLOCK:
            _block(data, body, stop, base, media, None, durations)
        elif ident == BLOCK_GROUP:
            inside = list(elements(data, body, stop))
            key = all(i != REFERENCE_BLOCK for i, _, _ in inside)
            for inner, a, z in inside:
                if inner == BLOCK:
                    _block(data, a, z, base, media, key, durations)
        at = stop
    return end


def _cue(data: bytes, at: int, end: int, media: Media) -> None:
    time, places = 0, []
    for ident, a, z in elements(data, at, end):
        if ident == CUE_TIME:
            time = _number(data, a, z)
        elif ident == CUE_TRACK_POSITIONS:
            track = position = 0
            for inner, b, y in elements(data, a, z):
                if inner == CUE_TRACK:
                    track = _number(data, b, y)
                elif inner == CUE_CLUSTER_POSITION:
                    position = _number(data, b, y)
            places.append((track, position))
    if time * media.timestamp_scale >> 62 or any((media.segment_start + p) >> 62 for _, p in places):
        raise MatroskaError("cue beyond 62 bits")
    media.cues += [(time * media.timestamp_scale, t, media.segment_start + p) for t, p in places]


def samples(data: bytes, media: Media, track: int) -> bytes:
    """The stored samples of a track, read from its packets' byte ranges."""
    return b"".join(data[p.offset : p.offset + p.size] for p in media.packets if p.track == track)


def feature(media: Media, payload: bytes) -> str:
    """What the packets and samples look like, as one short string."""
    x = np.frombuffer(payload, dtype=np.uint8)
    mean = float(x.mean()) if len(x) else 0.0
    rms = float(np.sqrt(np.mean((x.astype(np.float32) - mean) ** 2))) if len(x) else 0.0
    crossings = int(np.count_nonzero(np.diff(x > mean))) if len(x) else 0
    last = media.packets[-1].timestamp_ns // 1_000_000 if media.packets else 0
    codec = media.tracks[0]["codec"] if media.tracks else ""
    return f"{codec} clusters={media.clusters} blocks={media.blocks} packets={len(media.packets)} cues={len(media.cues)} last_ms={last} mean={mean:.2f} rms={rms:.2f} crossings={crossings}"


def store_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media`` with every text stored as a file, written to the shared folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_bytes": [len(b) for b in raw],
                    "media": [mux(b + b" " * (UNIT * max(1, -(-len(b) // UNIT)) - len(b))) for b in raw],
                }
            )

    with batches_of(docs.sparkSession, 1_000):
        return materialize(typed_ids(text_ids(docs.select("doc_id", "text")).mapInPandas(run, "doc_id string, n_bytes long, media binary"), docs), "media")


PACKET_SCHEMA = (
    "error string, doc_type string, tracks array<struct<number:long,type:long,codec:string,default_duration_ns:long,rate:double,channels:long,bits:long>>, "
    "packets array<struct<track:long,timestamp_ns:long,offset:long,size:long,cluster:int,block:int,lace:int,keyframe:boolean>>, "
    "cues array<struct<time_ns:long,track:long,cluster_offset:long>>"
)


def packet_table(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a file with its track, packet and cue tables, or the error that stopped the reader."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, data in zip(batch[key], batch["media"]):
                try:
                    m = parse(bytes(data if data is not None else b""))
                    rows.append((k, None, m.doc_type, m.tracks, [vars(p) for p in m.packets], [dict(time_ns=a, track=b, cluster_offset=c) for a, b, c in m.cues]))
                except MatroskaError as e:
                    rows.append((k, str(e), None, [], [], []))
            yield pd.DataFrame(rows, columns=[key, "error", "doc_type", "tracks", "packets", "cues"])

    return typed_ids(text_ids(media.select(key, "media"), key).mapInPandas(run, f"{key} string, {PACKET_SCHEMA}"), media, key)


def read_back(stored: DataFrame) -> DataFrame:
    """Digests and features of stored files, from the bytes their packets point at; nulls for a file that cannot be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, n_bytes, data in zip(batch["doc_id"], batch["n_bytes"], batch["media"]):
                try:
                    m = parse(bytes(data if data is not None else b""))
                    if not m.tracks:
                        raise MatroskaError("no track")
                    payload = samples(data, m, m.tracks[0]["number"])
                except MatroskaError:
                    rows.append((doc_id, n_bytes, None, None, None, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), None))
                    continue
                rows.append(
                    (doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(m, payload))
                )
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            yield out.astype({"payload_bytes": "Int64", "tail_crc32": "Int64", "media_bytes": "Int64"})

    found = text_ids(stored.select("doc_id", "n_bytes", "media")).mapInPandas(
        run, "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    return typed_ids(found, stored)
