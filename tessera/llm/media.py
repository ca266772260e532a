"""Media columns: bytes stored in ISO media containers, and a reader of nested boxes and sample tables.

`store` writes each payload as a track of raw 8 x 8 grey frames of 8-bit samples, so it is kept losslessly.
`probe` walks the boxes of any ISO media file in a binary column and decodes its sample tables into codec,
duration and the byte ranges of keyframes; it reads tables only and never decodes a payload. The first track's are
the struct's own fields, those of the others come in `others`. Sizes may be in stsz or stz2; samples of movie
fragments (moof, traf, trun) follow those of the movie's own tables.

Defined cases: a null payload is the empty one; payloads are padded by bytes 0 up to a positive multiple of the
frame size; null or malformed media give a null codec and no ranges, with the reason in `error`; equal bytes give
equal media; an empty table gives an empty table; other columns pass through, and input columns named like the
output's are replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import arrow_map, with_columns

#: Bytes of a stored frame (8 x 8 samples of 8 bits), frames a second, frames from one keyframe to the next, frames in a chunk.
FRAME_BYTES, FRAME_RATE, KEY_INTERVAL, CHUNK_FRAMES = 64, 25, 25, 100
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
#: The identity matrix of the movie and track headers.
MATRIX = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)

#: What is read of each track.
TRACK = [
    T.StructField("codec", T.StringType()),
    T.StructField("timescale", T.LongType()),
    T.StructField("duration", T.LongType()),
    T.StructField("samples", T.LongType()),
    T.StructField("keyframes", T.LongType()),
    T.StructField("ranges", T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("bytes", T.LongType())]))),
    T.StructField("handler", T.StringType()),
]
MEDIA = T.StructType([*TRACK, T.StructField("others", T.ArrayType(T.StructType(TRACK))), T.StructField("error", T.StringType())])


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full_box(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def padded(payload: bytes) -> bytes:
    """The payload with bytes 0 up to a positive multiple of the frame size."""
    return payload + bytes(FRAME_BYTES - len(payload) % FRAME_BYTES if len(payload) % FRAME_BYTES or not payload else 0)


def container(payload: bytes) -> bytes:
    """A movie of one track of raw grey frames; payload is a positive multiple of the frame size."""
    frames = len(payload) // FRAME_BYTES
    chunks, rest = divmod(frames, CHUNK_FRAMES)
    runs = ([(1, CHUNK_FRAMES, 1)] if chunks else []) + ([(chunks + 1, rest, 1)] if rest else [])
    keys = range(1, frames + 1, KEY_INTERVAL)
    head = box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))

    def movie(first: int) -> bytes:
        offsets = [first + i * CHUNK_FRAMES * FRAME_BYTES for i in range(chunks + bool(rest))]
        table = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, frames, 1)),
            full_box(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full_box(b"stsz", struct.pack(">II", FRAME_BYTES, frames)),
            full_box(b"co64", struct.pack(f">I{len(offsets)}Q", len(offsets), *offsets)),
        )
        data = box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1)))
        media = box(b"mdia", full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, FRAME_RATE, frames, 0x55C4, 0)), full_box(b"hdlr", bytes(4), b"vide", bytes(13)), box(b"minf", full_box(b"vmhd", bytes(8), flags=1), data, table))
        track = box(b"trak", full_box(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(16), MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=7), media)
        return box(b"moov", full_box(b"mvhd", struct.pack(">IIIIIH", 0, 0, FRAME_RATE, frames, 1 << 16, 1 << 8), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2)), track)

    first = len(head) + len(movie(0)) + 16
    return b"".join((head, movie(first), struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)), payload))


def boxes(data: memoryview, at: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, first byte, end) of the content of each box, parents before their children."""
    while at + 8 <= end:
        length, kind = struct.unpack_from(">I4s", data, at)
        header = 8
        if length == 1:
            if at + 16 > end:
                raise ValueError("a large box is cut off")
            (length,), header = struct.unpack_from(">Q", data, at + 8), 16
        elif length == 0:
            length = end - at
        if length < header or at + length > end:
            raise ValueError(f"box {kind!r} reaches beyond its parent")
        yield (*path, kind), at + header, at + length
        if kind in CONTAINERS:
            yield from boxes(data, at + header, at + length, (*path, kind))
        at += length


def numbers(data: memoryview, at: int, end: int, kind: str, columns: int = 1) -> np.ndarray:
    """The rows of a table whose count stands before it."""
    (count,) = struct.unpack_from(">I", data, at)
    width = np.dtype(kind).itemsize * columns
    if at + 4 + count * width > end:
        raise ValueError("a table is cut off")
    return np.frombuffer(data, kind, count * columns, at + 4).astype(np.int64).reshape(count, columns)


def tracks(data: bytes) -> list[dict]:
    """The tables of each track by box kind: content positions, grouped as the trak boxes come."""
    view, found = memoryview(data), []
    for path, at, end in boxes(view, 0, len(view)):
        if path[-1] == b"trak":
            found.append({})
        elif b"trak" in path and found:
            found[-1].setdefault(path[-1], (at, end))
    return found


def compact_sizes(view: memoryview, at: int, end: int) -> np.ndarray:
    """The sizes in a stz2 box: fields of 4, 8 or 16 bits."""
    bits, (count,) = view[at + 7], struct.unpack_from(">I", view, at + 8)
    if bits not in (4, 8, 16) or at + 12 + (count * bits + 7) // 8 > end:
        raise ValueError("a table is cut off")
    if bits == 4:
        pairs = np.frombuffer(view, np.uint8, (count + 1) // 2, at + 12)
        return np.stack([pairs >> 4, pairs & 15], 1).ravel()[:count].astype(np.int64)
    return np.frombuffer(view, ">u2" if bits == 16 else np.uint8, count, at + 12).astype(np.int64)


def fragments(data: bytes) -> dict[int, list[tuple[int, int, int, int]]]:
    """(offset, size, duration, flags) of the samples in movie fragments, by track id."""
    view, defaults, found = memoryview(data), {}, {}
    word = lambda at: struct.unpack_from(">I", view, at)[0]
    track = base = start = following = 0
    given = [0, 0, 0]
    for path, at, end in boxes(view, 0, len(view)):
        kind = path[-1]
        if kind == b"trex":
            defaults[word(at + 4)] = struct.unpack_from(">III", view, at + 12)
        elif kind == b"moof":
            start = following = at - 8 if bytes(view[at - 4 : at]) == kind else at - 16
        elif kind == b"tfhd":
            flags, track = word(at) & 0xFFFFFF, word(at + 4)
            at += 8
            base = start if flags & 0x20000 else following
            if flags & 1:
                (base,) = struct.unpack_from(">Q", view, at)
                at += 8
            at += 4 * bool(flags & 2)
            given = list(defaults.get(track, (0, 0, 0)))
            for i, flag in enumerate((8, 16, 32)):
                if flags & flag:
                    given[i] = word(at)
                    at += 4
            following = base
            found.setdefault(track, [])
        elif kind == b"trun":
            flags, count = word(at) & 0xFFFFFF, word(at + 4)
            at += 8
            if flags & 1:
                following = base + struct.unpack_from(">i", view, at)[0]
                at += 4
            first = None
            if flags & 4:
                first = word(at)
                at += 4
            width = 4 * sum(bool(flags & f) for f in (0x100, 0x200, 0x400, 0x800))
            if count > len(data) or at + count * width > end:
                raise ValueError("a table is cut off")
            for n in range(count):
                row = list(given)
                for i, flag in enumerate((0x100, 0x200, 0x400)):
                    if flags & flag:
                        row[i] = word(at)
                        at += 4
                at += 4 * bool(flags & 0x800)
                if not n and first is not None:
                    row[2] = first
                if following < 0 or following + row[1] > len(data):
                    raise ValueError("samples lie beyond the file")
                found[track].append((following, row[1], row[0], row[2]))
                following += row[1]
    return found


def samples(data: bytes, track: dict) -> tuple[np.ndarray, np.ndarray]:
    """File offset and size of every sample, by chunk offsets, samples a chunk and sample sizes."""
    view = memoryview(data)
    if b"stsz" in track:
        at, end = track[b"stsz"]
        fixed, count = struct.unpack_from(">II", view, at + 4)
        if fixed and count > len(data):
            raise ValueError("more samples than bytes")
        sizes = np.full(count, fixed, np.int64) if fixed else numbers(view, at + 8, end, ">u4")[:, 0]
    else:
        sizes = compact_sizes(view, *track[b"stz2"])
        count = len(sizes)
    large = b"co64" in track
    at, end = track[b"co64" if large else b"stco"]
    chunks = numbers(view, at + 4, end, ">u8" if large else ">u4")[:, 0]
    at, end = track[b"stsc"]
    runs = numbers(view, at + 4, end, ">u4", 3)
    spans = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    if (spans < 0).any() or int((spans * runs[:, 1]).sum()) != count:
        raise ValueError("chunks don't hold as many samples as there are")
    of_chunk = np.repeat(np.arange(len(chunks)), np.repeat(runs[:, 1], spans))
    before = np.cumsum(sizes) - sizes
    firsts = np.searchsorted(of_chunk, np.arange(len(chunks)))
    offsets = chunks[of_chunk] + before - before[firsts][of_chunk] if count else before
    if count and (int((offsets + sizes).max()) > len(data) or int(offsets.min()) < 0):
        raise ValueError("samples lie beyond the file")
    return offsets, sizes


def key_samples(data: bytes, track: dict, count: int) -> np.ndarray:
    """Indexes of the samples that can be decoded alone: those listed, or all where no list is."""
    if b"stss" not in track:
        return np.arange(count)
    at, end = track[b"stss"]
    keys = numbers(memoryview(data), at + 4, end, ">u4")[:, 0] - 1
    if len(keys) and (keys.min() < 0 or keys.max() >= count):
        raise ValueError("a keyframe isn't a sample")
    return keys


def all_samples(data: bytes, track: dict, found: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int | None]:
    """Offset and size of every sample of a track, indexes of keyframes, and the duration where fragments add to it."""
    at = track[b"tkhd"][0] if found else 0
    parts = found.get(struct.unpack_from(">I", data, at + (20 if data[at] else 12))[0], []) if found else []
    offsets, sizes = samples(data, track)
    keys = key_samples(data, track, len(sizes))
    if not parts:
        return offsets, sizes, keys, None
    more = np.array(parts, np.int64)
    keys = np.concatenate([keys, len(sizes) + np.flatnonzero(more[:, 3] & 0x10000 == 0)])
    at, end = track[b"stts"]
    times = numbers(memoryview(data), at + 4, end, ">u4", 2)
    return np.concatenate([offsets, more[:, 0]]), np.concatenate([sizes, more[:, 1]]), keys, int(times.prod(axis=1).sum() + more[:, 2].sum())


def probed_track(data: bytes, track: dict, found: dict) -> dict:
    at = track[b"stsd"][0]
    (codec,) = struct.unpack_from("4s", data, at + 12)
    at = track[b"mdhd"][0]
    scale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    handler = struct.unpack_from("4s", data, track[b"hdlr"][0] + 8)[0].decode("latin-1") if b"hdlr" in track else None
    offsets, sizes, keys, lasting = all_samples(data, track, found)
    ranges = [{"at": int(a), "bytes": int(n)} for a, n in zip(offsets[keys], sizes[keys])]
    return {"codec": codec.decode("latin-1"), "timescale": scale, "duration": duration if lasting is None else lasting, "samples": len(sizes), "keyframes": len(keys), "ranges": ranges, "handler": handler}


def probed(data: bytes | None) -> dict:
    """The MEDIA of one file."""
    empty = dict.fromkeys(MEDIA.names) | {"ranges": [], "others": []}
    if data is None:
        return empty | {"error": "no media"}
    try:
        found = tracks(data)
        if not found:
            return empty | {"error": "no track"}
        parts = fragments(data)
        first, *others = (probed_track(data, t, parts) for t in found)
    except (ValueError, struct.error, KeyError, IndexError) as e:
        return empty | {"error": f"{type(e).__name__}: {e}"}
    return first | {"others": others, "error": None}


def stored_payload(data: bytes | None, track: int = 0) -> bytes | None:
    """The bytes of all samples of a track, in order; null for malformed media."""
    try:
        offsets, sizes, _, _ = all_samples(data, tracks(data)[track], fragments(data))
    except (ValueError, struct.error, KeyError, IndexError, TypeError):
        return None
    if not len(offsets):
        return b""
    ends = offsets + sizes
    breaks = [0, *(np.flatnonzero(offsets[1:] != ends[:-1]) + 1).tolist(), len(offsets)]
    return b"".join(data[offsets[a] : ends[b - 1]] for a, b in pairwise(breaks))


def _fields(df: DataFrame, *new: T.StructField, drop: str = "") -> T.StructType:
    names = {f.name for f in new} | {drop}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + list(new))


def store(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """df with its binary payload column replaced by the stored form."""
    schema = _fields(df, T.StructField(media, T.BinaryType()), drop=payload)

    def run(b: pa.RecordBatch):
        made = [container(padded(x or b"")) for x in b.column(payload).to_pylist()]
        return with_columns(b, **{media: pa.array(made, pa.binary())}).select(schema.names)

    return arrow_map(df, schema, run)


def probe(df: DataFrame, media: str = "media", info: str = "info") -> DataFrame:
    """df with the MEDIA struct of its binary column."""
    schema = _fields(df, T.StructField(info, MEDIA))

    def run(b: pa.RecordBatch):
        from pyspark.sql.pandas.types import to_arrow_type

        found = [probed(x) for x in b.column(media).to_pylist()]
        return with_columns(b, **{info: pa.array(found, to_arrow_type(MEDIA))}).select(schema.names)

    return arrow_map(df, schema, run)


def read_back(df: DataFrame, media: str = "media", payload: str = "payload", track: int = 0) -> DataFrame:
    """df with the bytes that a track's samples hold; the stored form has one track."""
    schema = _fields(df, T.StructField(payload, T.BinaryType()))

    def run(b: pa.RecordBatch):
        found = [stored_payload(x, track) for x in b.column(media).to_pylist()]
        return with_columns(b, **{payload: pa.array(found, pa.binary())}).select(schema.names)

    return arrow_map(df, schema, run)
