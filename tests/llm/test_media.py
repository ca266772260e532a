import hashlib
import struct
import zlib

import pytest

from tessera.llm import media
from tessera.llm.queries import op8_media_columns


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 6400, 6464, 100_000])
def test_round_trip(size):
    payload = media.padded(bytes(i * 7 % 256 for i in range(size)))
    assert len(payload) % 64 == 0 and payload
    data = media.container(payload)
    assert media.stored_payload(data) == payload
    info = media.probed(data)
    frames = len(payload) // 64
    assert (info["codec"], info["timescale"], info["duration"], info["samples"], info["error"]) == ("raw ", 25, frames, frames, None)
    assert [r["at"] for r in info["ranges"]] == [data.index(b"mdat") + 12 + 64 * 25 * i for i in range(-(-frames // 25))]


def test_a_foreign_layout():
    """Chunks out of order, variable sizes, 32-bit offsets, no list of keyframes, boxes to the end of the file."""
    sizes, texts = [3, 5, 2], [b"abc", b"defgh", b"ij"]
    offsets = [8 + 2, 8]  # the first chunk (2 samples) lies behind the second (1 sample)
    mdat = media.box(b"mdat", texts[2] + texts[0] + texts[1])
    table = media.box(
        b"stbl",
        media.full_box(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(78))),
        media.full_box(b"stsz", struct.pack(">II3I", 0, 3, *sizes)),
        media.full_box(b"stsc", struct.pack(">I6I", 2, 1, 2, 1, 2, 1, 1)),
        media.full_box(b"stco", struct.pack(">I2I", 2, *offsets)),
    )
    track = media.box(b"trak", media.box(b"mdia", media.full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 1500, 0, 0)), media.box(b"minf", table)))
    tail = media.box(b"moov", track)
    data = mdat + struct.pack(">I", 0) + tail[4:]
    assert media.stored_payload(data) == b"abcdefghij"
    info = media.probed(data)
    assert (info["codec"], info["duration"], info["keyframes"]) == ("avc1", 1500, 3)
    assert info["ranges"] == [{"at": 10, "bytes": 3}, {"at": 13, "bytes": 5}, {"at": 8, "bytes": 2}]


def track(number, handler, codec, sizes, offsets=()):
    """A track of one sample a chunk, with its sizes in a stz2 box of 4-bit fields."""
    pairs = [*sizes, 0]
    table = media.box(
        b"stbl",
        media.full_box(b"stsd", struct.pack(">I", 1), media.box(codec, bytes(78))),
        media.full_box(b"stts", struct.pack(">3I", 1, len(sizes), 10)),
        media.full_box(b"stz2", bytes((0, 0, 0, 4)), struct.pack(">I", len(sizes)), bytes(pairs[i] << 4 | pairs[i + 1] for i in range(0, len(sizes), 2))),
        media.full_box(b"stsc", struct.pack(">4I", 1, 1, 1, 1) if sizes else bytes(4)),
        media.full_box(b"stco", struct.pack(f">{1 + len(offsets)}I", len(offsets), *offsets)),
    )
    head = media.full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 10 * len(sizes), 0, 0))
    return media.box(b"trak", media.full_box(b"tkhd", struct.pack(">IIIII", 0, 0, number, 0, 0)), media.box(b"mdia", head, media.full_box(b"hdlr", bytes(4), handler, bytes(13)), media.box(b"minf", table)))


def test_sound_before_picture():
    data = media.box(b"mdat", b"abcdefghij") + media.box(b"moov", track(1, b"soun", b"mp4a", [3, 2], [8, 14]), track(2, b"vide", b"avc1", [3, 1, 1], [11, 16, 17]))
    info = media.probed(data)
    assert (info["error"], info["handler"], info["codec"], info["samples"]) == (None, "soun", "mp4a", 2)
    (video,) = info["others"]
    assert (video["handler"], video["codec"], video["duration"], video["samples"]) == ("vide", "avc1", 30, 3)
    assert video["ranges"] == [{"at": 11, "bytes": 3}, {"at": 16, "bytes": 1}, {"at": 17, "bytes": 1}]
    assert (media.stored_payload(data), media.stored_payload(data, 1)) == (b"abcgh", b"defij")


def test_fragments():
    """A fragment with sizes and first flags of its own; one with a size from trex and an absolute base."""
    head = media.box(b"moov", track(7, b"vide", b"avc1", []), media.box(b"mvex", media.full_box(b"trex", struct.pack(">5I", 7, 1, 40, 2, 0x10000))))
    one = lambda at: media.box(b"moof", media.box(b"traf", media.full_box(b"tfhd", struct.pack(">I", 7), flags=0x20000), media.full_box(b"trun", struct.pack(">IiI2I", 2, at, 0, 3, 4), flags=0x205)))
    first = len(head) + len(one(0)) + 8
    second = first + 7
    two = lambda at: media.box(b"moof", media.box(b"traf", media.full_box(b"tfhd", struct.pack(">IQ", 7, at), flags=1), media.full_box(b"trun", struct.pack(">I", 2))))
    second += len(two(0)) + 8
    data = head + one(len(one(0)) + 8) + media.box(b"mdat", b"abcdefg") + two(second) + media.box(b"mdat", b"hijk")
    info = media.probed(data)
    assert (info["error"], info["samples"], info["keyframes"], info["duration"]) == (None, 4, 1, 160)
    assert info["ranges"] == [{"at": first, "bytes": 3}] and media.stored_payload(data) == b"abcdefghijk"
    assert media.probed(data[:-1])["error"] and media.stored_payload(data[:-1]) is None


@pytest.mark.parametrize("data", [None, b"", b"x", b"\x00" * 40, b"\xff" * 64, media.box(b"moov", media.box(b"trak", b"")), media.container(bytes(128))[:-100], struct.pack(">I4sQ", 1, b"mdat", 1 << 60)])
def test_malformed_media(data):
    info = media.probed(data)
    assert info["error"] and info["codec"] is None and info["ranges"] == []


def test_columns(spark):
    df = spark.createDataFrame([(1, b"ab", "k"), (2, None, "k"), (3, b"ab", "k")], "id long, payload binary, info string")
    got = media.read_back(media.probe(media.store(df))).orderBy("id").collect()
    assert [r["payload"] for r in got] == [b"ab" + bytes(62), bytes(64), b"ab" + bytes(62)]
    assert got[0]["media"] == got[2]["media"] and got[0]["info"]["keyframes"] == 1
    assert media.probe(media.store(df.limit(0))).count() == 0


def test_query(spark, sf):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_media_columns(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = media.padded(docs[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(docs[r["doc_id"]]), len(want), zlib.crc32(want[-64:]))
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest() and r["media_sha256"] == hashlib.sha256(media.container(want)).hexdigest()
