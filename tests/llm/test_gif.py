"""GIF round trips, and files that the encoder does not make."""

import random
import struct
import zlib

import numpy as np

from sheaf.llm import gif
from tests.llm.conftest import sha


def test_round_trips():
    rng = random.Random(6)
    for _ in range(60):
        raw = gif.pad64(bytes(rng.choices(range(rng.choice([1, 2, 4, 256])), k=rng.randrange(0, 90_000))))
        assert b"".join(f["samples"] for f in gif.decode(gif.encode(raw))) == raw
    assert gif.pad64(b"") == bytes(64) and len(gif.pad64(b"x" * 64)) == 64 and len(gif.pad64(b"x" * 65)) == 128


def small(frames, colours=4, background=0):
    """A GIF of 4 x 4 pixels; frames are (samples, disposal, transparent, interlaced, box)."""
    table = bytes(v for i in range(colours) for v in (i * 10, i, 255 - i))
    out = b"GIF89a" + struct.pack("<HHBBB", 4, 4, 0x80 | 1, background, 0) + table
    for px, disposal, clear, laced, (x, y, w, h) in frames:
        codes, bits = [4, *[c for p in px for c in (p, 4)], 5], ""
        bits = "".join(format(c, "03b")[::-1] for c in codes)
        stream = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), 7, clear or 0) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", x, y, w, h, 0x40 if laced else 0) + b"\x02" + gif._blocks(stream)
    return out + b";"


def test_disposal_transparency_and_interlace():
    whole, part = (0, 0, 4, 4), (1, 1, 2, 2)
    data = small([([1] * 16, 1, None, False, whole), ([2, 0, 2, 2], 2, 0, False, part), ([3] * 4, 3, None, False, (0, 0, 2, 2)), ([2] * 4, 1, None, False, (2, 2, 2, 2))])
    shots = [(f["index"], f["delay_ms"], f["rgb"][:, :, 1].copy()) for f in gif.decode(data)]
    assert [s[:2] for s in shots] == [(i, 70) for i in range(4)]
    assert shots[1][2].tolist() == [[1, 1, 1, 1], [1, 2, 1, 1], [1, 2, 2, 1], [1, 1, 1, 1]]
    assert shots[2][2].tolist() == [[3, 3, 1, 1], [3, 3, 0, 1], [1, 0, 0, 1], [1, 1, 1, 1]]
    assert shots[3][2].tolist() == [[1, 1, 1, 1], [1, 0, 0, 1], [1, 0, 2, 2], [1, 1, 2, 2]]
    laced = next(iter(gif.decode(small([([0] * 4 + [1] * 4 + [2] * 4 + [3] * 4, 1, None, True, whole)]))))
    assert laced["rgb"][:, 0, 1].tolist() == [0, 2, 1, 3]


def test_damaged_streams_end():
    raw = gif.encode(gif.pad64(b"hello world " * 50))
    for cut in range(0, len(raw), 37):
        try:
            list(gif.decode(raw[:cut]))
        except (struct.error, IndexError, ValueError):
            pass
    assert list(gif.decode(b"not a gif")) == []


def test_query_columns(spark, odd, empty):
    media = gif.store_media(odd)
    rows = gif.read_media(media).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        if r["doc_id"] is None or r["doc_id"] == 8:
            continue
        raw = gif.pad64((texts[r["doc_id"]] or "").encode())
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), sha(raw), zlib.crc32(raw[-64:]))
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["media_sha256"] == by[2]["media_sha256"] and by[1]["feature"] == by[2]["feature"] and by[4]["n_bytes"] == 0
    frames = gif.frames(media.where("doc_id = 10")).orderBy("frame").collect()
    assert [f["start_ms"] for f in frames] == [0, 100] and b"".join(bytes(f["samples"]) for f in frames) == gif.pad64(b"a" * 70_000)
    assert [sum(f["histogram"]) for f in frames] == [64 * 1024] * 2  # of the whole canvas, as shown
    assert gif.read_media(gif.store_media(empty)).count() == 0
    assert np.array_equal(gif.colour_histogram(np.zeros((2, 2, 3), np.uint8))[:1], [4])
