"""GIF media columns: whole payloads as timed 8-bit frames, read back through a real decoder.

``encode`` writes an animated GIF89a: a grey palette, one frame for each 64 x 1024 samples, LZW
code streams.  ``decode`` reads any GIF of that format: global and local palettes, interlacing,
transparency, delays and all disposal methods.

Nulls and odd input: a null text counts as empty; an empty text is one row of zeros.  Very long
texts become more frames, which are coded and decoded one after another; a document's payload and
file are held whole, and rows are taken in slices of about a MiB.  Equal texts give equal files.  Bytes that are not a GIF decode to no frames.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sheaf.llm.common import stored
from sheaf.llm.wordpos import lean, row_groups

WIDTH, FRAME_ROWS, DELAY_CS = 64, 1024, 10
CLEAR, END, FIRST = 256, 257, 258
#: Codes between two clear codes once the 4096 entries are used up, and the widths they have.
SEGMENT = 4096 - FIRST + 1


def _widths(root: int) -> list[tuple[int, int]]:
    """(width, codes) runs after a clear code, for a root of ``root`` bits; the last run is open."""
    runs, at, width = [], 0, root + 1
    first = (1 << root) + 2
    while width < 12:
        until = (1 << width) - first + 1
        runs.append((width, until - at))
        at, width = until, width + 1
    return [*runs, (12, 1 << 62)]


RUNS = {root: _widths(root) for root in range(2, 9)}


def _segment_codes(data: bytes, at: int) -> tuple[list[int], int]:
    """Codes of one segment from ``data[at:]`` and where the next segment starts."""
    table: dict[int, int] = {}
    get, codes, n = table.get, [], FIRST
    push = codes.append
    w = data[at]
    for i in range(at + 1, len(data)):
        b = data[i]
        key = w << 8 | b
        c = get(key)
        if c is not None:
            w = c
            continue
        push(w)
        if n < 4096:
            table[key] = n
            n += 1
            w = b
        elif len(codes) == SEGMENT:
            return codes, i
        else:
            w = b
    push(w)
    return codes, len(data)


def _bits(codes: list[int], runs: list[tuple[int, int]]) -> list[np.ndarray]:
    raw, at, parts = np.array(codes, dtype="<u2"), 0, []
    for width, n in runs:
        part = raw[at : at + n]
        if not part.size:
            break
        parts.append(np.unpackbits(part.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")[:, :width].reshape(-1))
        at += len(part)
    return parts


def lzw_encode(data: bytes) -> bytes:
    """LZW code stream of 8-bit samples; the table is cleared whenever it is full."""
    parts, at = _bits([CLEAR], RUNS[8]), 0
    while at < len(data):
        codes, at = _segment_codes(data, at)
        parts += _bits([*codes, CLEAR if at < len(data) else END], RUNS[8])
    if not data:
        parts += _bits([END], RUNS[8])
    return np.packbits(np.concatenate(parts), bitorder="little").tobytes()


def _expand(codes: np.ndarray, clear: int) -> bytes:
    """Samples of the codes between two clear codes.

    Entry ``j`` of the table is the output of code ``j`` and one sample more, so every sample of a
    non-literal code is a copy of an earlier one; lengths and copies are resolved by pointer
    doubling instead of building the strings.
    """
    n = len(codes)
    ref = codes - (clear + 2)
    literal = ref < 0
    at = np.arange(n)
    if bool((ref >= at).any()):  # no such entry yet: the stream is damaged from here on
        n = int(np.flatnonzero(ref >= at)[0])
        codes, ref, literal, at = codes[:n], ref[:n], literal[:n], at[:n]
    jump = np.where(literal, at, ref)
    length = np.where(literal, 0, 1)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        length, jump = length + length[jump], further
    length += 1
    start = np.cumsum(length) - length
    owner = np.repeat(at, length)
    place = np.arange(len(owner))
    copied = place - start[owner] + start[np.where(literal, 0, ref)][owner]
    source = np.where(literal[owner], place, copied)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    return codes[owner[source]].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, root: int, limit: int) -> bytes:
    """Samples of a code stream, as far as it goes, at most ``limit``."""
    bits = np.unpackbits(np.frombuffer(stream, dtype=np.uint8), bitorder="little")
    clear, end, at, out, made = 1 << root, (1 << root) + 1, 0, [], 0
    while made < limit:
        codes: list[np.ndarray] = []
        done = stop = False
        for width, n in RUNS[root]:
            while n > 0 and not stop:
                take = min(n, 4096, (len(bits) - at) // width)
                if take <= 0:
                    stop = done = True
                    break
                block = np.zeros((take, 16), dtype=np.uint8)
                block[:, :width] = bits[at : at + take * width].reshape(take, width)
                values = np.packbits(block, axis=1, bitorder="little").view("<u2").reshape(-1)
                marks = np.flatnonzero((values == clear) | (values == end))
                if marks.size:
                    take, done, stop = int(marks[0]) + 1, bool(values[marks[0]] == end), True
                    values = values[: take - 1]
                codes.append(values)
                at += take * width
                n -= take
            if stop:
                break
        if codes:
            piece = _expand(np.concatenate(codes).astype(np.int64), clear)
            out.append(piece)
            made += len(piece)
        if done:
            break
    return b"".join(out)[:limit]


def _blocks(stream: bytes) -> bytes:
    return b"".join(bytes([len(p)]) + p for p in (stream[i : i + 255] for i in range(0, len(stream), 255))) + b"\0"


GREY = bytes(v for i in range(256) for v in (i, i, i))


def encode(payload: bytes) -> bytes:
    """GIF89a of a payload whose length is a positive multiple of 64."""
    step = WIDTH * FRAME_ROWS
    rows = min(FRAME_ROWS, len(payload) // WIDTH)
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, rows, 0xF7, 0, 0), GREY]
    for at in range(0, len(payload), step):
        frame = payload[at : at + step]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, DELAY_CS, 0), b"\0"]
        out += [b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(frame) // WIDTH, 0), b"\x08", _blocks(lzw_encode(frame))]
    return b"".join([*out, b"\x3b"])


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _deinterlace(px: np.ndarray) -> np.ndarray:
    order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, px.shape[0], step)]
    out = np.empty_like(px)
    out[order] = px
    return out


def decode(data: bytes) -> Iterator[dict]:
    """Frames in order: index, delay_ms, disposal, box (x, y, w, h), samples (palette indices of
    the frame's own box), rgb (the whole canvas as shown, height x width x 3)."""
    if data[:4] != b"GIF8" or len(data) < 13:
        return
    width, height, packed, background, _ = struct.unpack("<HHBBB", data[6:13])
    at, palette = 13, None
    if packed & 0x80:
        n = 3 << (packed & 7) + 1
        palette, at = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n
    canvas = np.zeros((height, width, 3), np.uint8)
    if palette is not None and background < len(palette):
        canvas[:] = palette[background]
    blank, delay, disposal, clear_index, index = canvas.copy(), 0, 0, None, 0
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = _sub_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                flags, cs, see_through = struct.unpack("<BHB", body[:4])
                delay, disposal, clear_index = cs * 10, flags >> 2 & 7, see_through if flags & 1 else None
            continue
        if data[at] != 0x2C:
            return
        x, y, w, h, packed = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at, colours = at + 10, palette
        if packed & 0x80:
            n = 3 << (packed & 7) + 1
            colours, at = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n
        root = data[at]
        stream, at = _sub_blocks(data, at + 1)
        samples = lzw_decode(stream, root, w * h).ljust(w * h, b"\0")
        px = np.frombuffer(samples, np.uint8).reshape(h, w)
        if packed & 0x40:
            px = _deinterlace(px)
        earlier = canvas.copy() if disposal == 3 else None
        box = canvas[y : y + h, x : x + w]
        seen = px[: box.shape[0], : box.shape[1]]
        shown = (colours if colours is not None else np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1))[np.minimum(seen, len(colours) - 1 if colours is not None else 255)]
        if clear_index is None:
            box[:] = shown
        else:
            box[:] = np.where((seen == clear_index)[..., None], box, shown)
        yield {"index": index, "delay_ms": delay, "disposal": disposal, "box": (x, y, w, h), "samples": px.tobytes(), "rgb": canvas}
        if disposal == 2:
            canvas[y : y + h, x : x + w] = blank[y : y + h, x : x + w]
        elif disposal == 3:
            canvas = earlier
        index, delay, disposal, clear_index = index + 1, 0, 0, None


def colour_histogram(rgb: np.ndarray) -> np.ndarray:
    """Counts of 512 colours, three bits a channel."""
    q = rgb.reshape(-1, 3) >> 5
    return np.bincount(q[:, 0].astype(np.int64) << 6 | q[:, 1].astype(np.int64) << 3 | q[:, 2], minlength=512)


def pad64(raw: bytes) -> bytes:
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def _encode_batches(batches):
    for batch in batches:
        for rows in row_groups(batch, rows=64):
            raw = [(t or "").encode("utf-8") for t in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array([encode(pad64(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as a GIF, written to the shared folder."""
    return stored(docs.select("doc_id", "text").mapInArrow(lean(_encode_batches), "doc_id long, n_bytes long, media binary"), "gif-media")


def _read_one(media: bytes) -> tuple:
    digest, tail, n, frames, shown = hashlib.sha256(), b"", 0, 0, np.zeros(512, np.int64)
    for f in decode(media):
        grey = f["rgb"][: f["box"][3], :, 0].tobytes()
        digest.update(grey)
        n, frames, tail = n + len(grey), frames + 1, (tail + grey)[-64:]
        shown += colour_histogram(f["rgb"][: f["box"][3]])
    bins = np.flatnonzero(shown)
    feature = f"frames={frames};hist=" + ",".join(f"{b}:{shown[b]}" for b in bins)
    return n, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read_batches(batches):
    names = [f.split()[0] for f in READ.split(", ")][2:]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in (part for whole in batches for part in row_groups(whole, "media", rows=64)):
        cols = list(zip(*[_read_one(m.as_py()) for m in batch.column("media")])) or [[]] * 6
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "n_bytes", *names])


def read_media(media: DataFrame) -> DataFrame:
    """Decode stored GIFs: payload digests, and the colour histogram of what they show."""
    return media.mapInArrow(lean(_read_batches), READ)


FRAMES = "doc_id long, frame int, start_ms long, delay_ms int, disposal int, height int, samples binary, histogram array<long>"


def _frame_batches(batches):
    for batch in batches:
        for doc_id, media in zip(batch.column("doc_id").to_pylist(), batch.column("media")):
            start = 0
            for f in decode(media.as_py() or b""):
                row = {"doc_id": doc_id, "frame": f["index"], "start_ms": start, "delay_ms": f["delay_ms"], "disposal": f["disposal"], "height": f["box"][3], "samples": f["samples"], "histogram": colour_histogram(f["rgb"]).tolist()}
                start += f["delay_ms"]
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("doc_id", pa.int64()), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("disposal", pa.int32()), ("height", pa.int32()), ("samples", pa.binary()), ("histogram", pa.list_(pa.int64()))]))


def frames(media: DataFrame) -> DataFrame:
    """One row per timed frame of (doc_id, media), with its samples and colour histogram."""
    return media.select("doc_id", "media").mapInArrow(lean(_frame_batches), FRAMES)
