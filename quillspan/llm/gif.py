"""GIF as a lossless media column: an encoder, a full decoder, and frames with colour histograms.

The decoder reads GIF87a and GIF89a: LZW code streams with deferred clears, global and local palettes, interlacing,
transparency, delays, and the disposal methods keep, restore-to-background and restore-to-previous. Text payloads are
stored as 8-bit indices of an identity grey palette: tiles of 24 x 24 for each 576 bytes, up to 64 tiles in a frame.

Defined results: null text counts as empty, and empty text is one frame of byte 255; repeated rows give equal values;
an empty table gives an empty result; extra columns are ignored. A broken stream raises ValueError from decode(), and gives
null frames with the error's text in a column.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import common

SIDE = 24
TILE = SIDE * SIDE
#: Tiles in a frame: the longer a code stream, the better its table.
TILES = 64
GREY = bytes(v for i in range(256) for v in (i, i, i))
def lzw_encode(data: bytes, full: int = 4095) -> bytes:
    """Code stream for 8-bit samples, least significant bit first, with a clear code in front and when the table is full."""
    codes = [256]
    runs = []  # codes from one clear code up to the next
    add = codes.append
    table: dict[int, int] = {}
    find = table.get
    n, it = 258, iter(data)
    w = next(it, None)
    if w is None:
        add(257)
        return _pack([codes])
    for c in it:
        key = w << 8 | c
        x = find(key)
        if x is None:
            add(w)
            if n < full:
                table[key] = n
                n += 1
            else:
                runs.append(codes)
                codes = [256]
                add = codes.append
                table.clear()
                n = 258
            w = c
        else:
            w = x
    codes += (w, 257)
    runs.append(codes)
    return _pack(runs)


_TWELVE = np.arange(12)


def _pack(runs: list[list[int]]) -> bytes:
    """A clear code is as wide as the codes before it; the code k places after it has the k-th width of the schedule."""
    _, width = _schedule(8, max(map(len, runs)))
    codes = np.concatenate([np.array(r, np.int64) for r in runs])
    w, last = [], 9
    for r in runs:
        w += [np.array([last]), width[: len(r) - 1]]
        last = int(width[len(r) - 1])
    w = np.concatenate(w)
    bits = (codes[:, None] >> _TWELVE & 1).astype(np.uint8)
    return np.packbits(bits[w[:, None] > _TWELVE], bitorder="little").tobytes()


_widths: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _schedule(least: int, codes: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Bit offset and width of the k-th code after a clear, for at least so many codes: widths depend on the number of codes only."""
    if least not in _widths or len(_widths[least][1]) < codes:
        first = (1 << least) + 2
        k = np.arange(max(codes, 1 << 14))
        known = first + np.maximum(k - 1, 0)  # entries when code k is read
        width = np.clip(np.floor(np.log2(np.maximum(known, 1))).astype(np.int64) + 1, least + 1, 12)
        _widths[least] = np.concatenate([[0], np.cumsum(width)[:-1]]), width
    return _widths[least]


def lzw_decode(stream: bytes, least: int, n_pixels: int) -> bytes:
    """Samples of a code stream; stops at the end code or after n_pixels."""
    if not 1 <= least <= 11:
        raise ValueError("bad LZW minimum code size")
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8)
    total = len(stream) * 8
    clear, end = 1 << least, (1 << least) + 1
    singles = [bytes([i]) for i in range(min(clear, 256))] + [b""] * (clear - min(clear, 256)) + [b"", b""]
    offsets, widths = _schedule(least, total // (least + 1) + 2)
    out: list[bytes] = []
    have, at = 0, 0
    while have < n_pixels and at + least + 1 <= total:
        m = int(np.searchsorted(offsets, total - at, "left"))
        m -= m > 0 and offsets[m - 1] + widths[m - 1] > total - at
        o, w = offsets[:m] + at, widths[:m]
        b = o >> 3
        codes = ((raw[b].astype(np.int64) | raw[b + 1].astype(np.int64) << 8 | raw[b + 2].astype(np.int64) << 16) >> (o & 7)) & ((1 << w) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else m
        run = codes[:n].tolist()
        if run:
            table = singles.copy()
            if run[0] >= clear:
                raise ValueError("bad LZW code")
            prev = table[run[0]]
            put, add = out.append, table.append
            put(prev)
            room = 4096 - len(table)
            for code in run[1 : room + 1]:
                try:
                    s = table[code]
                except IndexError:
                    if code != len(table):
                        raise ValueError("bad LZW code") from None
                    s = prev + prev[:1]
                add(prev + s[:1])
                put(s)
                prev = s
            out += [table[code] for code in run[room + 1 :]]
            have = sum(map(len, out))
        if not len(stop):
            break
        if have >= n_pixels or codes[n] == end:
            break
        at = int(o[n] + w[n])
    data = b"".join(out)
    if len(data) < n_pixels:
        raise ValueError("LZW stream ends early")
    return data[:n_pixels]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode(frames: list[bytes], width: int = SIDE, palette: bytes = GREY, delay: int = 4) -> bytes:
    """GIF89a of frames of 8-bit indices, whole rows each, drawn from the top; delay in hundredths of a second."""
    heights = [len(f) // width for f in frames]
    out = [b"GIF89a", struct.pack("<HHBBB", width, max(heights), 0xF7, 0, 0), palette]
    if len(frames) > 1:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0")
    control = b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay, 0, 0) + b"\x2c"
    for f, h in zip(frames, heights, strict=True):
        out += [control, struct.pack("<HHHHB", 0, 0, width, h, 0), b"\x08", _blocks(lzw_encode(f))]
    return b"".join([*out, b"\x3b"])


_ROWS: dict[int, np.ndarray] = {}


def _interlaced(height: int) -> np.ndarray:
    if height not in _ROWS:
        _ROWS[height] = np.concatenate([np.arange(a, height, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
    return _ROWS[height]


#: Pixels of a canvas or a frame that are decoded; what is larger gives an error before any memory is taken for it.
MAX_PIXELS = 1 << 24


def decode(data: bytes, compose: bool = True) -> Iterator[dict]:
    """One dict per frame: delay (hundredths), disposal, transparent, left, top, indices (h x w), and canvas (RGBA) after drawing."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack("<HHBBB", data[6:13])
    at, colours = 13, None
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        colours = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3)
        at += n
    if compose and width * height > MAX_PIXELS:
        raise ValueError(f"a canvas of {width} x {height} is larger than {MAX_PIXELS} pixels")
    canvas = np.zeros((height, width, 4), np.uint8) if compose else None
    delay = disposal = 0
    transparent = -1

    def chunks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and (n := data[at]):
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        return b"".join(parts), at + 1

    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1]
            body, at = chunks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                f, delay, t = body[0], body[1] | body[2] << 8, body[3]
                disposal, transparent = f >> 2 & 7, t if f & 1 else -1
            continue
        if kind != 0x2C:
            raise ValueError(f"bad GIF block {kind:#x}")
        left, top, w, h, f = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        palette = colours
        if f & 0x80:
            n = 3 << (f & 7) + 1
            palette = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3)
            at += n
        if w * h > MAX_PIXELS:
            raise ValueError(f"a frame of {w} x {h} is larger than {MAX_PIXELS} pixels")
        stream, after = chunks(at + 1)
        indices = np.frombuffer(lzw_decode(stream, data[at], w * h), np.uint8).reshape(h, w)
        at = after
        if f & 0x40:
            rows = np.empty_like(indices)
            rows[_interlaced(h)] = indices
            indices = rows
        frame = {"delay": delay, "disposal": disposal, "transparent": transparent, "left": left, "top": top, "indices": indices}
        if compose:
            if palette is None:
                raise ValueError("frame without a palette")
            before = canvas.copy() if disposal == 3 else None
            lookup = np.zeros((256, 4), np.uint8)
            lookup[: len(palette), :3], lookup[: len(palette), 3] = palette, 255
            part = canvas[top : top + h, left : left + w]
            drawn = lookup[indices[: part.shape[0], : part.shape[1]]]
            if transparent >= 0:
                seen = indices[: part.shape[0], : part.shape[1]] != transparent
                part[seen] = drawn[seen]
            else:
                part[...] = drawn
            frame["canvas"] = canvas.copy()
            if disposal == 2:
                part[...] = 0
            elif disposal == 3:
                canvas = before
        yield frame
        delay = disposal = 0
        transparent = -1


def histogram(values: np.ndarray, bins: int = 8) -> list[int]:
    return np.bincount(values.reshape(-1) >> 5, minlength=bins)[:bins].tolist()


def frames_of(media: bytes) -> list[dict]:
    """Timed frames: seconds shown, size, and the histogram of each colour channel over the composed canvas."""
    out = []
    for f in decode(media):
        c = f["canvas"]
        out.append({"seconds": f["delay"] / 100, "width": c.shape[1], "height": c.shape[0], "red": histogram(c[..., 0]), "green": histogram(c[..., 1]), "blue": histogram(c[..., 2])})
    return out


FRAMES = "array<struct<seconds:double,width:int,height:int,red:array<long>,green:array<long>,blue:array<long>>>"


def decode_media(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """key, frames, error: the timed frames of a column of GIF bytes. Null bytes give neither; a broken stream gives an error."""

    def read(m) -> tuple:
        try:
            return (None, None) if m is None else (frames_of(bytes(m)), None)
        except (ValueError, IndexError, struct.error) as e:
            return None, str(e) or type(e).__name__

    def run(it):
        for pdf in it:
            frames, errors = zip(*map(read, pdf[media]), strict=True) if len(pdf) else ((), ())
            yield pd.DataFrame({key: pdf[key], "frames": frames, "error": errors})

    return common.table_of(df, key, media).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, frames {FRAMES}, error string")


def to_payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (-len(raw) % TILE if raw else TILE)


def store(text: str | None) -> tuple[int, bytes]:
    n, payload = to_payload(text)
    return n, encode([payload[i : i + TILES * TILE] for i in range(0, len(payload), TILES * TILE)])


def text_to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a GIF."""

    def run(it):
        for pdf in it:
            for part in common.batches([pdf]):
                n, media = zip(*map(store, part["text"]), strict=True)
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_bytes": n, "media": media})

    return common.table_of(docs, "doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def digest_row(text: str | None) -> tuple:
    """Store, read the stored bytes back, and describe what came back: the red channel of each composed frame, where it was drawn."""
    n, media = store(text)
    parts, hist, frames, delay = [], np.zeros(8, np.int64), 0, 0
    for f in decode(media):
        (h, w), left, top = f["indices"].shape, f["left"], f["top"]
        seen = f["canvas"][top : top + h, left : left + w, 0].reshape(-1)
        parts.append(seen)
        hist += histogram(seen)
        frames += 1
        delay += f["delay"]
    raw = np.concatenate(parts).tobytes()
    feature = f"frames={frames};seconds={delay / 100:.2f};hist=" + ",".join(map(str, hist.tolist()))
    return n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


NAMES = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def media_digest(docs: DataFrame) -> DataFrame:
    """The columns of the digest query for every document, from the samples read back out of the stored bytes."""

    def run(it):
        for part in common.batches(it):
            yield pd.concat([part[["doc_id"]].reset_index(drop=True), pd.DataFrame([digest_row(t) for t in part["text"]], columns=NAMES)], axis=1)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.table_of(docs, "doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
