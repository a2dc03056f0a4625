"""GIF: LZW code streams, blocks, palettes, interlace, disposal and transparency, in numpy; no Spark here.

Code boundaries of a GIF stream follow from the number of codes since the last clear code, so codes are cut out of the
bit string in bulk. A code that is not a literal stands for the output of an earlier code and the first byte after it;
those references are followed for all codes and all output bytes at once, by doubling.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the format.
TRAILER, EXTENSION, IMAGE, CONTROL, COMMENT = 0x3B, 0x21, 0x2C, 0xF9, 0xFE
INTERLACE = ((0, 8), (4, 8), (2, 4), (1, 2))


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    indices: np.ndarray
    palette: np.ndarray  # (n, 3) uint8
    delay_ms: int = 0
    disposal: int = 0
    transparent: int | None = None

    def rgb(self) -> np.ndarray:
        """The palette applied; an index beyond the palette is black."""
        full = np.zeros((256, 3), np.uint8)
        full[: len(self.palette)] = self.palette
        return full[self.indices]


@dataclass
class Picture:
    width: int
    height: int
    background: int = 0
    frames: list[Frame] = field(default_factory=list)
    comments: list[bytes] = field(default_factory=list)


def _widths(places: np.ndarray, low: int) -> np.ndarray:
    """Bits of the code at each place since the last clear code."""
    following = (1 << low) + 2 + np.maximum(places - 1, 0)
    return np.clip(np.floor(np.log2(following)).astype(np.int64) + 1, low + 1, 12)


def lzw_encode(data: bytes, low: int = 8) -> bytes:
    """Code stream of ``data`` (values under ``2**low``), with a clear code whenever the table is full."""
    clear, end = 1 << low, (1 << low) + 1
    codes, known, following = [clear], {}, clear + 2
    put, get = codes.append, known.get
    if data:
        prefix = data[0]
        for value in memoryview(data)[1:]:
            key = prefix << 8 | value
            longer = get(key)
            if longer is not None:
                prefix = longer
                continue
            put(prefix)
            if following < 4096:
                known[key] = following
                following += 1
            else:
                put(clear)
                known.clear()
                following = clear + 2
            prefix = value
        put(prefix)
    put(end)
    code = np.array(codes, np.uint32)
    at = np.arange(len(code))
    last_clear = np.maximum.accumulate(np.where(code == clear, at, -1))
    before = np.concatenate([[-1], last_clear[:-1]])
    widths = _widths(at - before - 1, low)
    widths[0] = low + 1
    ends = np.cumsum(widths)
    starts = ends - widths
    size = (int(ends[-1]) + 7) // 8
    shifted, byte = code << (starts & 7).astype(np.uint32), starts >> 3
    out = np.zeros(size + 3)
    for k in range(3):
        out += np.bincount(byte + k, weights=(shifted >> np.uint32(8 * k)) & np.uint32(255), minlength=size + 3)
    return out[:size].astype(np.uint8).tobytes()


def _codes(stream: bytes, low: int) -> Iterator[np.ndarray]:
    """Runs of codes between clear codes, up to the end code or the end of the stream."""
    clear, end = 1 << low, (1 << low) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    window = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    bits, position = len(stream) * 8, 0
    reach = 4096
    widths = _widths(np.arange(reach), low)
    upto = np.cumsum(widths)
    while position < bits:
        run, n = [], 0
        while True:  # a run may go on beyond a full table, with codes of 12 bits
            w = widths if n == 0 else np.full(reach, 12)
            ends = upto if n == 0 else np.arange(1, reach + 1) * 12
            m = int(np.searchsorted(ends, bits - position, side="right"))
            at = position + ends[:m] - w[:m]
            found = (window[at >> 3] >> (at & 7).astype(np.uint32)) & ((1 << w[:m]) - 1).astype(np.uint32)
            stops = np.flatnonzero((found == clear) | (found == end))
            if len(stops):
                k = int(stops[0])
                run.append(found[:k])
                position += int(ends[k])
                ended = found[k] == end
                break
            run.append(found)
            position += int(ends[m - 1]) if m else bits
            n += m
            if m < reach:
                ended, position = True, bits
                break
        yield np.concatenate(run) if len(run) > 1 else run[0]
        if ended:
            return


def lzw_decode(stream: bytes, low: int, expected: int) -> np.ndarray:
    """Up to ``expected`` values of a code stream; an impossible code is an error."""
    parts, total = [np.zeros(0, np.uint8)], 0
    clear = 1 << low
    for codes in _codes(stream, low):
        n = len(codes)
        if not n:
            continue
        place = np.arange(n)
        literal = codes < clear
        earlier = np.where(literal, place, codes.astype(np.int64) - clear - 2)
        if (earlier < 0).any() or (earlier[~literal] >= place[~literal]).any():
            raise ValueError("the LZW stream has a code that stands for nothing")
        length, jump = np.where(literal, 0, 1), earlier
        while True:
            more = length[jump]
            if not more.any():
                break
            length, jump = length + more, jump[jump]
        length = length + 1
        starts = np.cumsum(length) - length
        size = int(starts[-1] + length[-1])
        source = np.repeat(starts[earlier] - starts, length) + np.arange(size)
        while True:
            further = source[source]
            if np.array_equal(further, source):
                break
            source = further
        value = np.zeros(size, np.uint8)
        value[starts[literal]] = codes[literal]
        parts.append(value[source])
        total += size
        if total >= expected:
            break
    return np.concatenate(parts)[:expected]


def _blocks(data: bytes) -> bytes:
    """Sub-blocks of at most 255 bytes and the empty one."""
    return b"".join([bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)]) + b"\0"


def write(width: int, height: int, frames: list[Frame], palette: np.ndarray, comment: bytes = b"", background: int = 0) -> bytes:
    """A GIF89a file with one global palette of 256 colours; a frame's own palette is used where it differs."""
    out = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), bytes([0xF7, background, 0]), palette.astype(np.uint8).tobytes()]
    if comment:
        out += [bytes([EXTENSION, COMMENT]), _blocks(comment)]
    for f in frames:
        flags = f.disposal << 2 | (f.transparent is not None)
        out += [bytes([EXTENSION, CONTROL, 4, flags]), (f.delay_ms // 10).to_bytes(2, "little"), bytes([f.transparent or 0, 0])]
        out += [bytes([IMAGE]), *[x.to_bytes(2, "little") for x in (f.left, f.top, f.width, f.height)]]
        if f.palette is palette:
            out.append(b"\0")
        else:
            own = np.zeros((256, 3), np.uint8)
            own[: len(f.palette)] = f.palette
            out += [bytes([0x87]), own.tobytes()]
        out += [b"\x08", _blocks(lzw_encode(f.indices.astype(np.uint8).tobytes()))]
    return b"".join([*out, bytes([TRAILER])])


def read(data: bytes) -> Picture:
    """Parse a GIF file; frames keep their own rectangle, palette, delay, disposal and transparency. ValueError for damage."""
    try:
        return _parsed(data)
    except IndexError as error:
        raise ValueError("the file ends inside a block") from error


def _parsed(data: bytes) -> Picture:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("this is no GIF file")
    number = lambda k: int.from_bytes(data[k : k + 2], "little")
    picture, at = Picture(number(6), number(8), data[11]), 13
    common = np.zeros((0, 3), np.uint8)

    def palette(flags: int) -> np.ndarray:
        nonlocal at
        n = 2 << (flags & 7)
        at += 3 * n
        return np.frombuffer(data[at - 3 * n : at], np.uint8).reshape(-1, 3)

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while size := data[at]:
            parts.append(data[at + 1 : at + 1 + size])
            at += 1 + size
        at += 1
        return b"".join(parts)

    if data[10] & 0x80:
        common = palette(data[10])
    control = b""
    while data[at] != TRAILER:
        kind = data[at]
        if kind == EXTENSION:
            label = data[at + 1]
            at += 2
            body = blocks()
            if label == CONTROL:
                control = body
            elif label == COMMENT:
                picture.comments.append(body)
        elif kind == IMAGE:
            left, top, width, height = (number(at + k) for k in (1, 3, 5, 7))
            flags = data[at + 9]
            at += 10
            colours = palette(flags) if flags & 0x80 else common
            low = data[at]
            at += 1
            values = lzw_decode(blocks(), low, width * height)
            if len(values) < width * height:
                raise ValueError("a frame has too few pixels")
            values = values.reshape(height, width)
            if flags & 0x40:
                rows = np.concatenate([np.arange(a, height, b) for a, b in INTERLACE])
                straight = np.empty_like(values)
                straight[rows] = values
                values = straight
            frame = Frame(left, top, width, height, values, colours)
            if len(control) >= 4:
                frame.delay_ms, frame.disposal = int.from_bytes(control[1:3], "little") * 10, control[0] >> 2 & 7
                frame.transparent = control[3] if control[0] & 1 else None
            picture.frames.append(frame)
            control = b""
        else:
            raise ValueError(f"unknown block {kind:#x}")
    return picture


def composed(picture: Picture) -> Iterator[np.ndarray]:
    """The canvas (height, width, RGBA) as each frame shows it. Disposal 2 clears the frame's rectangle, 3 restores it."""
    canvas = np.zeros((picture.height, picture.width, 4), np.uint8)
    for f in picture.frames:
        area = (slice(f.top, f.top + f.height), slice(f.left, f.left + f.width))
        before = canvas[area].copy()
        shown = canvas[area]
        seen = np.ones(f.indices.shape, bool) if f.transparent is None else f.indices != f.transparent
        rows, columns = shown.shape[:2]
        seen = seen[:rows, :columns]
        shown[seen] = np.concatenate([f.rgb(), np.full((*f.indices.shape, 1), 255, np.uint8)], axis=2)[:rows, :columns][seen]
        yield canvas.copy()
        if f.disposal == 2:
            canvas[area] = 0
        elif f.disposal == 3:
            canvas[area] = before
