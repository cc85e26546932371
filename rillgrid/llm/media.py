"""Byte payloads as baseline JPEG images whose DC-only thumbnails are the payload.

The writer codes each payload byte as the level of one flat 8x8 block, with a restart
marker after every row of blocks. The reader parses the markers of any baseline JPEG,
decodes the Huffman codes of all restart intervals in step with numpy and keeps the
DC terms of the first component: its luminance thumbnail at one eighth of the size.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

#: Samples a payload is padded to a multiple of: 24 x 24 blocks.
UNIT, ACROSS = 576, 24
#: A JPEG has at most 65,535 lines; longer payloads take several images, one after the other.
IMAGE = UNIT * (65535 // 8 // ACROSS)
#: Samples coded or decoded in step.
STEP = 1 << 21

# The luminance DC code of the JPEG standard, and a code for "end of block" alone.
DC_BITS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_VALUES = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)
AC_BITS = (1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
AC_VALUES = (0,)


def _codes(bits: tuple, values: tuple) -> list[tuple[int, int, int]]:
    """(value, code, length) of a table, codes counted up within and between lengths."""
    out, code, at = [], 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out.append((values[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _writer_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each difference + 255: the bits of its block, and how many they are."""
    dc = {v: (c, n) for v, c, n in _codes(DC_BITS, DC_VALUES)}
    (_, end, end_bits), code, size = _codes(AC_BITS, AC_VALUES)[0], [], []
    for d in range(-255, 256):
        kind = abs(d).bit_length()
        c, n = dc[kind]
        extra = d if d >= 0 else d + (1 << kind) - 1
        code.append(((c << kind | extra) << end_bits) | end)
        size.append(n + kind + end_bits)
    return np.array(code, dtype=np.int64), np.array(size, dtype=np.int64)


_CODE, _SIZE = _writer_tables()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _head(samples: int) -> bytes:
    height = samples // ACROSS * 8
    quant = bytes((8, *[1] * 63))
    return b"".join((
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"),
        _segment(0xDB, b"\x00" + quant),
        _segment(0xC0, b"\x08" + height.to_bytes(2, "big") + (ACROSS * 8).to_bytes(2, "big") + b"\x01\x01\x11\x00"),
        _segment(0xC4, b"\x00" + bytes(DC_BITS) + bytes(DC_VALUES)),
        _segment(0xC4, b"\x10" + bytes(AC_BITS) + bytes(AC_VALUES)),
        _segment(0xDD, ACROSS.to_bytes(2, "big")),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ))


def write_images(payloads: list[np.ndarray]) -> list[bytes]:
    """A JPEG of each payload (uint8, a multiple of 576 long, ``IMAGE`` at most)."""
    sizes = np.array([len(p) for p in payloads])
    level = np.concatenate(payloads).astype(np.int64).reshape(-1, ACROSS)
    diff = np.diff(level, axis=1, prepend=128) + 255
    code, size = _CODE[diff], _SIZE[diff]
    used = size.sum(axis=1)
    row_bytes = (used + 7) >> 3
    row_end = np.cumsum(row_bytes)
    row_start = row_end - row_bytes
    at = row_start[:, None] * 8 + np.cumsum(size, axis=1) - size
    spread = (code << (24 - size - (at & 7))).ravel()
    first = (at >> 3).ravel()
    total = int(row_end[-1])
    raw = sum(
        np.bincount(first + k, weights=(spread >> shift) & 255, minlength=total + 2) for k, shift in enumerate((16, 8, 0))
    )[:total].astype(np.uint8)
    raw[row_end - 1] |= ((1 << (row_bytes * 8 - used)) - 1).astype(np.uint8)
    # A zero follows each byte 255; a restart marker follows each row but an image's last.
    rows = sizes // ACROSS
    last = np.cumsum(rows) - 1
    marked = np.ones(len(row_end), dtype=np.int64)
    marked[last] = 0
    number = np.arange(len(row_end)) - np.repeat(last + 1 - rows, rows)
    high = raw == 255
    before = np.cumsum(high) - high
    shift = np.repeat(2 * (np.cumsum(marked) - marked), row_bytes)
    where = np.arange(total) + before + shift
    out = np.zeros(total + int(high.sum()) + 2 * int(marked.sum()), dtype=np.uint8)
    out[where] = raw
    ends = where[row_end - 1] + 1 + high[row_end - 1]
    at = ends[marked == 1]
    out[at] = 255
    out[at + 1] = 0xD0 + number[marked == 1] % 8
    cuts, data, done = ends[last], out.tobytes(), 0
    images = []
    for n, cut in zip(sizes, cuts, strict=True):
        images.append(_head(int(n)) + data[done:cut] + b"\xff\xd9")
        done = cut
    return images


class _Image:
    """The headers of one baseline JPEG and where its scan lies."""

    def __init__(self, data: bytes, at: int):
        self.quant: dict[int, int] = {}
        self.tables: dict[int, tuple] = {}
        self.interval = 0
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("no marker")
            marker, at = data[at + 1], at + 2
            if marker == 0xFF:
                at -= 1
                continue
            size = int.from_bytes(data[at : at + 2], "big")
            body, at = data[at + 2 : at + size], at + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC0:
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline image")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.interval = int.from_bytes(body, "big")
            elif marker == 0xDA:
                chosen = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
                self.chosen = [(chosen[p[0]] >> 4, 16 | chosen[p[0]] & 15) for p in self.parts]
                break
        self.scan = at
        if len(self.parts) == 1:  # one component: its blocks follow one another
            self.parts = [(self.parts[0][0], 1, 1, self.parts[0][3])]
        self.h, self.v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        self.units = self.across * self.down
        self.interval = self.interval or self.units

    def plan(self) -> tuple:
        """What must be alike for images to be decoded in step."""
        return (tuple(p[1:3] for p in self.parts), tuple(tuple(self.tables[t] for t in pair) for pair in self.chosen))


def _lookup(bits: tuple, values: tuple) -> np.ndarray:
    """For each 16 bits ahead: the code's length times 256 plus its value."""
    out = np.zeros(1 << 16, dtype=np.int64)
    for value, code, length in _codes(bits, values):
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | value
    return out


def read_images(files: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each file, (width, height, luminance thumbnail as uint8 rows) of each image in it."""
    found, groups, order = [], {}, []
    for k, data in enumerate(files):
        whole, at, n = np.frombuffer(data, dtype=np.uint8), 0, 0
        while at < len(data):
            image = _Image(data, at)
            scan = whole[image.scan :]
            high = np.flatnonzero(scan[:-1] == 255)
            follow = scan[high + 1]
            stops = high[(follow != 0) & ((follow < 0xD0) | (follow > 0xD7))]
            end = int(stops[0])
            image.bytes = scan[:end]
            if scan[end + 1] != 0xD9:
                raise ValueError("more than one scan")
            at = image.scan + end + 2
            groups.setdefault(image.plan(), []).append((len(order), image))
            order.append((k, image))
            n += 1
    thumbs: dict[int, np.ndarray] = {}
    for members in groups.values():
        held, size = [], 0
        for member in members:
            held.append(member)
            size += member[1].units
            if size >= STEP:
                thumbs |= _decode(held)
                held, size = [], 0
        if held:
            thumbs |= _decode(held)
    found = [[] for _ in files]
    for n, (k, image) in enumerate(order):
        found[k].append((image.width, image.height, thumbs[n]))
    return found


def _decode(members: list[tuple[int, _Image]]) -> dict[int, np.ndarray]:
    # All scans without stuffed zeros and markers; where each restart interval starts.
    pieces, starts, units, done = [], [], [], 0
    for _, image in members:
        scan = image.bytes
        after = np.zeros(len(scan), dtype=bool)
        after[1:] = scan[:-1] == 255
        marker = after & (scan >= 0xD0) & (scan <= 0xD7)
        drop = (after & (scan == 0)) | marker
        drop[:-1] |= marker[1:]
        kept = np.cumsum(~drop)
        cut = kept[np.flatnonzero(marker)]
        pieces.append(scan[~drop])
        starts.append(done + np.concatenate([[0], cut]))
        n = len(cut) + 1
        left = np.full(n, image.interval)
        left[-1] = image.units - image.interval * (n - 1)
        units.append(left)
        done += int(kept[-1]) if len(kept) else 0
    data = np.concatenate([*pieces, np.full(8, 255, dtype=np.uint8)]).astype(np.uint32)
    ahead = (data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]).astype(np.int64)
    at, left = np.concatenate(starts) * 8, np.concatenate(units)
    image = members[0][1]
    tables = {t: _lookup(*image.tables[t]) for pair in image.chosen for t in pair}
    blocks = [(c, y, x) for c, (_, h, v, _) in enumerate(image.parts) for y in range(v) for x in range(h)]
    own = [b for b in blocks if b[0] == 0]
    most = int(left.max())
    level = np.zeros((len(at), most, len(own)), dtype=np.int16)
    last = [np.zeros(len(at), dtype=np.int64) for _ in image.parts]
    even = bool((left == most).all())
    lanes = slice(None) if even else None
    for unit in range(most):
        if not even:
            lanes = np.flatnonzero(left > unit)
        bit = at[lanes]
        for c, y, x in blocks:
            dc, ac = (tables[t] for t in image.chosen[c])
            got = dc[(ahead[bit >> 3] >> (16 - (bit & 7))) & 0xFFFF]
            bit = bit + (got >> 8)
            kind = got & 255
            extra = ((ahead[bit >> 3] << (bit & 7)) & 0xFFFFFFFF) >> (32 - kind)
            bit = bit + kind
            value = extra - ((extra < (1 << kind >> 1)) * ((1 << kind) - 1))
            last[c][lanes] += value
            if c == 0:
                level[lanes, unit, own.index((c, y, x))] = last[c][lanes]
            todo, place = None, None
            while True:  # the other terms are passed over
                here = bit if todo is None else bit[todo]
                got = ac[(ahead[here >> 3] >> (16 - (here & 7))) & 0xFFFF]
                symbol = got & 255
                here = here + (got >> 8) + (symbol & 15)
                if todo is None:
                    bit, go = here, symbol != 0
                    if not go.any():
                        break
                    place = np.ones(len(bit), dtype=np.int64)
                    todo = np.flatnonzero(go)
                else:
                    bit[todo] = here
                    go = symbol != 0
                    todo = todo[go]
                place[todo] += (symbol[go] >> 4) + 1
                todo = todo[place[todo] < 64]
                if not len(todo):
                    break
        at[lanes] = bit
    out, row = {}, 0
    for (n, image), lefts in zip(members, units, strict=True):
        part = level[row : row + len(lefts)]
        row += len(lefts)
        flat = part.reshape(-1, len(own))[: image.units] if len(lefts) == 1 or int(lefts.max()) == most else np.concatenate([p[:k] for p, k in zip(part, lefts, strict=True)])
        h, v = image.parts[0][1:3]
        grid = flat.reshape(image.down, image.across, v, h).transpose(0, 2, 1, 3).reshape(image.down * v, image.across * h)
        grid = grid[: -(-image.height * v // (8 * image.v)), : -(-image.width * h // (8 * image.h))]
        out[n] = np.clip(np.rint(grid * image.quant[image.parts[0][3]] / 8 + 128), 0, 255).astype(np.uint8)
    return out


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits: is a cell of the thumbnail's 8x8 means lighter than all of them on average."""
    rows = np.linspace(0, len(thumb), 9).astype(int)[:-1]
    cols = np.linspace(0, thumb.shape[1], 9).astype(int)[:-1]
    sums = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), rows, axis=0), cols, axis=1)
    cells = np.outer(np.diff([*rows, len(thumb)]), np.diff([*cols, thumb.shape[1]]))
    mean = sums / cells
    return np.packbits(mean > mean.mean()).tobytes().hex()


MEDIA = "media binary, payload binary, width int, height int, images int, thumbnail_hash string"


def store(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep_bytes: bool = True) -> DataFrame:
    """``doc_id, n_bytes`` and the stored image of every text with what is read back from it.

    A text's bytes, with bytes 255 up to a positive multiple of 576, are the samples of
    one JPEG (of several, one after the other, beyond 196,416 bytes): ``media``.
    ``payload`` and all after it come from decoding ``media``: ``width``, ``height``
    (of all images together), the number of images and the thumbnail's hash. The
    digests ``media_bytes, media_sha256, payload_bytes, payload_sha256, tail_crc32``
    (of the last 32 bytes) come with them; ``keep_bytes=False`` leaves the two byte
    columns null. Texts are coded about 2 MB at a time, so memory follows the longest
    text. A null text is empty; null and repeated ids are carried; equal texts give
    equal values; an empty table gives no rows; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raws, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                raws.append(t or b"")
                held += len(raws[-1]) + UNIT
                if held >= STEP:
                    yield stored(ids, raws)
                    ids, raws, held = [], [], 0
        if ids:
            yield stored(ids, raws)

    def stored(ids: list, raws: list[bytes]) -> pa.RecordBatch:
        padded = [r + b"\xff" * (-len(r) % UNIT or (0 if r else UNIT)) for r in raws]
        parts = [np.frombuffer(p, dtype=np.uint8)[k : k + IMAGE] for p in padded for k in range(0, len(p), IMAGE)]
        images, some, size = [], [], 0
        for p in parts:
            some.append(p)
            size += len(p)
            if size >= STEP:
                images += write_images(some)
                some, size = [], 0
        if some:
            images += write_images(some)
        files, n = [], 0
        for p in padded:
            count = -(-len(p) // IMAGE)
            files.append(b"".join(images[n : n + count]))
            n += count
        rows = []
        for i, raw, media, got in zip(ids, raws, files, read_images(files), strict=True):
            thumb = np.concatenate([g[2] for g in got])
            back = thumb.tobytes()
            rows.append((
                i, len(raw), media if keep_bytes else None, back if keep_bytes else None, got[0][0], sum(g[1] for g in got), len(got), thumbnail_hash(thumb),
                len(media), hashlib.sha256(media).hexdigest(), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]),
            ))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = f"doc_id long, n_bytes long, {MEDIA}, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long"
    names = [x.split()[0] for x in schema.split(", ")]
    return documents.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(tidied(run), schema)
