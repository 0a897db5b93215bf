"""Operator 10, media columns: baseline JPEG in numpy.

Decoding: markers are parsed per image (SOF0, DQT, DHT, DRI, SOS); the restart intervals of a
whole batch of images become the lanes of one vectorised Huffman decoder, which takes one
symbol of every lane per step, for any tables and sampling factors. DC coefficients give the
luminance thumbnail, one pixel per block, and a difference hash of it.

Encoding for bytes: the format's unit is the quantised coefficient. A payload of 64 m bytes
is m blocks of a greyscale image, byte k of a block being coefficient k in zigzag order, and
byte b stands for the coefficient b (128 to 255) or b - 255 (-255 to -128). All of these have
size category 8, whose appended bits are b itself, so that the payload is read back exactly.
Every block is its own restart interval. The image has ceil(sqrt(m)) blocks a row; blocks
that fill up the last row are beyond the count kept in a COM segment. More than `MOST` blocks
become several images one after the other.

Defined results: a null or empty text is 64 zero bytes (one block); equal texts give equal
values; rows are stored one by one (repeated rows and null ids give the same); an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm.common import picked, slices

#: Blocks of one image at most: 16 MB of payload.
MOST = 1 << 18
_DATA_SYMBOL = 0x08  # run 0, size 8; as a DC category also 8


@dataclass
class Component:
    h: int
    v: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Image:
    """A parsed baseline JPEG: tables and where its scan begins and ends."""

    width: int = 0
    height: int = 0
    components: dict[int, Component] = field(default_factory=dict)
    order: list[int] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    restart: int = 0
    comment: bytes = b""
    scan: tuple[int, int] = (0, 0)

    @property
    def slots(self) -> list[int]:
        """The component of each block of an MCU."""
        if len(self.order) == 1:
            return list(self.order)
        return [c for c in self.order for _ in range(self.components[c].h * self.components[c].v)]

    def mcus(self) -> tuple[int, int]:
        """MCUs across and down."""
        if len(self.order) == 1:
            return -(-self.width // 8), -(-self.height // 8)
        h, v = (max(getattr(c, k) for c in self.components.values()) for k in "hv")
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(data: bytes, at: int = 0) -> tuple[Image, int]:
    """The image that begins at `at`, and where it ends."""
    image = Image()
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no JPEG start marker")
    at += 2
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if data[at] != 0xFF:
            raise ValueError("a marker was expected")
        marker = data[at + 1]
        if marker == 0xD9:
            return image, at + 2
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC0:
            image.height, image.width = struct.unpack_from(">HH", body, 1)
            for i in range(body[5]):
                key, hv, quant = body[6 + 3 * i : 9 + 3 * i]
                image.components[key] = Component(hv >> 4, hv & 15, quant)
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                image.quant[body[i] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, i + 1).astype(np.int64)
                i += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                n = sum(body[i + 1 : i + 17])
                image.huffman[body[i]] = (body[i + 1 : i + 17], body[i + 17 : i + 17 + n])
                i += 17 + n
        elif marker == 0xDD:
            image.restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            for i in range(body[0]):
                key, tables = body[1 + 2 * i], body[2 + 2 * i]
                image.order.append(key)
                image.components[key].dc, image.components[key].ac = tables >> 4, 16 | tables & 15
            end = at
            while True:  # the scan ends at the first marker other than a restart
                end = data.index(b"\xff", end)
                if data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7:
                    break
                end += 2
            image.scan, at = (at, end), end


def lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """length << 8 | symbol for each 16-bit window; 0 where no code begins."""
    table, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def _lanes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scan bytes without stuffing and restart markers, and where each interval begins."""
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    follows = raw[ff + 1]
    drop = np.zeros(len(raw), bool)
    drop[ff[follows == 0] + 1] = True
    restarts = ff[follows != 0]
    drop[restarts] = drop[restarts + 1] = True
    kept = np.cumsum(~drop)
    return raw[~drop], np.concatenate([[0], kept[restarts]])


def decode(data: bytes, images: list[Image]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per image: coefficients [blocks, 64] in zigzag order and the component of each block.

    Blocks come in scan order. Every restart interval of every image is a lane.
    """
    tables: dict[tuple[bytes, bytes], int] = {}
    lanes: list[tuple[np.ndarray, ...]] = []
    bodies, base, first_block, slot_rows = [], 0, 0, []
    for image in images:
        raw = np.frombuffer(data, np.uint8, image.scan[1] - image.scan[0], image.scan[0])
        body, begins = _lanes(raw)
        across, down = image.mcus()
        slots = image.slots
        per = image.restart or across * down
        n = np.minimum(per, across * down - per * np.arange(-(-across * down // per))) * len(slots)
        if len(n) != len(begins):
            raise ValueError("restart intervals are missing")
        for key in image.huffman.values():
            tables.setdefault(key, len(tables))
        keys = list(image.components)
        slot_rows.append([(tables[image.huffman[image.components[c].dc]], tables[image.huffman[image.components[c].ac]], keys.index(c)) for c in slots])
        ends = np.cumsum(n)
        lanes.append((base + begins, first_block + ends - n, n, np.full(len(n), len(slot_rows) - 1)))
        bodies.append(body)
        base, first_block = base + len(body), first_block + int(ends[-1])
    if not images:
        return []
    stream = np.concatenate([*bodies, np.full(8, 0xFF, np.uint8)])
    width = max(map(len, slot_rows))
    layout = np.zeros((len(images), width, 3), np.int64)
    sizes = np.array([len(r) for r in slot_rows])
    for i, rows in enumerate(slot_rows):
        layout[i, : len(rows)] = rows
    lut = np.stack([lookup(*key) for key in tables])
    begin, block, left, image_of = (np.concatenate(x) for x in zip(*lanes, strict=True))
    coefficients = np.zeros((first_block, 64), np.int16)
    component = np.zeros(first_block, np.int8)
    _decode_lanes(stream, lut, layout, sizes, begin * 8, block, left, image_of, coefficients, component)
    cuts = np.cumsum([int(n[2].sum()) for n in lanes])[:-1]
    return list(zip(np.split(coefficients, cuts), np.split(component, cuts), strict=True))


#: By size category: the values below HALF are negative, FULL less than their bits say.
_HALF = np.array([0, *(1 << n for n in range(15))], np.int32)
_FULL = np.array([(1 << n) - 1 for n in range(16)], np.int32)


def _decode_lanes(stream, lut, layout, sizes, bit, block, left, image_of, coefficients, component) -> None:
    """One symbol of every live lane per round, until all lanes have ended.

    k is the coefficient that a lane reads next: 0 for a DC code, else an AC code.
    """
    n = len(stream) - 8
    window = np.zeros(n, np.uint64)  # 64 bits from each byte on
    for i in range(8):
        window |= stream[i : n + i].astype(np.uint64) << np.uint64(56 - 8 * i)
    lut, flat = lut.reshape(-1), coefficients.reshape(-1)
    k, slot = np.zeros(len(bit), np.int64), np.zeros(len(bit), np.int64)
    pred = np.zeros((len(bit), int(layout[:, :, 2].max()) + 1), np.int32)
    own = layout[image_of, slot]
    while len(bit):
        dc = k == 0
        some_dc, all_dc = dc.any(), dc.all()
        table = own[:, 0] if all_dc else np.where(dc, own[:, 0], own[:, 1]) if some_dc else own[:, 1]
        at = bit >> 3
        if int(at.max()) >= n:
            raise ValueError("the scan ends early")
        bits = window[at] << (bit & 7).astype(np.uint64)
        hit = lut[(table << 16) + (bits >> np.uint64(48)).astype(np.int64)]
        length, symbol = hit >> 8, hit & 255
        if not length.all():
            raise ValueError("no such code")
        size = symbol & 15
        raw = (((bits << length.astype(np.uint64)) >> np.uint64(1)) >> (63 - size).astype(np.uint64)).astype(np.int32)
        value = raw - _FULL[size] * (raw < _HALF[size])
        bit += length + size
        if some_dc:
            where = slice(None) if all_dc else np.flatnonzero(dc)
            which = own[where, 2]
            lane = np.arange(len(bit))[where]
            pred[lane, which] += value[where]
            flat[block[where] * 64] = pred[lane, which]
            component[block[where]] = which
            k[where] = 1
        if not all_dc:
            where = np.flatnonzero(~dc) if some_dc else slice(None)
            run, held = symbol[where] >> 4, size[where] > 0
            spot = k[where] + run
            if held.all():
                flat[block[where] * 64 + np.minimum(spot, 63)] = value[where]
                k[where] = spot + 1
            else:
                flat[block[where][held] * 64 + np.minimum(spot[held], 63)] = value[where][held]
                k[where] = np.where(held | (run == 15), spot + 1, 64)
        done = np.flatnonzero(k >= 64)
        if len(done):
            k[done] = 0
            block[done] += 1
            left[done] -= 1
            slot[done] = (slot[done] + 1) % sizes[image_of[done]]
            own[done] = layout[image_of[done], slot[done]]
            live = left > 0
            if not live.all():
                bit, block, left, image_of, k, slot, pred, own = (x[live] for x in (bit, block, left, image_of, k, slot, pred, own))


def thumbnail(image: Image, coefficients: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Luminance, one pixel per 8x8 block, from the DC coefficients alone."""
    first = image.components[image.order[0]]
    dc = coefficients[component == list(image.components).index(image.order[0]), 0].astype(np.int64)
    means = np.clip((dc * image.quant[first.quant][0] + 4) // 8 + 128, 0, 255).astype(np.uint8)
    across, down = image.mcus()
    if len(image.order) == 1:
        return means.reshape(down, across)
    return means.reshape(down, across, first.v, first.h).transpose(0, 2, 1, 3).reshape(down * first.v, across * first.h)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits as hexadecimal: is each of 8x8 cells darker than the cell to its right."""
    y = np.arange(8) * pixels.shape[0] // 8
    x = np.arange(9) * pixels.shape[1] // 9
    cells = pixels[np.ix_(y, x)].astype(int)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def _head(across: int, down: int, blocks: int) -> bytes:
    part = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    huffman = bytes([1, *[0] * 15, _DATA_SYMBOL])  # one code of one bit
    return b"".join([
        b"\xff\xd8",
        part(0xFE, struct.pack(">I", blocks)),
        part(0xDB, b"\0" + bytes([1] * 64)),
        part(0xC0, struct.pack(">BHHB", 8, 8 * down, 8 * across, 1) + bytes([1, 0x11, 0])),
        part(0xC4, b"\0" + huffman),
        part(0xC4, b"\x10" + huffman),
        part(0xDD, struct.pack(">H", 1)),
        part(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ])


def _scan(blocks: np.ndarray) -> bytes:
    """Blocks of 64 bytes as restart intervals of 64 nine-bit codes, with stuffing and markers."""
    n = len(blocks)
    bits = np.zeros((n, 64, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(blocks, axis=1).reshape(n, 64, 8)
    packed = np.packbits(bits.reshape(n, 576), axis=1)
    rows = np.empty((n, 74), np.uint8)
    rows[:, :72] = packed
    rows[:, 72] = 0xFF
    rows[:, 73] = 0xD0 + np.arange(n) % 8
    flat = rows.reshape(-1)
    stuffed = np.zeros((n, 74), bool)
    stuffed[:, :72] = packed == 0xFF
    return np.insert(flat, np.flatnonzero(stuffed.reshape(-1)) + 1, 0)[:-2].tobytes()


def store(payload: np.ndarray) -> bytes:
    """A JPEG stream (one image or more) that holds a positive multiple of 64 bytes."""
    out = []
    for start in range(0, len(payload), 64 * MOST):
        blocks = payload[start : start + 64 * MOST].reshape(-1, 64)
        across = int(np.ceil(np.sqrt(len(blocks))))
        down = -(-len(blocks) // across)
        full = np.zeros((across * down, 64), np.uint8)
        full[: len(blocks)] = blocks
        out += [_head(across, down, len(blocks)), _scan(full), b"\xff\xd9"]
    return b"".join(out)


def parse_all(data: bytes) -> list[Image]:
    at, images = 0, []
    while at < len(data):
        image, at = parse(data, at)
        images.append(image)
    return images


def restore(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """The payload bytes of an image made by `store`."""
    n = struct.unpack(">I", image.comment)[0]
    diff = coefficients[:n].reshape(-1)
    return np.where(diff < 0, diff + 255, diff).astype(np.uint8)


def padded(raw: bytes) -> np.ndarray:
    out = np.zeros(max(64, -(-len(raw) // 64) * 64), np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out


COLUMNS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def features(texts: list[bytes]) -> list[tuple]:
    """Store each text, read all of the stored images back in one decoder run, and describe them."""
    stored = [store(padded(t)) for t in texts]
    parsed = [parse_all(s) for s in stored]
    at, images = 0, []
    for s, own in zip(stored, parsed, strict=True):
        for image in own:
            image.scan = (image.scan[0] + at, image.scan[1] + at)
            images.append(image)
        at += len(s)
    decoded = iter(decode(b"".join(stored), images))
    out = []
    for text, s, own in zip(texts, stored, parsed, strict=True):
        payload, shown = [], []
        for image in own:
            coefficients, component = next(decoded)
            payload.append(restore(image, coefficients).tobytes())
            shown.append(f"{image.width}x{image.height}:{difference_hash(thumbnail(image, coefficients, component))}")
        whole = b"".join(payload)
        out.append((len(text), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]), len(s), hashlib.sha256(s).hexdigest(), "+".join(shown)))
    return out


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the features of every document's stored form."""

    def described(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                rows = features([(t or "").encode() for t in part.column("text").to_pylist()])
                columns = [pa.array(v, kind) for v, kind in zip(zip(*rows, strict=True), COLUMNS.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *COLUMNS])

    kinds = {pa.int64(): "bigint", pa.string(): "string"}
    return picked(docs, doc_id=id_col, text=text_col).mapInArrow(described, "doc_id bigint, " + ", ".join(f"{c} {kinds[t]}" for c, t in COLUMNS.items()))
