"""Media columns: Netpbm and BMP images as numpy arrays, NPY tiles and difference hashes.

`opened` reads P1 to P6 (plain and raw bitmaps, grey maps and pixel maps, samples
of one or two bytes), PAM (P7) and BMP of 1, 4, 8, 16, 24 and 32 bits, either way up, with
OS/2 or later headers, colour masks, and RLE4 or RLE8 packing. Tiles are resized by
area: the integral image, taken at fractional edges, gives the exact mean of
the source area under each target pixel. Pixels are decoded and summed block by block, so
memory follows the size of the file, never that of the picture, and pictures of any size are read.
The difference hash compares neighbours of a grey 9 x 8 version.

Defined results: NULL or undecodable media give NULL size, tile and hash, and the
column error tells why (NULL for NULL media); fields that claim more than the bytes hold are an
error before anything is reserved for them; repeated rows give the same tiles;
an empty table gives an empty result. Input columns named like an output column
are replaced. PAM and BMP transparency is left out.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType

from .common import carry, col, others, prepare, table

TILE = 16
#: Pixels of a block that is decoded at once.
BLOCK = 1 << 18
_COLUMNS = ("width", "height", "channels", "tile", "dhash", "error")
_TOKEN = re.compile(rb"(?:\s|#[^\r\n]*)*([0-9]+)")


@dataclass
class Picture:
    """An image whose pixels are decoded when asked for: block(y0, y1, x0, x1) gives uint8 of (rows, columns, channels)."""

    height: int
    width: int
    channels: int
    block: Callable[[int, int, int, int], np.ndarray]

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.height, self.width, self.channels

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, first column, pixels) of blocks, row by row of blocks."""
        wide = min(self.width, BLOCK)
        high = max(1, BLOCK // wide)
        for y in range(0, self.height, high):
            for x in range(0, self.width, wide):
                yield y, x, self.block(y, min(self.height, y + high), x, min(self.width, x + wide))


def whole(image: np.ndarray) -> Picture:
    return Picture(*image.shape, lambda y0, y1, x0, x1: image[y0:y1, x0:x1])


def opened(data: bytes) -> Picture:
    """The image in these bytes; ValueError if there is none."""
    if data[:2] == b"BM":
        return _bmp(data)
    if len(data) > 2 and data[:1] == b"P" and data[1:2] in b"1234567":
        return _pam(data) if data[1:2] == b"7" else _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def decode(data: bytes) -> np.ndarray:
    """(height, width, channels) of uint8, all at once; ValueError if the bytes aren't such an image."""
    p = opened(data)
    return np.ascontiguousarray(p.block(0, p.height, 0, p.width))


def _number(digits: bytes) -> int:
    """A number of a header; one of very many digits is an error."""
    digits = digits.lstrip(b"0")
    if len(digits) > 10:
        raise ValueError("bad Netpbm header")
    return int(digits or b"0")


def _scaled(v: np.ndarray, most: int) -> np.ndarray:
    if v.size and v.max() > most:
        raise ValueError("Netpbm sample above its maximum")
    return v if most == 255 else ((v.astype(np.uint32) * 255 + most // 2) // most).astype(np.uint8)


def _raw_samples(body: np.ndarray, height: int, width: int, channels: int, most: int, used: int) -> Picture:
    """Samples of one byte, or two for a maximum above 255, of which the first `used` channels count."""
    size = 2 if most > 255 else 1
    if len(body) < height * width * channels * size:
        raise ValueError("short Netpbm")
    rows = body[: height * width * channels * size].reshape(height, width, channels * size)

    def block(y0: int, y1: int, x0: int, x1: int) -> np.ndarray:
        v = np.ascontiguousarray(rows[y0:y1, x0:x1])
        return _scaled((v.view(">u2") if size == 2 else v)[:, :, :used], most)

    return Picture(height, width, used, block)


def _plain(body: bytes, n: int, most: int) -> np.ndarray:
    """The first n numbers of a text, scaled to a byte each."""
    text = np.frombuffer(re.sub(rb"#[^\r\n]*", b" ", body) if b"#" in body else body, np.uint8)
    out, have, at = np.empty(n, np.uint8), 0, 0
    while have < n and at < len(text):
        end = min(len(text), at + (1 << 20))
        while end < len(text) and not _SPACES[text[end]]:
            end += 1
        part = text[at:end]
        at = end
        digit = ~_SPACES[part]
        start = np.flatnonzero(digit & ~np.r_[False, digit[:-1]])
        stop = np.flatnonzero(digit & ~np.r_[digit[1:], False]) + 1
        start, stop = start[: n - have], stop[: n - have]
        if not len(start):
            continue
        if (part[: stop[-1]][digit[: stop[-1]]] - 48 > 9).any():
            raise ValueError("bad Netpbm sample")
        v = np.zeros(len(start), np.int64)
        long = np.flatnonzero(stop - start > 10)
        for k in long.tolist():
            own = part[start[k] : stop[k]].tobytes().lstrip(b"0")
            if len(own) > 5:
                raise ValueError("Netpbm sample above its maximum")
            start[k] = stop[k] - max(1, len(own))
        for k in range(int((stop - start).max())):
            on = start + k < stop
            v[on] = v[on] * 10 + (part[start[on] + k] - 48)
        out[have : have + len(v)] = _scaled(v, most)
        have += len(v)
    if have < n:
        raise ValueError("short Netpbm")
    return out


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def _netpbm(data: bytes) -> Picture:
    kind, at, head = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("bad Netpbm header")
        head.append(_number(m[1]))
        at = m.end()
    width, height = head[:2]
    most = head[2] if len(head) > 2 else 1
    if not (0 < width and 0 < height and 0 < most < 65536):
        raise ValueError("bad Netpbm size")
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if kind <= 3 and n > len(data):
        raise ValueError("short Netpbm")
    if kind == 1:
        bits = np.frombuffer(re.sub(rb"#[^\r\n]*", b"", data[at:]), np.uint8)
        bits = bits[~_SPACES[bits]][:n]
        if len(bits) < n:
            raise ValueError("short Netpbm")
        if ((bits != 48) & (bits != 49)).any():
            raise ValueError("bad Netpbm sample")
        return whole(((49 - bits) * np.uint8(255)).reshape(height, width, 1))
    if kind in (2, 3):
        return whole(_plain(data[at:], n, most).reshape(height, width, channels))
    body = np.frombuffer(data, np.uint8, offset=min(at + 1, len(data)))
    if kind != 4:
        return _raw_samples(body, height, width, channels, most, channels)
    row = (width + 7) // 8
    if len(body) < row * height:
        raise ValueError("short Netpbm")
    rows = body[: row * height].reshape(height, row)
    return Picture(height, width, 1, lambda y0, y1, x0, x1: ((1 - _bits(rows[y0:y1], x0, x1)) * np.uint8(255))[:, :, None])


def _bits(rows: np.ndarray, x0: int, x1: int) -> np.ndarray:
    return np.unpackbits(rows[:, x0 // 8 : -(-x1 // 8)], axis=1)[:, x0 % 8 : x0 % 8 + x1 - x0]


def _pam(data: bytes) -> Picture:
    head, end = {}, data.find(b"ENDHDR\n")
    if end < 0 or end > 1 << 16:
        raise ValueError("bad PAM header")
    for line in data[2:end].split(b"\n"):
        key, _, value = line.strip().partition(b" ")
        if key and not key.startswith(b"#"):
            head[key] = value.strip()
    sizes = [head.get(k, b"") for k in (b"HEIGHT", b"WIDTH", b"DEPTH", b"MAXVAL")]
    if not all(x.isdigit() for x in sizes):
        raise ValueError("bad PAM header")
    height, width, depth, most = map(_number, sizes)
    if not (0 < width and 0 < height and 0 < depth < 1 << 16 and 0 < most < 65536):
        raise ValueError("bad PAM size")
    body = np.frombuffer(data, np.uint8, offset=end + 7)
    return _raw_samples(body, height, width, depth, most, 3 if depth > 2 else 1)


def _bmp(data: bytes) -> Picture:
    if len(data) < 26:
        raise ValueError("short BMP")
    offset, head = struct.unpack_from("<II", data, 10)
    if head == 12:
        width, height, _, bits = struct.unpack_from("<HHHH", data, 18)
        packing = colours = 0
    elif head >= 40 and len(data) >= 54:
        width, height, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
        colours = struct.unpack_from("<I", data, 46)[0]
    else:
        raise ValueError("bad BMP header")
    down, height = height < 0, abs(height)
    if not (0 < width and 0 < height):
        raise ValueError("bad BMP header")
    if bits not in (1, 4, 8, 16, 24, 32) or packing not in (0, 1, 2, 3, 6) or (packing in (1, 2)) != (bits == {1: 8, 2: 4}.get(packing)) or packing in (3, 6) and bits not in (16, 32):
        raise ValueError("BMP of this kind is not read")
    body = np.frombuffer(data, np.uint8, offset=min(offset, len(data)))
    table_ = None
    if bits <= 8:
        size = 3 if head == 12 else 4
        colours = min(colours or 1 << bits, 1 << bits)
        table_ = np.frombuffer(data, np.uint8, offset=min(14 + head, len(data)))[: colours * size]
        if len(table_) < colours * size:
            raise ValueError("short BMP palette")
        table_ = table_.reshape(-1, size)[:, 2::-1]
    if packing in (1, 2):
        body, row = _run_lengths(body, width, height, bits), width
    else:
        row = (width * bits + 31) // 32 * 4
        if len(body) < row * height:
            raise ValueError("short BMP")
    rows = body[: row * height].reshape(height, row)
    masks = None
    if bits in (16, 32):
        masks = (0x7C00, 0x3E0, 0x1F) if bits == 16 else (0xFF0000, 0xFF00, 0xFF)
        if packing:
            if len(data) < 66:
                raise ValueError("short BMP")
            masks = struct.unpack_from("<III", data, 54)
        if any(not m or (m // (m & -m)) & (m // (m & -m)) + 1 for m in masks):
            raise ValueError("bad BMP mask")

    def block(y0: int, y1: int, x0: int, x1: int) -> np.ndarray:
        own = rows[y0:y1] if down else rows[::-1][y0:y1]
        if bits == 24:
            return own[:, 3 * x0 : 3 * x1].reshape(len(own), -1, 3)[:, :, ::-1]
        if masks:
            v = np.ascontiguousarray(own[:, x0 * bits // 8 : x1 * bits // 8]).view("<u2" if bits == 16 else "<u4").astype(np.int64)
            parts = [((v & m) // (m & -m), m // (m & -m)) for m in masks]
            return np.stack([((p * 255 + most // 2) // most).astype(np.uint8) for p, most in parts], axis=2)
        if bits == 1:
            index = _bits(own, x0, x1)
        elif bits == 4 and not packing:
            index = np.stack([own[:, x0 // 2 : -(-x1 // 2)] >> 4, own[:, x0 // 2 : -(-x1 // 2)] & 15], axis=2).reshape(len(own), -1)[:, x0 % 2 : x0 % 2 + x1 - x0]
        else:
            index = own[:, x0:x1]
        if index.max() >= len(table_):
            raise ValueError("BMP index outside its palette")
        return table_[index]

    return Picture(height, width, 3, block)


def _run_lengths(body: np.ndarray, width: int, height: int, bits: int) -> np.ndarray:
    """Palette indexes of RLE data, a byte each; what the runs leave out is 0. As two bytes make 255
    pixels at most, a picture of more is short."""
    if width * height > 128 * len(body):
        raise ValueError("short BMP")
    out, x, y, i, data = np.zeros(width * height, np.uint8), 0, 0, 0, body.tobytes()

    def put(values: np.ndarray) -> None:
        nonlocal x
        if y < height and x < width:
            values = values[: width - x]
            out[y * width + x : y * width + x + len(values)] = values
        x += len(values)

    while i + 1 < len(data):
        n, v = data[i], data[i + 1]
        i += 2
        if n:
            put(np.full(n, v, np.uint8) if bits == 8 else np.resize(np.array([v >> 4, v & 15], np.uint8), n))
        elif v == 0:
            x, y = 0, y + 1
        elif v == 1:
            return out
        elif v == 2:
            if i + 1 < len(data):
                x, y = x + data[i], y + data[i + 1]
            i += 2
        else:
            size = v if bits == 8 else (v + 1) // 2
            own = np.frombuffer(data[i : i + size], np.uint8)
            if len(own) < size:
                break
            put(own if bits == 8 else np.stack([own >> 4, own & 15], axis=1).reshape(-1)[:v])
            i += size + size % 2
    raise ValueError("short BMP")


def encode_netpbm(image: np.ndarray, kind: int, most: int = 255) -> bytes:
    """Bytes of an image as P1 to P7; bitmaps are set where it is dark, maxima above 255 stretch the samples."""
    h, w, c = image.shape
    head = f"P{kind}\n# tile\n{w} {h}\n".encode()
    if kind == 1:
        return head + b"\n".join(b"".join(b"1" if v < 128 else b"0" for v in row) for row in image[:, :, 0])
    if kind == 4:
        return head + np.packbits(image[:, :, 0] < 128, axis=1).tobytes()
    samples = (image.astype(np.uint32) * most + 127) // 255
    if kind == 7:
        head = f"P7\nWIDTH {w}\nHEIGHT {h}\nDEPTH {c}\nMAXVAL {most}\nTUPLTYPE {'RGB' if c == 3 else 'GRAYSCALE'}\nENDHDR\n".encode()
    else:
        head += f"{most}\n".encode()
    if kind in (2, 3):
        return head + " ".join(map(str, samples.reshape(-1))).encode()
    return head + samples.astype(">u2" if most > 255 else np.uint8).tobytes()


def encode_bmp(image: np.ndarray, bits: int = 24) -> bytes:
    """Bytes of an image as BMP, bottom up: 24 bits, 32 bits with masks, or a grey palette of 8, 4 or 1 bits."""
    h, w, c = image.shape
    row, palette, packing = (w * bits + 31) // 32 * 4, b"", 0
    body = np.zeros((h, row), np.uint8)
    if bits >= 24:
        rgb = np.repeat(image, 3, axis=2) if c == 1 else image
        if bits == 32:
            packing, palette = 3, struct.pack("<III", 0xFF, 0xFF00, 0xFF0000)
            rgb = np.concatenate([rgb, np.zeros((h, w, 1), np.uint8)], axis=2)
            body[:, : w * 4] = rgb[::-1].reshape(h, w * 4)
        else:
            body[:, : w * 3] = rgb[::-1, :, ::-1].reshape(h, w * 3)
    else:
        most = (1 << bits) - 1
        index = ((image[::-1, :, 0].astype(np.uint32) * most + 127) // 255).astype(np.uint8)
        palette = b"".join(bytes([k * 255 // most] * 3 + [0]) for k in range(most + 1))
        wide = np.zeros((h, row * 8 // bits), np.uint8)
        wide[:, :w] = index
        body = wide if bits == 8 else np.packbits(wide, axis=1) if bits == 1 else wide[:, ::2] << 4 | wide[:, 1::2]
    at = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", at + body.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, packing, body.size, 2835, 2835, 0, 0) + palette + body.tobytes()


def _edges(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(whole part, fraction) of the edges of m equal areas of n pixels."""
    edge = np.arange(m + 1) * n / m
    low = np.minimum(edge.astype(np.int64), n - 1)
    return low, edge - low


def _resized(picture: Picture, sizes: list[tuple[int, int, Callable[[np.ndarray], np.ndarray], int]]) -> list[np.ndarray]:
    """Exact area means, as float64, for each (height, width, what to make of the pixels first, channels), in one pass.

    The integral image is summed block by block and read at the edges only, between four of its points.
    """
    h, w, _ = picture.shape
    plans = []
    for height, width, view, c in sizes:
        (y, fy), (x, fx) = _edges(h, height), _edges(w, width)
        plans.append((y, fy, x, fx, view, np.zeros((height + 1, width + 1, c)), np.zeros((width + 1, c))))
    strips: dict[int, list] = {}
    for y0, x0, pixels in picture.blocks():
        for k, (y, fy, x, fx, view, out, above) in enumerate(plans):
            block = view(pixels)
            n, m, c = block.shape
            if x0 == 0:
                strips[k] = [np.zeros((n, x.size, c)), np.zeros((n, c))]
            at_edges, left = strips[k]
            sums = np.zeros((n, m + 1, c))
            np.cumsum(block, axis=1, out=sums[:, 1:], dtype=np.float64)
            own = np.flatnonzero((x >= x0) & (x < x0 + m))
            i = x[own] - x0
            f = fx[own][None, :, None]
            at_edges[:, own] = left[:, None] + sums[:, i] * (1 - f) + sums[:, i + 1] * f
            left += sums[:, -1]
            if x0 + m == w:
                down = np.concatenate([above[None], above + np.cumsum(at_edges, axis=0)])
                mine = np.flatnonzero((y >= y0) & (y < y0 + n))
                i, f = y[mine] - y0, fy[mine][:, None, None]
                out[mine] = down[i] * (1 - f) + down[i + 1] * f
                above[:] = down[-1]
    return [np.diff(np.diff(p[5], axis=0), axis=1) / (h / height * w / width) for p, (height, width, _, _) in zip(plans, sizes)]


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact area means of an image, as float64 of (height, width, channels)."""
    return _resized(whole(image), [(height, width, lambda v: v, image.shape[2])])[0]


def grey(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float64) if image.shape[2] == 1 else (image @ np.array([0.299, 0.587, 0.114]))[:, :, None]


def _hash(small: np.ndarray) -> int:
    small = np.rint(small[:, :, 0] * 256)
    return int(np.packbits(small[:, :-1] > small[:, 1:]).view(">i8")[0])


def dhash(image: np.ndarray) -> int:
    """64 bits, row by row, most significant first: is a pixel brighter than its right neighbour."""
    return _hash(_resized(whole(image), [(8, 9, grey, 1)])[0])


def tile_of(picture: Picture, size: int) -> tuple[np.ndarray, int]:
    """(tile of uint8, difference hash), decoding the picture once."""
    tile, small = _resized(picture, [(size, size, lambda v: v, picture.channels), (8, 9, grey, 1)])
    return np.clip(np.rint(tile), 0, 255).astype(np.uint8), _hash(small)


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def tiles(rows: DataFrame, media: str = "media", size: int = TILE) -> DataFrame:
    """rows without the media column, with width, height, channels, tile (NPY bytes), dhash and error."""
    rest = others(rows, media, *_COLUMNS)

    def one(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None, None, None, None
        try:
            picture = opened(data)
            tile, bits = tile_of(picture, size)
        except (ValueError, OverflowError, struct.error) as e:
            return None, None, None, None, None, str(e)
        return picture.width, picture.height, picture.channels, npy(tile), bits, None

    def work(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string())
        cols = list(zip(*map(one, b.column(0).to_pylist()))) or [()] * 6
        yield b, [pa.array(c, k) for c, k in zip(cols, types)]

    kinds = (IntegerType(), IntegerType(), IntegerType(), BinaryType(), LongType(), StringType())
    return carry(rows, [col(media).cast("binary")], rest, work, list(zip(_COLUMNS, kinds)))


def write_npy(tiled: DataFrame, folder: str, key: str) -> int:
    """Writes each tile to folder/<key>.npy from the executors, through a temporary name, so that
    a task that runs again leaves whole files; returns how many. The folder has to be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                draft = os.path.join(folder, f".{uuid.uuid4().hex}")
                with open(draft, "wb") as f:
                    f.write(data)
                os.replace(draft, os.path.join(folder, f"{name}.npy"))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    named = tiled.where(col(key).isNotNull() & F.col("tile").isNotNull()).select(col(key).cast("string").alias("key"), "tile")
    return named.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


#: All kinds that `opened` reads: bitmaps, grey and colour maps of one and two bytes, PAM, and BMP with and without palette.
_KINDS = (
    lambda p, c: encode_netpbm(p, 5), lambda p, c: encode_netpbm(c, 6), lambda p, c: encode_netpbm(p, 2), lambda p, c: encode_netpbm(c, 3), lambda p, c: encode_bmp(c),
    lambda p, c: encode_netpbm(p, 1), lambda p, c: encode_netpbm(p, 4), lambda p, c: encode_netpbm(c, 6, 1023), lambda p, c: encode_netpbm(c, 7), lambda p, c: encode_bmp(c, 32),
    lambda p, c: encode_bmp(p, 8), lambda p, c: encode_bmp(p, 4), lambda p, c: encode_bmp(p, 1),
)


def pictures(embeddings: DataFrame) -> DataFrame:
    """(vec_id, media): each vector drawn as an image, its format and size chosen by vec_id."""
    prepare(embeddings.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, vec in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not vec:
                    out.append(None)
                    continue
                v = np.nan_to_num(np.array([0.0 if x is None else x for x in vec]))
                side = int(np.ceil(np.sqrt(len(v))))
                square = np.zeros(side * side)
                square[: len(v)] = v
                low, high = square.min(), square.max()
                pixels = np.rint((square - low) / (high - low if high > low else 1) * 255).astype(np.uint8).reshape(side, side, 1)
                k = int(key or 0)
                pixels = np.repeat(np.repeat(pixels, 2 + k % 3, axis=0), 3 + k % 2, axis=1)
                colour = np.concatenate([pixels, 255 - pixels, pixels // 2], axis=2)
                out.append(_KINDS[k % len(_KINDS)](pixels, colour))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "media"])

    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, media binary")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles(pictures(table(spark, sf_dir, "embeddings")))


QUERIES = {"op7_media": op7_media}
ORACLE_SQL: dict[str, str] = {}
