"""Media columns: Netpbm and BMP bytes to numpy arrays, area resize by integral images, NPY tiles, difference hashes.

Nulls: a null image gives null features. Bytes in no known format, or cut short, give ``error`` and null features.
Images without pixels count as errors. Repeated rows keep their number; equal bytes give equal features.
Other columns pass through unless their names clash with the features' names, which win.
Texts and images of any length: the integral image is made of 1 MB at a time; an image's bytes themselves are held a few times.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

TILE = 16
#: Samples of a band of the integral image.
BAND = 1 << 20
#: A payload is padded to a multiple of this: rows of 24 samples.
UNIT, WIDTH = 576, 24


def encode_pgm(samples: np.ndarray | bytes, width: int) -> bytes:
    """8-bit grey samples as binary Netpbm (P5)."""
    data = samples if isinstance(samples, bytes) else samples.tobytes()
    return pgm_header(width, len(data)) + data


def pgm_header(width: int, size: int) -> bytes:
    return b"P5\n%d %d\n255\n" % (width, size // width)


def _header(data: bytes, n: int, at: int = 2) -> tuple[list[int], int]:
    """n decimal fields after the magic number, with comments; and where the next byte stands."""
    fields = []
    while len(fields) < n:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = data.find(b"\n", at) if data[at : at + 1] == b"#" else at + 1
            if at < 0:
                raise ValueError("header ends early")
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("header field is not a number")
        fields.append(int(data[at:end]))
        at = end
    return fields, at


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    fields, at = _header(data, 2 if kind in (1, 4) else 3)
    width, height = fields[:2]
    most = fields[2] if len(fields) > 2 else 1
    if not (width and height and 0 < most < 65536):
        raise ValueError("no pixels, or a bad maximum")
    depth = 3 if kind in (3, 6) else 1
    n = width * height * depth
    if kind in (1, 2, 3):
        text = b"\n".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
        values = np.array([c - 48 for c in text if c in b"01"] if kind == 1 else [int(x) for x in text.split()], np.int64)[:n]
    elif kind == 4:
        row = (width + 7) // 8
        packed = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        values = np.unpackbits(packed, axis=1)[:, :width].ravel()
    else:
        values = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, at + 1)
    if len(values) < n:
        raise ValueError("pixels are missing")
    if kind in (1, 4):
        values = 1 - values
    if most != 255:
        values = np.rint(values * (255.0 / most)).clip(0, 255)
    shape = (height, width, 3) if depth == 3 else (height, width)
    return np.ascontiguousarray(values, dtype=np.uint8).reshape(shape)


def _bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP with 8, 24 or 32 bits a pixel."""
    start, head, width, height, _, bits, method = struct.unpack_from("<I I i i H H I", data, 10)
    if method or bits not in (8, 24, 32) or width <= 0 or not height:
        raise ValueError("kind of BMP not supported")
    row = (width * bits // 8 + 3) // 4 * 4
    pixels = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)[:, : width * bits // 8]
    pixels = pixels[::-1] if height > 0 else pixels
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.zeros((256, 4), np.uint8)
        given = np.frombuffer(data, np.uint8, 4 * used, 14 + head).reshape(used, 4)
        palette[:used] = given
        out = palette[pixels][..., 2::-1]
        return np.ascontiguousarray(out[..., 0] if (out[..., 0] == out[..., 1]).all() and (out[..., 0] == out[..., 2]).all() else out)
    return np.ascontiguousarray(pixels.reshape(abs(height), width, bits // 8)[..., 2::-1])


def decode(data: bytes) -> np.ndarray:
    """uint8 array, height x width (grey) or height x width x 3. ValueError if it can't be read."""
    try:
        if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
            return _netpbm(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (struct.error, IndexError) as e:
        raise ValueError(str(e)) from e
    raise ValueError("no known format")


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else (image.astype(np.uint32) @ np.array([299, 587, 114], np.uint32) + 500) // 1000


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's area, with fractional edges, from the integral image (float64).

    The integral image is made in bands of rows, of which only the rows at cell borders stay.
    """
    h, w = image.shape
    y, x = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    y0, x0 = np.minimum(y.astype(int), h - 1), np.minimum(x.astype(int), w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    wanted = np.unique(np.concatenate([y0, y0 + 1]))
    kept, above = np.zeros((len(wanted), w + 1)), np.zeros(w + 1)
    band = max(1, BAND // w)
    for a in range(0, h, band):
        total = np.zeros((min(band, h - a) + 1, w + 1))  # its row i: the sum of all rows before a + i
        np.cumsum(image[a : a + band], axis=0, out=total[1:, 1:], dtype=np.float64)
        np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])
        total += above
        own = (wanted >= a) & (wanted < a + len(total))
        kept[own] = total[wanted[own] - a]
        above = total[-1].copy()
    rows = kept[np.searchsorted(wanted, y0)] * (1 - fy) + kept[np.searchsorted(wanted, y0 + 1)] * fy
    at = rows[:, x0] * (1 - fx) + rows[:, x0 + 1] * fx
    cells = at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]
    return cells / (np.diff(y)[:, None] * np.diff(x)[None, :])


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def features(image: np.ndarray, tile: int = TILE) -> tuple[int, int, bytes, str]:
    """Height, width, NPY tile (uint8) and 64-bit difference hash in hex."""
    image = grey(image)
    small = np.rint(area_resize(image, tile, tile)).clip(0, 255).astype(np.uint8)
    nine = area_resize(image, 8, 9)
    bits = np.packbits((nine[:, 1:] > nine[:, :-1] + 1e-9).ravel()).tobytes()
    return *image.shape, npy(small), bits.hex()


def text_to_media(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Texts as PGM images: UTF-8 padded with 255 to a positive multiple of 576, rows of 24 samples. Null: empty text."""

    def make():
        def f(batch):
            sizes, media = [], []
            for x in batch.column(1).cast(pa.binary()):
                data = x.as_py() or b""
                fill = (-len(data)) % UNIT if data else UNIT
                sizes.append(len(data))
                media.append(b"".join([pgm_header(WIDTH, len(data) + fill), data, b"\xff" * fill]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

        return f

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), text), make, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


FEATURES = "height int, width int, tile binary, dhash string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, error string"


def decode_media(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",), tile: int = TILE) -> DataFrame:
    """Features of each stored image: its size, NPY tile, difference hash, and digests of its samples and of the stored bytes."""
    names = [x.split()[0] for x in FEATURES.split(", ")]
    keep = tuple(k for k in keep if k not in names)

    def make():
        def one(data):
            if data is None:
                return (None,) * 9 + ("null",)
            try:
                image = decode(data)
                height, width, tile_bytes, dhash = features(image, tile)
                samples = memoryview(image).cast("B")
            except ValueError as e:
                return (None,) * 7 + (len(data), hashlib.sha256(data).hexdigest(), str(e) or "error")
            return height, width, tile_bytes, dhash, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), None

        types = [pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

        def f(batch):
            rows = [one(x.as_py()) for x in batch.column(len(keep))]
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], [*keep, *names])

        return f

    source = df.select(*keep, media)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), FEATURES])
    return map_batches(source, make, schema)


def op10(df: DataFrame) -> DataFrame:
    """The contract's digests. ``feature`` is the difference hash and the crc32 of the NPY tile."""
    out = decode_media(text_to_media(df), keep=("doc_id", "n_bytes"))
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat_ws("-", "dhash", F.lower(F.hex(F.crc32("tile")))).alias("feature"), "height", "width", "tile",
    )
