"""Media columns: texts stored as lossless WebP images, read back and described.

A text's payload is its UTF-8 bytes, padded with bytes 255 to a positive multiple of 576, and becomes a picture of 192
columns whose pixels are three bytes each (red, green, blue). A payload of more than ``ROWS`` rows becomes several pictures,
one file after the other. Null and empty texts have a payload of padding alone. Equal texts give equal bytes. Rows are
stored one by one, whatever their ids.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from scoreframe.llm.common import table
from scoreframe.llm.webp import decode_all, encode_all, size_of

UNIT, COLUMNS, ROWS = 576, 192, 4096
#: Documents that are handled together, and bytes of their payloads; of them, rows of pictures that are encoded and pixels
#: that are decoded together. One document or picture may have more.
DOCUMENTS, PAYLOADS, TOGETHER, READ_TOGETHER = 4096, 1 << 24, 1024, 1 << 23
_NINTHS = np.arange(9) * COLUMNS // 9


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload and its length before padding."""
    raw = (text or "").encode("utf-8", "replace")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\xff"), len(raw)


def store_all(payloads: list[bytes]) -> list[bytes]:
    """Each payload as one or more WebP files. Pictures are encoded together as long as they have few rows."""
    pictures, owners, files, held = [], [], [b""] * len(payloads), 0

    def flush():
        for owner, file in zip(owners, encode_all(pictures), strict=True):
            files[owner] += file
        pictures.clear()
        owners.clear()

    for owner, payload in enumerate(payloads):
        rows = np.frombuffer(payload, np.uint8).reshape(-1, COLUMNS, 3)
        for at in range(0, len(rows), ROWS):
            picture = rows[at : at + ROWS]
            if held + len(picture) > TOGETHER:
                flush()
                held = 0
            pictures.append(picture)
            owners.append(owner)
            held += len(picture)
    flush()
    return files


def store(payload: bytes) -> bytes:
    """One payload as one or more WebP files."""
    return store_all([payload])[0]


def load_all(stored: list[bytes]) -> list[list[np.ndarray]]:
    """Each row's pictures' samples (height, width, 3), read back from the stored bytes. Files are decoded together as long
    as they are small."""
    files, owners, out, held = [], [], [[] for _ in stored], 0

    def flush():
        for owner, image in zip(owners, decode_all(files), strict=True):
            out[owner].append(image[..., 1:])
        files.clear()
        owners.clear()

    for owner, data in enumerate(stored):
        at = 0
        while at < len(data):
            size = 8 + struct.unpack("<I", data[at + 4 : at + 8])[0]
            file = data[at : at + size]
            width, height = size_of(file)
            if held + width * height > READ_TOGETHER:
                flush()
                held = 0
            files.append(file)
            owners.append(owner)
            at, held = at + size, held + width * height
    flush()
    return out


def load(stored: bytes) -> list[np.ndarray]:
    """One row's pictures."""
    return load_all([stored])[0]


def describe(pictures: list[np.ndarray]) -> str:
    """Sizes, mean and deviation of all samples, and an 8 by 8 difference hash of each picture's brightness grid."""
    hashes, total, square, count = [], 0, 0, 0
    for picture in pictures:
        samples = picture.astype(np.int64)
        grey = samples[..., 0] + samples[..., 1] + samples[..., 2]
        edges = sorted({k * len(grey) // 8 for k in range(8)})
        grid = np.add.reduceat(np.add.reduceat(grey, edges, axis=0), _NINTHS, axis=1)
        hashes.append(f"{int.from_bytes(np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes(), 'big'):x}")
        total += int(grey.sum())
        square += int(np.square(samples).sum())
        count += picture.size
    mean = total / count
    shapes = "+".join(f"{p.shape[1]}x{p.shape[0]}" for p in pictures)
    return f"{shapes} mean={mean:.4f} sd={max(0.0, square / count - mean * mean) ** 0.5:.4f} dhash={'+'.join(hashes)}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): sizes, digests and features of the stored form; with the form itself on demand."""

    def described(ids, payloads):
        files, rows = store_all([p for p, _ in payloads]), []
        for doc_id, (_, size), stored, pictures in zip(ids, payloads, files, load_all(files), strict=True):
            back = b"".join([p.tobytes() for p in pictures])
            rows.append((doc_id, size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(pictures), stored))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")] + ["media"])
        out["doc_id"] = out.doc_id.astype("Int64")
        return out if keep_media else out.drop(columns="media")

    def run(frames):
        for pdf in frames:
            ids, payloads, held = [], [], 0
            for doc_id, text in zip(pdf.doc_id, pdf.text, strict=True):
                ids.append(doc_id)
                payloads.append(payload_of(text))
                held += len(payloads[-1][0])
                if held > PAYLOADS or len(ids) == DOCUMENTS:
                    yield described(ids, payloads)
                    ids, payloads, held = [], [], 0
            if ids:
                yield described(ids, payloads)

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA + ", media binary" * keep_media)


def op10_media(spark, sf_dir) -> DataFrame:
    """Every document stored as lossless WebP, read back and described."""
    return media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))
