"""Media columns: store bytes as media, sniff what a media column really holds.

An Aho-Corasick automaton finds every known signature in one pass over the bytes;
a validator of the format then walks its structure and confirms the length it
claims. The hit at offset 0 corrects the declared type, confirmed hits further in
are carved out as embedded media.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordtable import slices

#: Fixed values of public file formats: signature, place of the signature in the file, type.
SIGNATURES = (
    (b"RIFF", 0, "riff"),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"BM", 0, "image/bmp"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "audio/ogg"),
    (b"ftyp", 4, "video/mp4"),
)
#: Payload unit, padding byte and sample rate of stored payloads.
UNIT, PAD, RATE = 192, 32, 8000


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM; every payload byte is one sample, so nothing is lost."""
    pad = b"\0" * (len(payload) % 2)
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _riff(b: bytes, at: int, marks: Marks) -> tuple[int, str, dict] | None:
    if at + 12 > len(b):
        return None
    size = struct.unpack_from("<I", b, at + 4)[0] + 8
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}.get(b[at + 8 : at + 12])
    if not kind or at + size > len(b):
        return None
    place, info = at + 12, {}
    while place + 8 <= at + size:
        name, n = b[place : place + 4], struct.unpack_from("<I", b, place + 4)[0]
        if place + 8 + n > at + size:
            return None
        if name == b"fmt " and n >= 16:
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", b, place + 8)
            info |= {"channels": channels, "rate": rate, "bits": bits}
        elif name == b"data":
            info |= {"data_at": place + 8, "data_bytes": n}
        place += 8 + n + n % 2
    if place != at + size or kind == "audio/wav" and not {"bits", "data_at"} <= info.keys():
        return None
    return size, kind, info


def _png(b: bytes, at: int, marks: Marks):
    place = at + 8
    if b[place + 4 : place + 8] != b"IHDR":
        return None
    width, height = struct.unpack_from(">II", b, place + 8) if place + 16 <= len(b) else (0, 0)
    while place + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, place)
        if place + 12 + n > len(b) or zlib.crc32(b[place + 4 : place + 8 + n]) != struct.unpack_from(">I", b, place + 8 + n)[0]:
            return None
        place += 12 + n
        if name == b"IEND":
            return place - at, "image/png", {"width": width, "height": height}
    return None


def _gif(b: bytes, at: int, marks: Marks):
    if at + 13 > len(b):
        return None
    width, height, flags = struct.unpack_from("<HHB", b, at + 6)
    place = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    while place < len(b):
        mark = b[place]
        if mark == 0x3B:
            return place + 1 - at, "image/gif", {"width": width, "height": height}
        if mark == 0x2C and place + 10 <= len(b):
            local = b[place + 9]
            place += 11 + (3 << (local & 7) + 1 if local & 128 else 0)
        elif mark == 0x21:
            place += 2
        else:
            return None
        while place < len(b) and b[place]:
            place += 1 + b[place]
        place += 1
    return None


def _jpeg(b: bytes, at: int, marks: Marks):
    place = at + 2
    while place + 4 <= len(b) and at < marks.last_jpeg_end:
        if b[place] != 0xFF:
            return None
        mark = b[place + 1]
        if mark == 0xD9:
            return place + 2 - at, "image/jpeg", {}
        n = struct.unpack_from(">H", b, place + 2)[0]
        if n < 2:
            return None
        place += 2 + n
        if mark == 0xDA:  # entropy-coded data up to the next marker that is not stuffed or a restart
            while True:
                place = b.find(b"\xff", place)
                if place < 0 or place + 1 >= len(b):
                    return None
                if b[place + 1] and not 0xD0 <= b[place + 1] <= 0xD7:
                    break
                place += 2
            if b[place + 1] == 0xD9:
                return place + 2 - at, "image/jpeg", {}
    return None


def _bmp(b: bytes, at: int, marks: Marks):
    if at + 30 > len(b):
        return None
    size, reserved, data, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if reserved or planes != 1 or header not in (40, 52, 56, 108, 124) or bits not in (1, 4, 8, 16, 24, 32) or not 14 + header <= data <= size or at + size > len(b):
        return None
    return size, "image/bmp", {"width": width, "height": height}


class Marks:
    """What validators look for beyond a hit, found once for all hits of a text."""

    def __init__(self, data: bytes):
        self.data, self.walked = data, set()

    @cached_property
    def pdf_heads(self) -> list[int]:
        return [m.start() for m in re.finditer(rb"%PDF-", self.data)]

    @cached_property
    def pdf_tails(self) -> list[tuple[int, int, int]]:
        """(start, end, offset of the cross-reference) of every end of a PDF revision."""
        return [(m.start(), m.end(), int(m[1])) for m in re.finditer(rb"startxref\s{1,2}([0-9]{1,10})\s{1,2}%%EOF", self.data)]

    @cached_property
    def zips(self) -> dict[int, int]:
        """Start -> end of every archive, from its end record."""
        found = {}
        for m in re.finditer(rb"PK\x05\x06", self.data):
            if m.start() + 22 <= len(self.data):
                size, start, comment = struct.unpack_from("<IIH", self.data, m.start() + 12)
                end = m.start() + 22 + comment
                if end <= len(self.data):
                    found[m.start() - size - start] = end
        return found

    @cached_property
    def last_jpeg_end(self) -> int:
        return self.data.rfind(b"\xff\xd9")


def _pdf(b: bytes, at: int, marks: Marks):
    """Up to the last revision before the next PDF whose cross-reference lies in the file."""
    heads, tails = marks.pdf_heads, marks.pdf_tails
    k = bisect_right(heads, at)
    stop, end = heads[k] if k < len(heads) else len(b), 0
    for start, after, offset in tails[bisect_left(tails, (at,)) : bisect_left(tails, (stop,))]:
        if offset == 0 or at + offset < start and (b.startswith(b"xref", at + offset) or re.match(rb"[0-9]+ [0-9]+ obj", b[at + offset : at + offset + 24])):
            end = after
    return (end - at, "application/pdf", {}) if end else None


def _zip(b: bytes, at: int, marks: Marks):
    return (marks.zips[at] - at, "application/zip", {}) if at in marks.zips else None


def _flac(b: bytes, at: int, marks: Marks):
    """The metadata blocks; frames state no length, so what follows stays open."""
    if b[at + 5 : at + 8] != b"\0\0\x22" or at + 8 > len(b) or b[at + 4] & 127:
        return None
    place, last = at + 4, False
    while not last:
        if place + 4 > len(b):
            return None
        last, n = b[place] & 128, int.from_bytes(b[place + 1 : place + 4])
        place += 4 + n
    return (place - at, "audio/flac", {"open": 1}) if place <= len(b) else None


def _ogg(b: bytes, at: int, marks: Marks):
    place = at
    while b[place : place + 4] == b"OggS" and place + 27 <= len(b) and b[place + 4] == 0 and place not in marks.walked:
        marks.walked.add(place)  # a walk that failed from here fails again
        n = b[place + 26]
        if place + 27 + n > len(b):
            return None
        last = b[place + 5] & 4
        place += 27 + n + sum(b[place + 27 : place + 27 + n])
        if place > len(b):
            return None
        if last:
            return place - at, "audio/ogg", {}
    return None


def _mp4(b: bytes, at: int, marks: Marks):
    place, boxes = at, 0
    while place + 8 <= len(b):
        n, name = struct.unpack_from(">I4s", b, place)
        if n < 8 or place + n > len(b) or not name.isalnum():
            break
        place, boxes = place + n, boxes + 1
    return (place - at, "video/mp4", {}) if boxes > 1 else None


_VALIDATE = {"riff": _riff, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "application/pdf": _pdf, "application/zip": _zip, "audio/flac": _flac, "audio/ogg": _ogg, "video/mp4": _mp4}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for mark, before, kind in SIGNATURES:
        machine.add_word(mark.decode("latin-1"), (len(mark) - 1 + before, kind))
    machine.make_automaton()
    return machine


def sniff(data: bytes) -> list[tuple[int, int, str, dict]]:
    """(offset, length, type, details) of every confirmed medium, in order.

    Media within a medium that was carved whole are not listed again, except those
    in its payload when it starts at 0 (a container of other media). A medium whose end
    is not confirmed (open) has the length that is.
    """
    found, end, marks = [], 0, Marks(data)
    for last, (back, kind) in _automaton().iter(data.decode("latin-1")):
        at = last - back
        if at < end or at < 0:
            continue
        hit = _VALIDATE[kind](data, at, marks)
        if hit:
            found.append((at, *hit))
            if at:
                end = at + hit[0]
    return found


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "application/octet-stream") -> DataFrame:
    """doc_id, n_bytes, declared, media: each text's bytes, padded with PAD to a positive multiple of UNIT, as a WAV file.

    Null texts are empty: one unit of padding. Ids are passed through.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch):
                raw = [x or b"" for x in piece.column(1).to_pylist()]
                media = [wav(x + bytes([PAD]) * (-len(x) % UNIT or (0 if x else UNIT))) for x in raw]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary").withColumn("declared", F.lit(declared))


def inspect_media(media: DataFrame) -> DataFrame:
    """Reads a media column (doc_id, n_bytes, declared, media) back.

    Adds the sniffed type (declared where nothing is confirmed), the payload of a
    WAV (else the bytes themselves) with its digests, the stored form's digests, the
    number of carved media and a feature string. Depends on the bytes alone. A null
    medium counts as no bytes.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def row(data: bytes, declared: str | None):
            found = sniff(data)
            whole = next((x for x in found if x[0] == 0), None)
            kind, info = (whole[2], whole[3]) if whole else (declared, {})
            a = info.get("data_at", 0)
            payload = data[a : a + info["data_bytes"]] if "data_at" in info else data
            carved = [f"{x[2]}@{x[0]}+{x[1]}" for x in found if x[0]]
            level = np.frombuffer(payload, np.uint8)
            mean = int(level.sum(dtype=np.int64)) * 1000 // max(1, len(level))
            shape = ",".join(f"{k}={info[k]}" for k in ("channels", "rate", "bits", "width", "height") if k in info)
            feature = f"type={kind};{shape};samples={len(payload)};mean={mean};distinct={int((np.bincount(level, minlength=256) > 0).sum())};embedded={'|'.join(carved)}"
            return (kind, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), len(carved), feature)

        names = ["type", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_embedded", "feature"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for piece in slices(batch):
                out = [row(m or b"", d) for m, d in zip(piece.column(3).to_pylist(), piece.column(2).to_pylist(), strict=True)]
                columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *columns], ["doc_id", "n_bytes", *names])

    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, type string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_embedded long, feature string"
    return media.select("doc_id", "n_bytes", "declared", "media").mapInArrow(run, schema)
