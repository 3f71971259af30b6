"""Media columns: types told from signatures, declared types corrected, embedded media carved.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over a value. At each hit the
format's validator reads the structure and the lengths that the format itself states; only what holds together counts.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The magic bytes that the formats' specifications state.
MAGIC = {
    b"RIFF": "riff",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"BM": "image/bmp",
    b"%PDF-": "application/pdf",
    b"PK\x03\x04": "application/zip",
    b"\x1f\x8b\x08": "application/gzip",
    b"fLaC": "audio/flac",
    b"OggS": "audio/ogg",
}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    made = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        made.add_word(magic.decode("latin-1"), (kind, len(magic)))
    made.make_automaton()
    return made


def _riff(b: memoryview, at: int) -> tuple[str, int] | None:
    if at + 12 > len(b):
        return None
    size, form = struct.unpack_from("<I4s", b, at + 4)
    end = at + 8 + size
    if end > len(b) or form not in (b"WAVE", b"WEBP", b"AVI "):
        return None
    p, found = at + 12, set()
    while p + 8 <= end:
        name, n = struct.unpack_from("<4sI", b, p)
        p += 8 + n + (n & 1)
        found.add(name)
    if p not in (end, end + 1) or form == b"WAVE" and not {b"fmt ", b"data"} <= found:
        return None
    return {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}[form], end


def _png(b: memoryview, at: int) -> tuple[str, int] | None:
    p = at + 8
    while p + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        if p == at + 8 and (name != b"IHDR" or n != 13):
            return None
        p += 12 + n
        if name == b"IEND":
            return "image/png", p
    return None


def _gif(b: memoryview, at: int) -> tuple[str, int] | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return "image/gif", p + 1
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            local = b[p + 9]
            p = blocks(p + 10 + (3 << ((local & 7) + 1) if local & 0x80 else 0) + 1)
        else:
            return None
    return None


def _jpeg(b: memoryview, at: int) -> tuple[str, int] | None:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark = b[p + 1]
        if mark == 0xD9:
            return "image/jpeg", p + 2
        p += 2 + struct.unpack_from(">H", b, p + 2)[0]
        if mark == 0xDA:
            while p + 1 < len(b) and (b[p] != 0xFF or b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 1
    return None


def _bmp(b: memoryview, at: int) -> tuple[str, int] | None:
    if at + 26 > len(b):
        return None
    size, zero, pixels, header = struct.unpack_from("<IIII", b, at + 2)
    if zero or header not in (12, 40, 108, 124) or not 14 + header <= pixels <= size or at + size > len(b):
        return None
    return "image/bmp", at + size


_HEADER = re.compile(rb"%PDF-\d")
_MARKER = re.compile(rb"(?:startxref\s{1,8}(\d{1,10})\s{1,8})?%%EOF")
_OBJECT, _ENDED = re.compile(rb"(?<!\d)\d++\s++\d++\s++obj\b"), re.compile(rb"\bendobj\b")
_XREF = re.compile(rb"xref\b|\d{1,10}\s{1,8}\d{1,10}\s{1,8}obj\b")


@lru_cache(maxsize=1)
def _pdf_ends(raw: bytes) -> dict[int, int]:
    """The end of each PDF file in a value, by the place of its header: all markers are found once.

    A file goes up to the first end marker whose startxref fits, and to the later ones of updates, whose tables stand after the end before. Where none fits,
    as in damaged files, up to the last marker before the next header, if a whole object stands between.
    """
    headers = [m.start() for m in _HEADER.finditer(raw)]
    if not headers:
        return {}
    marks, ends = {}, []
    for m in _MARKER.finditer(raw):
        ends.append(m.end())
        if place := int(m[1] or 0):  # a linearized file's first part says 0
            marks.setdefault(place, []).append((m.start(), m.end()))
    at, data, fitting = np.array(headers), np.frombuffer(raw, np.uint8), {}
    # of the marks with one place only the first after the table can fit a header
    for place, mine in marks.items():
        near = at[at + place < mine[-1][0]]
        first = data[near + place]
        for h in near[(first == ord("x")) | (first >= ord("0")) & (first <= ord("9"))].tolist():
            if _XREF.match(raw, h + place):
                fitting.setdefault(h, []).append((*mine[bisect.bisect_right(mine, (h + place, len(raw)))], h + place))
    found = {}
    for n, h in enumerate(headers):
        end = None
        for _, its_end, table in sorted(fitting.get(h, ())):
            if table >= (end or h):
                end = its_end
        if end is None:
            following = headers[n + 1] if n + 1 < len(headers) else len(raw)
            k = bisect.bisect_right(ends, following)
            last = ends[k - 1] if k and ends[k - 1] - 5 >= h else None
            if last and (one := _OBJECT.search(raw, h, last)) and _ENDED.search(raw, one.end(), last):
                end = last
        if end:
            found[h] = end
    return found


def _pdf(b: memoryview, at: int) -> tuple[str, int] | None:
    end = _pdf_ends(b.obj).get(at)
    return end and ("application/pdf", end)


@lru_cache(maxsize=1)
def _zip_ends(raw: bytes) -> dict[int, int]:
    """The end of each ZIP file in a value, by its start: an end record tells where its file begins, and it fits when every entry of its directory has its local header, one of them at the start."""
    found, p = {}, -1
    while (p := raw.find(b"PK\x05\x06", p + 1)) >= 0 and p + 22 <= len(raw):
        entries, size, start, note = struct.unpack_from("<HIIH", raw, p + 10)
        at = p - size - start
        if at < 0 or at in found or p + 22 + note > len(raw) or raw[at : at + 4] != b"PK\x03\x04":
            continue
        q, places = at + start, []
        while q + 46 <= p and raw[q : q + 4] == b"PK\x01\x02":
            places.append(struct.unpack_from("<I", raw, q + 42)[0])
            q += 46 + sum(struct.unpack_from("<HHH", raw, q + 28))
        if q == p and len(places) == entries and 0 in places and all(raw[at + x : at + x + 4] == b"PK\x03\x04" for x in places):
            found[at] = p + 22 + note
    return found


def _zip(b: memoryview, at: int) -> tuple[str, int] | None:
    end = _zip_ends(b.obj).get(at)
    return end and ("application/zip", end)


def _gzip(b: memoryview, at: int) -> tuple[str, int] | None:
    reader = zlib.decompressobj(31)
    p = at
    try:
        while p < len(b) and not reader.eof:
            reader.decompress(b[p : p + 65536], 1 << 20)
            while reader.unconsumed_tail:
                reader.decompress(reader.unconsumed_tail, 1 << 20)
            p += 65536
    except zlib.error:
        return None
    return ("application/gzip", min(p, len(b)) - len(reader.unused_data)) if reader.eof else None


def _crc(data: bytes, poly: int, width: int) -> int:
    table, x = _crc_table(poly, width), 0
    for byte in data:
        x = (x << 8 & (1 << width) - 1) ^ table[x >> width - 8 ^ byte]
    return x


@lru_cache(maxsize=2)
def _crc_table(poly: int, width: int) -> list[int]:
    table = []
    for x in range(256):
        x <<= width - 8
        for _ in range(8):
            x = (x << 1 ^ (poly if x >> width - 1 else 0)) & (1 << width) - 1
        table.append(x)
    return table


def _flac_frame(b: memoryview, at: int, depth: int) -> tuple[int, int] | None:
    """``(samples, end)`` of the frame at ``at``: its subframes are read for their lengths, and both checksums have to hold."""
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8:
        return None
    block, rate, channels, bits = b[at + 2] >> 4, b[at + 2] & 15, b[at + 3] >> 4, b[at + 3] >> 1 & 7
    lead = b[at + 4]
    more = 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()
    q = at + 5 + more
    if block == 0 or rate == 15 or channels > 10 or bits == 3 or b[at + 3] & 1:
        return None
    if block in (6, 7):
        n = int.from_bytes(b[q : q + block - 5], "big") + 1
        q += block - 5
    else:
        n = 192 if block == 1 else 576 << block - 2 if block < 6 else 256 << block - 8
    q += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if _crc(b[at:q], 0x07, 8) != b[q]:
        return None
    depth, p, stop = (depth, 8, 12, 0, 16, 20, 24, 32)[bits], 8 * (q + 1), 8 * len(b)

    def read(k: int) -> int:
        nonlocal p
        if p + k > stop:
            raise IndexError("over the end")
        x = int.from_bytes(b[p >> 3 : p + k + 7 >> 3], "big") >> (-(p + k) & 7) & (1 << k) - 1
        p += k
        return x

    def unary() -> int:
        nonlocal p
        i, first = p >> 3, p
        x = b[i] & 0xFF >> (p & 7)
        while not x:
            i += 1
            x = b[i]
        p = 8 * i + 9 - x.bit_length()
        return p - 1 - first

    for channel in range(channels + 1 if channels < 8 else 2):
        width = depth + (channels in (8, 10) and channel == 1 or channels == 9 and channel == 0)
        head = read(8)
        kind = head >> 1
        if head & 1:
            width -= unary() + 1
        if kind == 0:
            p += width
        elif kind == 1:
            p += width * n
        elif 8 <= kind <= 12 or 32 <= kind < 64:
            order = kind - 8 if kind < 32 else kind - 31
            p += width * order
            if kind >= 32:
                precision = read(4) + 1
                p += 5 + precision * order
            method, parts = read(2), read(4)
            if method > 1:
                return None
            for part in range(1 << parts):
                count, rice = (n >> parts) - (0 if part else order), read(4 + method)
                if rice == (31 if method else 15):
                    p += read(5) * count
                else:
                    for _ in range(count):
                        unary()
                        p += rice
        else:
            return None
    end = (p + 7 >> 3) + 2
    return (n, end) if end <= len(b) and _crc(b[at:end], 0x8005, 16) == 0 else None


def _flac(b: memoryview, at: int) -> tuple[str, int] | None:
    """Up to the frame that brings the samples which the header states; where it states none, as far as frames follow."""
    if at + 42 > len(b) or b[at + 4] & 0x7F or bytes(b[at + 5 : at + 8]) != b"\0\0\x22":
        return None
    stated = int.from_bytes(b[at + 18 : at + 26], "big")
    depth, total = (stated >> 36 & 31) + 1, stated & (1 << 36) - 1
    p, last, samples = at + 4, False, 0
    while not last:
        last = b[p] >= 0x80
        p += 4 + int.from_bytes(b[p + 1 : p + 4], "big")
    while not total or samples < total:
        try:
            frame = _flac_frame(b, p, depth)
        except IndexError:
            frame = None
        if frame is None:
            break
        samples, p = samples + frame[0], frame[1]
    return ("audio/flac", p) if samples >= total and p <= len(b) else None


def _ogg(b: memoryview, at: int) -> tuple[str, int] | None:
    p = at
    while p + 27 <= len(b) and bytes(b[p : p + 5]) == b"OggS\0":
        n = b[p + 26]
        if p + 27 + n > len(b):
            return None
        p += 27 + n + sum(b[p + 27 : p + 27 + n])
    return ("audio/ogg", p) if at < p <= len(b) else None


VALIDATORS = {"riff": _riff, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip, "audio/flac": _flac, "audio/ogg": _ogg}


def sniff(raw: bytes) -> list[tuple[str, int, int]]:
    """``(type, start, end)`` of all media in ``raw`` whose structure holds, by start; one inside another is listed after it."""
    view, out = memoryview(raw), []
    for last, (kind, size) in automaton().iter(raw.decode("latin-1")):
        start = last - size + 1
        try:
            found = VALIDATORS[kind](view, start)
        except (struct.error, IndexError):
            found = None
        if found:
            out.append((found[0], start, found[1]))
    return sorted(out, key=lambda x: (x[1], -x[2]))


def wav(samples: bytes, rate: int = 16_000) -> bytes:
    """8-bit mono PCM; the samples are the bytes themselves."""
    pad = b"\0" * (len(samples) & 1)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + pad


def read_wav(raw: bytes) -> bytes:
    """The samples of the data chunk."""
    p = 12
    while p + 8 <= len(raw):
        name, n = struct.unpack_from("<4sI", raw, p)
        if name == b"data":
            return raw[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def corrected(media: DataFrame) -> DataFrame:
    """``id, declared, actual, matches, carved`` for each row of ``media(id, content, declared)``.

    ``actual``: the type of what starts at the first byte, else null. ``carved``: the other media found, with type, start, end and bytes.
    Null or empty content has no type and nothing carved. A null declared type never matches. Repeated rows are answered each; of items that begin at
    one place the longer comes first. Very long values are read in place, but for carved copies. No rows give none; other columns are ignored.
    """
    part = pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("content", pa.binary())])
    schema = pa.schema([("id", pa.int64()), ("declared", pa.string()), ("actual", pa.string()), ("matches", pa.bool_()), ("carved", pa.list_(part))])

    def run(batches):
        for batch in batches:
            rows = []
            for i, raw, declared in zip(batch["id"].to_pylist(), batch["content"], batch["declared"].to_pylist(), strict=True):
                raw = raw.as_py() or b""
                found = sniff(raw)
                actual = found[0][0] if found and found[0][1] == 0 else None
                rest = found[1:] if actual else found
                rows.append({"id": i, "declared": declared, "actual": actual, "matches": actual is not None and actual == declared, "carved": [{"type": t, "start": a, "end": b, "content": raw[a:b]} for t, a, b in rest]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return media.select(F.col("id").cast("long").alias("id"), F.col("content").cast("binary").alias("content"), "declared").mapInArrow(
        run, "id long, declared string, actual string, matches boolean, carved array<struct<type:string,start:long,end:long,content:binary>>"
    )


def stored_texts(docs: DataFrame, block: int = 192, with_media: bool = True) -> DataFrame:
    """The text of every row of ``docs(doc_id, text)`` as 8-bit samples of a WAV file, found again by its signature and read back.

    Null counts as empty. The payload is the UTF-8 text with blanks up to a positive multiple of ``block`` bytes. The stored bytes are
    declared as plain bytes; sniffing tells their type, the validator their length, and the samples come from what it
    carved. ``feature``: type, samples, sum and zero crossings around the middle value. Equal texts have equal values,
    repeated rows too; very long texts are stored whole; no rows give none; other columns are ignored. ``with_media`` keeps the stored bytes as a column.
    """
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    if with_media:
        fields.append(("media", pa.binary()))
    schema = pa.schema(fields)

    def rows_of(batch):
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            plain = text.as_buffer().to_pybytes() if text.is_valid else b""
            size = max(1, -(-len(plain) // block)) * block
            media = wav(plain.ljust(size, b" "))
            kind, start, end = sniff(media)[0]
            back = read_wav(media[start:end])
            x = np.frombuffer(back, np.uint8)
            crossings = int(np.count_nonzero(np.diff(x >= 110)))
            yield [doc_id, len(plain), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{kind};{len(x)};{int(x.sum(dtype=np.int64))};{crossings}", media]

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 500):
                columns = list(zip(*rows_of(whole.slice(at, 500)), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)], schema=schema)

    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).mapInArrow(run, out)


def op9_media(spark, sf_dir):
    return stored_texts(common.documents(spark, sf_dir), with_media=False)
