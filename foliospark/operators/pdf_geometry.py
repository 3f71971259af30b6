"""Page sizes of PDF files: their objects, and the page tree from the root down.

A small reader in Arrow batches takes a file apart into the objects that pages are made of, those in object streams too; of an object that
is there several times the last one counts, as updates are appended. References never leave a file, so its tree is followed where the file is read, and
neither contents nor objects are shuffled; what a page doesn't say itself comes from the nodes above it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from . import position as pos

_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})\s{1,8}\d{1,5}\s{1,8}obj\b")
_TRAILER = re.compile(rb"\btrailer\b")
_NODE, _CATALOG, _TYPED = re.compile(r"/Type\s*/Pages?\b"), re.compile(r"/Type\s*/Catalog\b"), re.compile(r"/Type\s*/")
_KIDS, _LIST, _KID = re.compile(r"/Kids\s*\[([^\]]*)\]"), re.compile(r"\s*\[([^\]]*)\]"), re.compile(r"(\d+)\s+\d+\s+R")
_NUMBER = r"\s*([+-]?(?:\d+\.?\d*|\.\d+))"
_BOX = r"\[" + _NUMBER + (r"\s" + _NUMBER) * 3 + r"\s*\]"
_PLACED = re.compile(r"\s*" + _BOX)
_TURN, _TURNED = re.compile(r"/Rotate\s+(-?\d+)(?!\s+\d+\s+R)"), re.compile(r"\s*(-?\d+)")
_BOXES = {n: re.compile(rf"/{n}\s*" + _BOX) for n in ("MediaBox", "CropBox")}
_REFERS = {n: re.compile(rf"/{n}\s+(\d+)\s+\d+\s+R") for n in ("Kids", "MediaBox", "CropBox", "Rotate", "Pages", "Root")}
#: A tree deeper than that is taken for a cycle.
LEVELS = 64
#: The number under which the trailers of a file stand.
TRAILER = -1


def _unpacked(body: bytes, data: bytes) -> list[tuple[int, bytes]]:
    """The objects of an object stream; none where it can't be read, as in encrypted files."""
    try:
        if b"/FlateDecode" in body or re.search(rb"/Fl\b", body):
            data = zlib.decompressobj().decompress(data)
        count, first = (int(re.search(rb"/%s\s+(\d+)" % n, body)[1]) for n in (b"N", b"First"))
        head = [int(x) for x in data[:first].split()[: 2 * count]]
    except (zlib.error, TypeError, ValueError):
        return []
    starts = [first + x for x in head[1::2]]
    return [(n, data[a:b]) for n, a, b in zip(head[::2], starts, [*starts[1:], len(data)], strict=False)]


def _of_a_page(body: bytes) -> bool:
    """Pages and what they refer to: nodes, catalogs, boxes, lists of kids, numbers."""
    return bool(re.search(rb"/Type\s*/(?:Pages?|Catalog)\b|/Root\s+\d", body) or re.match(rb"\s*(?:\[|[+-]?[\d.]+\s*$)", body))


def _parts(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """``(number, place, text)`` of objects and trailers; what lies within a stream is none."""
    at = 0
    while m := _OBJECT.search(raw, at):
        end = raw.find(b"endobj", m.end())
        end = len(raw) if end < 0 else end
        body = raw[m.end() : end]
        if (s := body.find(b"stream")) >= 0:
            body = body[:s]
            begin = m.end() + s + 6
            begin += raw[begin : begin + 2].startswith(b"\r\n") + 1
            stop = raw.find(b"endstream", begin)
            length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", body)
            if length and raw[begin + int(length[1]) : begin + int(length[1]) + 12].lstrip().startswith(b"endstream"):
                stop = begin + int(length[1])
            stop = len(raw) if stop < 0 else stop
            end = max(raw.find(b"endobj", stop), stop)
            if re.search(rb"/Type\s*/ObjStm\b", body):
                for number, text in _unpacked(body, raw[begin:stop]):
                    if _of_a_page(text):
                        yield number, m.start(), text
            if re.search(rb"/Type\s*/XRef\b", body):
                yield TRAILER, m.start(), body
        elif _of_a_page(body):
            yield int(m[1]), m.start(), body
        at = max(end, m.end())
    for m in _TRAILER.finditer(raw):
        yield TRAILER, m.start(), raw[m.end() : m.end() + 2000].split(b"startxref")[0]


def _referred(text: str, name: str) -> int | None:
    m = _REFERS[name].search(text)
    return int(m[1]) if m else None


def _objects(raw: bytes) -> dict[int, str]:
    """The objects of a file in their last version, and the last trailer that names a root."""
    last: dict[int, tuple[int, bytes]] = {}
    for number, place, text in _parts(raw):
        if (number != TRAILER or re.search(rb"/Root\s+\d", text)) and place >= last.get(number, (0,))[0]:
            last[number] = place, text
    return {n: text.decode("latin-1") for n, (_, text) in last.items()}


def _own(text: str, held: dict[int, str]) -> tuple[list[float] | None, list[float] | None, int | None]:
    """Media box, crop box and turn that a node gives, in its text or by an object of their own."""

    def told(name: str) -> str:
        other = held.get(_referred(text, name), "")
        return "" if _TYPED.search(other) else other

    boxes = [_BOXES[n].search(text) or _PLACED.match(told(n)) for n in _BOXES]
    turn = _TURN.search(text) or _TURNED.match(told("Rotate"))
    return *([float(x) for x in m.groups()] if m else None for m in boxes), int(turn[1]) % 360 if turn else None


def _kids(text: str, held: dict[int, str]) -> list[int] | None:
    """The nodes below one; None for pages."""
    if "/Kids" not in text:
        return None
    listed = _KIDS.search(text)
    if listed is None and (ref := _referred(text, "Kids")) is not None and ref in held and not _TYPED.search(held[ref]):
        listed = _LIST.match(held[ref]) or re.match("()", "")
    return [int(n) for n in _KID.findall(listed[1])] if listed else None


def _tree(held: dict[int, str]) -> Iterator[tuple[list[float] | None, list[float] | None, int | None]]:
    """What each page has or inherits, in the order of the tree."""
    root = _referred(held.get(TRAILER, ""), "Root")
    # a file whose trailer is lost has a catalog all the same
    catalogs = [(n == root, n) for n, text in held.items() if n != TRAILER and _CATALOG.search(text)]
    nodes = {n: (_own(text, held), _kids(text, held)) for n, text in held.items() if _NODE.search(text)}
    first = _referred(held[max(catalogs)[1]], "Pages") if catalogs else None
    open_ = [(first, (), (None, None, None))]
    while open_:
        number, above, inherited = open_.pop()
        if number not in nodes or number in above or len(above) >= LEVELS:
            continue
        own, kids = nodes[number]
        facts = tuple(i if o is None else o for o, i in zip(own, inherited, strict=True))
        if kids is None:
            yield facts
        else:
            open_ += [(k, (*above, number), facts) for k in reversed(kids)]


_PAGES = pa.list_(pa.struct([("media", pa.list_(pa.float64())), ("crop", pa.list_(pa.float64())), ("rotate", pa.int32())]))
#: Files of one step.
STEP = 64


def page_tree(raw: DataFrame) -> DataFrame:
    """``key, content, pages`` of every file of ``raw(key, content)``: of each page in the order of the tree ``media, crop, rotate``, with what is inherited. Null contents have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                pages = [[dict(zip(("media", "crop", "rotate"), p, strict=True)) for p in _tree(_objects(content.as_py() or b""))] for content in part["content"]]
                yield pa.RecordBatch.from_arrays([part["key"], part["content"], pa.array(pages, _PAGES)], names=["key", "content", "pages"])

    found = raw.select("key", F.col("content").cast("binary").alias("content"))
    return found.mapInArrow(run, f"key {raw.schema['key'].dataType.simpleString()}, content binary, pages array<struct<media:array<double>,crop:array<double>,rotate:int>>")


def page_sizes(raw: DataFrame) -> DataFrame:
    """``key, page_index, w, h`` of the pages of ``raw(key, content)``: the crop box, else the media box, sides exchanged where a page is turned by a quarter.

    Pages without a sound box are left out, but counted. A file without any sound page, as a damaged or an encrypted one, goes by the boxes that stand in its bytes.
    """

    def sized(p, i):
        box = F.coalesce(p["crop"], p["media"])
        a, b = box[2] - box[0], box[3] - box[1]
        turned = F.coalesce(p["rotate"], F.lit(0)) % 180 != 0
        return F.when((a > 0) & (b > 0), F.struct(i.alias("page_index"), F.when(turned, b).otherwise(a).alias("w"), F.when(turned, a).otherwise(b).alias("h")))

    files = page_tree(raw).select("key", "content", F.filter(F.transform("pages", sized), lambda p: p.isNotNull()).alias("pages"))
    # contents are kept of files without a sound page alone
    files = scratch.written(files.select("key", "pages", F.when(F.size("pages") == 0, F.col("content")).alias("content")), "sizes")
    return files.select("key", F.inline("pages")).unionByName(pos.page_sizes(files.where(F.size("pages") == 0).select("key", "content")))
