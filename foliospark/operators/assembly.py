"""Paragraphs from the lines of a page, and of a document from those of its pages.

Where a line goes depends on what the lines before it became, so pages and documents are walked through in order, in Arrow
batches: a page needs nothing but its row, a document its group. Whatever needs no such state stays in columns, in ``blocks`` and ``layout``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, groupby, islice
from statistics import median
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import plain
from . import blocks

# Patterns and thresholds that results depend on.
CAPTION = re.compile(blocks.CAPTION)
CENTRED_NUMBER, CENTRED_WORD = re.compile(r"\b\d+\b"), re.compile(r"(?i)\b(?:Figure|Fig\.?|Table|Tbl\.?)\b")
TABLE = re.compile(blocks.TABLE)
EQUATION_NUMBER = re.compile(blocks.EQUATION_NUMBER)
EQUATION_LABEL = re.compile(r"\(\s*\d{1,3}(?:\.\d{1,2}|[a-z])?\s*\)")
NUMBERED_HEADING = re.compile(r"^(?:\d{1,2}(?:\.\d{1,2})*)\s+\S")
SIDE_LABEL = re.compile(r"(?i)^(?:left|right|top|bottom)\s*:")
PARAGRAPH_GAP, SENTENCE_GAP, CAPTION_GAP, CAPTION_LINES = 1.5, 0.6, 1.6, 12
CAPTION_WIDTH, CAPTION_CENTRE = 0.75, 0.12
FOOT_SHARE, HEAD_SHARE = 0.18, 0.22
HEADING_FONT, HEADING_CHARS, NUMBERED_CHARS, NUMBERED_WORDS = 1.2, 40, 90, 14
MATH_SCORE, MATH_GAP, MATH_RUN_GAP, MATH_RUN_LINES, MATH_CRUMB = 6, 3.0, 1.3, 2, 40
TABLE_ABOVE, TABLE_BELOW, ABOVE_LEAST, BELOW_LEAST = 0.22, 0.34, 8, 4


class Line(NamedTuple):
    page_index: int
    ord: int
    x0: float
    y0: float
    x1: float
    y1: float
    text: str
    font_size: float

    @property
    def width(self) -> float:
        return self.x1 - self.x0

    @property
    def place(self) -> tuple[float, float]:
        return self.y0, self.x0

    @property
    def end(self) -> tuple[float, float]:
        return self.y1, self.x1


@dataclass
class Page:
    """What the walk over a page needs to know about it."""

    width: float
    height: float
    line_h: float
    median_w: float = 0.0
    page_font: float = 0.0
    font: float = 0.0
    top: float | None = None
    bottom: float | None = None
    band_h: float | None = None

    def column(self, x: Line) -> int:
        return int(x.x0 >= self.width * 0.5)

    def centred(self, x: Line) -> bool:
        return abs((x.x0 + x.x1) / 2 - self.width / 2) <= self.width * CAPTION_CENTRE

    def is_caption(self, x: Line, median_w: float | None = None) -> bool:
        """By its label, or a short line in the middle that names a figure or table and a number."""
        median_w = self.median_w if median_w is None else median_w
        if CAPTION.match(x.text):
            return True
        short = median_w > 0 and x.width <= median_w * CAPTION_WIDTH
        return bool(short and CENTRED_NUMBER.search(x.text) and CENTRED_WORD.search(x.text) and self.centred(x))

    def is_page_number(self, x: Line) -> bool:
        if not re.match(blocks.PAGE_NUMBER, x.text) or self.height <= 0:
            return False
        if self.top is not None:
            pad = max(self.band_h or 0.0, 1.0)
            away = x.y1 < self.top - pad or x.y0 > self.bottom + pad
        else:
            away = x.y0 <= self.height * 0.08 or x.y1 >= self.height * 0.92
        placed = abs((x.x0 + x.x1) / 2 - self.width / 2) <= self.width * 0.12 or x.x0 <= self.width * 0.2 or x.x1 >= self.width * 0.8
        return away and placed and not (self.font > 0 and x.font_size > self.font * 1.3)

    def is_equation_number(self, x: Line) -> bool:
        return bool(EQUATION_NUMBER.match(x.text)) and self.width > 0 and x.x0 >= self.width * 0.72 and x.width <= self.width * 0.18

    def is_heading(self, x: Line) -> bool:
        s = x.text
        if s.isdigit() or self.is_caption(x):
            return False
        if 0 < self.page_font * HEADING_FONT < x.font_size and len(s) <= HEADING_CHARS and not s.endswith((".", ":", ";")):
            return True
        numbered = len(s) <= NUMBERED_CHARS and NUMBERED_HEADING.match(s) and re.search("[A-Za-z]", s)
        return bool(numbered) and not s.endswith((".", ":", ";", ",")) and not plain.ends_sentence(s) and 2 <= len(s.split()) <= NUMBERED_WORDS


def gap(a: Line, b: Line) -> float:
    return b.y0 - a.y1


def overlap(a: Line, b: Line) -> float:
    narrower = min(a.width, b.width)
    return max(0.0, min(a.x1, b.x1) - max(a.x0, b.x0)) / (narrower if narrower > 0 else 1.0)


def same_font(a: Line, b: Line) -> bool:
    large = max(a.font_size, b.font_size)
    return min(a.font_size, b.font_size) <= 0 or abs(a.font_size - b.font_size) <= 0.25 * large


def positive_median(values) -> float:
    known = [v for v in values if v > 0]
    return float(median(known)) if known else 0.0


def continuity(a: Line, b: Line, page_w: float, line_h: float) -> int:
    """Points, 0 to 11, for ``b`` going on from ``a``."""
    apart, most = gap(a, b), max(1.0, line_h * MATH_GAP)
    points = int(a.page_index == b.page_index) + int(same_font(a, b))
    points += 2 * int((a.x0 < page_w * 0.5) == (b.x0 < page_w * 0.5))
    points += int(abs(a.x0 - b.x0) <= max(6.0, page_w * 0.03) or overlap(a, b) >= 0.35)
    points += 2 if -0.4 * line_h <= apart <= most else int(apart <= most * 1.3)
    points += 2 * int(bool(a.text.rstrip()) and not a.text.rstrip().endswith((".", ":", ";")))
    return points + 2 * int(plain.connects(b.text))


def direction(before: int | None, after: int | None, before_text: str, after_text: str, unsure: str) -> str:
    """Where a formula goes: to the prose ``before`` it, ``after`` it, or nowhere, by both scores; ``unsure`` where neither will do."""
    left, right = ((s if s is not None else -1) >= MATH_SCORE for s in (before, after))
    if left and right:
        if before_text.rstrip() and not before_text.rstrip().endswith((".", ":", ";")):
            return "before"
        return "after" if plain.connects(after_text) else unsure
    return "before" if left else "after" if right else unsure


# lines of a page


def _may_be_math(x: Line, page: Page) -> bool:
    s = x.text
    if not s or s.startswith(blocks.MATH) or page.is_caption(x, 0.0) or plain.is_worded(s):
        return False
    return plain.is_mathish(s) or (len(s) <= 2 and bool(re.search("[αβγθρησμλ∇·]", s))) or "·" in s or "=" in s


def collapse_unnumbered_math(lines: list[Line], page: Page) -> list[Line]:
    """Runs of formula lines without a number become a placeholder: within the prose before or after them where that goes on, else a line of its own."""
    if page.width <= 0 or page.height <= 0 or page.line_h <= 0:
        return lines
    now = dict(enumerate(lines))
    made = []
    for column in (0, 1):
        keys = sorted((k for k, x in now.items() if page.column(x) == column), key=lambda k: now[k].place)
        at = 0
        while at < len(keys):
            if not _may_be_math(now[keys[at]], page):
                at += 1
                continue
            end = at + 1
            while end < len(keys):
                x = now[keys[end]]
                if gap(now[keys[end - 1]], x) > page.line_h * MATH_RUN_GAP or page.is_caption(x, 0.0) or plain.is_worded(x.text):
                    break
                if not _may_be_math(x, page) and len(x.text) > MATH_CRUMB:
                    break
                end += 1
            if end - at < MATH_RUN_LINES:
                at += 1
                continue
            run = [now.pop(k) for k in keys[at:end]]
            before = next((k for k in reversed(keys[:at]) if k in now), None)
            after = keys[end] if end < len(keys) else None
            scores = []
            for k, pair in ((before, lambda k: (now[k], run[0])), (after, lambda k: (run[-1], now[k]))):
                scores.append(continuity(*pair(k), page.width, page.line_h) if k is not None and plain.is_worded(now[k].text) else None)
            goes = direction(*scores, now[before].text if before is not None else "", now[after].text if after is not None else "", "alone")
            if goes == "before":
                now[before] = now[before]._replace(text=f"{now[before].text.rstrip()} {blocks.MATH}".strip())
            elif goes == "after":
                now[after] = now[after]._replace(text=f"{blocks.MATH} {now[after].text.lstrip()}".strip())
            else:
                made.append(_joined(run, blocks.MATH))
            at = end
    return [*now.values(), *made]


def _joined(lines: list[Line], text: str) -> Line:
    """One line over the common box of several."""
    a = lines[0]
    return a._replace(x0=min(x.x0 for x in lines), y0=min(x.y0 for x in lines), x1=max(x.x1 for x in lines), y1=max(x.y1 for x in lines), text=text, font_size=positive_median(x.font_size for x in lines))


# paragraphs of a page


@dataclass
class Paragraph:
    lines: list[Line]
    caption: bool = False

    @property
    def text(self) -> str:
        return joined_text([x.text for x in self.lines])

    @property
    def first(self) -> Line:
        """The topmost line on its first page."""
        page = min(x.page_index for x in self.lines)
        return min((x for x in self.lines if x.page_index == page), key=lambda x: x.place)

    @property
    def last(self) -> Line:
        """The lowest line on its last page."""
        page = max(x.page_index for x in self.lines)
        return max((x for x in self.lines if x.page_index == page), key=lambda x: x.end)

    def box(self) -> tuple[float, float, float, float]:
        return min(x.x0 for x in self.lines), min(x.y0 for x in self.lines), max(x.x1 for x in self.lines), max(x.y1 for x in self.lines)


def joined_text(parts: list[str]) -> str:
    out: list[str] = []
    for s in filter(None, map(str.strip, parts)):
        if out and out[-1].endswith("-") and out[-1][-2:-1].isalpha():
            out[-1] = out[-1][:-1] + s
        else:
            out.append(s)
    return " ".join(" ".join(out).split())


@dataclass
class _Open:
    """The paragraph in work."""

    lines: list[Line] = field(default_factory=list)
    caption: bool = False
    labelled: bool = False
    caption_lines: int = 0
    column: int = 0


def _column_goes_on(a: Line, b: Line, page: Page) -> bool:
    """From the foot of the left column to the head of the right one, in the middle of a sentence."""
    places = a.y1 >= page.height * (1 - FOOT_SHARE) and b.y0 <= page.height * HEAD_SHARE
    return page.height > 0 and places and not plain.ends_sentence(a.text) and bool(re.match(r"[a-z,)\]]", b.text)) and same_font(a, b)


def _caption_goes_on(now: _Open, x: Line, page: Page) -> bool:
    """Whether a line without a label belongs to the caption in work."""
    a = now.lines[-1]
    ended = a.text.rstrip().endswith(".")
    if now.labelled and now.caption_lines < CAPTION_LINES and gap(a, x) <= page.line_h * CAPTION_GAP and overlap(a, x) >= 0.2 and same_font(a, x):
        body = x.text[:1].islower() or (x.text[:1].isupper() and len(x.text) >= 60 and plain.is_worded(x.text))
        if not (ended and body):
            return True
    if page.median_w > 0 and x.width <= page.median_w * CAPTION_WIDTH and (page.centred(x) or overlap(a, x) >= 0.2):
        return not (ended and x.text[:1].islower() and len(x.text) >= 40 and plain.is_sentence(x.text))
    return False


def assemble(lines: list[Line], page: Page) -> list[Paragraph]:
    """Lines in reading order (column, top, left), cut where a paragraph ends."""
    order = sorted(lines, key=lambda x: (page.column(x), *x.place))
    done: list[Paragraph] = []
    now = _Open()

    def close() -> None:
        nonlocal now
        lone_number = len(now.lines) == 1 and not now.caption and page.is_page_number(now.lines[0])
        if now.lines and not lone_number:
            done.append(Paragraph(now.lines, now.caption))
        now = _Open()

    at = 0
    while at < len(order):
        x = order[at]
        following = order[at + 1] if at + 1 < len(order) else None
        alone = [x]
        if x.text.startswith(blocks.MATH):
            pass
        elif following is not None and _numbers_heading(x, following, page):
            alone = [x, following]
        elif not page.is_heading(x):
            alone = []
        if alone:
            close()
            done.append(Paragraph(alone))
            at += len(alone)
            continue
        caption, column = page.is_caption(x), page.column(x)
        if now.lines:
            a = now.lines[-1]
            apart = gap(a, x)
            breaks = column != now.column or apart > page.line_h * PARAGRAPH_GAP
            if breaks and now.column == 0 and column == 1 and not now.caption and not caption:
                breaks = not _column_goes_on(a, x, page)
            if not breaks:
                caption = caption or (now.caption and _caption_goes_on(now, x, page))
                breaks = (
                    caption != now.caption
                    or (apart > page.line_h * SENTENCE_GAP and a.text.rstrip().endswith((".", "?", "!")) and x.text[:1].isupper())
                    or overlap(a, x) < 0.2
                    or not same_font(a, x)
                )
            if breaks:
                close()
        if not now.lines:
            now = _Open(caption=caption, labelled=bool(CAPTION.match(x.text)))
        now.lines.append(x)
        now.column = column
        now.caption_lines += now.caption
        at += 1
    close()
    return done


def _numbers_heading(number: Line, x: Line, page: Page) -> bool:
    """Whether ``number`` is the number of the heading that stands right of it in larger type."""
    s = x.text
    large = number.text.isdigit() and page.column(number) == page.column(x) and 0 < page.page_font * HEADING_FONT < x.font_size
    if not large or not s or len(s) > HEADING_CHARS or s.endswith((".", ":", ";")) or page.is_caption(x):
        return False
    row = abs(number.y0 - x.y0) <= page.line_h * 0.3 and abs(number.y1 - x.y1) <= page.line_h * 0.3
    return row and x.x0 >= number.x1 - 1.0


def join_captions(paras: list[Paragraph], page: Page) -> list[Paragraph]:
    """Captions with the paragraph below that belongs to them: text under a mere label, or a short end in lower case."""
    out, at = [], 0
    while at < len(paras):
        cur = paras[at]
        at += 1
        if cur.caption and at < len(paras) and not paras[at].caption and _belongs_below(cur, paras[at], page):
            out.append(Paragraph(cur.lines + paras[at].lines, True))
            at += 1
        else:
            out.append(cur)
    return out


def _belongs_below(caption: Paragraph, below: Paragraph, page: Page) -> bool:
    text, below_text = caption.text, below.text
    a, b = max(caption.lines, key=lambda x: x.end), min(below.lines, key=lambda x: x.place)
    if text.endswith((":", ".")) or len(text) <= 24:
        most = 3.0 if text.endswith(":") and len(text) <= 20 else 1.2
        if gap(a, b) <= page.line_h * most and overlap(a, b) >= 0.2:
            return True
    aligned = overlap(a, b) >= 0.2 or abs(a.x0 - b.x0) <= 8.0
    near = gap(a, b) <= page.line_h * CAPTION_GAP * 1.2 and aligned and len(below.lines) <= 2
    body = plain.is_sentence(below_text) or (a.text.rstrip().endswith(".") and len(below_text) >= 40)
    return bool(CAPTION.match(text)) and below_text[:1].islower() and near and not body


def split_captions(paras: list[Paragraph], page: Page) -> list[Paragraph]:
    """Captions without the body text that was taken for their end: it begins in lower case after a full stop."""
    out = []
    for p in paras:
        cut = None
        if p.caption:
            pairs = zip(p.lines, p.lines[1:], strict=False)
            cut = next((k for k, (a, b) in enumerate(pairs, 1) if _body_after(a, b, page)), None)
        out += [p] if cut is None else [Paragraph(p.lines[:cut], True), Paragraph(p.lines[cut:])]
    return out


def _body_after(a: Line, b: Line, page: Page) -> bool:
    s = b.text
    begins = a.text.endswith(".") and s[:1].islower() and len(s) >= 30 and plain.is_worded(s)
    return begins and not SIDE_LABEL.match(s) and gap(a, b) <= page.line_h * 2.6


def join_equation_numbers(paras: list[Paragraph], page: Page) -> list[Paragraph]:
    """Numbers at the right margin go to the nearest paragraph before them that ends on their baseline."""
    if page.width <= 0 or page.line_h <= 0:
        return paras
    out: list[Paragraph] = []
    for p in paras:
        x = p.lines[0]
        best = None
        if not p.caption and len(p.lines) == 1 and page.is_equation_number(x):
            for k in range(len(out) - 1, -1, -1):
                if out[k].caption:
                    continue
                end = max(out[k].lines, key=lambda y: y.end)
                if max(abs(end.y0 - x.y0), abs(end.y1 - x.y1)) > page.line_h * 0.35:
                    if end.y1 < x.y0 - page.line_h * 2.5:
                        break
                elif end.x1 <= x.x0 and (best is None or x.x0 - end.x1 < best[0]):
                    best = x.x0 - end.x1, k
        if best is None:
            out.append(p)
        else:
            out[best[1]] = Paragraph([*out[best[1]].lines, x])
    return out


def replace_display_math(paras: list[Paragraph], page: Page) -> list[Paragraph]:
    """Paragraphs with a numbered formula become its placeholder."""
    out = []
    for p in paras:
        number = None if p.caption else next((x.text for x in p.lines if page.is_equation_number(x)), None)
        if number is not None:
            label = re.sub(r"\s+", "", EQUATION_LABEL.search(number)[0])
            p = Paragraph([_joined(p.lines, f"{blocks.MATH}{label}")])
        out.append(p)
    return out


def drop_table_paragraphs(paras: list[Paragraph], page: Page) -> list[Paragraph]:
    """Without the bodies of tables above or below their captions, where enough of the paragraphs there look like rows."""
    middle, slack = page.width * 0.5, page.width * 0.02

    def column(p: Paragraph) -> int | None:
        x0, _, x1, _ = p.box()
        return None if x0 < middle - slack and x1 > middle + slack else int(x0 >= middle)

    gone: set[int] = set()
    for c, caption in enumerate(paras):
        if not caption.caption or not TABLE.match(caption.text) or page.height <= 0 or page.width <= 0:
            continue
        _, top, _, bottom = caption.box()
        own, window = column(caption), blocks.table_window(page.height)
        for low, high, least, score, all_go in ((max(0.0, top - window), top, ABOVE_LEAST, TABLE_ABOVE, True), (bottom, min(page.height, bottom + window), BELOW_LEAST, TABLE_BELOW, False)):
            inside = []
            for k, p in enumerate(paras):
                _, y0, _, y1 = p.box()
                if k != c and not p.caption and y1 > low and y0 < high and (own is None or column(p) == own) and p.text and not plain.is_sentence(p.text):
                    inside.append(k)
            strong = [k for k in inside if plain.table_score(paras[k].text) >= score]
            if len(strong) >= least:
                gone.update(inside if all_go else strong)
    return [p for k, p in enumerate(paras) if k not in gone]


PAGE_STEPS = (join_captions, split_captions, join_equation_numbers, replace_display_math, drop_table_paragraphs)


def paragraphs_of_page(lines: list[Line], page: Page) -> list[Paragraph]:
    paras = assemble(collapse_unnumbered_math(lines, page), page)
    for step in PAGE_STEPS:
        paras = step(paras, page)
    return paras


# paragraphs of a document


def join_math(paras: list[Paragraph]) -> list[Paragraph]:
    """Numbered placeholders go into the prose before or after them where that goes on; others stay, numbered ones also where neither fits."""

    def is_math(p: Paragraph) -> bool:
        return not p.caption and p.text.startswith(blocks.MATH)

    def is_target(p: Paragraph) -> bool:
        return not p.caption and not is_math(p) and plain.is_worded(p.text)

    def score(a: Line, b: Line) -> int:
        heights = [x.y1 - x.y0 for x in (a, b) if x.y1 > x.y0]
        return continuity(a, b, max(a.x1, b.x1, 1.0), float(median(heights)) if heights else 10.0)

    paras, out = list(paras), []
    last = None  # the place in out of the last paragraph that a formula may join
    targets = [k for k, p in enumerate(paras) if is_target(p)]
    ahead = 0
    for k, p in enumerate(paras):
        numbered = is_math(p) and EQUATION_LABEL.search(p.text)
        if not numbered:
            if is_target(p):
                last = len(out)
            out.append(p)
            continue
        while ahead < len(targets) and (targets[ahead] <= k or not is_target(paras[targets[ahead]])):
            ahead += 1
        after = targets[ahead] if ahead < len(targets) else None
        before = out[last] if last is not None else None
        scores = score(before.lines[-1], p.lines[0]) if before else None, score(p.lines[-1], paras[after].lines[0]) if after is not None else None
        goes = direction(*scores, before.text if before else "", paras[after].text if after is not None else "", "alone")
        if goes == "before":
            end = before.lines[-1]
            out[last] = Paragraph([*before.lines[:-1], end._replace(text=f"{end.text.rstrip()} {p.text}".strip())], before.caption)
        elif goes == "after":
            begin = paras[after].lines[0]
            paras[after] = Paragraph([begin._replace(text=f"{p.text} {begin.text.lstrip()}".strip()), *paras[after].lines[1:]], paras[after].caption)
        else:
            out.append(p)
    return out


def _facts(p: Paragraph, page: Page) -> dict:
    """What the merge over pages asks of a paragraph."""
    first, last, text = p.first, p.last, p.text
    edges = {f"first_{n}": getattr(first, n) for n in ("x0", "x1", "y0")} | {f"last_{n}": getattr(last, n) for n in ("x0", "x1", "y1")}
    return edges | {"page_index": first.page_index, "text": text, "caption": p.caption, "worded": plain.is_worded(text), "n_lines": len(p.lines), "page_w": page.width, "page_h": page.height, "line_h": page.line_h, "lines": p.lines}


def paragraphs_of_document(pages: list[tuple[Page, list[Paragraph]]]) -> list[Paragraph]:
    """The paragraphs of all pages in order, joined over pages, with formulas in the prose around them."""
    merged = blocks.merged_over_pages(_facts(p, page) for page, paras in pages for p in paras)
    return join_math([Paragraph(q["lines"], q["caption"]) for q in merged])


# as DataFrames

_LINE = pa.struct([("page_index", pa.int32()), ("ord", pa.int64()), ("x0", pa.float64()), ("y0", pa.float64()), ("x1", pa.float64()), ("y1", pa.float64()), ("text", pa.string()), ("font_size", pa.float64())])
LINE_SQL = "struct<page_index:int,ord:bigint,x0:double,y0:double,x1:double,y1:double,text:string,font_size:double>"
_FACTS = ("width", "height", "line_h", "median_w", "page_font", "font", "top", "bottom", "band_h")
_PAGE_COLUMNS = ("page_w", "page_h", "line_h", "median_w", "page_font", "font", "top", "bottom", "band_h")
_PARAGRAPHS = pa.schema([("doc_id", pa.int64()), ("page_index", pa.int32()), ("ord", pa.int64()), ("caption", pa.bool_()), ("lines", pa.list_(_LINE)), *[(n, pa.float64()) for n in ("page_w", "page_h", "line_h")]])
_DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("ord", pa.int64()), ("caption", pa.bool_()), ("lines", pa.list_(_LINE))])


#: Rows of one step, so that a task holds the objects of some pages or paragraphs and not those of a whole batch.
STEP = 256


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[dict, list[Line]]]:
    """Each row's own columns, and its lines."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            held = part["lines"]
            ends = held.offsets.to_pylist() if len(held) else [0]
            flat = held.values
            fields = [flat.field(n).slice(ends[0], ends[-1] - ends[0]).to_pylist() for n in Line._fields if flat.type.get_field_index(n) >= 0]
            numbers = part["page_index"].to_pylist()
            if len(fields) < len(Line._fields):  # a page's lines don't name their page
                fields.insert(0, [n for n, a, b in zip(numbers, ends, ends[1:], strict=False) for _ in range(b - a)])
            lines = list(map(Line, *fields))
            for k, own in enumerate(zip(*[part[n].to_pylist() for n in columns], strict=True)):
                yield dict(zip(columns, own, strict=True)), lines[ends[k] - ends[0] : ends[k + 1] - ends[0]]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of values in the order of ``schema``, with lists of ``Line`` for lines."""
    made = []
    for f, column in zip(schema, zip(*rows, strict=True), strict=True):
        if f.name == "lines":
            flat = list(zip(*[x for lines in column for x in lines], strict=True)) or [()] * len(_LINE)
            ends = [0, *accumulate(map(len, column))]
            made.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(v, x.type) for v, x in zip(flat, _LINE, strict=True)], fields=list(_LINE)), f.type))
        else:
            made.append(pa.array(column, f.type))
    return pa.RecordBatch.from_arrays(made, schema=schema)


def _stepped(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, STEP)):
        yield _batch(part, schema)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made() -> Iterator[tuple]:
        for row, lines in _rows(batches, ["doc_id", "page_index", *_PAGE_COLUMNS]):
            page = Page(**{f: row[c] for f, c in zip(_FACTS, _PAGE_COLUMNS, strict=True)})
            for k, p in enumerate(paragraphs_of_page(lines, page)):
                yield row["doc_id"], row["page_index"], k, p.caption, p.lines, page.width, page.height, page.line_h

    return _stepped(made(), _PARAGRAPHS)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of documents, pages and paragraphs; a document is what stands together."""

    def made() -> Iterator[tuple]:
        for doc_id, rows in groupby(_rows(batches, ["doc_id", "page_index", "caption", "page_w", "page_h", "line_h"]), lambda r: r[0]["doc_id"]):
            pages = [(Page(row["page_w"], row["page_h"], row["line_h"]), [Paragraph(lines, row["caption"])]) for row, lines in rows]
            for k, p in enumerate(paragraphs_of_document(pages)):
                yield doc_id, k, p.caption, p.lines

    return _stepped(made(), _DOCUMENTS)


def page_paragraphs(pages: DataFrame) -> DataFrame:
    """``doc_id, page_index, ord, caption, lines, page_w, page_h, line_h`` of ``pages`` with lines and metrics: a page is one row, so there is no shuffle."""
    columns = "doc_id long, page_index int, ord long, caption boolean, lines array<{}>, page_w double, page_h double, line_h double".format(LINE_SQL)
    return pages.select("doc_id", "page_index", *_PAGE_COLUMNS, "lines").mapInArrow(_pages, columns)


def merged_documents(paragraphs: DataFrame) -> DataFrame:
    """``doc_id, ord, caption, lines`` of each document.

    Documents are dealt out and sorted by Spark and walked through one after another, many in a batch: as groups of their own they cost a hand-over each.
    """
    held = paragraphs.select("doc_id", "page_index", "ord", "caption", "lines", "page_w", "page_h", "line_h")
    dealt = held.repartition("doc_id").sortWithinPartitions("doc_id", "page_index", "ord")
    return dealt.mapInArrow(_documents, f"doc_id long, ord long, caption boolean, lines array<{LINE_SQL}>")
