"""The predicates of ``text`` for a single string, where a walk over lines carries state that columns can't."""

from __future__ import annotations

import re
import unicodedata

from . import text as T

_SENTENCE_END = re.compile(T.SENTENCE_END)
_SIGNS = re.compile(T.MATH_SIGNS)
_MATH = re.compile(T.MATH_ANY)
_NAMED = re.compile(T.MATH_NAME)
_NUMBER = re.compile(r"[+\-−]?\d+(?:\.\d+)?")
_CONNECTS = re.compile(T.CONNECTS)
_CAPTION = re.compile(T.CAPTION)


def ends_sentence(s: str) -> bool:
    return bool(_SENTENCE_END.search(s))


def is_sentence(s: str) -> bool:
    return bool(re.search("[a-z]", s)) and len(s.split()) >= 6 and ends_sentence(s)


def is_prose(s: str) -> bool:
    letters = sum(map(str.isalpha, s))
    signs = len(_SIGNS.findall(s))
    return len(s.split()) >= 6 and letters >= 15 and not (signs >= 4 and signs > letters * 0.15)


def is_worded(s: str) -> bool:
    return is_sentence(s) or is_prose(s)


def is_mathish(s: str) -> bool:
    if not s or is_prose(s):
        return False
    odd = sum(not c.isalnum() and not c.isspace() for c in s)
    return bool(_MATH.search(s) or _NAMED.search(s)) or (odd >= 3 and sum(map(str.isalpha, s)) <= 10)


def connects(s: str) -> bool:
    return bool(_CONNECTS.match(s.lstrip()))


def is_captionish(s: str) -> bool:
    """Whether a text is a caption, or short and like the rest of one."""
    t = s.strip(" ")
    short = t != "" and len(t) <= 120 and unicodedata.category(t[0]) != "Ll" and ("," in t or len(t.split()) <= 6)
    return short or bool(_CAPTION.match(t))


def table_score(s: str) -> float:
    """How much a text looks like a row of a table, 0 to 1; a percent sign makes no number here."""
    tokens = s.split()
    if not tokens:
        return 0.0
    worded = [t for t in tokens if re.search("[A-Za-z]", t)]
    shares = (sum(bool(_NUMBER.fullmatch(t)) for t in tokens), sum(len(t) <= 2 for t in tokens))
    raw = 0.55 * shares[0] / len(tokens) + 0.22 * shares[1] / len(tokens)
    raw += 0.18 * sum(t[0].isupper() or t.endswith(".") for t in worded) / max(1, len(worded))
    return max(0.0, min(1.0, raw + 0.15 * (len(tokens) >= 12) - 0.7 * is_sentence(s)))


def clean_answer(s: str) -> str:
    """A provider's answer without code fence and without one leading label."""
    return re.sub(T.ANSWER_LABEL, "", re.sub(r"\n?```$", "", re.sub(r"^```[^\n]*\n", "", s.strip(" "))).strip(" ")).strip(" ")


def error_kind(status: int, detail: str = "", provider: str = "chat") -> str:
    """What an error of a service is: auth, quota, rate_limit, or temporary."""
    if status in (401, 403):
        return "auth"
    if provider == "deepl":
        return {429: "rate_limit", 456: "quota"}.get(status, "temporary")
    if status == 402 or re.search("quota|billing", detail.lower()):
        return "quota"
    return "rate_limit" if status == 429 else "temporary"
