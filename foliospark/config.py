"""Settings of the paragraph chain, the library and the text providers, from a mapping, the environment or a settings file."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path
from typing import get_type_hints

PLACEHOLDER = "..."

# The names under which settings are given, and their defaults.
NAMES = {
    "scope": "Z_SCOPE",
    "library_id": "Z_ID",
    "library_key": "Z_API_KEY",
    "min_chars": "PARA_MIN_CHARS",
    "max_chars": "PARA_MAX_CHARS",
    "min_font": "PARA_MIN_MEDIAN_COORD_H",
    "min_font_ratio": "PARA_MIN_MEDIAN_COORD_H_AUTO_RATIO",
    "skip_algorithms": "PARA_SKIP_ALGORITHMS",
    "skip_captions": "PARA_SKIP_CAPTIONS",
    "skip_references": "PARA_SKIP_REFERENCES",
    "skip_table_like": "PARA_SKIP_TABLE_LIKE",
    "target_tag": "Z_TARGET_TAG",
    "base_done_tag": "Z_BASE_DONE_TAG",
    "done_tag": "Z_DONE_TAG",
    "remove_tag": "Z_REMOVE_TAG",
    "pending_tag": "ANN_PENDING_TRANSLATION_TAG",
    "translated_tag": "ANN_TRANSLATED_TAG",
    "provider": "TRANSLATOR_PROVIDER",
    "target_lang": "TARGET_LANG",
    "source_lang": "SOURCE_LANG",
    "deepl_key": "DEEPL_API_KEY",
    "deepl_url": "DEEPL_API_URL",
    "chat_key": "OPENAI_API_KEY",
    "chat_model": "OPENAI_MODEL",
    "chat_url": "OPENAI_BASE_URL",
    "local_key": "LOCAL_LLM_API_KEY",
    "local_model": "LOCAL_LLM_MODEL",
    "local_url": "LOCAL_LLM_BASE_URL",
    "local_temperature": "LOCAL_LLM_TEMPERATURE",
    "local_top_p": "LOCAL_LLM_TOP_P",
}


@dataclass(frozen=True)
class Settings:
    scope: str = "user"
    library_id: str = ""
    library_key: str = ""
    min_chars: int = 60
    max_chars: int = 1500
    min_font: float | str = "auto"
    min_font_ratio: float = 0.8
    skip_algorithms: bool = True
    skip_captions: bool = False
    skip_references: bool = True
    skip_table_like: bool = True
    target_tag: str = "to-translate"
    base_done_tag: str = "base-done"
    done_tag: str = "translated"
    remove_tag: str = "to-translate"
    pending_tag: str = "za:translate"
    translated_tag: str = "za:translated"
    provider: str = "deepl"
    target_lang: str = ""
    source_lang: str = ""
    deepl_key: str = ""
    deepl_url: str = "https://api-free.deepl.com"
    chat_key: str = ""
    chat_model: str = ""
    chat_url: str = "https://api.openai.com/v1"
    local_key: str = ""
    local_model: str = ""
    local_url: str = ""
    local_temperature: float = 0.1
    local_top_p: float = 0.9
    dedup_prefix: str = "para:"
    annotation_mode: str = "note"
    max_paragraphs: int = 100
    delete_broken: bool = True
    repair_broken: bool = True

    def __post_init__(self) -> None:
        if self.min_chars > self.max_chars:
            raise ValueError(f"{NAMES['min_chars']} ({self.min_chars}) is above {NAMES['max_chars']} ({self.max_chars})")
        if self.scope not in ("user", "group"):
            raise ValueError(f"{NAMES['scope']} must be user or group")
        unset = [NAMES[n] for n in ("library_id", "library_key") if getattr(self, n) == PLACEHOLDER]
        if unset:
            raise ValueError(f"not filled in: {', '.join(unset)}")
        blank = [NAMES[n] for n in ("target_tag", "base_done_tag", "done_tag", "remove_tag", "pending_tag", "translated_tag") if not getattr(self, n)]
        if blank:
            raise ValueError(f"must not be empty: {', '.join(blank)}")


def _typed(value: str, kind: object) -> object:
    if kind is bool:
        low = value.strip().lower()
        if low not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
            raise ValueError(f"not a truth value: {value}")
        return low in ("1", "true", "yes", "on")
    if kind is int:
        return int(value)
    if kind is float:
        return float(value)
    if kind == float | str:
        return value if value == "auto" else float(value)
    return value


def settings_file(path: str) -> dict[str, str]:
    """Names and values of a file of ``NAME=value`` lines; comments, blank lines, quotes and a leading export are understood."""
    out = {}
    for raw in Path(path).read_text(encoding="utf-8").splitlines():
        name, mark, value = raw.strip().removeprefix("export ").partition("=")
        if mark and not name.startswith("#"):
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value.split(" #")[0].strip()
    return out


def load(path: str | None = None, environ: Mapping[str, str] | None = None) -> Settings:
    """Settings by their names, of any case; the environment goes before the file, unknown names are ignored."""
    found = settings_file(path) if path and Path(path).exists() else {}
    known = {k.upper(): v for k, v in found.items()} | {k.upper(): v for k, v in (os.environ if environ is None else environ).items()}
    kinds = get_type_hints(Settings)
    return Settings(**{f.name: _typed(known[NAMES[f.name]], kinds[f.name]) for f in fields(Settings) if NAMES.get(f.name) in known})
