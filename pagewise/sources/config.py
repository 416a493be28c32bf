"""Configuration of a run: defaults, a YAML file over them, dotted overrides over that, and rules that all must keep."""

from __future__ import annotations

import copy
import json
import os
from collections.abc import Callable

from ..functions.text import MarkPolicy
from .sinks import sink_names
from .texts import apply_overrides

DEFAULTS: dict = {
    "seed": 1234,
    "fonts": {"paths": ["assets/fonts"], "size_range": [18, 30], "require_full_coverage": True, "include": [], "exclude": []},
    "text": {
        "source": {"type": "inline", "path": None, "column": "text", "title_column": None, "split": "train", "name": None, "limit": None,
                   "sentences": ["Every page begins with a line of text.", "كل صفحة تبدأ بسطر من النص.", "A table holds what a sentence cannot."]},
        "diacritics": {"mode": "keep", "keep_range": [0.1, 0.6], "mixed_weights": [0.15, 0.25, 0.60]},
        "normalization": {"strip_marks": False, "strip_tatweel": False, "unify_alef": False, "unify_ya": False, "unify_ta_marbuta": False, "numerals": "keep", "collapse_white": True},
        "direction": "auto",
    },
    "page": {
        "papers": {"a4": 4, "a5": 1, "letter": 1}, "dpi_range": [110, 200], "margin_mm_range": [12, 28], "columns": {"1": 3, "2": 1}, "landscape_probability": 0.05, "header_probability": 0.35,
        "footer_probability": 0.45, "max_pages": 3, "background": {"kinds": {"paper": 3, "solid": 1, "gradient": 0.5, "image": 0}, "image_paths": [], "tint_range": [[238, 234, 226], [255, 255, 255]]},
    },
    "templates": {"weights": {"article": 3, "report": 2, "newspaper": 1.5, "paper": 1.5, "letter": 1, "form": 1, "invoice": 1, "contents": 0.8, "slide": 0.8, "notes": 1}},
    "degradations": {"presets": {"clean": 1, "scan": 4, "photo": 3, "fax": 0.5, "archive": 1}},
    "output": {"dir": "outputs/dataset", "format": "jsonl", "image_format": "png", "image_quality": 92, "images_subdir": "images", "shard_size": 1000},
    "quality": {"enabled": True, "max_rejection_rate": 0.5},
    "run": {"num_samples": 100, "workers": 1, "start_index": 0, "max_consecutive_failures": 50},
}


def _at(config: dict, path: str):
    for name in path.split("."):
        config = config[name]
    return config


def _share(v) -> bool:
    return isinstance(v, (int, float)) and 0 <= v <= 1


def _weights(v) -> bool:
    return isinstance(v, dict) and all(isinstance(x, (int, float)) for x in v.values()) and any(x > 0 for x in v.values())


def _span(v, least: float = 0) -> bool:
    return isinstance(v, (list, tuple)) and len(v) == 2 and all(isinstance(x, (int, float)) for x in v) and min(v) > least


def _whole(least: int) -> Callable[[object], bool]:
    return lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= least


_RULES: list[tuple[str, Callable[[object], bool], str]] = [
    ("fonts.size_range", _span, "two positive sizes"), ("page.dpi_range", _span, "two positive numbers"), ("page.margin_mm_range", lambda v: _span(v, -1), "two numbers"),
    *((f"page.{k}", _weights, "a positive weight") for k in ("papers", "columns")), ("page.background.kinds", _weights, "a positive weight"), ("templates.weights", _weights, "a positive weight"), ("degradations.presets", _weights, "a positive weight"),
    *((f"page.{k}_probability", _share, "a number from 0 to 1") for k in ("landscape", "header", "footer")), ("quality.max_rejection_rate", _share, "a number from 0 to 1"),
    ("page.max_pages", _whole(1), "1 or more"), ("output.shard_size", _whole(1), "1 or more"), ("run.num_samples", _whole(0), "0 or more"), ("run.workers", _whole(1), "1 or more"), ("run.max_consecutive_failures", _whole(1), "1 or more"),
    ("output.image_quality", lambda v: _whole(1)(v) and v <= 100, "1 to 100"), ("output.format", lambda v: v in sink_names(), "a known format"), ("text.direction", lambda v: v in ("auto", "ltr", "rtl"), "auto, ltr or rtl"),
    ("text.diacritics.mode", lambda v: v in ("keep", "strip", "partial", "mixed"), "keep, strip, partial or mixed"), ("seed", lambda v: v is None or isinstance(v, int), "a whole number or null"),
]


def validate(config: dict) -> dict:
    """The configuration over the defaults; unknown keys and values against a rule are errors."""

    def merge(base: dict, given: dict, path: str) -> dict:
        out = copy.deepcopy(base)
        for key, value in given.items():
            if key not in base:
                raise ValueError(f"unknown key {path}{key}")
            free = isinstance(base[key], dict) and isinstance(value, dict) and key not in ("papers", "columns", "kinds", "weights", "presets")
            out[key] = merge(base[key], value, f"{path}{key}.") if free else copy.deepcopy(value)
        return out

    if not isinstance(config, dict):
        raise ValueError("a configuration is a mapping")
    out = merge(DEFAULTS, config, "")
    for path, rule, told in _RULES:
        if not rule(_at(out, path)):
            raise ValueError(f"{path} must be {told}, not {_at(out, path)!r}")
    source = out["text"]["source"]
    if source["type"] in ("csv", "parquet") and not source["path"]:
        raise ValueError(f"text.source of type {source['type']} needs a path")
    if source["type"] == "inline" and not source["sentences"]:
        raise ValueError("text.source of type inline needs sentences")
    if out["page"]["background"]["kinds"].get("image", 0) > 0 and not out["page"]["background"]["image_paths"]:
        raise ValueError("page.background.image_paths are needed for image backgrounds")
    out["fonts"]["size_range"] = sorted(out["fonts"]["size_range"])
    return out


def load(path: str | None = None, overrides: list[str] | None = None) -> dict:
    """A configuration from a YAML file, or the defaults, with overrides."""
    data = {}
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f) or {}
        if not isinstance(data, dict):
            raise ValueError(f"{path} holds no mapping")
    return validate(apply_overrides(data, overrides or []))


def mark_policy(config: dict) -> MarkPolicy:
    d = config["text"]["diacritics"]
    return MarkPolicy(d["mode"], tuple(d["keep_range"]), tuple(d["mixed_weights"]))


#: Arms of ablations: name and overrides.
ABLATIONS: dict[str, list[tuple[str, list[str]]]] = {
    "degradations": [("all", []), ("clean_only", ['degradations.presets={"clean": 1}']), ("no_physical", ['degradations.presets={"clean": 1, "scan": 4, "fax": 1}'])],
    "fonts": [("all", []), ("single_family", ['fonts.include=["NotoSansArabic-"]'])],
    "layout": [("all", []), ("prose_only", ['templates.weights={"article": 1}']), ("single_column", ['page.columns={"1": 1}'])],
    "diacritics": [("mixed", ['text.diacritics.mode="mixed"']), ("stripped", ['text.diacritics.mode="strip"']), ("kept", ['text.diacritics.mode="keep"'])],
}


def ablation(name: str, config: dict, root: str, arms: list[tuple[str, list[str]]] | None = None, num_samples: int | None = None) -> list[dict]:
    """``name``, ``overrides``, ``dir`` and ``config`` of each arm: one seed, a folder each."""
    if arms is None:
        if name not in ABLATIONS:
            raise ValueError(f"unknown ablation {name!r}; one of {', '.join(sorted(ABLATIONS))}")
        arms = ABLATIONS[name]
    out = []
    for arm, changes in arms:
        folder = f"{root.rstrip('/')}/{name}/{arm}"
        more = [*changes, f"output.dir={json.dumps(folder)}", *([f"run.num_samples={int(num_samples)}"] if num_samples else [])]
        out.append({"name": arm, "overrides": changes, "dir": folder, "config": validate(apply_overrides(config, more))})
    return out


def write_manifest(name: str, arms: list[dict], folder: str) -> str:
    """The plan of an ablation as JSON; the path of the file."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/ablation-{name}.json"
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"name": name, "arms": arms}, f, indent=2, ensure_ascii=False)
    return path
