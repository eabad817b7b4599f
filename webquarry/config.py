"""Operator configuration: an optional YAML file with two knobs. A malformed file is an error before anything is written."""

from __future__ import annotations

import os
from dataclasses import dataclass

DEFAULT_SNIP_BYTES, DEFAULT_BUFFER_BYTES, LEAST_BUFFER_BYTES = 16 * 1024, 50 * 1024 * 1024, 15 * 1024 * 1024


@dataclass(frozen=True)
class Config:
    """snip_bytes: stored bytes of a body for snippets, 0 for all. buffer_bytes: kept for homes that set it; Spark sizes its own."""

    snip_bytes: int = DEFAULT_SNIP_BYTES
    buffer_bytes: int = DEFAULT_BUFFER_BYTES


def _yaml(text: str) -> dict:
    """Nested `key: value` lines; a real YAML parser where one is installed."""
    try:
        import yaml
    except ImportError:
        return _plain(text)
    try:
        found = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(f"malformed configuration: {e}") from e
    return found or {}


def _plain(text: str) -> dict:
    out: dict = {}
    inside = None
    for line in text.splitlines():
        bare = line.split("#")[0].rstrip()
        if not bare:
            continue
        key, colon, value = bare.partition(":")
        if not colon:
            raise ValueError(f"malformed configuration: {line!r}")
        value = value.strip().strip("'\"")
        if line[0].isspace() and inside is not None:
            inside[key.strip()] = int(value) if value.isdigit() else value
        elif value:
            out[key.strip()] = int(value) if value.isdigit() else value
        else:
            inside = out.setdefault(key.strip(), {})
    return out


def load(home: str) -> Config:
    at = os.path.join(home, "config.yaml")
    if not os.path.exists(at):
        return Config()
    with open(at, encoding="utf-8") as f:
        found = _yaml(f.read())
    if not isinstance(found, dict) or not isinstance(found.get("index") or {}, dict):
        raise ValueError("malformed configuration: sections expected")
    index = found.get("index") or {}
    for k in ("stored_body_cap_kb", "writer_heap_mb"):
        if index.get(k) is not None and (not isinstance(index[k], int) or index[k] < 0):
            raise ValueError(f"malformed configuration: {k} must be a whole number")
    cap, heap = index.get("stored_body_cap_kb"), index.get("writer_heap_mb")
    return Config(DEFAULT_SNIP_BYTES if cap is None else cap * 1024, DEFAULT_BUFFER_BYTES if heap is None else max(LEAST_BUFFER_BYTES, heap * 1024 * 1024))
