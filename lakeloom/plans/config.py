"""Settings of searches and readers: a JSON file or a dict, under what is given explicitly and over the defaults."""

from __future__ import annotations

import copy
import json
from dataclasses import fields, is_dataclass, replace
from typing import Any


def read(source: str | dict | None) -> dict:
    """A dict as it is, a .json file's content, nothing for None; a file that is not there or no JSON is an error."""
    if source is None or isinstance(source, dict):
        return dict(source or {})
    if not source.endswith(".json"):
        raise ValueError(f"not a JSON file: {source}")
    with open(source, encoding="utf-8") as f:
        found = json.load(f)
    if not isinstance(found, dict):
        raise ValueError(f"not an object: {source}")
    return found


def settled(defaults: dict, source: str | dict | None = None, **explicit: Any) -> dict:
    """Each setting by the first that has it: given explicitly (not None), in the file, by default."""
    return {**defaults, **read(source), **{k: v for k, v in explicit.items() if v is not None}}


def options(kind: type, source: str | dict | None = None, **explicit: Any):
    """An options dataclass from a file or dict and explicit values, which win; names that it does not have are left out of
    the file, but an error where they are explicit. Dataclasses within it are given as dicts of their own."""
    names = {f.name for f in fields(kind)}
    if unknown := set(explicit) - names:
        raise TypeError(f"no such option: {sorted(unknown)}")
    out = kind()
    for k, v in settled({}, {k: v for k, v in read(source).items() if k in names}, **explicit).items():
        old = getattr(out, k)
        v = replace(old, **v) if is_dataclass(old) and isinstance(v, dict) else tuple(v) if isinstance(old, tuple) and isinstance(v, list) else v
        out = replace(out, **{k: v})
    return out


class Config:
    """Nested settings by dotted names."""

    def __init__(self, source: str | dict | None = None):
        self.values = copy.deepcopy(read(source))

    def get(self, name: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in name.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, name: str, value: Any) -> Config:
        *path, last = name.split(".")
        at = self.values
        for part in path:
            at = at.setdefault(part, {})
            if not isinstance(at, dict):
                raise ValueError(f"{part} of {name} is a value already")
        at[last] = value
        return self

    def merge(self, other: str | dict | Config) -> Config:
        """Takes over the other's values; objects on both sides are merged in turn."""

        def into(a: dict, b: dict) -> None:
            for k, v in b.items():
                if isinstance(v, dict) and isinstance(a.get(k), dict):
                    into(a[k], v)
                else:
                    a[k] = copy.deepcopy(v)

        into(self.values, other.values if isinstance(other, Config) else read(other))
        return self

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.values, f, ensure_ascii=False, indent=2)
