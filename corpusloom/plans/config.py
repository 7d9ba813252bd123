"""Settings in layers: built-in profile, then file, then call; with the layer that each value came from."""

from __future__ import annotations

import json
from dataclasses import fields
from pathlib import Path
from typing import Any

from corpusloom.plans.pipeline import Settings

#: Chunk sizes of the built-in profiles.
PROFILES: dict[str, dict[str, Any]] = {
    "cpu": {"chunk_chars": 4000, "reduce_chars": 4000},
    "small": {"chunk_chars": 6000, "reduce_chars": 6000},
    "standard": {"chunk_chars": 8000, "reduce_chars": 8000},
    "large": {"chunk_chars": 12000, "reduce_chars": 12000},
    "xlarge": {"chunk_chars": 20000, "reduce_chars": 20000},
}


def resolve(profile: str = "standard", path: str | None = None, **overrides: Any) -> tuple[Settings, dict[str, str]]:
    """(settings, layer of each value).  Unknown profiles and keys are errors, as is a file that holds no object."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile}")
    known = {f.name: f.default for f in fields(Settings)}
    layers: list[tuple[str, dict[str, Any]]] = [("profile", PROFILES[profile])]
    if path:
        read = json.loads(Path(path).read_text(encoding="utf-8"))
        if not isinstance(read, dict):
            raise ValueError("a settings file must hold an object")
        layers.append(("file", read))
    layers.append(("call", {k: v for k, v in overrides.items() if v is not None}))
    values, source = dict(known), dict.fromkeys(known, "default")
    for name, layer in layers:
        for k, v in layer.items():
            if k not in known:
                raise ValueError(f"unknown setting {k} in {name}")
            values[k], source[k] = v, name
    return Settings(**values), source


def changes(before: dict[str, Any], after: dict[str, Any]) -> list[tuple[str, str, Any, Any]]:
    """(change, dotted path, old, new) of nested settings, in order of the path."""

    def flat(d: dict[str, Any], at: str = "") -> dict[str, Any]:
        out: dict[str, Any] = {}
        for k, v in d.items():
            out |= flat(v, f"{at}{k}.") if isinstance(v, dict) and v else {at + k: v}
        return out

    a, b = flat(before), flat(after)
    kind = lambda k: "add" if k not in a else "remove" if k not in b else "update"
    return [(kind(k), k, a.get(k), b.get(k)) for k in sorted(a.keys() | b.keys()) if k not in a or k not in b or a[k] != b[k]]
