"""Closed configuration objects, read on the driver: unknown keys, wrong types and ranges raise."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from typing import Any

from quillstone.functions.hashing import canonical_sha


@dataclass(frozen=True)
class Field:
    kind: type
    low: float | None = None
    high: float | None = None
    choices: tuple = ()
    required: bool = True


def validate(value: Any, spec: dict[str, Any], at: str = "config") -> dict[str, Any]:
    """`value` if it has the keys of `spec` and no others, with values in range; nested specs are dicts.

    Booleans aren't numbers, and numbers must be finite.
    """
    if not isinstance(value, dict):
        raise ValueError(f"{at} is not an object")
    if extra := sorted(set(value) - set(spec)):
        raise ValueError(f"{at} has unknown keys {extra}")
    for key, field in spec.items():
        here = f"{at}.{key}"
        if isinstance(field, dict):
            validate(value.get(key), field, here)
            continue
        if key not in value:
            if field.required:
                raise ValueError(f"{here} is missing")
            continue
        x = value[key]
        number = field.kind in (int, float)
        if (isinstance(x, bool) and field.kind is not bool) or not isinstance(x, (int, float) if field.kind is float else field.kind):
            raise ValueError(f"{here} is not a {field.kind.__name__}")
        if number and not math.isfinite(x):
            raise ValueError(f"{here} is not finite")
        if (field.low is not None and x < field.low) or (field.high is not None and x > field.high):
            raise ValueError(f"{here} is out of range")
        if field.choices and x not in field.choices:
            raise ValueError(f"{here} is not one of {list(field.choices)}")
    return value


def semantic_hash(value: dict[str, Any], without: tuple[str, ...] = ("paths", "resume")) -> str:
    """Digest of what changes results: paths and the resume flag stay out."""
    return canonical_sha({k: v for k, v in value.items() if k not in without})


def load(text: str, spec: dict[str, Any]) -> tuple[dict[str, Any], str]:
    """(config, digest) of a JSON or, where that library is present, YAML document."""
    try:
        value = json.loads(text)
    except json.JSONDecodeError:
        import yaml

        value = yaml.safe_load(text)
    return validate(value, spec), canonical_sha(value)
