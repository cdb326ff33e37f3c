"""Run manifests: canonical JSON, run ids and artifact inventories, on the driver."""

from __future__ import annotations

import hashlib
import json
import math
import os
from datetime import UTC, datetime
from pathlib import Path


def normalised(value):
    """A value of plain JSON types: sorted sets, UTC times, finite numbers only."""
    if isinstance(value, dict):
        return {str(k): normalised(v) for k, v in value.items()}
    if isinstance(value, set | frozenset):
        return sorted((normalised(x) for x in value), key=lambda x: json.dumps(x, sort_keys=True))
    if isinstance(value, list | tuple):
        return [normalised(x) for x in value]
    if isinstance(value, datetime):
        if value.tzinfo is None:
            raise ValueError("times need a zone")
        return value.astimezone(UTC).isoformat().replace("+00:00", "Z")
    if isinstance(value, Path):
        return value.as_posix()
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("numbers must be finite")
    if value is None or isinstance(value, str | int | float | bool):
        return value
    raise TypeError(f"{type(value).__name__} has no canonical form")


def canonical_json(value) -> bytes:
    return (json.dumps(normalised(value), sort_keys=True, indent=2, ensure_ascii=False) + "\n").encode()


def write_atomically(path: Path, data: bytes) -> None:
    part = path.with_name(path.name + ".part")
    part.write_bytes(data)
    os.replace(part, path)


def run_id(kind: str, **identity) -> str:
    return f"{kind}-{hashlib.sha256(canonical_json({'kind': kind, **identity})).hexdigest()[:16]}"


def inventory(paths: list[Path], root: Path) -> list[dict]:
    """Relative path, size and hash of each file, sorted; files outside root are refused."""
    out = {}
    for path in paths:
        inside = path.resolve().relative_to(root.resolve()).as_posix()
        digest = hashlib.sha256()
        with path.open("rb") as file:
            while block := file.read(1 << 20):
                digest.update(block)
        out[inside] = {"path": inside, "size": path.stat().st_size, "sha256": digest.hexdigest().upper()}
    return [out[k] for k in sorted(out)]
