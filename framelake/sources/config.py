"""Settings: layered files, references between values, dotted look-up, closed sets of keys."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from typing import Any


def merge(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``over`` on top of ``base``; only mappings are merged deeply."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


class Settings:
    """Nested settings with ``a.b`` look-up and ``${a.b}`` references."""

    def __init__(self, values: Mapping[str, Any]) -> None:
        self.values = self._resolved(dict(values), dict(values))

    @classmethod
    def load(cls, *paths: str, **over: Any) -> Settings:
        """JSON files from general to special, then keyword values; files that don't exist are skipped."""
        values: dict[str, Any] = {}
        for p in paths:
            if os.path.exists(p):
                with open(p, encoding="utf-8") as f:
                    values = merge(values, json.load(f))
        return cls(merge(values, over))

    def _resolved(self, node: Any, root: Mapping[str, Any], depth: int = 0) -> Any:
        if depth > 32:
            raise ValueError("references turn in a circle")
        if isinstance(node, Mapping):
            return {k: self._resolved(v, root, depth) for k, v in node.items()}
        if isinstance(node, list):
            return [self._resolved(v, root, depth) for v in node]
        if not isinstance(node, str):
            return node
        if whole := re.fullmatch(r"\$\{([^}]+)\}", node):
            return self._resolved(_find(root, whole[1]), root, depth + 1)
        return re.sub(r"\$\{([^}]+)\}", lambda m: str(self._resolved(_find(root, m[1]), root, depth + 1)), node)

    def get(self, path: str, default: Any = None) -> Any:
        try:
            return _find(self.values, path)
        except KeyError:
            return default

    def replaced(self, path: str, value: Any) -> Settings:
        """A copy with one value changed."""
        node: Any = value
        for key in reversed(path.split(".")):
            node = {key: node}
        return Settings(merge(self.values, node))


def _find(root: Any, path: str) -> Any:
    for key in path.split("."):
        if not isinstance(root, Mapping) or key not in root:
            raise KeyError(path)
        root = root[key]
    return root


def closed(values: Mapping[str, Any], allowed: set[str], fixed: Mapping[str, Any] | None = None) -> None:
    """Fail on keys that are not allowed and on policy keys with another value than the fixed one."""
    if extra := set(values) - allowed - set(fixed or {}):
        raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
    for k, v in (fixed or {}).items():
        if k in values and values[k] != v:
            raise ValueError(f"{k} must be {v!r}")
