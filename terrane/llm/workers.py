"""Objects that a Python worker keeps between tasks. Import it inside the function that runs there."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_objects: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` built for ``key``; the last few objects are kept."""
    if key not in _objects:
        if len(_objects) >= 4:
            _objects.clear()
        _objects[key] = make()
    return _objects[key]
