"""What a Python worker keeps between its tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable


def kept(key: object, make: Callable[[], object]) -> object:
    """The value under this key in this process, made at first use.

    The package's functions reach tasks by value, so their own globals start anew in each
    task; this store is a module of the process and outlives them.
    """
    store = sys.modules.setdefault("_pointweave_kept", types.ModuleType("_pointweave_kept"))
    values = store.__dict__.setdefault("values", {})
    if key not in values:
        values[key] = make()
    return values[key]
