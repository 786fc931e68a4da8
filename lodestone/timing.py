"""How long a call took, on its own result."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable
from dataclasses import replace


def measured(call: Callable) -> Callable:
    """A call whose result, a dataclass with a field ``elapsed``, says how many seconds it
    took, three digits. What a lazy plan takes when it is run isn't in it."""

    @functools.wraps(call)
    def timed(*args, **kwargs):
        began = time.perf_counter()
        result = call(*args, **kwargs)
        return replace(result, elapsed=round(time.perf_counter() - began, 3))

    return timed
