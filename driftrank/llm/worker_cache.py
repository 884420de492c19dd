"""What a Python worker keeps between tasks, such as a built automaton or word tables.

Import this module inside the task's function: the import then finds the
worker's own module, not a copy that travels with the closure.
"""

from __future__ import annotations

_HELD: dict = {}


def once(key: str, make):
    """The object of ``key``, made on first use; it stays until another one is asked for.

    A worker runs one stage's function at a time, so what an earlier stage
    has left is of no use and only takes memory.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]
