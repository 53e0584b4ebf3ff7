"""Things that a Python worker loads once and keeps."""

from __future__ import annotations

import uuid
from collections.abc import Callable

_loaded: dict[str, object] = {}


def once_per_worker(load: Callable[[], object]) -> Callable[[], object]:
    """``load`` wrapped so that each Python worker process calls it only once.

    The key is drawn where the wrapper is made, so it travels with it to all
    workers, which Spark uses again for later tasks.
    """
    key = uuid.uuid4().hex

    def get():
        from docloom.operators.worker import _loaded as kept

        if key not in kept:
            kept[key] = load()
        return kept[key]

    return get
