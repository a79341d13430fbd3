"""Objects that Python workers build once: automata, indexes and tables stay in a worker for all its tasks.

A class derived from ``Once`` keeps its constructor's arguments in ``args``; when a task unpickles an instance, the worker looks
whether it has built the same one before. The identity is drawn where the instance is first made, so two instances never mix."""

from __future__ import annotations

import uuid
from collections import OrderedDict

#: Objects a worker keeps; the one used longest ago goes first.
KEPT = 8
_built: OrderedDict[str, object] = OrderedDict()


class Once:
    """``args``: what the constructor was called with. ``uid`` tells instances apart."""

    args: tuple
    uid: str | None = None

    def __reduce__(self):
        if self.uid is None:
            self.uid = uuid.uuid4().hex
        return once, (type(self), self.uid, self.args)


def once(kind: type, uid: str, args: tuple) -> object:
    """The worker's instance of this identity, built if it isn't there yet."""
    if uid not in _built:
        made = kind(*args)
        made.uid = uid
        _built[uid] = made
        while len(_built) > KEPT:
            _built.popitem(last=False)
    _built.move_to_end(uid)
    return _built[uid]


def bounded(function, most: int = 50_000, longest: int = 2_000):
    """``function`` of one text with a cache of ``most`` results; texts over ``longest`` characters are computed each time, so a cache never holds gigabytes."""
    from functools import lru_cache, wraps

    kept = lru_cache(most)(function)

    @wraps(function)
    def run(text):
        return function(text) if text is not None and len(text) > longest else kept(text)

    return run
