"""Client-side events: changes, measurements and annihilations, and the recorder that captures an update's calls as patches."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime


def encoded(key) -> str:
    """Ids as strings; others than strings carry their type, so that 5 and "5" differ."""
    text = key if isinstance(key, str) else f"{type(key).__name__}:{key}"
    if "\x01" in text:
        raise ValueError("an id cannot hold the character U+0001")
    return text


def _moment(when) -> tuple[int, datetime | None]:
    if when is None or when == "-inf":
        return -1, None
    if when == "+inf":
        raise ValueError("an event cannot happen at the end of time")
    return 0, datetime.fromisoformat(when) if isinstance(when, str) else when


@dataclass(frozen=True)
class Patch:
    item_id: str
    item_class: str
    method: str | None
    args: tuple = ()


@dataclass(frozen=True)
class Event:
    kind: str
    when_rank: int
    when_ts: datetime | None
    patches: tuple[Patch, ...] = field(default=())


class Recorder:
    """Stands for an item while an update runs: calls and assignments become patches, anything but `id` cannot be read."""

    def __init__(self, registry, item_class: str, item_id, patches: list[Patch]) -> None:
        object.__setattr__(self, "_r", (registry, item_class, encoded(item_id), patches, item_id))

    def __getattr__(self, name: str):
        registry, item_class, item_id, patches, plain = self._r
        if name == "id":
            return plain
        if name not in registry.methods(item_class):
            raise AttributeError(f"{item_class}.{name} is no mutator; while an update is recorded only id can be read")
        return lambda *args: patches.append(Patch(item_id, item_class, name, tuple(map(_argument, args))))

    def __setattr__(self, name: str, value) -> None:
        getattr(self, name)(value)


def _argument(value) -> tuple[str | None, tuple[str, str] | None]:
    if isinstance(value, Recorder):
        return None, (value._r[2], value._r[1])
    return value if isinstance(value, str) else json.dumps(value), None


class Events:
    """Makes events for the item types of a registry. `when` is a datetime, ISO text, or None for the beginning of time."""

    def __init__(self, registry) -> None:
        self.registry = registry

    def _record(self, kind: str, when, update: Callable, *items: tuple[str, object]) -> Event:
        patches: list[Patch] = []
        update(*[Recorder(self.registry, c, i, patches) for c, i in items])
        return Event(kind, *_moment(when), tuple(patches))

    def change(self, item_class: str, item_id, update: Callable, when=None) -> Event:
        return self._record("change", when, update, (item_class, item_id))

    def change_two(self, class1: str, id1, class2: str, id2, update: Callable, when=None) -> Event:
        return self._record("change", when, update, (class1, id1), (class2, id2))

    def measurement(self, item_class: str, item_id, update: Callable, when=None) -> Event:
        return self._record("measurement", when, update, (item_class, item_id))

    def measurement_two(self, class1: str, id1, class2: str, id2, update: Callable, when=None) -> Event:
        return self._record("measurement", when, update, (class1, id1), (class2, id2))

    def annihilation(self, item_class: str, item_id, when) -> Event:
        """Ends the item; the time is finite and the class is named."""
        rank, ts = _moment(when)
        if rank < 0 or not item_class:
            raise ValueError("an annihilation needs a finite time and a class")
        return Event("annihilation", rank, ts, (Patch(encoded(item_id), item_class, None),))
