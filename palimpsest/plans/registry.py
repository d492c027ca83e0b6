"""Item types: parents, mutators as declared operations, invariants as SQL."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Op:
    """What a mutator does: `kind` to `attribute`.

    set, add (a running sum), append, append_negated, refer (a reference), add_ref, forget (all of an attribute's references to the argument).
    `mirror` is (kind, attribute) of what the same call does to the item that is its argument, with the target as argument.
    """

    kind: str
    attribute: str
    sql_type: str = "string"
    mirror: tuple[str, str] | None = None


@dataclass
class ItemType:
    name: str
    parent: str | None = None
    abstract: bool = False
    methods: dict[str, Op] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    invariants: tuple[str, ...] = ()


class Registry:
    def __init__(self, *types: ItemType) -> None:
        self.types = {t.name: t for t in types}

    def chain(self, name: str) -> list[ItemType]:
        out, t = [], self.types[name]
        while t is not None:
            out.append(t)
            t = self.types[t.parent] if t.parent else None
        return out

    def methods(self, name: str) -> dict[str, Op]:
        """A type's mutators, inherited ones included; a subtype's own come first."""
        out: dict[str, Op] = {}
        for t in reversed(self.chain(name)):
            out |= t.methods
        return out

    def defaults(self, name: str) -> dict[str, str]:
        out: dict[str, str] = {}
        for t in reversed(self.chain(name)):
            out |= t.defaults
        return out

    def invariants(self, name: str) -> list[str]:
        return [i for t in self.chain(name) for i in t.invariants]

    def parents(self) -> dict[str, str | None]:
        return {n: t.parent for n, t in self.types.items()}

    def abstract(self) -> list[str]:
        return [n for n, t in self.types.items() if t.abstract]

    def method_rows(self) -> list[tuple]:
        return [(n, m, o.kind, o.attribute, o.sql_type, *(o.mirror or (None, None))) for n in self.types for m, o in self.methods(n).items()]

    def attributes(self, name: str) -> dict[str, Op]:
        """The attributes of a type by name, those that mirrors of other types give it included."""
        out = {o.attribute: o for o in self.methods(name).values()}
        for t in self.types.values():
            for o in t.methods.values():
                if o.mirror:
                    out.setdefault(o.mirror[1], Op(o.mirror[0], o.mirror[1]))
        return out
