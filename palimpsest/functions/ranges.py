"""Key ranges and the predicates that select them.

Keys sort as unsigned bytes, which is also how Spark orders binary columns. A prefix is always written as two bounds:
those reach the Parquet scan as filters, `startswith` on binary columns does not.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class Kind(Enum):
    INCLUDED = "included"
    EXCLUDED = "excluded"
    UNBOUNDED = "unbounded"


@dataclass(frozen=True)
class Bound:
    kind: Kind
    key: Any = None


def included(key: Any) -> Bound:
    return Bound(Kind.INCLUDED, key)


def excluded(key: Any) -> Bound:
    return Bound(Kind.EXCLUDED, key)


UNBOUNDED = Bound(Kind.UNBOUNDED)


def successor(prefix: bytes) -> bytes | None:
    """The smallest key above every key with this prefix; None if there is none."""
    stripped = prefix.rstrip(b"\xff")
    return stripped[:-1] + bytes([stripped[-1] + 1]) if stripped else None


@dataclass(frozen=True)
class KeyRange:
    start: Bound = UNBOUNDED
    end: Bound = UNBOUNDED

    def __post_init__(self) -> None:
        if self.is_empty():
            raise ValueError("empty key range")

    def is_empty(self) -> bool:
        if Kind.UNBOUNDED in (self.start.kind, self.end.kind):
            return False
        if self.start.key != self.end.key:
            return self.start.key > self.end.key
        return not self.start.kind == self.end.kind == Kind.INCLUDED

    @staticmethod
    def point(key: Any) -> KeyRange:
        return KeyRange(included(key), included(key))

    @staticmethod
    def prefix(prefix: bytes, inner: KeyRange | None = None) -> KeyRange:
        """Keys with a prefix; `inner` bounds what follows the prefix."""
        end = successor(prefix)
        low = included(prefix)
        high = UNBOUNDED if end is None else excluded(end)
        if inner is not None and inner.start.kind != Kind.UNBOUNDED:
            low = Bound(inner.start.kind, prefix + inner.start.key)
        if inner is not None and inner.end.kind != Kind.UNBOUNDED:
            high = Bound(inner.end.kind, prefix + inner.end.key)
        return KeyRange(low, high)

    def contains(self, key: Any) -> bool:
        low = self.start.kind == Kind.UNBOUNDED or key > self.start.key or (key == self.start.key and self.start.kind == Kind.INCLUDED)
        high = self.end.kind == Kind.UNBOUNDED or key < self.end.key or (key == self.end.key and self.end.kind == Kind.INCLUDED)
        return low and high

    def as_point(self) -> Any | None:
        closed = self.start.kind == self.end.kind == Kind.INCLUDED
        return self.start.key if closed and self.start.key == self.end.key else None

    def intersect(self, other: KeyRange) -> KeyRange | None:
        def tighter(a: Bound, b: Bound, low: bool) -> Bound:
            if Kind.UNBOUNDED in (a.kind, b.kind):
                return b if a.kind == Kind.UNBOUNDED else a
            if a.key == b.key:
                return a if a.kind == Kind.EXCLUDED else b
            return a if (a.key > b.key) == low else b

        start, end = tighter(self.start, other.start, True), tighter(self.end, other.end, False)
        try:
            return KeyRange(start, end)
        except ValueError:
            return None

    def overlaps(self, other: KeyRange) -> bool:
        return self.intersect(other) is not None

    def predicate(self, key: Column | str) -> Column:
        c = F.col(key) if isinstance(key, str) else key
        out = F.lit(True)
        if self.start.kind != Kind.UNBOUNDED:
            out = c >= F.lit(self.start.key) if self.start.kind == Kind.INCLUDED else c > F.lit(self.start.key)
        if self.end.kind != Kind.UNBOUNDED:
            high = c <= F.lit(self.end.key) if self.end.kind == Kind.INCLUDED else c < F.lit(self.end.key)
            out = high if self.start.kind == Kind.UNBOUNDED else out & high
        return out


ALL = KeyRange()
