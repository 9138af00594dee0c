"""Prefix extractors: which part of a key names its segment or goes into a prefix filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ranges import KeyRange, Kind


@dataclass(frozen=True)
class FixedPrefix:
    """The first `length` bytes; shorter keys have no prefix."""

    length: int

    @property
    def name(self) -> str:
        return f"fixed:{self.length}"

    def of(self, key: bytes) -> bytes | None:
        return key[: self.length] if len(key) >= self.length else None

    def column(self, key: Column) -> Column:
        return F.when(F.octet_length(key) >= self.length, F.substring(key, 1, self.length))

    def shared(self, keys: KeyRange) -> bytes | None:
        """The one prefix of all keys of a range, if they have one."""
        if Kind.UNBOUNDED in (keys.start.kind, keys.end.kind):
            return None
        p = self.of(keys.start.key)
        return p if p is not None and (within := KeyRange.prefix(p)).contains(keys.start.key) and (within.contains(keys.end.key) or (keys.end.kind == Kind.EXCLUDED and keys.end == within.end)) else None


@dataclass(frozen=True)
class DelimitedPrefix:
    """Everything up to and including the first delimiter."""

    delimiter: bytes

    @property
    def name(self) -> str:
        return f"delimited:{self.delimiter.hex()}"

    def of(self, key: bytes) -> bytes | None:
        at = key.find(self.delimiter)
        return None if at < 0 else key[: at + len(self.delimiter)]

    def column(self, key: Column) -> Column:
        # in hexadecimal, a delimiter must begin at an even place: pairs are set apart first
        spaced = F.concat(F.regexp_replace(F.hex(key), "(..)", "$1."))
        mark = ".".join(f"{b:02X}" for b in self.delimiter) + "."
        found = F.instr(spaced, mark)
        return F.when(found > 0, F.substring(key, F.lit(1), F.floor((found - 1) / 3).cast("int") + len(self.delimiter)))

    def shared(self, keys: KeyRange) -> bytes | None:
        p = None if keys.start.kind == Kind.UNBOUNDED else self.of(keys.start.key)
        if p is None or keys.end.kind == Kind.UNBOUNDED:
            return None
        within = KeyRange.prefix(p)
        return p if within.contains(keys.end.key) or (keys.end.kind == Kind.EXCLUDED and keys.end == within.end) else None
