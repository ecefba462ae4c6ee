"""Regions that a reader is asked for, by option and by pushed filters."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa

BATCH = 8192
EVERYWHERE = 1 << 40


class Wanted:
    """Which stretches of each reference are asked for; None: of all of them, everything."""

    def __init__(self, regions: str | None = None):
        self.by: dict[str, list[tuple[int, int]]] | None = None
        for one in (regions or "").split(","):
            if one:
                chrom, _, place = one.strip().rpartition(":") if ":" in one else (one.strip(), "", "")
                lo, hi = (int(x.replace("_", "")) for x in place.split("-")) if place else (0, EVERYWHERE)
                self.by = self.by or {}
                self.by.setdefault(chrom, []).append((lo, hi))
        self.lo, self.hi = 0, EVERYWHERE

    def only(self, chroms) -> None:
        known = {c: [(0, EVERYWHERE)] for c in chroms}
        self.by = known if self.by is None else {c: self.by[c] for c in known if c in self.by}

    def within(self, refs: list[tuple[str, int]]) -> dict[int, list[tuple[int, int]]] | None:
        """reference -> disjoint stretches in order, half-open."""
        if self.by is None and (self.lo, self.hi) == (0, EVERYWHERE):
            return None
        out = {}
        for i, (name, _) in enumerate(refs):
            cut = sorted((max(a, self.lo), min(b, self.hi)) for a, b in ([(0, EVERYWHERE)] if self.by is None else self.by.get(name, ())))
            merged: list[tuple[int, int]] = []
            for a, b in cut:
                if a < b and merged and a <= merged[-1][1]:
                    merged[-1] = merged[-1][0], max(b, merged[-1][1])
                elif a < b:
                    merged.append((a, b))
            if merged:
                out[i] = merged
        return out

    def push(self, f) -> None:
        """Takes in a filter on chrom, start or end; Spark goes on checking it."""
        kind, on = type(f).__name__, f.attribute if hasattr(f, "attribute") else None
        if on == ("chrom",) and kind in ("EqualTo", "EqualNullSafe") and f.value is not None:
            self.only({f.value})
        elif on == ("chrom",) and kind == "In":
            self.only({v for v in f.value if v is not None})
        elif on in (("start",), ("end",)) and kind in ("GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "EqualTo") and f.value is not None:
            v = int(f.value)
            if kind in ("GreaterThan", "GreaterThanOrEqual", "EqualTo"):  # a record ends at or behind its start
                self.lo = max(self.lo, v - 1 if kind != "GreaterThan" else v)
            if kind in ("LessThan", "LessThanOrEqual", "EqualTo"):
                self.hi = min(self.hi, v + (kind != "LessThan") + (on == ("end",)))


def hits(stretches: list[tuple[int, int]], start: int, end: int) -> bool:
    """Does [start, end), or the point start, touch one of the disjoint stretches in order?"""
    i = bisect_left(stretches, (start + 1,)) - 1
    return any(0 <= j < len(stretches) and start < stretches[j][1] and max(end, start + 1) > stretches[j][0] for j in (i, i + 1))


def batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
