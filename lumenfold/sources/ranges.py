"""Planned ranges of files, dealt to tasks."""

from __future__ import annotations

MOST, FULL = 256, 64 << 20


def gathered(ranges: list, sizes: list[int], most: int | None = None, full: int = FULL) -> list[list]:
    """The ranges in their order, one for each task, or neighbours together where there are more than `most` of them and tasks would have less than `full` bytes.

    So small ranges, and many small files, cost a task each only while they are few; a task reads its ranges one after another.
    """
    parts = max(MOST if most is None else most, -(-sum(sizes) // full))
    if len(ranges) <= parts:
        return [[r] for r in ranges]
    out, at, last, total = [], 0, -1, max(1, sum(sizes))
    for r, n in zip(ranges, sizes, strict=True):
        part = min(parts - 1, at * parts // total)
        if part != last:
            out.append([])
        out[-1].append(r)
        at, last = at + n, part
    return out
