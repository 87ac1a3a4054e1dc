"""Large text files in parts, cut at line ends."""

from __future__ import annotations


def parts(data: bytes | None, count: int) -> list[bytes]:
    """At most ``count`` non-empty parts that join to ``data``: cut after the newline nearest to each even
    division, no further off than half a part and the later one of two as near; at the division itself
    where no newline is that near.  Null and empty data have no parts."""
    if not data:
        return []
    cuts, step = [0], len(data) / max(count, 1)
    for k in range(1, max(count, 1)):
        ideal, low = int(k * step), cuts[-1] + 1
        reach = int(step / 2)
        after = data.find(b"\n", max(ideal, low), min(ideal + reach, len(data)))
        before = data.rfind(b"\n", max(low, ideal - reach + 1), ideal + 1)
        near = [(abs(p - ideal), -p) for p in (after, before) if p >= 0]
        cut = -min(near)[1] + 1 if near else min(max(ideal, low), len(data) - 1)
        if cut > cuts[-1]:
            cuts.append(cut)
    return [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)]) if a < b]
