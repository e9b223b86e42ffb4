"""Level of detail: how many points a viewport needs and which strategy gets them. Plain functions on the driver."""

from __future__ import annotations

from datetime import datetime, timezone

#: Least and greatest point cap, points for each pixel by mode, least and greatest bucket in seconds.
LEAST_CAP, MOST_CAP = 500, 5_000_000
POINTS_PER_PIXEL = {"overview": 2, "detail": 4}
LEAST_BUCKET_S, MOST_BUCKET_S = 0.001, 86_400.0
UNREDUCED = ("none", "raw")


def _unreduced(mode: str, aggregation: str | None) -> bool:
    return mode == "raw" or (aggregation or "auto").strip().lower() in UNREDUCED


def strategy(mode: str, aggregation: str | None, cap: int | None) -> str:
    """aggregate, raw_lttb or raw."""
    if _unreduced(mode, aggregation) or not cap or cap <= 0:
        return "raw"
    return "aggregate" if mode == "overview" else "raw_lttb"


def points_cap(resolution_px: int | None, aggregation: str | None = None, max_points: int | None = None, mode: str = "overview") -> int | None:
    """Points for each series; a given max_points wins, unreduced requests have no cap."""
    if max_points and max_points > 0:
        return max_points
    if _unreduced(mode, aggregation) or not resolution_px or resolution_px <= 0:
        return None
    return max(LEAST_CAP, min(resolution_px * POINTS_PER_PIXEL.get(mode, POINTS_PER_PIXEL["overview"]), MOST_CAP))


def bucket_seconds(span_s: float, cap: int) -> float:
    """Width of a bucket so that a span has about cap of them."""
    if span_s <= 0 or cap <= 0:
        return LEAST_BUCKET_S
    return min(max(span_s / cap, LEAST_BUCKET_S), MOST_BUCKET_S)


def epoch_ms(text: str | None) -> float | None:
    """ISO-8601 to epoch milliseconds; without a zone it is UTC."""
    if not text:
        return None
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000


def window_ms(bounds: list[str | None] | None) -> tuple[float | None, float | None]:
    first, last = [*(bounds or []), None, None][:2]
    return epoch_ms(first), epoch_ms(last)


def dependency_order(specs: list) -> list:
    """Calculated channels so that those that others need come first; members of a cycle keep their order at the end."""
    names = {s.name for s in specs}
    needs = {id(s): {reference(c) for c in s.channels} & names - {s.name} for s in specs}
    done: set[str] = set()
    ordered, waiting = [], list(specs)
    while waiting:
        ready = []
        for s in waiting:  # a channel that becomes ready serves those behind it at once
            if needs[id(s)] <= done:
                ready.append(s)
                done.add(s.name)
        if not ready:
            return ordered + waiting
        ordered += ready
        waiting = [s for s in waiting if all(s is not r for r in ready)]
    return ordered


def reference(channel: str) -> str:
    """The channel of a qualified name: what stands behind the last bar."""
    return channel.rsplit("|", 1)[-1]
