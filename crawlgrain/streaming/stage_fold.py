"""Folding stage events into mergeable facts in plain Python, for the state of a stream.

The same reading as ``operators.status.stage_facts``: minima and maxima over event order, so folds merge in any order. Entries
are ordered by event id, then by their other fields with null first, as Spark orders structs.
"""

from __future__ import annotations

from collections.abc import Iterable

FIELDS = (
    ("start_id", "long"), ("start_ts", "double"), ("start_details", "string"), ("last_start", "long"), ("n_starts", "long"),
    ("end_id", "long"), ("end_ts", "double"), ("end_status", "string"), ("note_id", "long"), ("note_details", "string"),
    ("fail_id", "long"), ("fail_details", "string"), ("last_complete", "long"))
FACTS = ", ".join(f"{n} {t}" for n, t in FIELDS)
FOLDED = f"request_id long, stage_key string, newest double, events long, {FACTS}"
# Seconds folded into one row: rows keep apart what a watermark may tell apart.
FOLD_SECONDS = 60
# Where the parts of a fact stand, and whether the least or the greatest stays.
_PARTS = ((slice(0, 3), min), (slice(3, 4), max), (slice(5, 8), max), (slice(8, 10), max), (slice(10, 12), max), (slice(12, 13), max))
_N_STARTS = 4


def _order(entry: tuple) -> tuple:
    return tuple((v is not None, v if v is not None else 0) for v in entry)


def merge(a: tuple | None, b: tuple) -> tuple:
    """Facts of two sets of events -> facts of both."""
    if a is None:
        return b
    out = list(a)
    for part, best in _PARTS:
        one, two = tuple(a[part]), b[part]
        chosen = two if one[0] is None else one if two[0] is None else best(one, two, key=_order)
        out[part] = chosen
    out[_N_STARTS] = (a[_N_STARTS] or 0) + (b[_N_STARTS] or 0)
    return tuple(out)


def facts_of(event_id: int, action: str | None, ts: float | None, details: str | None) -> tuple:
    """Facts of a single event."""
    none = (None,) * 3
    if action == "start":
        return (event_id, ts, details, event_id, 1, *none, None, None, None, None, None)
    if action == "complete":
        note = (event_id, details) if details else (None, None)
        return (*none, None, 0, event_id, ts, "completed", *note, None, None, event_id)
    if action == "fail":
        return (*none, None, 0, event_id, ts, "failed", event_id, details, event_id, details, None)
    return (*none, None, 0, *none, None, None, None, None, None)


def stage_key(stage: str | None) -> str:
    """A map key is never null: named stages begin with a sign."""
    return "" if stage is None else f"={stage}"


def fold_events(events: Iterable[tuple]) -> list[dict]:
    """Rows (event_id, request_id, stage, action, ts_s, details) -> one row per request, stage and minute."""
    held: dict[tuple, tuple] = {}
    for event_id, request_id, stage, action, ts, details in events:
        key = request_id, stage_key(stage), None if ts is None or ts != ts else ts // FOLD_SECONDS
        newest, n, facts = held.get(key, (None, 0, None))
        newest = ts if newest is None else newest if ts is None else max(newest, ts)
        held[key] = newest, n + 1, merge(facts, facts_of(event_id, action, ts, details))
    return [{"request_id": r, "stage_key": s, "newest": newest, "events": n, **{f: v for (f, _), v in zip(FIELDS, facts, strict=True)}}
            for (r, s, _), (newest, n, facts) in held.items()]


def due(stages: dict[str, tuple], final_stages: tuple[str, ...], lifetime: float, finished_lifetime: float) -> float | None:
    """When a request's status runs out: after its first start, or sooner after the end of its last stage if it is finished."""
    facts = [(key, dict(zip((n for n, _ in FIELDS), values, strict=True))) for key, values in stages.items()]
    started = [f for _, f in facts if f["start_id"] is not None]
    if not started:
        return None
    after = lambda f, name: f["start_id"] is not None and f[name] is not None and f[name] > f["start_id"]
    finished = any(after(f, "fail_id") or (key[1:] in final_stages and after(f, "last_complete")) for key, f in facts)
    newest = max(started, key=lambda f: f["last_start"])
    first = min(started, key=lambda f: _order((f["start_id"], f["start_ts"], f["start_details"])))
    ended = newest["end_ts"] if newest["last_start"] == newest["start_id"] and after(newest, "end_id") else None
    ends = [] if first["start_ts"] is None else [first["start_ts"] + lifetime]
    if finished and ended is not None:
        ends.append(ended + finished_lifetime)
    return min(ends) if ends else None
