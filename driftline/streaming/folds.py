"""Change rules as one fold per key: the same step and timers over a table and over a stream.

A step takes the key's state (a dict) and one observation, changes the state and returns events (at_ms, kind, detail). A ring
does the same for what falls due between observations, at the moment it falls due. State holds hashes of lines and a few bounded histories,
never bodies. `fold` walks through a table; `streaming.state` keeps the same state in the engine's store.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MINUTE, HOUR = 60_000, 3_600_000
Event = tuple[int, str, str]

#: Milliseconds a number-only change has to stand; numeric changes in six hours that teach their lines; loads so close that numbers that
#: differ between them tick; learned lines of a page; changes in an hour that mute; days of trust; entries of a history.
HOLD_MS, TICKS, LOADS_MS, LEARNED, CHURN, UNSTABLE, TRUST_MS, HISTORY = 120_000, 3, MINUTE, 200, 4, 3, 24 * HOUR, 10


@dataclass(frozen=True)
class Kind:
    """A fold: its step; its timers, (state, now) -> events due up to now; when the next one is due; and the state as groups of fields, each
    kept and rewritten on its own (name of the group -> columns)."""

    step: Callable[[dict, dict], list[Event]]
    groups: dict[str, str]
    ring: Callable[[dict, int], list[Event]] = lambda s, now: []
    due: Callable[[dict], int | None] = lambda s: None
    history: bool = field(default=False)


def _usable(row: dict) -> bool:
    return not (row["status"] <= 0 or row["status"] >= 500 or row["status"] == 429 or row["blocked"])


def _flip_flop(history: list, value: str, at: int) -> bool:
    """Left at most 15 minutes ago, or current twice before: history is [value, at, left_at]."""
    own = [x for x in history if x[0] == value]
    return len(own) >= 2 or any(x[2] is not None and at - x[2] <= 15 * MINUTE for x in own)


def _push(s: dict, value: str, at: int) -> None:
    """One more entry of the history; `accepted` numbers them."""
    history = s["history"] = s.get("history") or []
    if history:
        history[-1][2] = at
    history.append([value, at, None])
    del history[:-HISTORY]
    s["accepted"] = (s.get("accepted") or 0) + 1


def _lines(row: dict) -> tuple[list, list]:
    """(lines, masked lines) of an observation as hashes; one without them is a page of one line."""
    if row.get("lines") is not None:
        return list(row["lines"]), list(row["masks"])
    return [row["hash"]], [row["mask"]]


def compared(lines: list, masks: list, learned: list) -> str:
    """What versions are compared by: the masked form of learned lines, all others as they are."""
    known = set(learned or ())
    parts = [m if m in known else x for x, m in zip(lines, masks, strict=True)] if known else lines
    if len(parts) == 1 and isinstance(parts[0], str):
        return parts[0]
    return hashlib.blake2b(b"".join(struct.pack("<q", x) if isinstance(x, int) else str(x).encode() + b"\n" for x in parts), digest_size=8).hexdigest()


def ticking(old: tuple[list, list], new: tuple[list, list]) -> list:
    """Masked forms of the lines that differ only in numbers, where both versions have the same masked lines; else none."""
    return list(dict.fromkeys(m for x, y, m in zip(old[0], new[0], old[1], strict=True) if x != y)) if old[1] == new[1] else []


def learn(learned: list | None, lines: list, most: int = LEARNED) -> list:
    """The learned lines with these as the newest; the oldest go beyond `most`."""
    return [*(x for x in learned or [] if x not in set(lines)), *lines][-most:]


def _accept(s: dict, value: str, page: tuple[list, list], at: int) -> None:
    _push(s, value, at)
    s.update(hash=value, lines=page[0], masks=page[1], changed=at, pending=None, pending_at=None, new_lines=None, new_masks=None, held=None, unstable=0)


def _teach(s: dict, lines: list, page: tuple[list, list], at: int) -> list[Event]:
    """These masked lines are compared without numbers from now on. Hashes change their meaning, so the history starts anew."""
    had = set(s.get("learned") or ())
    s["learned"] = learn(s.get("learned"), lines)
    s.update(ticks=[], history=[])
    _accept(s, compared(*page, s["learned"]), page, at)
    return [(at, "learned", str(m)) for m in lines if m not in had]


def page_step(s: dict, row: dict) -> list[Event]:
    """Text changes of a page. row: at, status, blocked, and lines and masks (hashes of the lines, and of the lines with numbers masked), or
    hash and mask of a page of one line."""
    at = row["at"]
    if row["status"] in (404, 410):
        gap = at - s["checked"] if s.get("checked") is not None else MINUTE
        s["checked"] = at
        if s.get("hash") and not s.get("gone") and gap >= MINUTE:
            s["missing"] = (s.get("missing") or 0) + 1
            if s["missing"] == 2:
                s["gone"] = True
                return [(at, "removed", "")]
        return []
    s["checked"] = at
    if not _usable(row) or (row["hash"] is None and row.get("lines") is None):
        return []
    s["missing"] = 0
    page = _lines(row)
    value = compared(*page, s.get("learned"))
    if s.get("gone"):
        s["gone"] = False
        _accept(s, value, page, at)
        return [(at, "back", value)]
    if s.get("hash") is None:
        _accept(s, value, page, at)
        return []
    if value == s["hash"]:
        out = [(at, "transient", s["pending"])] if s.get("pending") else []
        s.update(pending=None, pending_at=None, new_lines=None, new_masks=None, held=None, unstable=0)
        return out
    if s.get("muted"):
        _accept(s, value, page, at)
        return []
    if s.get("pending") != value:
        before = (s["new_lines"], s["new_masks"]) if s.get("pending") else None
        if before and at - s["pending_at"] <= LOADS_MS and (lines := ticking(before, page)):
            # two loads one after the other differ in numbers only: these lines tick, in the version that is kept as well
            return _teach(s, lines, (s["lines"], s["masks"]), at)
        unstable = (s.get("unstable") or 0) + 1 if before else 0
        s.update(pending=value, pending_at=at, new_lines=page[0], new_masks=page[1], held=None, unstable=unstable)
        if unstable >= UNSTABLE:
            _accept(s, value, page, at)
            s["muted"] = True
            return [(at, "dynamic", value)]
        return []
    if lines := ticking((s["lines"], s["masks"]), page):  # only numbers differ
        if s.get("held") is None:
            s["held"] = at
            s["ticks"] = [t for t in s.get("ticks") or [] if at - t < 6 * HOUR] + [at]
        if len(s["ticks"]) >= TICKS:
            return _teach(s, lines, page, at)
        if at - s["held"] < HOLD_MS:
            return []
        _accept(s, value, page, at)
        return [(at, "number", value)]
    silent = _flip_flop(s.get("history") or [], value, at)
    _accept(s, value, page, at)
    s["changes"] = [t for t in s.get("changes") or [] if at - t < HOUR] + [at]
    if len(s["changes"]) >= CHURN:
        s.update(muted=True, changes=[])
        return [(at, "muted", value)]
    return [] if silent else [(at, "text", value)]


def page_due(s: dict) -> int | None:
    """A muted page is trusted again once it has kept its text for long enough, whether or not it is looked at then."""
    return s["changed"] + TRUST_MS if s.get("muted") and not s.get("pending") else None


def page_ring(s: dict, now: int) -> list[Event]:
    due = page_due(s)
    if due is None or due > now:
        return []
    s.update(muted=False, changes=[], ticks=[])
    return [(due, "trusted", s["hash"])]


def outage_step(s: dict, row: dict) -> list[Event]:
    """DOWN at the third failure in a row that is 20 s after the first, UP at the next good row; refusals are passed over."""
    at = row["at"]
    if row["blocked"] or row["status"] == 429:
        return []
    if row["status"] <= 0 or row["status"] >= 500:
        s["n"] = (s.get("n") or 0) + 1
        if s.get("since") is None:
            s["since"] = at
        if not s.get("down") and s["n"] >= 3 and at - s["since"] >= 20_000:
            s["down"] = True
            return [(at, "down", str(s["since"]))]
        return []
    out = [(at, "up", str(at - s["since"]))] if s.get("down") else []
    s.update(n=0, since=None, down=False)
    return out


def deploy_step(s: dict, row: dict) -> list[Event]:
    """Confirmed changes of an asset signature (row's hash), silent where it flips back."""
    if not _usable(row) or not row["hash"]:
        return []
    at, value = row["at"], row["hash"]
    if s.get("hash") is None:
        _push(s, value, at)
        s.update(hash=value, pending=None)
    elif value == s["hash"]:
        s["pending"] = None
    elif s.get("pending") != value:
        s["pending"] = value
    else:
        silent, old = _flip_flop(s.get("history") or [], value, at), s["hash"]
        _push(s, value, at)
        s.update(hash=value, pending=None)
        if not silent:
            return [(at, "deploy", f"{old} > {value}")]
    return []


PAGES = Kind(
    page_step,
    {
        "page": "hash string, changed long, checked long, gone boolean, missing int, unstable int, muted boolean, held long, pending string, pending_at long, accepted long, ticks array<long>, changes array<long>",
        "version": "lines array<{0}>, masks array<{0}>",
        "candidate": "new_lines array<{0}>, new_masks array<{0}>",
        "learned": "learned array<{0}>",
    },
    page_ring,
    page_due,
    history=True,
)
OUTAGES = Kind(outage_step, {"run": "n int, since long, down boolean"})
DEPLOYS = Kind(deploy_step, {"deploy": "hash string, pending string, accepted long"}, history=True)

EVENT_COLUMNS = "at_ms long, kind string, detail string"
ROW = ("at", "event_id", "status", "blocked", "hash", "mask")


def row_columns(columns: list[str]) -> list[str]:
    """The columns of an observation that a log has."""
    return [*ROW, *(c for c in ("lines", "masks") if c in columns)]


def rows_of(frame: pd.DataFrame, columns: list[str]) -> Iterator[dict]:
    """The observations of a frame, column by column, with missing values as None."""
    values = []
    for c in columns:
        own = frame[c]
        values.append([None if x is None else x.tolist() for x in own] if c in ("lines", "masks") else own.astype(object).where(own.notna(), None).tolist())
    for row in zip(*values, strict=True):
        out = dict(zip(columns, row, strict=True))
        out["status"], out["blocked"], out["at"] = int(out["status"]), bool(out["blocked"]), int(out["at"])
        yield out


def walk(kind: Kind, s: dict, row: dict, forget_ms: int | None = None) -> list[Event]:
    """The events of one more observation, and of what fell due before it. A state that was not touched for forget_ms is empty again."""
    if forget_ms is not None and s.get("seen") is not None and row["at"] - s["seen"] >= forget_ms:
        out = kind.ring(s, s["seen"] + forget_ms)
        s.clear()
    else:
        out = kind.ring(s, row["at"] - 1)
    s["seen"] = row["at"]
    return out + kind.step(s, row)


def rest(kind: Kind, s: dict, until: int, forget_ms: int | None = None) -> list[Event]:
    """What falls due before `until` without another observation."""
    gone = forget_ms is not None and s.get("seen") is not None and s["seen"] + forget_ms < until
    out = kind.ring(s, s["seen"] + forget_ms if gone else until - 1)
    if gone:
        s.clear()
    return out


def fold(log: DataFrame, keys: list[str], kind: Kind, until: int | None = None, forget_ms: int | None = None) -> DataFrame:
    """(keys, at_ms, kind, detail): events of a table log(keys, at, event_id, status, blocked, hash, mask, and lines and masks if need be).

    Rows are dealt and sorted by key, and each task goes through them with one key's state in hand, however long a key's history is.
    Rows before `until` count, and timers that fall due before it ring; by default that is the moment after the log's last row."""
    kinds = {f.name: f.dataType.simpleString() for f in log.schema.fields}
    columns = row_columns(log.columns)
    if until is None:
        last = log.agg(F.max("at")).first()[0]
        until = 0 if last is None else last + 1

    def run(frames):
        key, state = None, {}
        for frame in frames:
            out = []
            for own, r in zip(zip(*(frame[k].tolist() for k in keys), strict=True), rows_of(frame, columns), strict=True):
                if own != key:
                    if key is not None:
                        out += [(*key, *e) for e in rest(kind, state, until, forget_ms)]
                    key, state = own, {}
                out += [(*own, *e) for e in walk(kind, state, r, forget_ms)]
            yield pd.DataFrame(out, columns=[*keys, "at_ms", "kind", "detail"])
        if key is not None:
            yield pd.DataFrame([(*key, *e) for e in rest(kind, state, until, forget_ms)], columns=[*keys, "at_ms", "kind", "detail"])

    ordered = log.where(F.col("at") < until).repartition(*keys).sortWithinPartitions(*keys, "at", "event_id")
    return ordered.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + EVENT_COLUMNS)
