"""Folds over a stream: each key's state in the engine's store, as typed values, with event-time timers.

A key has a value for each group of fields that changes on its own, a map of history entries, a list of rows that wait for the
watermark, and one timer. A row is appended to the list without reading it; a value is written only where it changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from .folds import EVENT_COLUMNS, Kind, rest, row_columns, rows_of, walk

#: The store that keeps state on the executor's disk and its changes in the checkpoint folder; states like these need it.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HISTORY_KEY, HISTORY_VALUE = "number long", "value string, at long, left_at long"


class FoldProcessor(StatefulProcessor):
    """One key's rows in order of time, as they pass the watermark, with the timers between them."""

    def __init__(self, kind: Kind, keys: list[str], columns: list[str], row_schema: str, line_type: str, forget_ms: int | None):
        self.kind, self.keys, self.columns, self.forget_ms = kind, keys, columns, forget_ms
        # parsed here, as workers have no session
        groups = {name: fields.format(line_type) for name, fields in kind.groups.items()} | {"clock": "seen long, timer long"}
        self.groups = {name: StructType.fromDDL(fields) for name, fields in groups.items()}
        self.row, self.entry = StructType.fromDDL(row_schema), (StructType.fromDDL(HISTORY_KEY), StructType.fromDDL(HISTORY_VALUE))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fields = {name: schema.names for name, schema in self.groups.items()}
        self.values = {name: handle.getValueState(name, schema) for name, schema in self.groups.items()}
        self.waiting = handle.getListState("waiting", self.row)
        self.history = handle.getMapState("history", *self.entry) if self.kind.history else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for frame in rows:
            new = [tuple(r[c] for c in self.columns) for r in rows_of(frame, self.columns)]
            if new:
                self.waiting.appendList(new)
                first = min(r[0] for r in new)
                least = first if least is None else min(least, first)
        if least is not None:
            clock = self.values["clock"].get()
            seen, timer = (clock[0], clock[1]) if clock else (None, None)
            self._set_timer(seen, timer, least if timer is None else min(least, timer))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        state, was = self._read()
        rows = sorted((dict(zip(self.columns, r, strict=True)) for r in self.waiting.get()), key=lambda r: (r["at"], r["event_id"]))
        ready = [r for r in rows if r["at"] < now]
        out = [e for r in ready for e in walk(self.kind, state, r, self.forget_ms)]
        out += rest(self.kind, state, now, self.forget_ms)
        later = rows[len(ready) :]
        if ready:
            self.waiting.put([tuple(r[c] for c in self.columns) for r in later]) if later else self.waiting.clear()
        due = [later[0]["at"]] if later else []
        following = self.kind.due(state)
        due += [] if following is None else [following]
        due += [state["seen"] + self.forget_ms] if self.forget_ms is not None and state.get("seen") is not None else []
        # the timer that has rung is taken out by the engine
        state["timer"] = None
        self._write(state, was)
        if due:
            self._set_timer(state.get("seen"), None, max(min(due), now))
        yield pd.DataFrame([(*key, *e) for e in out], columns=[*self.keys, "at_ms", "kind", "detail"])

    def close(self) -> None:
        pass

    def _set_timer(self, seen: int | None, old: int | None, new: int) -> None:
        if old == new:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(new)
        self.values["clock"].update((seen, new))

    def _read(self) -> tuple[dict, dict]:
        """(state of the key, what was read of each group)."""
        state, was = {}, {}
        for name, value in self.values.items():
            got = value.get()
            was[name] = tuple(got) if got is not None else None
            if got is not None:
                state |= {f: list(x) if isinstance(x, (list, tuple)) else x for f, x in zip(self.fields[name], got, strict=True)}
        if self.history is not None:
            entries = sorted((k[0], list(v)) for k, v in self.history.iterator())
            state["history"], was["history"] = [v for _, v in entries], {k: tuple(v) for k, v in entries}
        return state, was

    def _write(self, state: dict, was: dict) -> None:
        for name, names in self.fields.items():
            now = tuple(state.get(f) for f in names)
            if all(x is None for x in now):
                if was[name] is not None:
                    self.values[name].clear()
            elif was[name] is None or [list(x) if isinstance(x, (list, tuple)) else x for x in was[name]] != list(now):
                self.values[name].update(now)
        if self.history is not None:
            entries = state.get("history") or []
            first = (state.get("accepted") or 0) - len(entries) + 1
            now = {first + k: tuple(v) for k, v in enumerate(entries)}
            for number in was["history"].keys() - now.keys():
                self.history.removeKey((number,))
            for number, v in now.items():
                if was["history"].get(number) != v:
                    self.history.updateValue((number,), v)


def fold_stream(log: DataFrame, keys: list[str], kind: Kind, event_time: str = "ts", late: str = "1 hour", forget_ms: int | None = None) -> DataFrame:
    """The events of `fold` over a stream of the same columns and a timestamp column `event_time` of the same time as `at`.

    A key's rows wait until the watermark, `late` behind the latest row of all, has passed them, and are folded in order then: in
    whatever order rows come, late ones within that bound count as if they had come in time. Events are those of fold(log, ..., until=the
    watermark). Timers ring when the watermark passes their time, whether or not another row of the key comes. With
    forget_ms, the state of a key that is not seen for so long is deleted. A key holds the rows it gets within `late`, its last version as
    hashes of lines, ten entries of history and 200 learned lines."""
    spark = log.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    types = {f.name: f.dataType.simpleString() for f in log.schema.fields}
    columns = row_columns(log.columns)
    line_type = types["lines"].removeprefix("array<").removesuffix(">") if "lines" in types else types["hash"]
    row_schema = ", ".join(f"{c} {types[c]}" for c in columns)
    made = log.withWatermark(event_time, late).groupBy(*keys)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + EVENT_COLUMNS
    return made.transformWithStateInPandas(FoldProcessor(kind, keys, columns, row_schema, line_type, forget_ms), schema, "append", "EventTime")
