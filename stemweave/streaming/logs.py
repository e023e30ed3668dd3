"""Structured Streaming forms: windowed event counts and the keyed log fold.  The reference domain is batch; these
run the same folds over a growing log."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def windowed_counts(events: DataFrame, ts: str, keys: list[str], size: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts per key and time window; with ``late`` a watermark bounds the state.  Works on streams and tables."""
    if late:
        events = events.withWatermark(ts, late)
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def session_counts(events: DataFrame, ts: str, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    """Counts per key and session; a pause of ``gap`` ends a session."""
    if late:
        events = events.withWatermark(ts, late)
    out = events.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def latest_state(events: DataFrame, key: str, order: list[Column], fields: list[str]) -> DataFrame:
    """The latest fields per key, as an aggregation that streams can update."""
    return events.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("s")).select(key, "s.*")


def _patched(lists: dict, name: str, values: list) -> None:
    for suffix in ("_add", "_remove", "_set"):
        if name.endswith(suffix):
            field = name[: -len(suffix)]
            have = lists.get(field, [])
            if suffix == "_add":
                lists[field] = have + [v for v in dict.fromkeys(values) if v not in set(have)]
            else:
                lists[field] = [v for v in have if v not in set(values)] if suffix == "_remove" else values
            return
    lists[name] = values


def fold_stream(log: DataFrame, key: str, order: str, op: str, fields: str, lists: str) -> DataFrame:
    """A growing log folded by key as ``operators.log.fold_entities`` folds a finished one: each batch gives ``(key, live, state, lists, errors)`` of the
    keys it touched, for an update sink.  The state of a key is its maps, the number of errors and the greatest order seen.

    Within a batch events are put in order; an event whose order isn't behind all of the batches before comes too late, changes nothing and counts as an error.
    """

    def run(k, frames, state):
        live, scalars, arrays, errors, seen = json.loads(state.get[0]) if state.exists else (False, {}, {}, 0, None)
        rows = sorted((r for f in frames for r in zip(f[order].tolist(), f[op], f[fields], f[lists])), key=lambda r: r[0])
        for at, what, scalar, array in rows:
            what = what or "set"
            scalar = dict(scalar or {})
            array = {n: [x for x in v if x is not None] for n, v in dict(array or {}).items() if v is not None}
            if (seen is not None and at <= seen) or (what == "add" and live) or (what == "patch" and not live):
                errors += 1
                continue
            seen = at
            if what == "patch":
                scalars |= scalar
                for n, v in array.items():
                    _patched(arrays, n, v)
            elif what == "remove":
                live, scalars, arrays = False, {}, {}
            else:
                live, scalars, arrays = True, scalar, array
        state.update((json.dumps([live, scalars, arrays, errors, seen]),))
        yield pd.DataFrame({key: [k[0]], "live": [live], "state": [dict(sorted(scalars.items()))], "lists": [dict(sorted(arrays.items()))], "errors": [errors]})

    kind = log.schema[key].dataType.simpleString()
    rows = log.select(key, order, op, fields, lists)
    schema = f"`{key}` {kind}, live boolean, state map<string,string>, lists map<string,array<string>>, errors int"
    return rows.groupBy(key).applyInPandasWithState(run, schema, "state string", "update", GroupStateTimeout.NoTimeout)
