"""Maturity and period feedback of orders as event-time state machines.

One state per instrument and source day; all its rows carry the day's close.  A row's event time is when it is known:
a quote or fill at its time, a matured order at its origin plus the longest horizon.  Timers fire when the watermark
passes them, each item comes out once, and the state is deleted when the day is over.  States are bounded by a day's
grid points and open items.  Rows of kind ``beat`` carry nothing but time: a source that has nothing to say sends them
so that the others' watermark can advance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quotegrid.params import MS

KEYS = ["instrument_id", "file_date"]
ITEM = ["strategy", "seq", "ts_ns", "side", "mid"]
MARKED = "instrument_id bigint, file_date string, strategy string, seq bigint, ts_ns bigint, status string, u array<double>"
BUCKET = ["strategy", "version_id", "period_index", "owner"]
COUNTS = ["orders", "pending", "matured", "missing_target", "crossed_gap_or_session", "reward_sum"]
FEEDBACK = ("instrument_id bigint, file_date string, strategy string, version_id string, period_index bigint, owner int, end_ns bigint, last_origin_ns bigint, "
            "orders bigint, pending bigint, matured bigint, missing_target bigint, crossed_gap_or_session bigint, reward_sum double, observed_at_ns bigint, status string, reward double")
NEVER = -1
ASKED = {"close_ns": "bigint", "strategy": "string", "seq": "bigint", "ts_ns": "bigint", "side": "bigint", "mid": "double"}
TOLD = {"close_ns": "bigint", "strategy": "string", "version_id": "string", "period_index": "bigint", "owner": "bigint", "end_ns": "bigint", "ts_ns": "bigint", "status": "string", "score": "double"}


def event_time(ns: Column) -> Column:
    return F.timestamp_micros((ns / 1000).cast("bigint"))


def timed(rows: DataFrame, kind: str, ns: Column, delay: str) -> DataFrame:
    """Rows of one kind with their event time and its watermark; ``beat`` rows keep their kind."""
    named = F.when(F.col("beat"), "beat").otherwise(kind) if "beat" in rows.columns else F.lit(kind)
    return rows.withColumn("kind", named).drop("beat").withColumn("at", event_time(ns)).withWatermark("at", delay)


def _filled(rows: DataFrame, shape: dict[str, str]) -> DataFrame:
    """Rows with all columns of ``shape``.  Whole numbers a kind doesn't have are ``NEVER``: a NULL would turn the column
    into floating point in the state function, and nanoseconds don't survive that."""
    def column(name: str, kind: str) -> Column:
        value = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        return (F.coalesce(value, F.lit(NEVER).cast(kind)) if kind == "bigint" else value).alias(name)

    return rows.select(*KEYS, "kind", "at", *[column(c, k) for c, k in shape.items()])


def _reached(state: GroupState) -> int:
    """Nanoseconds the watermark has passed."""
    return state.getCurrentWatermarkMs() * MS


def _wake(state: GroupState, at_ns: int) -> None:
    """Timer at the first watermark that has reached ``at_ns``."""
    state.setTimeoutTimestamp(max(-(-at_ns // MS), state.getCurrentWatermarkMs() + 1))


def judge(items: pd.DataFrame, times: np.ndarray, mids: np.ndarray, steps: np.ndarray, interval: int, last: int) -> tuple[list, list]:
    """Status and markout of each fill.  A target lies in the fill's block if no grid point between them lacks a quote."""
    statuses, vectors = [], []
    for at, side, mid in zip(items["ts_ns"].tolist(), items["side"].tolist(), items["mid"].tolist()):
        place = np.searchsorted(times, at + steps)
        found = (place < len(times)) & (times[np.minimum(place, len(times) - 1)] == at + steps) if len(times) else np.zeros(len(steps), bool)
        if last < at + steps.max():
            statuses.append("unmatured_at_end")
        elif not found.all():
            statuses.append("missing_target")
        elif ((place - np.searchsorted(times, at)) * interval != steps).any():
            statuses.append("crossed_gap_or_session")
        else:
            statuses.append("matured")
        vectors.append((side * (mids[place] - mid)).tolist() if statuses[-1] == "matured" else None)
    return statuses, vectors


def maturing_fills(fills: DataFrame, quotes: DataFrame, horizons_ms: tuple, interval_ns: int, delay: str) -> DataFrame:
    """Every fill once, with its maturity status and, where matured, its markout vector.

    ``fills``: instrument_id, file_date, close_ns, strategy, seq, ts_ns, side, mid; ``quotes``: instrument_id,
    file_date, close_ns, ts_ns, mid.  A fill is judged when the watermark has passed its longest horizon and a quote
    has; where none does, when the day is over, as ``unmatured_at_end``.  Quotes are kept as long as a fill that is
    open, or may still arrive, can ask for them."""
    steps = np.array([h * MS for h in horizons_ms], np.int64)
    longest = int(steps.max())

    def advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, mids, open_, close, last = np.zeros(0, np.int64), np.zeros(0), pd.DataFrame(columns=ITEM), NEVER, NEVER
        if state.exists:
            t, m, *columns, close, last = state.get
            times, mids, open_ = np.array(t, np.int64), np.array(m, float), pd.DataFrame(dict(zip(ITEM, columns)))
        rows = pd.concat(list(frames)) if not state.hasTimedOut else pd.DataFrame(columns=["kind", "close_ns", *ITEM])
        rows = rows[rows["kind"] != "beat"]
        if not len(rows) and not state.exists:
            return
        if len(rows):
            close = max(close, int(rows["close_ns"].max()))
            told = rows[rows["kind"] == "quote"]
            times, first = np.unique(np.concatenate([times, told["ts_ns"].to_numpy(np.int64)]), return_index=True)
            mids = np.concatenate([mids, told["mid"].to_numpy(float)])[first]
            last = max(last, int(times[-1])) if len(times) else last
            open_ = pd.concat([open_, rows.loc[rows["kind"] == "fill", ITEM]]) if len(open_) else rows.loc[rows["kind"] == "fill", ITEM]
        now = _reached(state)
        over = now >= close
        due = open_["ts_ns"].to_numpy(np.int64) + longest
        ready = np.full(len(open_), over) | ((due <= now) & (due <= last))
        if ready.any():
            done = open_[ready]
            statuses, vectors = judge(done, times, mids, steps, interval_ns, last)
            yield pd.DataFrame({"instrument_id": key[0], "file_date": key[1], **{c: done[c].to_numpy() for c in ("strategy", "seq", "ts_ns")}, "status": statuses, "u": vectors})
        if over:
            if state.exists:
                state.remove()
            return
        open_, due = open_[~ready], due[~ready]
        keep = times >= min(now, int(open_["ts_ns"].min()) if len(open_) else now)
        state.update((times[keep].tolist(), mids[keep].tolist(), *[open_[c].tolist() for c in ITEM], close, last))
        ahead = due[due > now]
        _wake(state, min(int(ahead.min()) if len(ahead) else close, close))

    told = _filled(timed(quotes, "quote", F.col("ts_ns"), delay), ASKED)
    asked = _filled(timed(fills, "fill", F.col("ts_ns"), delay), ASKED)
    layout = "times array<bigint>, mids array<double>, strategy array<string>, seq array<bigint>, ts_ns array<bigint>, side array<bigint>, mid array<double>, close bigint, last bigint"
    return told.unionByName(asked).groupBy(*KEYS).applyInPandasWithState(advance, MARKED, layout, "append", GroupStateTimeout.EventTimeTimeout)


def feedback_of(buckets: pd.DataFrame, times: np.ndarray, longest: int, over: bool, now: int) -> tuple[np.ndarray, pd.DataFrame]:
    """Which buckets can be told, and these with their time, status and reward."""
    origin = buckets["last_origin_ns"].to_numpy(np.int64)
    end = buckets["end_ns"].to_numpy(np.int64)
    due = np.where(origin == NEVER, end, np.maximum(end, origin + longest))
    place = np.searchsorted(times, due)
    seen = place < len(times)
    ready = np.full(len(buckets), over) | (seen & (end + longest <= now))  # no order of the period can come any more
    done = buckets[ready].copy()
    at = pd.Series([times[p] if p < len(times) else (times[-1] if len(times) else None) for p in place[ready]], index=done.index, dtype="Int64")
    early = (at < done["end_ns"]).fillna(False).to_numpy(bool)
    orders = done["orders"].to_numpy()
    done["observed_at_ns"] = at
    done["status"] = np.select([early, done["pending"].to_numpy() > 0, orders == 0, done["matured"].to_numpy() != orders],
                               ["incomplete_period", "pending_orders", "no_orders", "incomplete_orders"], "matured")
    done["reward"] = np.where(done["status"] == "matured", done["reward_sum"].to_numpy(float) / np.maximum(1, orders), np.nan)
    done["last_origin_ns"] = done["last_origin_ns"].astype("Int64").mask(done["last_origin_ns"] == NEVER)
    return ready, done


def period_feedback_stream(selections: DataFrame, orders: DataFrame, quotes: DataFrame, horizon_ns: int, delay: str) -> DataFrame:
    """One row per (session day, version, period, opening owner) that was selected or holds orders.

    ``selections``: keys, bucket, end_ns, close_ns, selected_at_ns; ``orders``: keys, bucket, end_ns, close_ns, ts_ns,
    status, score; ``quotes``: keys, close_ns, ts_ns.  ``end_ns`` is the period's end, clipped at the close.  A bucket is
    told at the first quote at or after max(end, last order + horizon), once the watermark says that no order of the
    period is still to come; what is left when the day is over is judged at its last quote.  The score counts only if
    every order matured."""

    names = [*BUCKET, "end_ns", "last_origin_ns", *COUNTS]

    def advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, held, close = np.zeros(0, np.int64), pd.DataFrame(columns=names), NEVER
        if state.exists:
            t, *columns, close = state.get
            times, held = np.array(t, np.int64), pd.DataFrame(dict(zip(names, columns)))
        rows = pd.concat(list(frames)) if not state.hasTimedOut else None
        rows = rows[rows["kind"] != "beat"] if rows is not None else []
        if not len(rows) and not state.exists:
            return
        if len(rows):
            close = max(close, int(rows["close_ns"].max()))
            times = np.unique(np.concatenate([times, rows.loc[rows["kind"] == "quote", "ts_ns"].to_numpy(np.int64)]))
            fresh = rows[rows["kind"] != "quote"]
            order = (fresh["kind"] == "order").to_numpy()
            is_ = lambda s: (order & (fresh["status"] == s).to_numpy()).astype(np.int64)
            fresh = fresh[BUCKET + ["end_ns"]].assign(
                last_origin_ns=np.where(order, fresh["ts_ns"].to_numpy(np.int64), NEVER), orders=order.astype(np.int64), pending=is_("unmatured_at_end"),
                matured=is_("matured"), missing_target=is_("missing_target"), crossed_gap_or_session=is_("crossed_gap_or_session"),
                reward_sum=np.where(order, fresh["score"].fillna(0.0).to_numpy(float), 0.0))
            both = pd.concat([held, fresh]) if len(held) else fresh
            held = both.groupby(BUCKET, as_index=False, dropna=False).agg({"end_ns": "max", "last_origin_ns": "max", **dict.fromkeys(COUNTS, "sum")})
        now = _reached(state)
        over = now >= close + horizon_ns
        ready, done = feedback_of(held, times, horizon_ns, over, now)
        if len(done):
            yield done.assign(instrument_id=key[0], file_date=key[1])[[part.strip().split(" ")[0] for part in FEEDBACK.split(",")]]
        if over:
            if state.exists:
                state.remove()
            return
        held = held[~ready]
        state.update((times.tolist(), *[held[c].tolist() for c in names], close))
        ahead = held["end_ns"].to_numpy(np.int64) + horizon_ns
        ahead = ahead[ahead > now]
        _wake(state, min(int(ahead.min()) if len(ahead) else close + horizon_ns, close + horizon_ns))

    told = _filled(timed(quotes, "quote", F.col("ts_ns"), delay), TOLD)
    chosen = _filled(timed(selections, "selection", F.col("selected_at_ns"), delay), TOLD)
    known = _filled(timed(orders, "order", F.col("ts_ns") + F.lit(horizon_ns), delay), TOLD)
    layout = ("times array<bigint>, strategy array<string>, version_id array<string>, period_index array<bigint>, owner array<bigint>, end_ns array<bigint>, last_origin_ns array<bigint>, "
              "orders array<bigint>, pending array<bigint>, matured array<bigint>, missing_target array<bigint>, crossed_gap_or_session array<bigint>, reward_sum array<double>, close bigint")
    return told.unionByName(chosen).unionByName(known).groupBy(*KEYS).applyInPandasWithState(advance, FEEDBACK, layout, "append", GroupStateTimeout.EventTimeTimeout)
