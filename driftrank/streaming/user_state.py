"""ST4 stateful user-profile stream: F4 -> ST1 -> F5 -> ST2 -> ST3 per user,
with checkpointed state keyed by user_idx.

State per user (one value state, bounded): the vector, the live debounce
anchors per (item, type) and the bounded purchase set (item -> last time).
Item vectors enter by a stream-static left join before the keyed operator,
so a missing item still arms the debounce (checks run in the service's
order: type, debounce, item lookup, update).

Two ways of time:

- **Arrival order** (no watermark): each micro-batch is applied as it comes,
  sorted by (timestamp, event_id).  An event that arrives in a later batch than
  younger ones of its user is judged against what is left of the anchors, so
  it may pass where the batch operator rejects it, and it moves the vector last.
- **Event time** (``watermark``, a delay): events are held in state until the
  watermark has passed them and are then applied in order, so any arrival
  order within the delay gives what the batch operator gives; events behind
  the watermark are dropped by Spark.  The youngest ``watermark`` of a stream
  that stops stays held.  Timers expire what is idle: anchors after the
  debounce window, the purchase set ``ttl`` after the last purchase, and
  with ``forget_after`` the whole user that long after the last event.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftrank import schema as S

OUTPUT_SCHEMA = T.StructType([
    T.StructField("user_idx", T.IntegerType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("action", T.StringType()),
    T.StructField("features", T.ArrayType(T.FloatType())),
    T.StructField("history_size", T.IntegerType()),
])


def step(vec, anchors: dict, history: dict, ev: dict, lr: float = S.LEARNING_RATE,
         weights=S.EVENT_WEIGHTS, window: float = S.DEBOUNCE_SECONDS,
         limit: int = S.HISTORY_LIMIT, ttl: float = S.HISTORY_TTL_DAYS * 86400.0):
    """Apply one event to a user's state.  Returns (vec, action) where action
    is None (ignored), 'debounced', 'missing_item', 'created' or 'updated'.
    ``anchors`` and ``history`` are updated in place."""
    etype = ev["event_type"]
    w = weights.get(etype) if etype is not None else None
    if w is None:
        return vec, None
    ts = float(ev["timestamp"])
    key = (int(ev["item_idx"]), etype)
    last = anchors.get(key)
    if last is not None and ts - last < window:
        return vec, "debounced"
    anchors[key] = ts
    iv = ev.get("item_vector")
    if iv is None:
        return vec, "missing_item"
    iv = np.asarray(iv, dtype=np.float64)
    if vec is None:
        new, action = iv.copy(), "created"
    else:
        c = lr * w
        new, action = vec * (1.0 - c) + iv * c, "updated"
    if etype == "purchase":
        if history and ts - max(history.values()) >= ttl:
            history.clear()
        history[key[0]] = ts
        if len(history) > limit:
            # trim from the bottom: oldest time, then smaller id text
            ordered = sorted(history.items(), key=lambda kv: (kv[1], str(kv[0])))
            for item, _ in ordered[: len(history) - limit]:
                del history[item]
    return new, action


_STATE = T.StructType([
    T.StructField("v", T.ArrayType(T.DoubleType())),
    T.StructField("anchors", T.ArrayType(T.StructType([
        T.StructField("item_idx", T.IntegerType()), T.StructField("event_type", T.StringType()),
        T.StructField("ts", T.DoubleType())]))),
    T.StructField("history", T.ArrayType(T.StructType([
        T.StructField("item_idx", T.IntegerType()), T.StructField("ts", T.DoubleType())]))),
    T.StructField("newest", T.DoubleType()),
])

_HELD = T.StructType([
    T.StructField("timestamp", T.DoubleType()), T.StructField("event_id", T.LongType()),
    T.StructField("item_idx", T.IntegerType()), T.StructField("event_type", T.StringType()),
    T.StructField("item_vector", T.ArrayType(T.FloatType())),
])


class UserStateProcessor(StatefulProcessor):
    """One value state per user holding the vector, the live debounce
    anchors and the bounded purchase set: read once and written once per
    micro-batch.  Anchors older than the window behind the user's newest
    event can no longer block anything that comes in order and are pruned.
    In event time a list state holds the events that the watermark has not
    passed yet."""

    def __init__(self, lr: float = S.LEARNING_RATE, window: float = S.DEBOUNCE_SECONDS, in_order: bool = False,
                 ttl: float = S.HISTORY_TTL_DAYS * 86400.0, forget_after: float | None = None):
        self.lr, self.window, self.in_order, self.ttl, self.forget_after = lr, window, in_order, ttl, forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("user", _STATE)
        if self.in_order:
            self.held = handle.getListState("held", _HELD)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Seed a user's vector (e.g. ALS user factors) before the first batch."""
        if initialState["features"] is not None:
            self.state.update(([float(x) for x in initialState["features"]], [], [], None))

    def _load(self):
        if not self.state.exists():
            return None, {}, {}, None
        v, anchors, history, newest = self.state.get()
        return (None if v is None else np.asarray(v, dtype=np.float64), {(int(x[0]), x[1]): float(x[2]) for x in anchors or []},
                {int(x[0]): float(x[1]) for x in history or []}, newest)

    def _store(self, vec, anchors: dict, history: dict, newest: float | None) -> None:
        self.state.update((None if vec is None else vec.tolist(), [(i, t, ts) for (i, t), ts in anchors.items()],
                           list(history.items()), newest))

    def _apply(self, user: int, events: list[Row]):
        """The events, in order, against the user's state; a row per vector write."""
        vec, anchors, history, newest = self._load()
        out = []
        for ev in sorted(events, key=lambda e: (e["timestamp"], e["event_id"])):
            vec, action = step(vec, anchors, history, ev.asDict(), self.lr, window=self.window, ttl=self.ttl)
            if action in ("created", "updated"):
                out.append(Row(user_idx=user, event_id=int(ev["event_id"]), timestamp=float(ev["timestamp"]), action=action,
                               features=vec.astype(np.float32).tolist(), history_size=len(history)))
            newest = max(float(ev["timestamp"]), newest if newest is not None else -math.inf)
        anchors = {k: t for k, t in anchors.items() if newest - t < self.window}
        self._store(vec, anchors, history, newest)
        return out

    def handleInputRows(self, key, rows, timerValues):
        if not self.in_order:
            yield from self._apply(int(key[0]), list(rows))
            return
        came = [(float(e["timestamp"]), int(e["event_id"]), int(e["item_idx"]), e["event_type"], e["item_vector"]) for e in rows]
        self.held.appendList(came)
        self.handle.registerTimer(_millis(min(e[0] for e in came)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        names = [f.name for f in _HELD.fields]
        held = [Row(**dict(zip(names, e))) for e in self.held.get()] if self.held.exists() else []
        due = [e for e in held if _millis(e["timestamp"]) <= passed]
        if due:
            yield from self._apply(int(key[0]), due)
            rest = [e for e in held if _millis(e["timestamp"]) > passed]
            if rest:
                self.held.put([tuple(e[n] for n in names) for e in rest])
                self.handle.registerTimer(_millis(min(e["timestamp"] for e in rest)))
            else:
                self.held.clear()
        self._expire(passed / 1000.0, bool(held) and len(due) < len(held))

    def _expire(self, now: float, waiting: bool) -> None:
        """Drops what is idle at ``now`` and sets a timer for what expires next."""
        if not self.state.exists():
            return
        vec, anchors, history, newest = self._load()
        if self.forget_after is not None and not waiting and newest is not None and now - newest >= self.forget_after:
            self.state.clear()
            return
        live = {k: t for k, t in anchors.items() if now - t < self.window}
        kept = {} if history and now - max(history.values()) >= self.ttl else history
        if len(live) < len(anchors) or len(kept) < len(history):
            self._store(vec, live, kept, newest)
        ends = [t + self.window for t in live.values()]
        if kept:
            ends.append(max(kept.values()) + self.ttl)
        if self.forget_after is not None and newest is not None:
            ends.append(newest + self.forget_after)
        if ends:
            self.handle.registerTimer(max(_millis(min(ends)), int(now * 1000) + 1))

    def close(self) -> None:
        pass


def _millis(seconds: float) -> int:
    """The first whole millisecond at or after a time."""
    return math.ceil(round(seconds * 1000, 3))


def user_state_stream(events: DataFrame, item_vectors: DataFrame,
                      lr: float = S.LEARNING_RATE, window: float = S.DEBOUNCE_SECONDS,
                      initial_vectors: DataFrame | None = None, watermark: str | None = None,
                      ttl: float = S.HISTORY_TTL_DAYS * 86400.0, forget_after: float | None = None) -> DataFrame:
    """Changelog of vector writes per accepted event: (user_idx, event_id,
    timestamp, action, features, history_size).  ``initial_vectors``
    (user_idx or id, features) seeds users that already have a vector, e.g.
    from ALS.  Without ``watermark`` it works on streaming and batch inputs
    alike; with it (such as "10 minutes") events are applied in event-time
    order and idle state expires, see the module text.  The state lies in
    the RocksDB state store, which the session must name as its provider."""
    spark = events.sparkSession
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    if events.isStreaming and not provider.endswith("RocksDBStateStoreProvider"):
        raise ValueError("spark.sql.streaming.stateStore.providerClass must be the RocksDB provider")
    iv = item_vectors.select("item_idx", F.col("features").alias("item_vector"))
    # an event without a mapped user or item has no state to change
    known = events.where(F.col("event_type").isin(list(S.EVENT_WEIGHTS))
                         & F.col("user_idx").isNotNull() & F.col("item_idx").isNotNull())
    known = known.select("user_idx", "item_idx", "event_type", "timestamp", "event_id")
    if watermark is not None:
        known = known.where(F.col("timestamp").isNotNull()).withColumn(
            "event_time", F.timestamp_micros((F.col("timestamp") * 1e6).cast("long"))).withWatermark("event_time", watermark)
    j = known.join(iv, "item_idx", "left")
    init = None
    if initial_vectors is not None:
        key = "id" if "id" in initial_vectors.columns else "user_idx"
        init = initial_vectors.select(F.col(key).cast("int").alias("user_idx"),
                                      "features").groupBy("user_idx")
    return j.groupBy("user_idx").transformWithState(
        statefulProcessor=UserStateProcessor(lr, window, watermark is not None, ttl, forget_after),
        outputStructType=OUTPUT_SCHEMA, outputMode="Append",
        timeMode="None" if watermark is None else "EventTime", initialState=init)


def latest_vectors(changelog: DataFrame) -> DataFrame:
    """Current vector per user from the changelog (latest write wins)."""
    return changelog.groupBy("user_idx").agg(
        F.max_by("features", F.struct("timestamp", "event_id")).alias("features"))
