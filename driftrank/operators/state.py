"""User state in batch form: ST1 debounce, ST2 EMA user vectors, ST3 bounded
purchase history (R3).  The streaming operator (``streaming.user_state``)
applies the same rules incrementally and is tested equal to these.

Time is event time ordered by (timestamp, event_id), so batch and stream
agree and replays are deterministic.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftrank import schema as S
from driftrank.functions.columns import event_weight
from driftrank.operators.ordered import PID, key_change, not_null, ranged

DEBOUNCE_KEYS = ("user_idx", "item_idx", "event_type")


def _next_accept(ts: np.ndarray, window: float) -> np.ndarray:
    """nxt[i] = first j > i with ts[j] - ts[i] >= window (n if none), using
    the exact subtraction test of the fold."""
    n = len(ts)
    nxt = np.searchsorted(ts, ts + window, side="left")
    idx = np.arange(n)
    nxt = np.maximum(nxt, idx + 1)
    # rounding of ts + window can put the start off by whole runs of equal
    # times: move run by run until the subtraction test holds on both sides
    while True:
        c = np.minimum(nxt, n - 1)
        fwd = (nxt < n) & (ts[c] - ts < window)
        prev = np.maximum(nxt - 1, 0)
        back = (nxt - 1 > idx) & (ts[prev] - ts >= window)
        if not (fwd.any() or back.any()):
            break
        after = np.searchsorted(ts, ts[c], side="right")
        before = np.maximum(np.searchsorted(ts, ts[prev], side="left"), idx + 1)
        nxt = np.where(fwd, after, np.where(back, before, nxt))
    return nxt


def debounce_fold(ts: np.ndarray, window: float, anchor: float | None = None) -> np.ndarray:
    """Accept flags for one key's time-sorted events: an event is accepted iff
    ``ts - last_accepted >= window`` (the anchor moves only on accepts)."""
    n = len(ts)
    acc = np.zeros(n, dtype=bool)
    if n == 0:
        return acc
    nxt = _next_accept(ts, window)
    i = 0
    if anchor is not None:
        i = int(np.searchsorted(ts, anchor + window, side="left"))
        while i < n and ts[i] - anchor < window:
            i += 1
        while i > 0 and ts[i - 1] - anchor >= window:
            i -= 1
    while i < n:
        acc[i] = True
        i = int(nxt[i])
    return acc


#: breakpoints in one row of a slice's summary
CHUNK = 1024


def segment_summary(ts: np.ndarray, window: float) -> tuple[np.ndarray, np.ndarray]:
    """How a key's slice maps an incoming anchor to its outgoing anchor.

    An incoming anchor A comes from earlier partitions, so A <= ts[0]; the
    first accepted event is then one of the events within ``window`` of
    ts[0] or the first one after them (which any A lets pass: its breakpoint
    is infinite).  Returns (bound, last): A goes with the first breakpoint of
    bound - A >= window, and ``last`` is the time of the last event that the
    chain from there accepts; neighbours of equal ``last`` are one breakpoint.
    """
    n = len(ts)
    nxt = _next_accept(ts, window)
    # end of the chain from every start, by pointer jumping (log n numpy
    # passes instead of a per-event loop): chain ends point to themselves
    ptr = np.where(nxt < n, nxt, np.arange(n))
    while True:
        nxt_ptr = ptr[ptr]
        if np.array_equal(nxt_ptr, ptr):
            break
        ptr = nxt_ptr
    h = int(np.searchsorted(ts, ts[0] + window, side="left"))
    while h < n and ts[h] - ts[0] < window:
        h += 1
    while h > 1 and ts[h - 1] - ts[0] >= window:
        h -= 1
    bound, last = ts[:h], ts[ptr[:h]]
    if h < n:
        bound, last = np.append(bound, np.inf), np.append(last, ts[ptr[h]])
    run_end = np.append(last[1:] != last[:-1], True)
    return bound[run_end], last[run_end]


def apply_summary(bound: np.ndarray, last: np.ndarray, window: float, anchor: float) -> float | None:
    """Outgoing anchor for an incoming one (minus infinity: none); None if no breakpoint lets it pass."""
    at = int(np.argmax(bound - anchor >= window))
    return float(last[at]) if bound[at] - anchor >= window else None


def _summaries(batches, keys: Sequence[str], ts_col: str, window: float):
    """Pass 1: per partition, the summary of its first and last key segment
    (the only ones that can continue into a neighbour partition).  Middle
    segments of a batch are skipped without a per-segment loop."""
    first = None
    cur_key, cur_ts = None, []
    pid = None
    for pdf in batches:
        n = len(pdf)
        if n == 0:
            continue
        pid = int(pdf[PID].iloc[0])
        ts = pdf[ts_col].to_numpy(dtype=np.float64)
        kdf = pdf[list(keys)]
        starts = np.flatnonzero(key_change(kdf, n))
        e0 = int(starts[1]) if len(starts) > 1 else n
        k0 = tuple(kdf.iloc[0].tolist())
        if cur_key is not None and k0 == cur_key:
            cur_ts.append(ts[:e0])
        else:
            if cur_key is not None and first is None:
                first = (cur_key, cur_ts)
            cur_key, cur_ts = k0, [ts[:e0]]
        if len(starts) > 1:
            if first is None:
                first = (cur_key, cur_ts)
            sl = int(starts[-1])
            cur_key, cur_ts = tuple(kdf.iloc[sl].tolist()), [ts[sl:]]
    if cur_key is None:
        return
    segs = ([first] if first is not None else []) + [(cur_key, cur_ts)]
    for k, parts in segs:
        bound, last = segment_summary(np.concatenate(parts), window)
        for c, at in enumerate(range(0, len(bound), CHUNK)):
            yield pd.DataFrame([(*k, pid, c, bound[at:at + CHUNK].tolist(), last[at:at + CHUNK].tolist())],
                               columns=[*keys, PID, "_chunk", "_bound", "_last"])


def _compose(batches, keys: Sequence[str], window: float):
    """Pass 1.5, chunks sorted by (keys, partition, chunk): carries each key's
    anchor from slice to slice; what is held at a time is one chunk."""
    key, part, anchor, out = None, None, -np.inf, -np.inf
    for pdf in batches:
        rows = []
        for *k, pid, _, bound, last in pdf[[*keys, PID, "_chunk", "_bound", "_last"]].itertuples(index=False):
            k = tuple(k)
            if k != key:
                key, part, out = k, None, -np.inf
            if pid != part:
                part, anchor, passed = pid, out, False
                rows.append((*k, pid, None if np.isinf(anchor) else anchor))
            if not passed:
                found = apply_summary(np.asarray(bound), np.asarray(last), window, anchor)
                if found is not None:
                    out, passed = found, True
        yield pd.DataFrame(rows, columns=[*keys, PID, "_ain"])


def _debounce_partition(batches, keys: Sequence[str], ts_col: str, window: float,
                        ain_col: str | None = None):
    """Pass 2: stream a partition sorted by (keys, ts, order); a segment
    starts from its boundary anchor (``ain_col``) or the anchor carried from
    the previous Arrow batch.  Memory is one batch plus one anchor."""
    carry_key = None
    carry_anchor = None
    for pdf in batches:
        n = len(pdf)
        if n == 0:
            continue
        ts = pdf[ts_col].to_numpy(dtype=np.float64)
        kdf = pdf[list(keys)]
        change = key_change(kdf, n)
        gap_new = np.ones(n, dtype=bool)
        gap_new[1:] = (ts[1:] - ts[:-1]) >= window
        # a session starts on a key change or a gap >= window: its first
        # event is accepted whatever came before (the anchor is older)
        session = change | gap_new
        acc = np.zeros(n, dtype=bool)
        starts = np.flatnonzero(session)
        ends = np.append(starts[1:], n)
        ain = pdf[ain_col].to_numpy() if ain_col else None
        first_key = tuple(kdf.iloc[0].tolist())
        has_ain = (np.zeros(n, dtype=bool) if ain is None
                   else ~np.asarray(pd.isna(ain), dtype=bool))
        lens = ends - starts
        # single-event sessions with no anchor to honour: accepted outright
        plain = (lens == 1) & ~(change[starts] & has_ain[starts])
        plain[0] &= not (carry_key is not None and first_key == carry_key)
        acc[starts[plain]] = True
        for s, e in zip(starts[~plain], ends[~plain]):
            anchor = None
            if s == 0 and carry_key is not None and first_key == carry_key:
                anchor = carry_anchor
            elif change[s] and has_ain[s]:
                anchor = float(ain[s])
            acc[s:e] = debounce_fold(ts[s:e], window, anchor)
        # carry: last accepted ts of the last key in this batch
        last_key = tuple(kdf.iloc[n - 1].tolist())
        key_start = int(np.flatnonzero(change)[-1])
        hits = np.flatnonzero(acc[key_start:])
        if hits.size:
            carry_anchor = float(ts[key_start + hits[-1]])
        elif key_start == 0 and carry_key == last_key:
            pass
        elif ain is not None and not pd.isna(ain[key_start]):
            carry_anchor = float(ain[key_start])
        else:
            carry_anchor = None
        carry_key = last_key
        out = pdf.drop(columns=[c for c in (ain_col, PID) if c and c in pdf.columns])
        yield out.assign(accepted=acc)


def debounce(events: DataFrame, keys: Sequence[str] = DEBOUNCE_KEYS,
             seconds: float = S.DEBOUNCE_SECONDS, ts: str = "timestamp",
             order: str = "event_id", keep_rejected: bool = False,
             num_partitions: int | None = None) -> DataFrame:
    """ST1: drop an event when the same key had an *accepted* event less than
    ``seconds`` before it.  Anchored on accepted events only: 0,100,400,700 s
    keep 0,400,700 (``dropDuplicatesWithinWatermark`` and a plain ``lag``
    are both wrong here).

    Plan (skew-safe, exact): range-partition by (key, ts, order) so a hot
    key is split over many sorted partitions; pass 1 summarises each
    partition's boundary segments (how an incoming anchor maps to the
    outgoing one) in rows of at most ``CHUNK`` breakpoints; a walk over those
    rows, one at a time, gives every boundary segment its incoming anchor;
    pass 2 folds all partitions in parallel, streaming Arrow batches.  Events
    with a gap >= window to their predecessor bypass the fold.
    """
    keys_t, window = tuple(keys), float(seconds)
    out_schema = T.StructType(events.schema.fields + [T.StructField("accepted", T.BooleanType())])
    keyed = events.where(not_null(keys_t))
    nulls = events.where(~not_null(keys_t)).withColumn("accepted", F.lit(True))
    r = ranged(keyed, keys_t, (ts, order), num_partitions)

    key_fields = [r.schema[k] for k in keys_t]
    summ_schema = T.StructType(key_fields + [
        T.StructField(PID, T.IntegerType()), T.StructField("_chunk", T.LongType()),
        T.StructField("_bound", T.ArrayType(T.DoubleType())),
        T.StructField("_last", T.ArrayType(T.DoubleType()))])
    summ = (r.select(*keys_t, ts, PID).mapInPandas(lambda it: _summaries(it, keys_t, ts, window), summ_schema)
            .repartition(*keys_t).sortWithinPartitions(*keys_t, PID, "_chunk"))
    ain_schema = T.StructType(key_fields + [T.StructField(PID, T.IntegerType()),
                                            T.StructField("_ain", T.DoubleType())])
    ain = summ.mapInPandas(lambda it: _compose(it, keys_t, window), ain_schema)
    # at most two rows per partition: a proven-small broadcast
    joined = (r.join(F.broadcast(ain), [*keys_t, PID], "left")
              .sortWithinPartitions(*keys_t, ts, order))
    joined = joined.select(*events.columns, PID, "_ain")
    out = joined.mapInPandas(lambda it: _debounce_partition(it, keys_t, ts, window, "_ain"),
                             out_schema)
    out = out.unionByName(nulls)
    if keep_rejected:
        return out
    return out.where("accepted").drop("accepted")


def attach_item_vectors(events: DataFrame, item_vectors: DataFrame) -> DataFrame:
    """Stream-static style left join; ``item_vector`` null when missing."""
    iv = item_vectors.select(F.col("item_idx"), F.col("features").alias("item_vector"))
    return events.join(iv, "item_idx", "left")


def drop_missing_items(events: DataFrame, item_vectors: DataFrame) -> DataFrame:
    """after debounce, events whose item has no vector are skipped."""
    return attach_item_vectors(events, item_vectors).where(F.col("item_vector").isNotNull())


def _ema_summaries(batches, ts_col: str):
    """Pass 1: per partition, sum of log1p(-c) of its first and last user
    segments (the only ones that can continue into a neighbour)."""
    first = None
    cur_user, cur_sum = None, 0.0
    pid = None
    for pdf in batches:
        if len(pdf) == 0:
            continue
        pid = int(pdf[PID].iloc[0])
        users = pdf["user_idx"].to_numpy()
        logs = np.log1p(-pdf["c"].to_numpy(dtype=np.float64))
        change = key_change(pdf[["user_idx"]], len(pdf))
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], len(pdf))
        for s, e in zip(starts, ends):
            u = int(users[s])
            if cur_user is not None and u == cur_user:
                cur_sum += float(logs[s:e].sum())
                continue
            if cur_user is not None and first is None:
                first = (cur_user, cur_sum)
            cur_user, cur_sum = u, float(logs[s:e].sum())
    if cur_user is None:
        return
    rows = ([first] if first is not None else []) + [(cur_user, cur_sum)]
    yield pd.DataFrame({"user_idx": [r[0] for r in rows], PID: [pid] * len(rows),
                        "_tot": [r[1] for r in rows]})


def _ema_compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pass 1.5, one user: for each of its partitions, the log-sum of all
    later partitions and whether an earlier partition holds the user."""
    pdf = pdf.sort_values(PID)
    tots = pdf["_tot"].to_numpy(dtype=np.float64)
    later = np.concatenate([np.cumsum(tots[::-1])[::-1][1:], [0.0]])
    return pd.DataFrame({"user_idx": pdf["user_idx"].to_numpy(), PID: pdf[PID].to_numpy(),
                         "_later": later, "_earlier": np.arange(len(pdf)) > 0})


_COEF_OUT = T.StructType([
    T.StructField("user_idx", T.IntegerType()),
    T.StructField("item_idx", T.IntegerType()),
    T.StructField("coef", T.DoubleType()),
])


def _segment_coefficients(seg: pd.DataFrame) -> pd.DataFrame:
    """Coefficients for whole user segments (several users at once):
    c_i * exp(sum of log1p(-c) over the user's later rows here + later
    partitions), with c = 1 for the first event of a cold user."""
    users = seg["user_idx"].to_numpy()
    c = seg["c"].to_numpy(dtype=np.float64).copy()
    logs = np.log1p(-c)
    n = len(seg)
    change = key_change(seg[["user_idx"]], n)
    sid = np.cumsum(change) - 1
    csum = np.cumsum(logs)
    ends = np.append(np.flatnonzero(change)[1:], n) - 1
    suffix = csum[ends][sid] - csum
    later = seg["_later"].to_numpy(dtype=np.float64, na_value=0.0)
    earlier = seg["_earlier"].to_numpy(dtype=object)
    earlier = np.array([False if pd.isna(x) else bool(x) for x in earlier])
    init = seg["_has_init"].to_numpy(dtype=bool)
    cold_first = change & ~earlier & ~init
    c[cold_first] = 1.0
    return pd.DataFrame({"user_idx": users.astype(np.int32),
                         "item_idx": seg["item_idx"].to_numpy(dtype=np.int32),
                         "coef": c * np.exp(suffix + later)})


def _ema_coefficients(batches):
    """Pass 2: complete user segments of a batch are handled vectorised; the
    batch's last segment is held back until its user ends (bounded by the
    partition), since its suffix sums need the rows still to come."""
    held = None
    for pdf in batches:
        if len(pdf) == 0:
            continue
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        starts = np.flatnonzero(key_change(pdf[["user_idx"]], len(pdf)))
        last = int(starts[-1])
        held = pdf.iloc[last:]
        if last > 0:
            yield _segment_coefficients(pdf.iloc[:last].reset_index(drop=True))
    if held is not None and len(held):
        yield _segment_coefficients(held.reset_index(drop=True))


#: events of a user whose terms are summed in one place
SUM_ROWS = 1 << 16


def _weighted_sums(terms: DataFrame, width: int) -> DataFrame:
    """(user_idx, features) per user: the sum of ``coef * features`` over its rows.

    ``terms`` has user_idx, _part, coef and features of at most ``width``
    entries.  A row goes to its user's part as the single-precision vector
    that it is, so what is shuffled grows with the rows, however many tasks
    they come from.  A sum per dimension, null entries left out.
    """
    terms = terms.where(F.size("features") > 0)
    parts = (terms.repartition("user_idx", "_part").groupBy("user_idx", "_part")
             .agg(F.max(F.size("features")).alias("_n"), *[
                 F.sum(F.col("coef") * F.get("features", F.lit(k)).cast("double")).alias(f"_{k}") for k in range(width)]))
    whole = parts.groupBy("user_idx").agg(F.max("_n").alias("_n"), *[F.sum(f"_{k}").alias(f"_{k}") for k in range(width)])
    return whole.select(F.col("user_idx").cast("int"), F.slice(
        F.array(*[F.col(f"_{k}").cast("float") for k in range(width)]), F.lit(1), F.col("_n")).alias("features"))


def ema_vectors(accepted: DataFrame, item_vectors: DataFrame,
                user_vectors: DataFrame | None = None, lr: float = S.LEARNING_RATE,
                weights: Mapping[str, float] = S.EVENT_WEIGHTS,
                ts: str = "timestamp", order: str = "event_id",
                num_partitions: int | None = None) -> DataFrame:
    """ST2: fold ``u <- u (1 - lr w) + v lr w`` over each user's accepted
    events in time order; a user without a vector starts at the first item
    vector (coefficient 1, whatever the weight).

    Closed form, fully associative: event i contributes
    ``c_i * prod_{j>i} (1 - c_j)`` times its item vector, the prior vector
    contributes ``prod_j (1 - c_j)``.  The suffix products are log-sums over
    a user's later events; they are computed on range-partitioned slices
    (a hot user spans many partitions) with the later partitions' sums
    carried by a boundary table of at most two rows per partition.  No vector
    takes part in that: coefficients are summed per (user, item) first, each
    pair then meets its item vector once, and the weighted sum is formed per
    user, where a user of more than ``SUM_ROWS`` events is dealt by item over
    so many more parts, so no such user's events are gathered in one place.
    Output: (user_idx, features array<float>).
    """
    max_c = lr * max(list(weights.values()) + [0.0])
    if not (0.0 <= max_c < 1.0):
        raise ValueError("lr * weight must be in [0, 1) for the closed form")
    vectors = item_vectors.where(F.col("features").isNotNull()).select(
        F.col("item_idx").cast("int").alias("item_idx"), "features")
    c = F.lit(lr) * event_weight("event_type", weights)
    ev = (accepted.where(F.col("event_type").isin(list(weights)))
          .select(F.col("user_idx").cast("int").alias("user_idx"), ts, order,
                  F.col("item_idx").cast("int").alias("item_idx"), c.alias("c"))
          .join(vectors.select("item_idx"), "item_idx", "left_semi"))
    has_init = user_vectors is not None
    if has_init:
        init = user_vectors.select(F.col("id").cast("int").alias("user_idx"),
                                   F.lit(True).alias("_has_init"))
        ev = ev.join(init, "user_idx", "left").withColumn(
            "_has_init", F.coalesce("_has_init", F.lit(False)))
    else:
        ev = ev.withColumn("_has_init", F.lit(False))
    r = ranged(ev.where(F.col("user_idx").isNotNull()), ["user_idx"], [ts, order], num_partitions)
    summ = r.select("user_idx", "c", PID).mapInPandas(lambda it: _ema_summaries(it, ts), T.StructType([
        T.StructField("user_idx", T.IntegerType()), T.StructField(PID, T.IntegerType()),
        T.StructField("_tot", T.DoubleType())]))
    bounds = summ.groupBy("user_idx").applyInPandas(_ema_compose, T.StructType([
        T.StructField("user_idx", T.IntegerType()), T.StructField(PID, T.IntegerType()),
        T.StructField("_later", T.DoubleType()), T.StructField("_earlier", T.BooleanType())]))
    # at most two rows per partition: a proven-small broadcast
    j = (r.join(F.broadcast(bounds), ["user_idx", PID], "left")
         .sortWithinPartitions("user_idx", ts, order)
         .select("user_idx", "item_idx", "c", "_has_init", "_later", "_earlier"))
    coefs = (j.mapInPandas(_ema_coefficients, _COEF_OUT)
             .groupBy("user_idx", "item_idx").agg(F.sum("coef").alias("coef")))
    given = [vectors] + ([user_vectors] if has_init else [])
    width = max([1] + [v.agg(F.max(F.size("features"))).first()[0] or 0 for v in given])
    # at most one row per SUM_ROWS events: a proven-small broadcast
    hot = (r.groupBy("user_idx").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > SUM_ROWS)
           .select("user_idx", F.ceil(F.col("_rows") / SUM_ROWS).alias("_parts")))
    part = F.coalesce(F.pmod(F.xxhash64("item_idx"), F.col("_parts")), F.lit(0).cast("long"))
    terms = (coefs.join(vectors, "item_idx").join(F.broadcast(hot), "user_idx", "left")
             .select("user_idx", part.alias("_part"), "coef", "features"))
    if has_init:
        # prior vector term: prod over all of the user's events of (1 - c)
        total = ev.groupBy("user_idx").agg(F.sum(F.log1p(-F.col("c"))).alias("_all"))
        prior = (user_vectors.select(F.col("id").cast("int").alias("user_idx"), "features")
                 .join(total, "user_idx", "left")
                 .select("user_idx", F.lit(0).cast("long").alias("_part"),
                         F.exp(F.coalesce("_all", F.lit(0.0))).alias("coef"), "features"))
        terms = terms.unionByName(prior)
    return _weighted_sums(terms, width)


def user_history(accepted: DataFrame, item_vectors: DataFrame | None = None,
                 n: int = S.HISTORY_LIMIT, ttl_days: float = S.HISTORY_TTL_DAYS,
                 as_of: float | None = None, ts: str = "timestamp") -> DataFrame:
    """ST3: bounded purchase set per user.  Only accepted purchases whose item
    has a vector enter (the update is skipped otherwise).  The whole set
    expires ``ttl_days`` after the user's last purchase: purchases before a
    silent gap >= ttl are gone, and a user whose last purchase is older than
    ttl at ``as_of`` (default: the data's last event time) has no history.
    Output: (user_idx, item_idx, last_purchase_at).

    Skew-safe: no per-user window over purchases.  With ttl-wide time
    buckets, only a bucket's first purchase can follow a silent gap, and it
    does iff the previous bucket's last purchase is >= ttl older (or the
    previous bucket is empty).  So the live epoch comes from per-(user,
    bucket) min/max aggregates (partial, map-side) and the item times from
    a per-(user, item) max; the 100-item cut is a per-user top-n whose
    partial limit runs before the shuffle.
    """
    p = accepted.where(F.col("event_type") == "purchase")
    if item_vectors is not None:
        p = p.join(item_vectors.select("item_idx"), "item_idx", "left_semi")
    ttl = float(ttl_days) * 86400.0
    p = p.select(F.col("user_idx").cast("int").alias("user_idx"),
                 F.col("item_idx").cast("int").alias("item_idx"), F.col(ts).alias("_t"))
    buckets = (p.groupBy("user_idx", F.floor(F.col("_t") / ttl).alias("_b"))
               .agg(F.min("_t").alias("_mn"), F.max("_t").alias("_mx")))
    prev = buckets.select("user_idx", (F.col("_b") + 1).alias("_b"), F.col("_mx").alias("_pmx"))
    epoch = (buckets.join(prev, ["user_idx", "_b"], "left")
             .where(F.col("_pmx").isNull() | (F.col("_mn") - F.col("_pmx") >= ttl))
             .groupBy("user_idx").agg(F.max("_mn").alias("_epoch"), F.max("_mx").alias("_last")))
    items = p.groupBy("user_idx", "item_idx").agg(F.max("_t").alias("last_purchase_at"))
    clock = (F.lit(float(as_of)) if as_of is not None
             else accepted.agg(F.max(ts)).scalar())
    live = (items.join(epoch, "user_idx")
            .where((F.col("last_purchase_at") >= F.col("_epoch"))
                   & (clock - F.col("_last") < F.lit(ttl))))
    w = Window.partitionBy("user_idx").orderBy(F.col("last_purchase_at").desc(),
                                               F.col("item_idx").cast("string").desc())
    return (live.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
            .select("user_idx", "item_idx", "last_purchase_at"))
