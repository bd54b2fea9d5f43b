"""Streams with state of their own, on transformWithStateInPandas. Each has a batch twin in tape.py that gives the same rows.

A key's rows of one micro-batch are put in order of time, compared as columns with the row before each, and the last of
them becomes the state; what is held is one key of one micro-batch (the source's trigger options bound that). A row that is
not newer than the state is late and ignored. State lives in RocksDB, beside the checkpoint.
"""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STOPPED = ("cut", "withdrawn", "disqualified", "dns")
FULL, NEAR, FAR = 18, (5, 10), (5, 25)


def with_state(spark: SparkSession) -> None:
    """These operators need the RocksDB store; a query takes the setting that the session has when it starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _apply(stream: DataFrame, by: Sequence[str], processor: StatefulProcessor, schema: str | StructType, mode: str = "append", time: str = "None") -> DataFrame:
    with_state(stream.sparkSession)
    return stream.groupBy(*by).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode=time)


def _rows(frames: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(list(order), na_position="first", kind="stable", ignore_index=True)


def _plain(value):
    """A value as state takes it: no numpy type, and None for what is missing."""
    if value is None or (not isinstance(value, (list, np.ndarray)) and pd.isna(value)):
        return None
    return value.item() if isinstance(value, np.generic) else value


class _Last(StatefulProcessor):
    """Keeps the last row's columns, its time in microseconds first, and gives what judge makes of the newer ones.

    judge takes the last row (a tuple or None) and the sorted newer rows, and returns the rows to emit and the new last row.
    """

    def __init__(self, schema: str, order: Sequence[str], judge: Callable, late: bool = False):
        self.schema, self.order, self.judge, self.late = schema, order, judge, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        given = _rows(rows, self.order)
        if last is not None and not self.late:
            given = given[given["at_us"] > last[0]].reset_index(drop=True)
        if len(given):
            out, now = self.judge(last, given)
            self.last.update(tuple(_plain(x) for x in now))
            yield out

    def close(self) -> None:
        pass


#: Rows pass through Python as JSON, so that no value changes its type or digits there.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def _packed(stream: DataFrame, by: Sequence[str], ts: str, **more: Column) -> DataFrame:
    """The key, the time in microseconds, the row as JSON and what the operator looks at."""
    row = F.to_json(F.struct(*stream.columns), JSON).alias("packed_row")
    return stream.select(*by, F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"), row, *(c.alias(n) for n, c in more.items()))


def _unpacked(df: DataFrame, schema: StructType, *more: Column) -> DataFrame:
    return df.select(F.from_json("packed_row", schema, JSON).alias("r"), *more)


def change_only_stream(stream: DataFrame, by: Sequence[str], ts: str, signature: Sequence[str]) -> DataFrame:
    """Rows whose signature differs from that of the row before (change_only); the first row of a key is one. Of rows of one
    time the least signature comes first."""
    given = _packed(stream, by, ts, sign=F.sha2(F.to_json(F.struct(*signature), JSON), 256))

    def judge(last, rows):
        before = rows["sign"].shift(fill_value=last[1] if last is not None else "")
        return rows.loc[rows["sign"] != before, ["packed_row"]], (rows["at_us"].iloc[-1], rows["sign"].iloc[-1])

    return _unpacked(_apply(given, by, _Last("at long, sign string", ["at_us", "sign"], judge), "packed_row string"), stream.schema).select("r.*")


def carry_forward_stream(stream: DataFrame, by: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Rows that were not observed again (all of cols null) keep the values of the last one that was, with its time in
    row_observed_at (carry_forward)."""
    values = F.struct(*cols)
    given = _packed(stream, by, ts, seen=F.coalesce(*(F.col(c).cast("string") for c in cols)).isNotNull(), held=F.to_json(values, JSON))

    def judge(last, rows):
        held = np.maximum.accumulate(np.where(rows["seen"], np.arange(len(rows)), -1))
        at, texts = rows["at_us"].to_numpy(), rows["held"].to_numpy(object)
        before = (None, None) if last is None else last[1:]
        out = pd.DataFrame({"packed_row": rows["packed_row"], "observed": pd.array([int(at[h]) if h >= 0 else before[0] for h in held], "Int64"), "held": [texts[h] if h >= 0 else before[1] for h in held]})
        now = before if held[-1] < 0 else (at[held[-1]], texts[held[-1]])
        return out, (at[-1], *now)

    done = _apply(given, by, _Last("at long, observed long, held string", ["at_us"], judge), "packed_row string, observed long, held string")
    kind = StructType([stream.schema[c] for c in cols])
    done = _unpacked(done, stream.schema, F.from_json("held", kind, JSON).alias("h"), F.timestamp_micros("observed").alias("row_observed_at"))
    return done.select(*(F.col(f"h.{c}") if c in cols else F.col(f"r.{c}") for c in stream.columns), "row_observed_at")


def time_since_change_stream(stream: DataFrame, by: Sequence[str], ts: str, col: str) -> DataFrame:
    """changed_at, the first time of the current value without interruption, and seconds since then (time_since_change)."""
    given = _packed(stream, by, ts, value=F.to_json(F.struct(col), JSON))

    def judge(last, rows):
        values, at = rows["value"], rows["at_us"].to_numpy()
        same = (values == values.shift(fill_value="" if last is None else last[2])).to_numpy()
        start = np.maximum.accumulate(np.where(same, -1, np.arange(len(rows))))
        changed = np.where(start >= 0, at[np.maximum(start, 0)], 0 if last is None else last[1])
        return pd.DataFrame({"packed_row": rows["packed_row"], "changed": changed, "at_us": at}), (at[-1], changed[-1], values.iloc[-1])

    done = _apply(given, by, _Last("at long, changed long, value string", ["at_us"], judge), "packed_row string, changed long, at_us long")
    whole = lambda c: F.floor(F.col(c) / 1_000_000)
    return _unpacked(done, stream.schema, F.timestamp_micros("changed").alias("changed_at"), (whole("at_us") - whole("changed")).alias("seconds")).select("r.*", "changed_at", "seconds")


def drop_late_stream(stream: DataFrame, by: Sequence[str], ts: str, arrival: str) -> DataFrame:
    """Rows that are newer than all that arrived before them (drop_late). arrival orders the rows of a micro-batch, and
    micro-batches come one after the other."""

    def judge(last, rows):
        at = rows["at_us"].to_numpy()
        before = np.maximum.accumulate(np.concatenate([[np.iinfo(np.int64).min if last is None else last[0]], at]))
        return rows.loc[at > before[:-1], ["packed_row"]], (before[-1],)

    given = _packed(stream, by, ts, came=F.col(arrival))
    return _unpacked(_apply(given, by, _Last("at long", ["came"], judge, late=True), "packed_row string"), stream.schema).select("r.*")


def pulse_stream(ticks: DataFrame, watch: DataFrame, entity: str, ts: str, position: str, top: int = 10) -> DataFrame:
    """Watched entities that came into the top since their observation before (pulse). watch is a table."""

    def judge(last, rows):
        now = rows["place"].astype("float64")
        before = now.shift(fill_value=np.nan if last is None or last[1] is None else last[1])
        return rows.loc[(now <= top) & (before > top), ["packed_row"]], (rows["at_us"].iloc[-1], now.iloc[-1])

    watched = ticks.join(watch.select(entity).distinct(), entity, "left_semi").select(ticks.columns)
    given = _packed(watched, [entity], ts, place=F.col(position).cast("double"))
    return _unpacked(_apply(given, [entity], _Last("at long, place double", ["at_us"], judge), "packed_row string"), ticks.schema).select("r.*")


# --- the tape ---------------------------------------------------------------------------------------------------------

SNAPSHOT = ["observed_at", "period", "status", "position", "total", "thru", "items", "row_observed_at"]


def snapshot_columns(df: DataFrame) -> DataFrame:
    """The columns that the tape reads, in their types; items and row_observed_at may be missing."""
    items = F.transform("items", lambda x: F.struct(x["item"].cast("int").alias("item"), x["strokes"].cast("int").alias("strokes"), x["par"].cast("int").alias("par"))) if "items" in df.columns else F.lit(None).cast("array<struct<item:int,strokes:int,par:int>>")
    again = F.col("row_observed_at").cast("timestamp") if "row_observed_at" in df.columns else F.lit(None).cast("timestamp")
    return df.select("event_id", "entity_id", F.col("observed_at").cast("timestamp").alias("observed_at"), F.col("period").cast("int").alias("period"), "status", F.col("position").cast("long").alias("position"), F.col("total").cast("long").alias("total"), F.col("thru").cast("int").alias("thru"), items.alias("items"), again.alias("row_observed_at"))


def _card(items) -> list[tuple[int, int | None]]:
    """item and strokes against par of the items of a card, in its order; None where either is unknown."""
    if items is None:
        return []
    return [(int(x["item"]), None if x["strokes"] is None or x["par"] is None else int(x["strokes"]) - int(x["par"])) for x in items if x["item"] is not None]


def events_between(q: dict, had: set[int], p: dict, card: list[tuple[int, int | None]], again: bool) -> Iterator[tuple[str, str]]:
    """The events between two snapshots of an entity. had: the items that the older card holds."""
    if q["period"] is None or p["period"] is None or q["period"] != p["period"]:
        return
    if q["status"] == "active" and p["status"] in STOPPED:
        yield "status", p["status"]
        return
    if p["status"] not in (None, "active"):
        return
    fresh = [(i, d) for i, d in card if i not in had and d is not None]
    known = q["total"] is not None and p["total"] is not None and q["total"] + sum(d for _, d in fresh) == p["total"]
    run = q["total"]
    for i, d in fresh:
        run = run + d if known else None
        yield "item", f"{i}/{d}/{'' if run is None else run}"
    if q["thru"] is not None and p["thru"] == FULL and q["thru"] < FULL:
        yield "finish", "" if p["total"] is None else str(p["total"])
    if not again or p["position"] is None or q["position"] is None or p["position"] == 1:
        return
    for k in NEAR:
        if p["position"] <= k < q["position"]:
            yield f"top{k}", str(p["position"])
            return
    if not fresh and abs(p["position"] - q["position"]) >= FAR[0] and p["position"] <= FAR[1]:
        yield "move", str(q["position"] - p["position"])


class _Tape(StatefulProcessor):
    """The last snapshot of an entity, and the items of its card by number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long, period int, status string, position long, total long, thru int")
        self.items = handle.getMapState("items", "item int", "against_par int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = ["period", "status", "position", "total", "thru"]
        q = self.last.get() if self.last.exists() else None
        at, q = (q[0], dict(zip(names, q[1:]))) if q is not None else (None, None)
        had = {k[0] for k, _ in self.items.iterator()}
        stored, out = set(had), []
        for r in _rows(rows, ["at_us", *names]).itertuples(index=False):
            if at is not None and r.at_us <= at:
                continue
            p = {n: _plain(getattr(r, n)) for n in names}
            p = {n: int(x) if isinstance(x, float) else x for n, x in p.items()}
            card = _card(r.items)
            if q is not None:
                again = pd.isna(r.row_observed_at) or r.row_observed_at == r.observed_at
                out += [(*key, r.observed_at, kind, detail) for kind, detail in events_between(q, had, p, card, again)]
            at, q, had, last_card = r.at_us, p, {i for i, _ in card}, card
        if q is not None:
            self.last.update((int(at), *(q[n] for n in names)))
        for gone in stored - had:
            self.items.removeKey((gone,))
        for i in had - stored:
            self.items.updateValue((i,), (dict(last_card)[i],))
        yield pd.DataFrame(out, columns=["event_id", "entity_id", "observed_at", "kind", "detail"])

    def close(self) -> None:
        pass


def delta_tape(stream: DataFrame) -> DataFrame:
    """The events of delta_tape_batch from a stream. Late and repeated snapshots are ignored, so of those of one time in
    different batches the one that came first counts."""
    given = snapshot_columns(stream).withColumn("at_us", F.unix_micros("observed_at"))
    return _apply(given, ["event_id", "entity_id"], _Tape(), "event_id long, entity_id long, observed_at timestamp, kind string, detail string")


class _Leaders(StatefulProcessor):
    """The leaders of an event at its last snapshot."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long, leaders array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, before = self.last.get() if self.last.exists() else (None, None)
        given, out = pd.concat(list(rows), ignore_index=True), []
        for now, board in given.groupby("at_us", sort=True):
            if at is not None and now <= at:
                continue
            active = board[board["status"] == "active"]
            first = active[active["position"] == 1]
            leaders = sorted({int(x) for x in first["entity_id"].dropna()})
            if before is not None and leaders and leaders != sorted(before):
                when = board["observed_at"].iloc[0]
                if first["total"].notna().any():
                    out.append((*key, when, "lead" if len(leaders) == 1 else "tie", ",".join(map(str, leaders))))
                still = set(active["entity_id"].dropna().astype(int))
                out += [(*key, when, "lost_lead", str(x)) for x in before if x not in leaders and x in still]
            at, before = int(now), leaders
        if at is not None:
            self.last.update((at, before))
        yield pd.DataFrame(out, columns=["event_id", "observed_at", "kind", "holders"])

    def close(self) -> None:
        pass


def lead_changes(stream: DataFrame) -> DataFrame:
    """The events of lead_changes_batch from a stream, with the leaders of each event as state. All rows of a snapshot come in
    one micro-batch; what is not newer than the last snapshot of the event is ignored."""
    given = stream.select("event_id", "entity_id", F.col("observed_at").cast("timestamp").alias("observed_at"), "status", F.col("position").cast("long").alias("position"), F.col("total").cast("long").alias("total")).withColumn("at_us", F.unix_micros("observed_at"))
    return _apply(given, ["event_id"], _Leaders(), "event_id long, observed_at timestamp, kind string, holders string")


class _Kept(StatefulProcessor):
    """The newest rows of a key, each identity once."""

    def __init__(self, schema: StructType, keys: Sequence[str], cap: int, ttl_ms: int | None):
        self.schema, self.keys, self.cap, self.ttl_ms = schema, list(keys), cap, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", self.schema, self.ttl_ms)
        self.version = handle.getValueState("version", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = self.schema.names
        held = pd.DataFrame([tuple(x) for x in self.kept.get()] if self.kept.exists() else [], columns=names)
        for frame in rows:  # what is held is the cap and one frame
            both = pd.concat([held, frame[names].sort_values(["at_us", *self.keys], kind="stable")], ignore_index=True) if len(held) else frame[names].sort_values(["at_us", *self.keys], kind="stable")
            held = both.drop_duplicates(self.keys, keep="first").sort_values(["at_us", *self.keys], kind="stable", ignore_index=True).tail(self.cap)
        n = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((n,))
        self.kept.put([tuple(_plain(x) for x in r) for r in held.itertuples(index=False, name=None)])
        yield pd.DataFrame({"packed_row": held["packed_row"], "version": n})

    def close(self) -> None:
        pass


def bounded_tape(stream: DataFrame, by: Sequence[str], keys: Sequence[str], ts: str, cap: int, ttl_ms: int | None = None) -> DataFrame:
    """The newest cap rows of each key, each identity (keys, not null) once, after each micro-batch that has rows of it; version
    counts these, so that the rows of the highest one are the tape. Of rows of one identity the one that came first counts, as
    long as it is kept. ttl_ms: state of a key that gets no rows for so long
    goes; that needs a clock, so such a stream runs until it is stopped, and never ends by itself (availableNow). The batch twin is
    keep_newest."""
    given = _packed(stream, by, ts, **{f"key_{k}": F.col(k) for k in keys})
    named = [f"key_{k}" for k in keys]
    held = StructType([f for f in given.schema.fields if f.name in ("at_us", "packed_row", *named)])
    done = _apply(given, by, _Kept(held, named, cap, ttl_ms), "packed_row string, version long", "update", "ProcessingTime" if ttl_ms else "None")
    return _unpacked(done, stream.schema, F.col("version")).select("r.*", "version")


class _Decay(StatefulProcessor):
    """Weight, sum and sum of squares of an entity, as of its newest observation."""

    def __init__(self, tau: float):
        self.tau = tau

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sums", "w double, s double, q double, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        w, s, q, at = self.state.get() if self.state.exists() else (0.0, 0.0, 0.0, None)
        began = at
        for frame in rows:
            t = frame["at_us"].to_numpy(np.int64)
            t = t if began is None else np.maximum(t, began)  # late ones count as of the state
            v = frame["v"].to_numpy(np.float64)
            new = int(t.max()) if at is None else max(at, int(t.max()))
            old = 1.0 if at is None else np.exp(-(new - at) / 86_400e6 / self.tau)
            each = np.exp(-(new - t) / 86_400e6 / self.tau)
            w, s, q, at = w * old + each.sum(), s * old + (each * v).sum(), q * old + (each * v * v).sum(), new
        self.state.update((float(w), float(s), float(q), int(at)))
        yield pd.DataFrame([(key[0], w, s, q, pd.to_datetime(at, unit="us"))], columns=["entity", "weight", "s", "q", "at"])

    def close(self) -> None:
        pass


def decayed_state(stream: DataFrame, entity: str, ts: str, value: str, tau: float = 730.0) -> DataFrame:
    """weight, sum and sum of squares of each entity after each batch, decayed by exp(-days / tau); state is three numbers and a
    time. An observation older than the state is taken without decay, and time never runs back. Null values are left out."""
    given = stream.select(F.col(entity).cast("long").alias("entity"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"), F.col(value).cast("double").alias("v")).where("at_us is not null and v is not null")
    return _apply(given, ["entity"], _Decay(tau), "entity long, weight double, s double, q double, at timestamp", "update")
