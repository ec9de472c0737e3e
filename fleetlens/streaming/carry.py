"""Carried-state checks over a live line stream (OP-40, OP-41, OP-48): state keyed by file.

The batch forms scan whole files in line order.  Live, the lines of a file arrive in many
micro-batches; what a check carries from line to line - the open section and its values so far,
the last header, the last flag - is the file's state in a state store, a few fields whatever the file's length.
An event-time timer ends a file that has been idle: its open section or last row is put out and its state
goes, so state follows the files in use, not the history.  State and progress live in the
query's checkpoint, and a restart goes on where it stopped.

Lines are parsed by Spark before they reach the state, and only those that matter are sent.  A
micro-batch's lines of one file are folded in the order of ``seq``, which must grow within a file; a
line that comes after a later one of its file was folded in an earlier batch is left out, as is one behind the watermark.  What one
file brings in one batch is held in memory: bound it with the source's files or bytes per trigger.

The stream needs the columns ``file``, ``seq``, ``value`` and an ``event_time`` with a
watermark.  The state store must be RocksDB (``STATE_CONF``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import awk_field
from ..operators.fleet import CACHE_PROBLEM, process_values
from ..session import ship_package

#: what a session must set before it starts one of these streams
STATE_CONF = {"spark.sql.streaming.stateStore.providerClass":
              "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: a file without lines for this long (in event time) is complete
IDLE_MS = 3_600_000


class _Fold(StatefulProcessor):
    """Folds a file's lines in order: ``step`` takes the carried fields and new rows, ``last`` ends a file.

    All lines of a file go through one worker, so a step that sees many lines works on whole columns."""

    carried: T.StructType
    columns: list[str]

    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [T.StructField("seq", T.LongType()), T.StructField("until", T.LongType()), *self.carried.fields]
        self.state = handle.getValueState("carry", T.StructType(fields))

    def step(self, carry: dict, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def last(self, carry: dict) -> Iterator[dict]:
        return iter(())

    def _frame(self, file: str, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(rows):
            yield rows[self.columns].astype(object).assign(file=file)[["file", *self.columns]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = ["seq", "until", *(f.name for f in self.carried.fields)]
        carry = dict(zip(names, self.state.get())) if self.state.exists() else dict.fromkeys(names)
        new = pd.concat(list(rows))
        if not new["seq"].is_monotonic_increasing:
            new = new.sort_values("seq", kind="stable")
        if carry["seq"] is not None:
            new = new[new["seq"] > carry["seq"]]
        if not len(new):
            return
        out = self.step(carry, new)
        until = int(new["event_time"].max().timestamp() * 1000) + self.idle_ms
        if carry["until"] is None or until > carry["until"]:
            if carry["until"] is not None:
                self.handle.deleteTimer(carry["until"])
            self.handle.registerTimer(until)
            carry["until"] = until
        carry["seq"] = int(new["seq"].iloc[-1])
        self.state.update(tuple(carry[n] for n in names))
        yield from self._frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            names = ["seq", "until", *(f.name for f in self.carried.fields)]
            out = list(self.last(dict(zip(names, self.state.get()))))
            self.state.clear()
            yield from self._frame(key[0], pd.DataFrame(out, columns=self.columns, dtype=object))

    def close(self) -> None:
        pass


def _known(v):
    """A Python value, None where pandas has a missing one."""
    return None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v


class _Sections(_Fold):
    """Process listing: the values of the open section; a header or the idle timer puts it out."""

    values = ["max_overall", "total_running", "max_user", "total_mem", "free_mem"]
    carried = T.StructType([T.StructField("server", T.StringType()), T.StructField("user_running", T.LongType()),
                            *[T.StructField(c, T.LongType()) for c in values]])
    columns = ["server", "max_overall", "total_running", "max_user", "user_running", "total_mem", "free_mem"]

    def step(self, carry, rows):
        """Every header begins a section; the lines before the first one go on with the carried section."""
        section = rows["server"].notna().to_numpy().cumsum()
        by = rows.groupby(section, sort=True)
        each = by[self.values].last().astype("Float64").astype("Int64").assign(server=by["server"].first(), user_running=by["user_running"].sum())
        if section[0] == 0 and carry["server"] is not None:
            more = each.loc[0]
            carry["user_running"] += int(more["user_running"])
            carry.update({c: int(more[c]) for c in self.values if not pd.isna(more[c])})
        each = each.loc[1:]
        if not len(each):
            return each
        closed = pd.DataFrame(list(self.last(carry)), columns=self.columns, dtype=object)
        done = each.iloc[:-1].fillna({"total_running": 0})[self.columns].astype(object)
        newest = each.iloc[-1]
        carry.update({c: None if pd.isna(newest[c]) else int(newest[c]) for c in self.values},
                     server=newest["server"], user_running=int(newest["user_running"]))
        return pd.concat([closed, done.where(done.notna(), None)])

    def last(self, carry):
        if carry["server"] is not None:
            yield {c: carry[c] for c in self.columns} | {"total_running": carry["total_running"] or 0}


class _Realms(_Fold):
    """Lookup listing: the last label, and the last site row, which is held until it is known whether another follows."""

    carried = T.StructType([T.StructField("label", T.StringType()), T.StructField("held_seq", T.LongType()),
                            T.StructField("held_label", T.StringType()), T.StructField("held_site", T.StringType())])
    columns = ["seq", "label", "site", "chosen"]

    def step(self, carry, rows):
        return pd.DataFrame(list(self._steps(carry, rows)), columns=self.columns, dtype=object)

    def _steps(self, carry, rows):
        for r in rows.itertuples(index=False):
            if (label := _known(r.label)) is not None:
                carry["label"] = label
            if r.is_site:
                yield from self._held(carry, False)
                carry.update(held_seq=int(r.seq), held_label=carry["label"], held_site=_known(r.site))

    def last(self, carry):
        return self._held(carry, True)

    def _held(self, carry, chosen):
        if carry["held_seq"] is not None:
            yield {"seq": carry["held_seq"], "label": carry["held_label"], "site": carry["held_site"], "chosen": chosen}


class _Audit(_Fold):
    """Cache audit: how many lines were seen, and whether the last marked line was a problem without ``Enabled``."""

    carried = T.StructType([T.StructField("seen", T.LongType()), T.StructField("pending", T.BooleanType())])
    columns = ["seq", "value", "kind", "highlight"]

    def __init__(self, head: int, idle_ms: int = IDLE_MS):
        super().__init__(idle_ms)
        self.head = head

    def step(self, carry, rows):
        seen = carry["seen"] or 0
        first = rows.iloc[:max(self.head - seen, 0)].assign(kind="head", highlight=False)
        marked = rows[rows["enabled"] | rows["problem"]]
        pending = (~marked["enabled"]).shift(fill_value=bool(carry["pending"]))
        shown = marked.assign(kind="enabled", highlight=marked["problem"] | pending)[marked["enabled"]]
        carry.update(seen=seen + len(first), pending=not marked["enabled"].iloc[-1] if len(marked) else bool(carry["pending"]))
        return pd.concat([first, shown])


def _after_watermark(cond: Column) -> Column:
    """The condition, tied to the event time, so that it stays above the watermark and all lines move it."""
    return F.when(F.col("event_time").isNotNull(), cond)


def _run(rows: DataFrame, fold: _Fold, schema: str) -> DataFrame:
    ship_package(rows.sparkSession)
    return rows.groupBy("file").transformWithStateInPandas(fold, schema, "Append", "EventTime")


def process_capacity_stream(lines: DataFrame, user: str, idle_ms: int = IDLE_MS) -> DataFrame:
    """Live ``process_capacity``: a section is put out when the next one begins, or its file is idle.

    Only lines that carry a value are sent to the state, as numbers."""
    rows = process_values(lines.filter(~F.col("value").contains("defunct")), user)
    values = ["max_overall", "total_running", "max_user", "total_mem", "free_mem"]
    some = F.col("server").isNotNull() | (F.col("user_running") > 0)
    for c in values:
        some = some | F.col(c).isNotNull()
    rows = rows.filter(_after_watermark(some)).select("file", "seq", "event_time", "server", "user_running", *values)
    out = _run(rows, _Sections(idle_ms), "file string, server string, max_overall long, total_running long, max_user long, "
               "user_running long, total_mem long, free_mem long")
    return (out.withColumn("flag_user_at_max", F.col("user_running") >= F.col("max_user"))
            .withColumn("flag_low_mem", F.try_divide(F.col("free_mem"), F.col("total_mem")) < 0.2))


def resolve_sections_stream(lines: DataFrame, labels: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Live ``resolve_sections``: a site row is put out when the next one arrives; the last one of an idle file is ``chosen``."""
    v = F.col("value")
    label = F.when(v.startswith("["), F.expr("substring(value, 2, length(value) - 3)"))
    site = v.startswith(" ")
    rows = lines.select("file", "seq", "event_time", label.alias("label"), site.alias("is_site"), F.when(site, awk_field(v, 1)).alias("site"))
    rows = rows.filter(_after_watermark(F.col("label").isNotNull() | F.col("is_site")))
    out = _run(rows, _Realms(idle_ms), "file string, seq long, label string, site string, chosen boolean")
    return out.join(labels, "label", "left")


def cache_audit_stream(lines: DataFrame, head: int = 10, idle_ms: int = IDLE_MS) -> DataFrame:
    """Live ``cache_audit``: every ``Enabled`` line as it comes, highlighted after a problem; the first ``head`` lines too."""
    v = F.col("value")
    rows = lines.select("file", "seq", "event_time", "value", F.coalesce(v.contains("Enabled"), F.lit(False)).alias("enabled"),
                        F.coalesce(v.rlike(CACHE_PROBLEM), F.lit(False)).alias("problem"))
    if not head:
        rows = rows.filter(_after_watermark(F.col("enabled") | F.col("problem")))
    return _run(rows, _Audit(head, idle_ms), "file string, seq long, value string, kind string, highlight boolean")


def read_segments(spark: SparkSession, folder: str, schema: str, late: str = "0 seconds", files_per_trigger: int = 1) -> DataFrame:
    """A stream of stored line segments (Parquet files that land in ``folder``), some files a micro-batch."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
            .withWatermark("event_time", late))


def event_time(column: str | Column) -> Column:
    """A column as the ``event_time`` of a line stream."""
    return (F.col(column) if isinstance(column, str) else column).cast("timestamp").alias("event_time")
