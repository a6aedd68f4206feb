"""Causal operators as stateful streams: one small state per signal, kept in the RocksDB state store.

Frames with an event time ``ts`` and a watermark may come in any order and in any split into micro-batches: a frame that
continues its signal is worked on at once, any other waits in the state store until the frames before it have come, or
until the watermark says that they will not come. Without ``ts`` micro-batches must follow the frame order. State goes
from one micro-batch to the next through the query checkpoint, so many small batches give what one batch gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wavelake.operators.stateful import CANCELLER, DEAD_POWER, cancel_frames, frame_arrays, impulse_scan, initial_filter
from wavelake.plans.batches import plain

#: Waiting frames that are worked on together.
TOGETHER = 1024

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB state store; call before starting such a query."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class SignalProcessor(StatefulProcessor):
    """Common part: brings the frames of one signal into order, hands them on in batches and keeps one state row.

    ``waiting`` is the schema of the frames that wait for earlier ones, by frame number; null where batches come in order.
    A frame that comes after its place has been given up, or a second time, is dropped.
    """

    state_schema = ""
    waiting: str | None = None
    names: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)
        if self.waiting:
            self.next_frame = handle.getValueState("next_frame", "frame long")
            self.early = handle.getMapState("early", "frame long", self.waiting)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.waiting:
            self.signal = key[0]
            yield from self._in_order(rows, timerValues.getCurrentWatermarkInMs())
            return
        parts = [part for part in rows if len(part)]
        if parts:
            output, stored = self.step(pd.concat(parts).sort_values("frame", ignore_index=True), self._stored())
            self.state.update(stored)
            yield plain(output)

    def _stored(self):
        return self.state.get() if self.state.exists() else None

    def _in_order(self, rows, watermark: int) -> Iterator[pd.DataFrame]:
        wanted = self.next_frame.get()[0] if self.next_frame.exists() else 0
        began, stored, earliest = wanted, self._stored(), None
        for part in rows:
            part = part[part["frame"] >= wanted].drop_duplicates("frame").sort_values("frame", ignore_index=True)
            run = int((part["frame"].to_numpy() == wanted + np.arange(len(part))).sum())
            for row in part.iloc[run:].itertuples(index=False):
                self.early.updateValue((int(row.frame),), tuple(_stored_value(getattr(row, n)) for n in self.names))
                earliest = row.ts_ms if earliest is None else min(row.ts_ms, earliest)
            if run:
                output, stored = self.step(part.iloc[:run], stored)
                wanted += run
                yield plain(output)
            for ready in self._waited(wanted):
                output, stored = self.step(ready, stored)
                wanted += len(ready)
                yield plain(output)
        if wanted != began:
            self.next_frame.update((wanted,))
            self.state.update(stored)
        if earliest is not None:
            self.handle.registerTimer(int(max(earliest, watermark + 1)))

    def _waited(self, wanted: int) -> Iterator[pd.DataFrame]:
        """The waiting frames that continue the signal, in batches."""
        taken: list[tuple] = []
        while self.early.containsKey((wanted + len(taken),)):
            taken.append(self.early.getValue((wanted + len(taken),)))
            if len(taken) == TOGETHER:
                yield self._released(taken)
                wanted, taken = wanted + len(taken), []
        if taken:
            yield self._released(taken)

    def _released(self, values: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame([tuple(v) for v in values], columns=self.names)
        for number in frame["frame"]:
            self.early.removeKey((int(number),))
        return frame.assign(signal_id=self.signal)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Gives up frames that the watermark has passed: those that wait behind them go on without them."""
        watermark = timerValues.getCurrentWatermarkInMs()
        self.signal = key[0]
        stored, last, left = self._stored(), None, None
        due = []
        for (number,), value in self.early.iterator():
            at = value[self.names.index("ts_ms")]
            if at <= watermark:
                due.append(int(number))
            else:
                left = at if left is None else min(at, left)
        due.sort()
        for first in range(0, len(due), TOGETHER):
            ready = self._released([self.early.getValue((n,)) for n in due[first : first + TOGETHER]])
            output, stored = self.step(ready, stored)
            last = due[first : first + TOGETHER][-1]
            yield plain(output)
        if last is not None:
            for ready in self._waited(last + 1):
                output, stored = self.step(ready, stored)
                last += len(ready)
                yield plain(output)
            self.next_frame.update((last + 1,))
            self.state.update(stored)
        if left is not None:
            self.handle.registerTimer(max(left, watermark + 1))

    def step(self, group: pd.DataFrame, stored):
        raise NotImplementedError

    def close(self) -> None:
        pass


def _stored_value(value):
    """A value of a frame as the state store takes it."""
    if isinstance(value, np.ndarray):
        return value.tolist()
    if isinstance(value, np.generic):
        return value.item()
    return value


class ImpulseProcessor(SignalProcessor):
    state_schema = "floor double, held int"

    def step(self, group, stored):
        floor, held = (stored[0], stored[1]) if stored else (None, 0)
        flag, severity, floor, held = impulse_scan(group["energy"].to_numpy(), floor, held)
        return group[["signal_id", "frame"]].assign(flag=flag, severity=severity), (float(floor), int(held))


class MeanProcessor(SignalProcessor):
    """Running mean per band or bin; subclasses say how a frame is measured and normalised."""

    state_schema = "mean array<double>"

    def __init__(self, alpha: float, start: float, stop: float):
        self.alpha, self.start, self.stop = alpha, start, stop

    def means(self, values: np.ndarray, stored) -> tuple[np.ndarray, list[float]]:
        mean = np.asarray(stored[0]) if stored else np.linspace(self.start, self.stop, values.shape[1])
        out = np.empty_like(values)
        for i, row in enumerate(values):
            mean = self.alpha * mean + (1 - self.alpha) * row
            out[i] = mean
        return out, mean.tolist()


class ErbMeanNormProcessor(MeanProcessor):
    def step(self, group, stored):
        values = np.stack(group["erb"].to_numpy()).astype(np.float64)
        means, state = self.means(values, stored)
        return group[["signal_id", "frame"]].assign(erb_norm=list((values - means) / 40.0)), (state,)


class UnitNormProcessor(MeanProcessor):
    def step(self, group, stored):
        spec = np.stack(group["re"].to_numpy()) + 1j * np.stack(group["im"].to_numpy())
        means, state = self.means(np.abs(spec), stored)
        spec = spec / np.sqrt(means)
        return group[["signal_id", "frame"]].assign(re=list(spec.real), im=list(spec.imag)), (state,)


class OverlapAddProcessor(SignalProcessor):
    state_schema = "memory array<double>"

    def __init__(self, hop: int):
        self.hop = hop

    def step(self, group, stored):
        memory = np.asarray(stored[0]) if stored else np.zeros(self.hop)
        out = []
        for frame in group["x"]:
            frame = np.asarray(frame, dtype=np.float64)
            out.append(frame[: self.hop] + memory)
            memory = frame[self.hop :]
        return group[["signal_id", "frame"]].assign(y=out), (memory.tolist(),)


class CancellerProcessor(SignalProcessor):
    state_schema = "w_re array<double>, w_im array<double>, mask array<double>"

    def __init__(self, **overrides: float):
        self.params = {**CANCELLER, **overrides}

    def step(self, group, stored):
        frames = frame_arrays(group)
        state = initial_filter(frames["mask"].shape[1])
        if stored:
            re, im, mask = (np.asarray(v, np.float64) for v in stored)
            state = {"w": re + 1j * im, "mask": mask}
        frames["bypass"] = group["ref_clipped"].to_numpy(dtype=bool) | (np.mean(np.abs(frames["x"]) ** 2, axis=1) < DEAD_POWER)
        s, z = frames["s"], cancel_frames(state, frames, self.params)["z"]
        louder = (np.abs(z) ** 2).sum(axis=1) > (np.abs(s) ** 2).sum(axis=1)
        z = np.where(louder[:, None], s, z)
        out = group[["signal_id", "frame"]].assign(z_re=list(z.real), z_im=list(z.imag))
        return out, (state["w"].real.tolist(), state["w"].imag.tolist(), state["mask"].tolist())


def _apply(frames: DataFrame, processor: SignalProcessor, columns: str) -> DataFrame:
    """Frames with ``ts`` and a watermark are put in order by event time; see `SignalProcessor`."""
    head = [frames.schema["signal_id"], frames.schema["frame"]]
    schema = T.StructType(head + T.StructType.fromDDL(columns).fields)
    timed = "ts" in frames.columns
    if timed:
        frames = frames.withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp")))
        fields = [f for f in frames.schema.fields if f.name not in ("signal_id", "ts")]
        processor.waiting = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
        processor.names = [f.name for f in fields]
    return frames.groupBy("signal_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime" if timed else "None"
    )


def impulse_flags(energies: DataFrame) -> DataFrame:
    """(signal_id, frame, energy) to (signal_id, frame, flag, severity)."""
    return _apply(energies, ImpulseProcessor(), "flag BOOLEAN, severity DOUBLE")


def erb_mean_norm(frames: DataFrame, alpha: float = 0.99) -> DataFrame:
    """(signal_id, frame, erb ARRAY) to (signal_id, frame, erb_norm ARRAY)."""
    return _apply(frames, ErbMeanNormProcessor(alpha, -60.0, -90.0), "erb_norm ARRAY<DOUBLE>")


def unit_norm(frames: DataFrame, alpha: float = 0.99) -> DataFrame:
    """(signal_id, frame, re ARRAY, im ARRAY) normalised by the running mean magnitude."""
    return _apply(frames, UnitNormProcessor(alpha, 1e-3, 1e-4), "re ARRAY<DOUBLE>, im ARRAY<DOUBLE>")


def overlap_add(frames: DataFrame, hop: int) -> DataFrame:
    """(signal_id, frame, x ARRAY) to the finished hop of every frame."""
    return _apply(frames, OverlapAddProcessor(hop), "y ARRAY<DOUBLE>")


def nlms_cancel(frames: DataFrame, **overrides: float) -> DataFrame:
    """Streaming form of the residual canceller; the input is that of the batch form."""
    return _apply(frames, CancellerProcessor(**overrides), "z_re ARRAY<DOUBLE>, z_im ARRAY<DOUBLE>")
