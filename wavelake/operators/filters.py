"""Recursive filters run forward and backward over signals of any length, on block arrays.

A filter of n states maps a block to its output and to the state after it: state' = A^length state + what the block alone
leaves behind. One pass over the blocks gives what each leaves behind, a fold over one small row for each block gives the
state that each starts from, and a second pass gives the output. The same is done in reverse. Ends are treated as
forward-backward filters usually do: the signal goes on beyond both ends as its point reflection, and the filter starts
in the state of rest for the first sample.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelake.plans.batches import plain
from wavelake.plans.ordered import BLOCK, fold_blocks, join_on, with_block
from wavelake.session import settled

#: Samples that are filtered with one matrix product.
STRIDE = 64


def butterworth(low_hz: float | None, high_hz: float | None, rate: float, order: int = 4) -> np.ndarray:
    """Second-order sections (b0, b1, b2, a0, a1, a2) of a Butterworth filter of even order.

    ``low_hz`` alone is a high-pass, ``high_hz`` alone a low-pass, both a band-pass of twice the order. The poles of the
    analogue low-pass are moved to the band and brought to discrete time by the bilinear transform.
    """
    if order % 2:
        raise ValueError("the order has to be even")
    angle = np.pi * (2 * np.arange(order // 2) + 1) / (2 * order)
    poles = -np.sin(angle) + 1j * np.cos(angle)  # of the upper half plane
    warp = lambda hz: np.tan(np.pi * hz / rate)
    if low_hz and high_hz:
        a, b = warp(low_hz), warp(high_hz)
        half = poles * (b - a) / 2
        root = np.sqrt(half * half - a * b)
        poles, zeros = np.concatenate([half + root, half - root]), (1.0, -1.0)
        gain, middle = (b - a) ** order, np.exp(2j * np.arctan(np.sqrt(a * b)))
    elif low_hz:
        poles, zeros, middle = warp(low_hz) / poles, (1.0, 1.0), -1.0
    else:
        poles, zeros, middle = warp(high_hz) * poles, (-1.0, -1.0), 1.0
    discrete = (1 + poles) / (1 - poles)
    sections = np.array([[1, -sum(zeros), zeros[0] * zeros[1], 1, -2 * p.real, abs(p) ** 2] for p in discrete])
    # The response is one in the middle of the band.
    at = np.array([1, 1 / middle, 1 / middle**2])
    sections[0, :3] /= abs(np.prod((sections[:, :3] @ at) / (sections[:, 3:] @ at)))
    return sections


@dataclass(frozen=True)
class StateSpace:
    """The sections in a row: state' = a state + b x, y = c state + d x."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float

    @property
    def rest(self) -> np.ndarray:
        """State in which a signal that is one throughout has always been."""
        return np.linalg.solve(np.eye(len(self.b)) - self.a, self.b)


def state_space(sections: np.ndarray) -> StateSpace:
    a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
    for b0, b1, b2, _, a1, a2 in sections:
        own = np.array([[-a1, 1.0], [-a2, 0.0]])
        enter = np.array([b1 - a1 * b0, b2 - a2 * b0])
        n = len(b)
        whole = np.zeros((n + 2, n + 2))
        whole[:n, :n], whole[n:, :n], whole[n:, n:] = a, np.outer(enter, c), own
        a, b = whole, np.concatenate([b, enter * d])
        c, d = np.concatenate([b0 * c, [1.0, 0.0]]), b0 * d
    return StateSpace(a, b, c, d)


class BlockFilter:
    """Filters arrays from a given state, STRIDE samples at a time."""

    def __init__(self, sections: np.ndarray):
        self.space = space = state_space(np.asarray(sections, float))
        n, m = len(space.b), STRIDE
        powers = [np.eye(n)]
        for _ in range(m):
            powers.append(space.a @ powers[-1])
        answer = np.array([space.d, *(space.c @ powers[k] @ space.b for k in range(m - 1))])
        lag = np.arange(m)[:, None] - np.arange(m)[None, :]
        self.toeplitz = np.where(lag >= 0, answer[np.abs(lag)], 0.0)
        self.observed = np.array([space.c @ powers[k] for k in range(m)])
        self.reached = np.array([powers[m - 1 - k] @ space.b for k in range(m)])
        self.powers = powers
        self.far: dict[int, np.ndarray] = {}

    def power(self, length: int) -> np.ndarray:
        """What remains of a state after so many samples; blocks have few lengths."""
        if length not in self.far:
            self.far[length] = np.linalg.matrix_power(self.space.a, length)
        return self.far[length]

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output and the state after it."""
        whole = len(x) // STRIDE
        parts = x[: whole * STRIDE].reshape(whole, STRIDE)
        enter = parts @ self.reached
        states = np.empty((whole, len(state)))
        jump = self.powers[STRIDE]
        for k in range(whole):
            states[k] = state
            state = jump @ state + enter[k]
        y = parts @ self.toeplitz.T + states @ self.observed.T
        rest = x[whole * STRIDE :]
        r = len(rest)
        tail = self.toeplitz[:r, :r] @ rest + self.observed[:r] @ state
        return np.concatenate([y.ravel(), tail]), self.powers[r] @ state + rest @ self.reached[STRIDE - r :]


def reach_beyond(sections: np.ndarray) -> int:
    """Samples that the signal goes on for beyond each end."""
    return 3 * (2 * len(sections) + 1 - min(int((sections[:, 2] == 0).sum()), int((sections[:, 5] == 0).sum())))


def _rows_of(blocks: Iterator[pd.DataFrame], names: Sequence[str], one) -> Iterator[pd.DataFrame]:
    for batch in blocks:
        rows = [one(row) for row in batch.itertuples(index=False)]
        yield plain(pd.DataFrame(rows, columns=list(names)))


def forward_backward(
    samples: DataFrame, sections: np.ndarray, column: str = "x", keys: Sequence[str] = ("signal_id",), size: int = BLOCK
) -> DataFrame:
    """Filters every signal forward and backward: (keys, t, block, column).

    The samples of a signal are taken in the order of t; positions that are missing do not count. A signal that is
    shorter than the reach of the filter goes on beyond its ends by its own length less one. Null and NaN samples make
    the output NaN from there on, as in any recursion. An empty table gives no rows.
    """
    keys = list(keys)
    on = [*keys, "block"]
    pad = reach_beyond(np.asarray(sections))
    head = [samples.schema[k] for k in keys] + [T.StructField("block", T.LongType())]
    names = lambda schema: [f.name for f in schema.fields]
    schema = lambda columns: T.StructType([*head, *T.StructType.fromDDL(columns).fields])
    rows = with_block(samples.select(*keys, "t", F.col(column).cast("double").alias("x")), "t", size)
    packed = rows.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("_s"))
    blocks = settled(packed.select(*on, F.transform("_s", lambda s: s["t"]).alias("t"), F.transform("_s", lambda s: s["x"]).alias("x")))
    key_of = lambda row: [getattr(row, k) for k in keys]

    # What each block leaves behind, and its ends.
    ends = schema("n bigint, left array<double>, first array<double>, last array<double>")

    def leave(backward: bool):
        def run(batches):
            filter_ = BlockFilter(sections)
            nothing = np.zeros(len(filter_.space.b))

            def one(row):
                x = np.asarray(row.x, float)
                _, left = filter_.run(x[::-1] if backward else x, nothing)
                return (*key_of(row), row.block, len(x), left, x[: pad + 1], x[-pad - 1 :])

            yield from _rows_of(batches, names(ends), one)

        return run

    # The first and the last samples of a signal, however its blocks are filled.
    def gather(state, row):
        first, last, n = state
        first = np.concatenate([first, row.first])[: pad + 1] if len(first) <= pad else first
        last = np.concatenate([last, row.last])[-pad - 1 :]
        return (first, last, n + row.n), (first.tolist(), last.tolist(), n + row.n)

    forward = settled(blocks.mapInPandas(leave(False), ends))
    nothing = lambda: (np.empty(0), np.empty(0), 0)
    told = fold_blocks(forward, keys, nothing, gather, "first array<double>, last array<double>, samples bigint")
    whole = told.groupBy(*keys).agg(
        F.max_by(F.struct("first", "last", "samples", "block"), "block").alias("_w")
    ).select(*keys, F.col("_w.first").alias("head"), F.col("_w.last").alias("tail"), F.col("_w.samples").alias("samples"), F.col("_w.block").alias("final"))
    whole = settled(whole)

    def begin_forward(filter_, row):
        edge = np.asarray(row.head)
        reach = min(pad, int(row.samples) - 1)
        before = 2 * edge[0] - edge[1 : reach + 1][::-1]
        start = before[0] if reach else edge[0]
        return filter_.run(before, filter_.space.rest * start)[1]

    def carry(begin, left):
        filter_ = BlockFilter(sections)

        def step(state, row):
            state = begin(filter_, row) if state is None else state
            return filter_.power(int(row.n)) @ state + np.asarray(getattr(row, left)), (state.tolist(),)

        return step

    starts = fold_blocks(join_on(forward, whole, keys), keys, lambda: None, carry(begin_forward, "left"), "state array<double>")
    ready = join_on(join_on(blocks, starts, on), whole.select(*keys, "tail", "samples", "final"), keys)
    once = schema("t array<bigint>, x array<double>, back array<double>")

    def filtered(batches):
        filter_ = BlockFilter(sections)

        def one(row):
            y, state = filter_.run(np.asarray(row.x, float), np.asarray(row.state))
            back = None
            if row.block == row.final:
                edge = np.asarray(row.tail)
                reach = min(pad, int(row.samples) - 1)
                beyond = filter_.run(2 * edge[-1] - edge[-reach - 1 : -1][::-1], state)[0] if reach else y[-1:]
                back = filter_.space.rest * beyond[-1]
                back = filter_.run(beyond[::-1], back)[1] if reach else back
            return (*key_of(row), row.block, row.t, y, back)

        yield from _rows_of(batches, names(once), one)

    halfway = settled(ready.mapInPandas(filtered, once))
    backward = halfway.mapInPandas(leave(True), ends).select(*on, "n", "left")
    backward = join_on(backward, halfway.select(*on, "back"), on)
    states = fold_blocks(
        backward, keys, lambda: None, carry(lambda _, row: np.asarray(row.back), "left"), "state array<double>", backward=True
    )
    final = schema("t array<bigint>, x array<double>")

    def reversed_(batches):
        filter_ = BlockFilter(sections)

        def one(row):
            y, _ = filter_.run(np.asarray(row.x, float)[::-1], np.asarray(row.state))
            return (*key_of(row), row.block, row.t, y[::-1])

        yield from _rows_of(batches, names(final), one)

    done = join_on(halfway.select(*on, "t", "x"), states, on).mapInPandas(reversed_, final)
    pairs = done.select(*on, F.explode(F.arrays_zip("t", "x")).alias("p"))
    return pairs.select(*keys, F.col("p.t").alias("t"), "block", F.col("p.x").alias(column))
