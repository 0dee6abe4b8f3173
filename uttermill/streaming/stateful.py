"""Stateful operators: framing of samples, speech detection with hysteresis, and a registry of names.

Each has one step function that takes the state so far and new rows. The batch form runs it over a whole group, the
stream form over micro-batches with the state kept by Structured Streaming, so both give the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# ---------------------------------------------------------------- framing


def framed(rest: list[float], samples: list[float], length: int, shift: int, first: int) -> tuple[list[tuple[int, list[float]]], list[float], int]:
    """Whole frames from the samples left over and the new ones: numbered frames, what is left, and the next number."""
    have, out, at = [*rest, *samples], [], 0
    while at + length <= len(have):
        out.append((first, have[at : at + length]))
        first += 1
        at += shift
    return out, have[at:], first


def stream_frames(samples: DataFrame, length: int = 400, shift: int = 160) -> DataFrame:
    """``utt, seq, samples ARRAY<DOUBLE>`` as they arrive to ``utt, frame_no, frame``; what is left over waits for more.

    Within a micro-batch chunks are put in order of ``seq``; chunks of later batches are later.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, first = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], 0)
        pdf = pd.concat(list(frames)).sort_values("seq", kind="stable")
        new = [float(x) for chunk in pdf["samples"] for x in chunk]
        out, rest, first = framed(rest, new, length, shift, first)
        state.update((json.dumps(rest), first))
        yield pd.DataFrame({"utt": [key[0]] * len(out), "frame_no": [i for i, _ in out], "frame": [f for _, f in out]})

    return samples.groupBy("utt").applyInPandasWithState(step, "utt string, frame_no long, frame array<double>", "rest string, first long", "append", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- speech detection


class Hysteresis:
    """Speech begins at a probability of ``on`` and ends once it has stayed below ``on - 0.15`` for a while.

    Times are samples. A stretch counts if it is longer than ``least_speech``; the one that is open at the end always does.
    """

    def __init__(self, on: float = 0.5, step: int = 1_536, rate: int = 16_000, least_speech_ms: int = 250, least_silence_ms: int = 100, pad_ms: int = 30, least_result_s: float = 0.255):
        self.on, self.off, self.step, self.rate = on, on - 0.15, step, rate
        self.least_speech, self.least_silence, self.pad = (rate * x / 1000 for x in (least_speech_ms, least_silence_ms, pad_ms))
        self.least_result = least_result_s

    def feed(self, start: int | None, quiet: int | None, i: int, p: float) -> tuple[int | None, int | None, tuple[int, int] | None]:
        """One probability: the open stretch's start, where its silence began, and a stretch that has just ended."""
        at = i * self.step
        if p >= self.on:
            return (at if start is None else start), None, None
        if p < self.off and start is not None:
            # A silence that begins at sample 0 cannot be: speech began before it.
            quiet = at if quiet is None else quiet
            if at - quiet >= self.least_silence:
                return None, None, ((start, quiet) if quiet - start > self.least_speech else None)
        return start, quiet, None

    def padded(self, stretches: list[tuple[int, int]], total: int) -> list[tuple[float, float]]:
        """Stretches widened by the padding, in seconds; too short ones go.

        A silence that two paddings would fill is shared out in halves; a longer one gives its padding to the stretch
        before it. The outer edges stay within the recording.
        """
        if not stretches:
            return []
        begin, end = np.array(stretches, np.float64).T
        silence = begin[1:] - end[:-1]
        shared = silence < 2 * self.pad
        half = np.where(shared, silence // 2, 0.0)
        begin[1:] = np.maximum(begin[1:] - half, 0.0)
        end[:-1] += np.where(shared, half, np.floor(self.pad))
        begin[0], end[-1] = np.floor(max(begin[0] - self.pad, 0.0)), np.floor(min(end[-1] + self.pad, total))
        long = (end - begin) / self.rate >= self.least_result
        return list(zip((begin[long] / self.rate).tolist(), (end[long] / self.rate).tolist()))


def speech_stretches(probs: DataFrame, **options) -> DataFrame:
    """``utt, i, prob`` of whole recordings to padded ``utt, begin, end`` in seconds."""
    rule = Hysteresis(**options)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", kind="stable")
        start = quiet = None
        found: list[tuple[int, int]] = []
        for i, p in zip(pdf["i"].tolist(), pdf["prob"].tolist()):
            start, quiet, ended = rule.feed(start, quiet, i, p)
            found += [ended] if ended else []
        total = (int(pdf["i"].max()) + 1) * rule.step
        if start is not None:
            found.append((start, total))
        out = rule.padded(found, total)
        return pd.DataFrame({"utt": pdf["utt"].iloc[0], "begin": [b for b, _ in out], "end": [e for _, e in out]})

    return probs.dropna().groupBy("utt").applyInPandas(run, "utt string, begin double, end double")


def stream_speech(probs: DataFrame, **options) -> DataFrame:
    """Raw stretches ``utt, begin_sample, end_sample`` of a stream of ``utt, i, prob``, each as soon as it has ended."""
    rule = Hysteresis(**options)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, quiet = (x if x >= 0 else None for x in state.get) if state.exists else (None, None)
        pdf = pd.concat(list(frames)).sort_values("i", kind="stable")
        found = []
        for i, p in zip(pdf["i"].tolist(), pdf["prob"].tolist()):
            start, quiet, ended = rule.feed(start, quiet, i, p)
            found += [ended] if ended else []
        state.update((-1 if start is None else start, -1 if quiet is None else quiet))
        yield pd.DataFrame({"utt": [key[0]] * len(found), "begin_sample": [b for b, _ in found], "end_sample": [e for _, e in found]})

    return probs.groupBy("utt").applyInPandasWithState(step, "utt string, begin_sample long, end_sample long", "start long, quiet long", "append", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- registry


def registered(people: DataFrame) -> DataFrame:
    """``name, seq, emb``: the first registration of each name, of equal ``seq`` the smaller vector; the batch form of :func:`stream_registry`."""
    return people.groupBy("name").agg(F.min(F.struct("seq", "emb")).alias("r")).select("name", "r.seq", "r.emb")


def stream_registry(people: DataFrame) -> DataFrame:
    """``name, seq, emb`` as they register to the first registration of each name; later ones are ignored."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames))
        if not state.exists:
            state.update((True,))
            yield pdf.sort_values("seq", kind="stable").head(1)[["name", "seq", "emb"]]

    return people.groupBy("name").applyInPandasWithState(step, "name string, seq long, emb array<double>", "known boolean", "append", GroupStateTimeout.NoTimeout)
