"""A live loop detector: keyed state over a stream of labelled beats."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TAIL = 64  # beats that a session's state keeps


def loop_of(labels: list[str], shortest: int = 4, longest: int = 32, least: float = 0.65) -> tuple[int, float] | None:
    """The smallest period, up to half the beats, at which at least a share ``least`` of the labels recurs."""
    for p in range(shortest, min(longest, len(labels) // 2) + 1):
        same = sum(a == b for a, b in zip(labels, labels[p:], strict=False)) / (len(labels) - p)
        if same >= least:
            return p, same
    return None


def votes(labels: list[str], period: int) -> tuple[list[str], list[float]]:
    """For each slot of the loop the label most often heard, the first heard of equals, and its share."""
    slots = [Counter(labels[i::period]).most_common(1)[0] for i in range(period)]
    return [x for x, _ in slots], [round(n / len(labels[i::period]), 3) for i, (_, n) in enumerate(slots)]


def detect_loops(beats: DataFrame, shortest: int = 4, longest: int = 32, least: float = 0.65, tail: int = TAIL) -> DataFrame:
    """For every session of the stream ``beats`` (session string, beat long, label string) that a batch
    touches: beats heard so far, the loop's period and score (null while there is none), labels and shares.

    The loop is found anew from the last ``tail`` beats, which with their count are all the state; rows
    of a batch are put in order of beat, a null label counts as N. Use the update output mode.
    """

    def run(key, frames, state: GroupState):
        n, kept = state.get if state.exists else (0, [])
        new = pd.concat(list(frames)).sort_values("beat", kind="stable")
        kept = [*kept, *(x if isinstance(x, str) else "N" for x in new["label"])][-tail:]
        n += len(new)
        state.update((n, kept))
        found = loop_of(kept, shortest, longest, least)
        names, share = votes(kept, found[0]) if found else (None, None)
        yield pd.DataFrame([{"session": key[0], "n_beats": n, "period": found and found[0], "score": found and found[1], "labels": names, "shares": share}])

    return beats.select("session", "beat", "label").groupBy("session").applyInPandasWithState(
        run, "session string, n_beats long, period int, score double, labels array<string>, shares array<double>", "n long, kept array<string>", "update", GroupStateTimeout.NoTimeout
    )


def part_change(labels: list[str], period: int, least_beats: int, rate: float = 0.6) -> int | None:
    """Where a new part begins: after two whole loops or more, the start of the last max(period, ``least_beats``) beats if a share
    ``rate`` of them differs from the voted loop."""
    if len(labels) // period < 2:
        return None
    names, _ = votes(labels, period)
    tail = min(max(period, least_beats), len(labels))
    at = len(labels) - tail
    wrong = sum(x != names[(at + i) % period] for i, x in enumerate(labels[at:]))
    return at if wrong / tail >= rate else None


def follow_parts(beats: DataFrame, least_beats: int = 12, tail: int = TAIL) -> DataFrame:
    """The finished parts of every session of the stream ``beats`` (session string, beat long, label string, stop boolean): session, part
    (from 0), n_beats, period and labels of its loop.

    A part ends when the recent beats leave its loop, or when a row says ``stop`` (then also without a loop: period is null), after which
    the session begins anew. The state is the last ``tail`` beats of the part and its numbers. Use the append output mode.
    """

    def run(key, frames, state: GroupState):
        part, n, kept = state.get if state.exists else (0, 0, [])
        out = []

        def finish(found, length):
            out.append({"session": key[0], "part": part, "n_beats": length, "period": found and found[0], "labels": votes(kept, found[0])[0] if found else None})

        for label, stop in pd.concat(list(frames)).sort_values("beat", kind="stable")[["label", "stop"]].itertuples(index=False):
            if stop is True or stop == 1:
                finish(loop_of(kept), n)
                part, n, kept = 0, 0, []
                continue
            kept = [*kept, label if isinstance(label, str) else "N"][-tail:]
            n += 1
            found = loop_of(kept)
            at = part_change(kept, found[0], least_beats) if found else None
            if at is not None:
                finish(found, n - (len(kept) - at))
                part, n, kept = part + 1, len(kept) - at, kept[at:]
        state.update((part, n, kept))
        yield pd.DataFrame(out, columns=["session", "part", "n_beats", "period", "labels"]).astype({"period": "Int32"})

    return beats.select("session", "beat", "label", "stop").groupBy("session").applyInPandasWithState(
        run, "session string, part int, n_beats long, period int, labels array<string>", "part int, n long, kept array<string>", "append", GroupStateTimeout.NoTimeout
    )
