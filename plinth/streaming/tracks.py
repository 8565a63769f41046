"""Obstacle tracks: what was sighted frame by frame, told apart and followed. Batch and stream share one step.

A frame goes through four steps: the distances of sightings and tracks that may belong together, a one-to-one choice among them, the tracks after it, and what is left of the sightings.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed values of obstacle tracks: metres within which a sighting is of a track, sightings that confirm it, clear looks that end it, seconds it lives unseen, the share of a newest velocity, the seconds that a velocity takes, and the speed of what moves.
NEAR, CONFIRM, CLEAR_LOOKS, TTL, VELOCITY_GAIN, VELOCITY_TIME, MOVING = 1.0, 2, 3, {"PERSON": 10.0, "UNCLASSIFIED": 30.0}, 0.5, 0.2, 0.4
SIGHTINGS = ("floor", "t", "id", "category", "x", "y", "confidence", "uncertainty")
TRACKS = "floor long, track long, category string, x double, y double, first_t double, last_t double, hits int, misses int, vx double, vy double, status string"
#: A track while it is followed; velocities are NaN until they are known.
_STATE = np.dtype([("track", "i8"), ("person", "?"), ("x", "f8"), ("y", "f8"), ("uncertainty", "f8"), ("first_t", "f8"), ("last_t", "f8"), ("hits", "i8"), ("misses", "i8"), ("vx", "f8"), ("vy", "f8")])
#: A sighting; clear says that nothing was seen there.
_SEEN = np.dtype([("clear", "?"), ("person", "?"), ("x", "f8"), ("y", "f8"), ("confidence", "f8"), ("uncertainty", "f8")])


#: Pairs of sightings and tracks of a frame from which arrays are faster than a loop, and frames that are turned into rows at a time.
MANY, FRAMES = 2_000, 20_000


def _taken(pairs: list[tuple[float, int, int]]) -> dict[int, int]:
    """Column by row: pairs (distance, row, column) are taken from the nearest on, ties by row, then column, each row and column once."""
    to: dict[int, int] = {}
    taken = set()
    for _, row, column in sorted(pairs):
        if row not in to and column not in taken:
            to[row] = column
            taken.add(column)
    return to


def one_to_one(apart: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """For each row its column or -1, taken from the nearest allowed pair on."""
    rows, columns = np.nonzero(allowed)
    to = _taken(list(zip(apart[rows, columns].tolist(), rows.tolist(), columns.tolist(), strict=True)))
    return np.array([to.get(r, -1) for r in range(apart.shape[0])], int)


def _meet(seen: list, tracks: list) -> list[tuple[float, int, int]]:
    """(distance, sighting, track) of those within NEAR and both uncertainties. The absolute value of a complex number is the C library's hypot, as in the arrays."""
    if len(seen) * len(tracks) > MANY:
        (sx, sy, su), (x, y, u) = np.array([(s[2], s[3], s[5]) for s in seen]).T, np.array([o[2:5] for o in tracks]).T
        apart = np.hypot(sx[:, None] - x[None, :], sy[:, None] - y[None, :])
        rows, columns = np.nonzero(apart <= NEAR + su[:, None] + u[None, :])
        return list(zip(apart[rows, columns].tolist(), rows.tolist(), columns.tolist(), strict=True))
    found = []
    for i, (_, _, x, y, _, wide) in enumerate(seen):
        for k, o in enumerate(tracks):
            reach, dx, dy = NEAR + wide + o[4], x - o[2], y - o[3]
            if -reach <= dx <= reach and -reach <= dy <= reach and (apart := abs(complex(dx, dy))) <= reach:
                found.append((apart, i, k))
    return found


def _advance(tracks: list[list], next_id: int, t: float, frame: list[tuple]) -> tuple[list[list], int]:
    """advance() on lists in the order of the fields, which for the few rows of a frame take less time than arrays. The frame comes in its order; tracks are changed in place."""
    seen, clear = [s for s in frame if not s[0]], [s for s in frame if s[0]]
    to = _taken(_meet(seen, tracks))
    found = []
    for i in sorted(to):
        own, o = seen[i], tracks[to[i]]
        time = t - o[6]
        if time >= VELOCITY_TIME:
            for new, at, v in ((own[2], 2, 9), (own[3], 3, 10)):
                new = (new - o[at]) / time
                o[v] = new if o[v] != o[v] else o[v] + VELOCITY_GAIN * (new - o[v])
        o[1], o[2], o[3], o[4], o[6], o[7], o[8] = o[1] or own[1], own[2], own[3], own[5], t, o[7] + 1, 0
        found.append(o)

    met = set(to.values())
    out = []
    for k, o in enumerate(tracks):
        if k not in met:
            if clear and any(abs(complex(o[2] - s[2], o[3] - s[3])) <= s[5] for s in clear):
                o[8] += 1
            if t - o[6] <= TTL["PERSON" if o[1] else "UNCLASSIFIED"] and o[8] < CLEAR_LOOKS:
                out.append(o)

    for i, s in enumerate(seen):
        if i not in to:
            same = next((o for o in found if abs(complex(o[2] - s[2], o[3] - s[3])) <= NEAR), None)
            if same is None:
                found.append([next_id, s[1], s[2], s[3], s[5], t, t, 1, 0, float("nan"), float("nan")])
                next_id += 1
            elif s[1]:
                same[1], same[2], same[3], same[4] = s[1], s[2], s[3], s[5]
    out += found
    out.sort(key=itemgetter(0))
    return out, next_id


def _placed(tracks: list) -> np.ndarray:
    return np.array([tuple(o) for o in tracks], _STATE)


def advance(tracks: np.ndarray, next_id: int, t: float, frame: np.ndarray) -> tuple[np.ndarray, int]:
    """Tracks (_STATE) after the frame (_SEEN) of moment t, and the next free number.

    A sighting may be of a track within NEAR and both uncertainties. One that is of no track, but within NEAR of something sighted in this frame, is a
    second look at it, and only tells if it is a person. The rest, the most confident first, are new tracks."""
    frame = frame[np.lexsort((frame["y"], frame["x"], -frame["confidence"]))]
    out, next_id = _advance([list(o) for o in tracks.tolist()], next_id, t, frame.tolist())
    return _placed(out), next_id


def _rows(floor, tracks: np.ndarray) -> pd.DataFrame:
    fast = tracks["person"] & (np.hypot(tracks["vx"], tracks["vy"]) > MOVING)
    told = {"floor": np.full(len(tracks), floor), "category": np.where(tracks["person"], "PERSON", "UNCLASSIFIED"), "status": np.where(tracks["hits"] < CONFIRM, "TENTATIVE", np.where(fast, "MOVING", "STATIONARY"))}
    return pd.DataFrame({c: told[c] if c in told else tracks[c] for c in (x.split()[0] for x in TRACKS.split(", "))})


def track_obstacles(sightings: DataFrame) -> DataFrame:
    """sightings (SIGHTINGS), a null category marking a place seen clear within its uncertainty: the tracks of each floor, TRACKS. Categories other than PERSON count as UNCLASSIFIED.

    On a stream, every micro-batch gives each floor's tracks as they stand then (those of its newest batch); the state is the floor's living tracks, and
    sightings older than the last frame are dropped as late. Frames are the rows of one (floor, t). A task holds one floor's rows of one micro-batch. Rows without floor, t, x or y take no part."""

    def fold(tracks: list[list], next_id: int, until: float | None, parts: Iterator[pd.DataFrame]):
        columns: dict[str, list[np.ndarray]] = {c: [] for c in ("t", "id", *_SEEN.names)}
        for pdf in parts:
            for c, held in columns.items():
                held.append(pdf[c].to_numpy())
        at = {c: np.concatenate(columns.pop(c)) for c in list(columns)}
        ids = at.pop("id")
        ids = pd.factorize(ids, sort=True, use_na_sentinel=False)[0] if ids.dtype == object else ids  # those without an id come last
        order = np.lexsort((ids, at["y"], at["x"], -at["confidence"], at["t"]))
        t = at.pop("t")[order]
        turns = np.r_[np.flatnonzero(np.r_[True, t[1:] != t[:-1]]), len(t)]
        for first in range(0, len(turns) - 1, FRAMES):
            begins = turns[first : first + FRAMES + 1].tolist()
            some = order[begins[0] : begins[-1]]
            rows = list(zip(*[at[c][some].tolist() for c in _SEEN.names], strict=True))
            for a, z, moment in zip(begins, begins[1:], t[turns[first : first + FRAMES][: len(begins) - 1]].tolist(), strict=False):
                if until is None or moment > until:
                    until = moment
                    tracks, next_id = _advance(tracks, next_id, until, rows[a - begins[0] : z - begins[0]])
        return tracks, next_id, until

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, next_id, until = json.loads(state.get[0]) if state.exists else ([], 1, None)
        tracks, next_id, until = fold(known, next_id, until, parts)
        state.update((json.dumps((tracks, next_id, until)),))
        yield _rows(key[0], _placed(tracks))

    number = lambda c: F.col(c).cast("double")
    kind = [F.col("category").isNull().alias("clear"), F.coalesce(F.col("category") == "PERSON", F.lit(False)).alias("person")]
    whole = sightings.select(F.col("floor").cast("long").alias("floor"), number("t").alias("t"), "id", *kind, number("x").alias("x"), number("y").alias("y"), *[F.coalesce(number(c), F.lit(0.0)).alias(c) for c in SIGHTINGS[6:]]).dropna(subset=["floor", "t", "x", "y"])
    if whole.isStreaming:
        return whole.groupBy("floor").applyInPandasWithState(step, TRACKS, "tracks string", "append", GroupStateTimeout.NoTimeout)
    return whole.groupBy("floor").applyInPandas(lambda key, pdf: _rows(key[0], _placed(fold([], 1, None, iter([pdf]))[0])), TRACKS)


def living(tracks: DataFrame, now: Column) -> DataFrame:
    """Tracks within their time to live at a moment without a new frame."""
    ttl = F.coalesce(*[F.when(F.col("category") == c, s) for c, s in TTL.items()])
    return tracks.where(now - F.col("last_t") <= ttl)
