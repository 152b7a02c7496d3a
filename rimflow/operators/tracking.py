"""Multi-object and ball tracking: the operators that need a matching and a filter step.

A tracker is sequential within one game and independent between games. Spark deals the rows by game_id and sorts them by
frame; a task takes them in chunks of whole frames (`mapInArrow`), moves all games of a chunk on side by side, one frame a
step, and hands what is live in a chunk's last game on to the next chunk. What it holds at once is a chunk, not a game.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rimflow.sources import adapters

#: A chunk has at least so many rows, unless its task has no more.
CHUNK_ROWS = 300_000


def assign(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """The one-to-one assignment of least total cost whose pairs cost at most `limit`.

    Pairs above the limit count as unmatched: they cost as much as leaving both sides free.
    """
    rows, cols = np.nonzero(cost <= limit)
    best = _matched(rows, cols, cost[rows, cols], limit)
    return sorted(zip(rows[best].tolist(), cols[best].tolist(), strict=True))


def _matched(rows: np.ndarray, cols: np.ndarray, cost: np.ndarray, limit: float) -> np.ndarray:
    """Which of these pairs, none above the limit, make the assignment of least total cost.

    A pair saves 2 * limit - cost. Where all that compete want the same row or column, the nearest gets it.
    """
    if not len(rows):
        return np.zeros(0, int)
    lone_row, lone_col = np.bincount(rows)[rows] == 1, np.bincount(cols)[cols] == 1
    star_col = (np.bincount(cols, ~lone_row) == 0)[cols]  # a column whose rows have no other one
    star_row = (np.bincount(rows, ~lone_col) == 0)[rows] & ~star_col
    found = [_first(np.flatnonzero(star_col), cols, rows, cost), _first(np.flatnonzero(star_row), rows, cols, cost)]
    tangled = np.flatnonzero(~star_col & ~star_row)
    if len(tangled):
        part = _parts(rows[tangled], cols[tangled])
        order = np.argsort(part, kind="stable")
        for some in np.split(tangled[order], np.flatnonzero(np.diff(part[order])) + 1):
            found.append(some[_solved(rows[some].tolist(), cols[some].tolist(), (cost[some] - 2 * limit).tolist())])
    return np.concatenate(found)


def _first(some: np.ndarray, by: np.ndarray, then: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Of these pairs the cheapest one for each value of `by`."""
    some = some[np.lexsort((then[some], cost[some], by[some]))]
    return some[_changes(by[some])]


def _changes(values: np.ndarray) -> np.ndarray:
    """Where a value isn't the one before it."""
    return np.append(True, values[1:] != values[:-1])[: len(values)]


def _parts(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The number of each pair's connected part: pairs with a common row or column belong together."""
    ends = [np.unique(x, return_inverse=True)[1] for x in (rows, cols)]
    label = np.arange(len(rows))
    while True:
        new = label
        for end in ends:
            least = np.full(len(rows), len(rows))
            np.minimum.at(least, end, new)
            new = least[end]
        if (new == label).all():
            return label
        label = new


def _solved(rows: list[int], cols: list[int], cost: list[float]) -> list[int]:
    """Which of the pairs of one part make the assignment of least total cost, by shortest augmenting paths; all costs are below 0.

    The fewer side gets a partner each: whom no partner suits is given one at cost 0, and has none.
    """
    if len(set(rows)) > len(set(cols)):
        rows, cols = cols, rows
    row, col = ({x: k for k, x in enumerate(sorted(set(xs)))} for xs in (rows, cols))
    n, m = len(row), len(col)
    full, at = [[0.0] * m for _ in range(n)], {}
    for k, (r, c) in enumerate(zip(rows, cols, strict=True)):
        full[row[r]][col[c]] = cost[k]
        at[row[r], col[c]] = k
    u, v, match, way = [0.0] * (n + 1), [0.0] * (m + 1), [n] * (m + 1), [m] * (m + 1)  # n: nobody; column m is where a path begins
    for i in range(n):
        match[m], j0 = i, m
        least, open_, done = [np.inf] * m, list(range(m)), [m]
        while True:
            i0 = match[j0]
            costs, base = full[i0], u[i0]
            for j in open_:
                reduced = costs[j] - base - v[j]
                if reduced < least[j]:
                    least[j], way[j] = reduced, j0
            j0 = min(open_, key=least.__getitem__)
            step = least[j0]
            for j in done:
                u[match[j]] += step
                v[j] -= step
            for j in open_:
                least[j] -= step
            if match[j0] == n:
                break
            open_.remove(j0)
            done.append(j0)
        while j0 != m:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [at[match[j], j] for j in range(m) if (match[j], j) in at]


class ConstantVelocity:
    """Kalman filters of points (x, y, vx, vy) with process noise q and measurement noise r, one or an array of them.

    Both axes have the same noise and so the same covariances: of the place, of place and speed, of the speed.
    """

    def __init__(self, x: float | np.ndarray, y: float | np.ndarray, q: float = 0.01, r: float = 0.1):
        one = np.ones_like(x, float)
        self.s = np.array([one * x, one * y, 0 * one, 0 * one, one, 0 * one, one])
        self.q, self.r = q, r

    def predict(self, at=...) -> np.ndarray:
        """Moves (those points) one frame on."""
        x, y, vx, vy, p, c, v = self.s[:, at]
        self.s[:, at] = x + vx, y + vy, vx, vy, p + 2 * c + v + self.q, c + v, v + self.q
        return self.s[:2, at].copy()

    def correct(self, x: float | np.ndarray, y: float | np.ndarray, at=...) -> None:
        was_x, was_y, vx, vy, p, c, v = self.s[:, at]
        gain, gain_v = p / (p + self.r), c / (p + self.r)
        dx, dy = x - was_x, y - was_y
        self.s[:, at] = was_x + gain * dx, was_y + gain * dy, vx + gain_v * dx, vy + gain_v * dy, (1 - gain) * p, (1 - gain) * c, v - gain_v * c


class _Chunk:
    """Rows of whole frames, sorted by game and frame: the games and frames by number, and how far each frame is into its game."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        new_game = _starts(rows["game_id"])
        self.first = np.flatnonzero(new_game | _changes(rows["frame_id"].to_numpy()))  # row of each frame
        self.game = np.cumsum(new_game)[self.first] - 1  # of each frame
        self.games = int(self.game[-1]) + 1
        self.frame = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, rows.num_rows)))  # of each row
        self.step = np.arange(len(self.first)) - np.flatnonzero(_changes(self.game))[self.game]

    def columns(self, *names: str) -> np.ndarray:
        return np.array([self.rows[x].cast("double").to_numpy() for x in names])


def _starts(column: pa.ChunkedArray) -> np.ndarray:
    """Where a value, or null, isn't the one before it."""
    return _changes(column.fill_null(0).to_numpy()) | _changes(column.is_valid().to_numpy())


def _steps(step: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """An order by step, and from where to where each step goes in it."""
    ends = np.cumsum(np.bincount(step)).tolist()
    return np.argsort(step, kind="stable"), list(zip([0, *ends[:-1]], ends, strict=True))


def _by_chunks(follow: Callable, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """follow(chunk, live): the columns found and what is live in the last game; live: the same of the chunk's first game, None if it begins here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, before, live = [], 0, None, None

        def made(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal before, live
            found, live = follow(_Chunk(rows), live if before == [rows["game_id"][0].as_py()] else None)
            before = [rows["game_id"][-1].as_py()]
            yield from pa.table(found, schema).to_batches()

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK_ROWS:
                rows = pa.Table.from_batches(held).combine_chunks()
                cut = int(np.flatnonzero(_starts(rows["game_id"]) | _changes(rows["frame_id"].to_numpy()))[-1])
                if cut:  # the last frame may go on
                    yield from made(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                n = sum(x.num_rows for x in held)
        if n:
            yield from made(pa.Table.from_batches(held).combine_chunks())

    return run


@dataclass(frozen=True)
class TrackerSettings:
    confirm_hits: int = 3
    max_lost: int = 30
    min_iou: float = 0.3
    max_distance: float = 120.0
    suppress_iou: float = 0.45


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of box by box, both with rows x1, y1, x2, y2."""
    width, height = np.clip(np.minimum(a[2:], b[2:]) - np.maximum(a[:2], b[:2]), 0, None)
    area = lambda z: np.prod(np.clip(z[2:] - z[:2], 0, None), axis=0)
    inter = width * height
    union = area(a) + area(b) - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


def _kept(boxes: np.ndarray, frame: np.ndarray, limit: float) -> np.ndarray:
    """Which boxes no surer one of their frame suppresses; the surest of a frame come first."""
    kept, pairs, i = np.ones(len(frame), bool), [], np.arange(len(frame))
    for ahead in range(1, len(frame)):
        i = i[i + ahead < len(frame)]
        i = i[frame[i] == frame[i + ahead]]
        if not len(i):
            break
        over = i[_iou(boxes[:, i], boxes[:, i + ahead]) > limit]
        pairs += zip((over + ahead).tolist(), over.tolist(), strict=True)
    for later, sooner in sorted(pairs):
        if kept[sooner]:
            kept[later] = False
    return kept


class _Tracks:
    """Tracks of many games side by side; sure (0 or 1): confirmed, and seen in the frame before."""

    def __init__(self, places: np.ndarray, counts: np.ndarray):
        self.places, self.counts = places, counts
        self.motion, self.boxes = ConstantVelocity(0, 0), places[7:]
        self.motion.s = places[:7]
        self.game, self.number, self.hits, self.lost, self.sure = counts

    @staticmethod
    def begun(game: np.ndarray, number: np.ndarray, boxes: np.ndarray) -> _Tracks:
        one = np.ones_like(game)
        return _Tracks(np.concatenate([ConstantVelocity(*_centers(boxes)).s, boxes]), np.array([game, number, one, 0 * one, 0 * one]))

    def only(self, which: np.ndarray) -> _Tracks:
        at = np.flatnonzero(which)
        return _Tracks(self.places.take(at, axis=1), self.counts.take(at, axis=1))

    def joined(self, more: _Tracks) -> _Tracks:
        return _Tracks(np.concatenate([self.places, more.places], axis=1), np.concatenate([self.counts, more.counts], axis=1))


def _centers(boxes: np.ndarray) -> np.ndarray:
    return (boxes[:2] + boxes[2:]) / 2


TRACK_SCHEMA = "game_id long, frame_id long, track_id long, state string, x1 double, y1 double, x2 double, y2 double"
_TRACKS = pa.schema([("game_id", "int64"), ("frame_id", "int64"), ("track_id", "int64"), ("state", "string"), *((x, "float64") for x in ("x1", "y1", "x2", "y2"))])


def _tracker(settings: TrackerSettings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Confirmed tracks are matched by overlap first, the rest by distance; what stays free starts a new track."""

    def matched(tracks: _Tracks, boxes: np.ndarray, t: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tracks and detections that belong together, of the pairs t, d within a game."""
        some = np.flatnonzero(tracks.sure[t])
        cost = 1 - _iou(tracks.boxes[:, t[some]], boxes[:, d[some]])
        near = cost <= 1 - settings.min_iou
        some = some[near]
        some = some[_matched(t[some], d[some], cost[near], 1 - settings.min_iou)]
        (x, y), (at_x, at_y) = _centers(boxes), tracks.motion.s[:2]  # as filtered up to the frame before
        dx, dy = at_x[t] - x[d], at_y[t] - y[d]
        away = np.sqrt(dx * dx + dy * dy)
        taken_t, taken_d = np.zeros(len(tracks.game), bool), np.zeros(len(x), bool)
        taken_t[t[some]] = taken_d[d[some]] = True
        rest = np.flatnonzero(away <= settings.max_distance)
        rest = rest[~taken_t[t[rest]] & ~taken_d[d[rest]]]
        some = np.append(some, rest[_matched(t[rest], d[rest], away[rest], settings.max_distance)])
        return t[some], d[some]

    def follow(chunk: _Chunk, live: tuple | None) -> tuple[list, tuple]:
        found = chunk.columns("x1", "y1", "x2", "y2")
        kept = np.flatnonzero(_kept(found, chunk.frame, settings.suppress_iou))
        order, spans = _steps(chunk.step[chunk.frame[kept]])
        row = kept[order]
        found, games, last = found[:, row], chunk.game[chunk.frame[row]], chunk.games - 1
        number, sure, born = np.zeros(len(row), int), np.zeros(len(row), bool), np.zeros(chunk.games, int)
        tracks, end = _Tracks(np.zeros((11, 0)), np.zeros((5, 0), int)), None
        if live:
            tracks, born[0] = live
        for a, b in spans:
            game, boxes = games[a:b], found[:, a:b]
            count = np.bincount(game, minlength=chunk.games)
            if not count[last] and end is None:
                end = tracks.only(tracks.game == last)
            if not count.all():  # a game that has no frame here has none later
                tracks = tracks.only(count[tracks.game] > 0)
            n = count[tracks.game]
            t = np.repeat(np.arange(len(n)), n)
            d = np.arange(len(t)) + np.repeat((np.cumsum(count) - count)[tracks.game] - np.cumsum(n) + n, n)
            t, d = matched(tracks, boxes, t, d)
            tracks.motion.predict()
            tracks.motion.correct(*_centers(boxes[:, d]), t)
            tracks.boxes[:, t] = boxes[:, d]
            tracks.lost += 1
            tracks.lost[t] = 0
            tracks.hits[t] += 1
            tracks.sure[:] = 0
            tracks.sure[t] = tracks.hits[t] >= settings.confirm_hits
            number[a + d], sure[a + d] = tracks.number[t], tracks.sure[t]
            free = np.delete(np.arange(b - a), d)
            new = np.bincount(game[free], minlength=chunk.games)
            number[a + free] = (born - np.cumsum(new) + new)[game[free]] + np.arange(len(free)) + 1
            born += new
            tracks = tracks.only(tracks.lost < settings.max_lost).joined(_Tracks.begun(game[free], number[a + free], boxes[:, free]))
        end = tracks.only(tracks.game == last) if end is None else end
        end.game[:] = 0
        order = np.lexsort((number, chunk.frame[row]))
        rows, state = chunk.rows.take(row[order]), np.where(sure[order], "confirmed", "tentative")
        return [rows["game_id"], rows["frame_id"], pa.array(number[order]), pa.array(state), *map(pa.array, found[:, order])], (end, int(born[last]))

    return _by_chunks(follow, _TRACKS)


def track_game(game: pd.DataFrame, settings: TrackerSettings = TrackerSettings()) -> pd.DataFrame:
    """game_id, frame_id, track_id, state, x1, y1, x2, y2 of every track in every frame in which it was seen."""
    rows = game.dropna(subset=["frame_id"]).sort_values(["frame_id", "conf", "k1", "k2", "k3"], ascending=[True, False, True, True, True])
    return _of_pandas(_tracker(settings), rows[["game_id", "frame_id", "x1", "y1", "x2", "y2"]], _TRACKS)


def _of_pandas(run: Callable, rows: pd.DataFrame, schema: pa.Schema) -> pd.DataFrame:
    return pa.Table.from_batches(run(iter(pa.Table.from_pandas(rows, preserve_index=False).to_batches())), schema).to_pandas()


def active(tracks: DataFrame) -> DataFrame:
    """Tracks that are tentative or confirmed where they were seen."""
    return tracks.where("state in ('tentative', 'confirmed')")


def confirmed(tracks: DataFrame) -> DataFrame:
    return tracks.where("state = 'confirmed'")


def _dealt(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Each game in one partition, frame by frame."""
    return rows.where("frame_id is not null").repartition("game_id").sortWithinPartitions("game_id", "frame_id", *order)


def track_objects(detections: DataFrame, settings: TrackerSettings = TrackerSettings()) -> DataFrame:
    """Tracks of all games; detections: game_id, frame_id, k1, k2, k3, conf, x1, y1, x2, y2."""
    narrow = detections.selectExpr("cast(game_id as long) as game_id", "cast(frame_id as long) as frame_id", "k1", "k2", "k3", "nanvl(cast(conf as double), null) as conf", "x1", "y1", "x2", "y2")
    rows = _dealt(narrow, F.desc_nulls_last("conf"), *map(F.asc_nulls_last, ("k1", "k2", "k3")))
    return rows.select("game_id", "frame_id", "x1", "y1", "x2", "y2").mapInArrow(_tracker(settings), TRACK_SCHEMA)


BALL_SCHEMA = "game_id long, frame_id long, x double, y double, speed double, frames_lost long"
_BALLS = pa.schema([("game_id", "int64"), ("frame_id", "int64"), ("x", "float64"), ("y", "float64"), ("speed", "float64"), ("frames_lost", "int64")])


def _ball_tracker(gate: float = 160.0, sure: float = 0.35, max_lost: int = 15, near_weight: float = 0.7) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From the second point on the candidates within the gate of the prediction compete by a blend of nearness and confidence; a candidate
    outside is taken only if none is inside and it is sure. A ball that is lost for more than max_lost frames has to be found anew.
    """

    def follow(chunk: _Chunk, live: tuple | None) -> tuple[list, tuple]:
        found = chunk.columns("ball_x", "ball_y", "conf")
        order, spans = _steps(chunk.step[chunk.frame])
        found, frames = found[:, order], chunk.frame[order]
        motion = ConstantVelocity(np.zeros(chunk.games), np.zeros(chunk.games))
        on, lost, points = np.zeros(chunk.games, bool), np.zeros(chunk.games, int), np.zeros(chunk.games, int)
        if live:
            motion.s[:, 0], on[0], lost[0], points[0] = live
        given, out = np.zeros(len(chunk.first), bool), np.zeros((4, len(chunk.first)))
        for a, b in spans:
            (x, y, conf), begins = found[:, a:b], _changes(frames[a:b])
            of, frame = np.cumsum(begins) - 1, frames[a:b][begins]  # candidates of a frame come surest first
            g = chunk.game[frame]
            motion.predict(g[on[g]])
            away = np.hypot(x - motion.s[0, g][of], y - motion.s[1, g][of])
            gated = (on[g] & (points[g] >= 2))[of]
            rank = np.where(gated, np.where(away <= gate, 2, conf >= sure), 1) * ~(np.isnan(x) | np.isnan(y))
            score = np.where(rank == 2, near_weight * (1 - away / gate) + (1 - near_weight) * conf, 0.0)
            best = np.lexsort((-score, -rank, of))[begins]
            best = best[rank[best] > 0]
            seen = g[of[best]]
            new = ~on[seen]
            motion.s[:, seen[new]] = ConstantVelocity(x[best[new]], y[best[new]]).s
            motion.correct(x[best[~new]], y[best[~new]], seen[~new])
            on[seen] = True
            lost[g] += 1
            lost[seen] = 0
            points[g] += on[g]
            given[frame], out[:, frame] = on[g], (*motion.s[:2, g], np.hypot(*motion.s[2:4, g]), lost[g])
            on[g] &= lost[g] <= max_lost
        rows = chunk.rows.take(chunk.first[given])
        return [rows["game_id"], rows["frame_id"], *map(pa.array, out[:3, given]), pa.array(out[3, given].astype(int))], (motion.s[:, -1].copy(), on[-1], lost[-1], points[-1])

    return _by_chunks(follow, _BALLS)


def track_ball(game: pd.DataFrame, gate: float = 160.0, sure: float = 0.35, max_lost: int = 15, near_weight: float = 0.7) -> pd.DataFrame:
    """One filtered ball position for each frame: game_id, frame_id, x, y, speed, frames_lost."""
    rows = game.dropna(subset=["frame_id"]).sort_values(["frame_id", "conf", "ball_x", "ball_y"], ascending=[True, False, True, True])
    return _of_pandas(_ball_tracker(gate, sure, max_lost, near_weight), rows[["game_id", "frame_id", "ball_x", "ball_y", "conf"]], _BALLS)


def ball_tracks(frames: DataFrame) -> DataFrame:
    """frames: game_id, frame_id, ball_x, ball_y, conf (one row for each candidate; nulls where none)."""
    narrow = frames.selectExpr("cast(game_id as long) as game_id", "cast(frame_id as long) as frame_id", "cast(ball_x as double) as ball_x", "cast(ball_y as double) as ball_y", "nanvl(cast(conf as double), null) as conf")
    return _dealt(narrow, F.desc_nulls_last("conf"), "ball_x", "ball_y").mapInArrow(_ball_tracker(), BALL_SCHEMA)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    players = lambda s, d: adapters.detections(s, d).where("class_name = 'player'")
    return {
        "object_tracks": lambda s, d: track_objects(players(s, d)),
        "ball_tracks": lambda s, d: ball_tracks(adapters.frames(s, d)),
    }
