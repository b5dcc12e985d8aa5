"""K-means of many small groups at once: one row per group, fitted where it lies.

A distributed fit of one model would be one job after another for every group. Here a
group's points are one row, which its key's bound on points keeps small (a listener has at most
one point per calendar week), and a task fits the groups it holds: those of as many points
in the same array operations, ``TOGETHER`` at a time. Results depend on a group's points and
the seed, not on how groups are dealt to tasks or which are fitted beside them.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds after which a start that still changes is taken as it is.
MOST_ROUNDS = 300
#: Groups fitted, and held as arrays, at a time.
TOGETHER = 512


# In what follows points are (groups, points, features) and centres (groups, starts, k, features).


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of every point and start, the first one on a tie."""
    groups, starts, k, width = centres.shape
    cross = centres.transpose(0, 2, 1, 3).reshape(groups, k * starts, width) @ points.transpose(0, 2, 1)
    # What a point's own square adds is the same for all centres.
    squares = (centres * centres).sum(axis=3).transpose(0, 2, 1)
    apart = squares[..., None] - 2 * cross.reshape(groups, k, starts, -1)
    least, own = apart[:, 0], np.zeros((groups, starts, points.shape[1]), np.int8)
    for other in range(1, k):
        np.copyto(own, other, where=apart[:, other] < least)
        np.minimum(least, apart[:, other], out=least)
    return own


def _means(points: np.ndarray, own: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Means of the clusters of every start; a centre without points stays."""
    groups, starts, k, width = centres.shape
    member = (own[:, :, None] == np.arange(k, dtype=np.int8)[:, None]).reshape(groups, starts * k, -1)
    sizes = member.sum(axis=2).reshape(groups, starts, k, 1)
    sums = (member.astype(np.float64) @ points).reshape(centres.shape)
    return np.where(sizes > 0, sums / np.maximum(sizes, 1), centres)


def lloyd_together(points: np.ndarray, centres: np.ndarray, rounds: int = MOST_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(cluster per point, centres) of every group and start, after ``rounds`` or when none changes.

    Ties go to the first centre, and a centre without points stays. The clusters are those
    that the centres returned are the means of. Groups that have settled drop out.
    """
    own, centres = _nearest(points, centres), centres.copy()
    going = np.arange(len(points))
    for turn in range(rounds):
        centres[going] = _means(points[going], own[going], centres[going])
        if turn + 1 == rounds:
            break
        moved = _nearest(points[going], centres[going])
        changed = (moved != own[going]).any(axis=(1, 2))
        going = going[changed]
        if not len(going):
            break
        own[going] = moved[changed]
    return own, centres


def lloyd(points: np.ndarray, centres: np.ndarray, rounds: int = MOST_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """``lloyd_together`` for the starts of one group."""
    own, centres = lloyd_together(points[None], centres[None].astype(np.float64), rounds)
    return own[0], centres[0]


def seeded(points: np.ndarray, k: int, seeds: range) -> np.ndarray:
    """Starting centres per seed: points drawn with chances by their squared distance to those before.

    A seed's draws are the same for all groups of as many points.
    """
    groups, size, width = points.shape
    chances = [np.random.default_rng((seed, k)) for seed in seeds]
    starts = np.empty((groups, len(seeds), k, width))
    apart = np.full((groups, len(seeds), size), np.inf)
    chosen = np.broadcast_to([rng.integers(size) for rng in chances], (groups, len(seeds)))
    every = np.arange(groups)[:, None]
    for turn in range(k):
        starts[:, :, turn] = points[every, chosen]
        apart = np.minimum(apart, ((points[:, None] - starts[:, :, turn, None]) ** 2).sum(axis=3))
        reach = np.cumsum(apart, axis=2)
        draws, whole = np.array([rng.random() for rng in chances]), reach[:, :, -1]
        drawn = np.minimum((reach <= (draws * whole)[:, :, None]).sum(axis=2), size - 1)
        # Where all points are centres already, any point is as good as another.
        chosen = np.where(whole > 0, drawn, (draws * size).astype(np.int64))
    return starts


def best_fits(points: np.ndarray, k: int, seeds: range) -> np.ndarray:
    """Cluster per point of each group's cheapest start, the first one on a tie."""
    own, centres = lloyd_together(points, seeded(points, k, seeds))
    cost = np.empty(own.shape[:2])
    for start in range(len(seeds)):
        nearest = np.take_along_axis(centres[:, start], own[:, start, :, None].astype(np.int64), axis=1)
        cost[:, start] = ((points - nearest) ** 2).sum(axis=2).sum(axis=1)
    return own[np.arange(len(points)), cost.argmin(axis=1)]


def best_fit(points: np.ndarray, k: int, seeds: range) -> np.ndarray:
    """``best_fits`` for one group."""
    return best_fits(points[None], k, seeds)[0]


def mean_silhouettes(points: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Each group's mean silhouette with squared Euclidean distance; points alone in a cluster count 0."""
    member = (own[:, :, None] == np.arange(k)).astype(np.float64)
    sizes, squares = member.sum(axis=1), (points * points).sum(axis=2)
    counted = np.maximum(sizes, 1)
    # The mean squared distance to a cluster needs its mean and mean square only.
    means = member.transpose(0, 2, 1) @ points / counted[:, :, None]
    mean_squares = (member * squares[:, :, None]).sum(axis=1) / counted
    apart = np.maximum(squares[:, :, None] + mean_squares[:, None] - 2 * points @ means.transpose(0, 2, 1), 0)
    place = own[:, :, None].astype(np.int64)
    size = np.take_along_axis(sizes[:, None], place.transpose(0, 2, 1), axis=2)[:, 0]
    inside = np.take_along_axis(apart, place, axis=2)[:, :, 0] * size / np.maximum(size - 1, 1)
    nearest = np.where((member > 0) | (sizes == 0)[:, None], np.inf, apart).min(axis=2)
    larger = np.maximum(inside, nearest)
    with np.errstate(invalid="ignore"):
        score = np.where((size > 1) & (larger > 0), (nearest - inside) / np.where(larger > 0, larger, 1), 0.0)
    return np.where((sizes > 0).sum(axis=1) < 2, 0.0, score.mean(axis=1))


def mean_silhouette(points: np.ndarray, own: np.ndarray) -> float:
    """``mean_silhouettes`` for one group, whatever its clusters are called."""
    names, place = np.unique(own, return_inverse=True)
    return float(mean_silhouettes(points[None], place[None], len(names))[0])


def searched(most: int, search_starts: int, final_starts: int, seed: int) -> Callable[[np.ndarray], list[dict]]:
    """The fit, for groups of as many points, with the k of best silhouette (the smaller on a
    tie), tried from 2 to ``most`` and below a third of the points."""

    def fit(points: np.ndarray) -> list[dict]:
        ks = list(range(2, min(most + 1, points.shape[1] // 3)))
        scores = np.empty((len(points), len(ks)))
        for at, k in enumerate(ks):
            scores[:, at] = mean_silhouettes(points, best_fits(points, k, range(seed, seed + search_starts)), k)
        best = scores.argmax(axis=1)
        own = np.empty(points.shape[:2], np.int32)
        for at in np.unique(best):
            own[best == at] = best_fits(points[best == at], ks[at], range(seed, seed + final_starts))
        return [{"clusters": c, "ks": np.array(ks, np.int32), "silhouettes": s} for c, s in zip(own, scores, strict=True)]

    return fit


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """Points of each row, without a Python object for every number."""
    inner = column.flatten()
    numbers = inner.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    rows = numbers.reshape(len(inner), -1) if len(inner) else numbers.reshape(0, 0)
    return np.split(rows, np.cumsum(sizes)[:-1])


def each(fit: Callable[[np.ndarray], dict]) -> Callable[[np.ndarray], list[dict]]:
    """A fit of one group's points as one of several groups' points."""
    return lambda points: [fit(one) for one in points]


def fitted(groups: DataFrame, fit: Callable[[np.ndarray], list[dict]], added: dict[str, str]) -> DataFrame:
    """``groups`` with the arrays that ``fit`` makes of the rows' ``points``, in place of these.

    ``fit`` is given several groups of as many points and returns a dict for each.
    ``added`` names the arrays' element types, as Spark calls them.
    """
    kinds = {"int": pa.int32(), "double": pa.float64()}
    fields = [f for f in groups.schema.fields if f.name != "points"]
    kept = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                points = _arrays(batch["points"])
                sizes = np.array([len(p) for p in points])
                fits: list[dict] = [{}] * len(points)
                for size in np.unique(sizes):
                    rows = np.flatnonzero(sizes == size)
                    for row, found in zip(rows, fit(np.stack([points[r] for r in rows])), strict=True):
                        fits[row] = found
                arrays = [pa.array([f[name] for f in fits], pa.list_(kinds[kind])) for name, kind in added.items()]
                yield pa.record_batch([*[batch[c] for c in kept], *arrays], names=[*kept, *added])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], *[f"`{n}` array<{k}>" for n, k in added.items()]])
    return groups.select(*kept, "points").mapInArrow(run, schema)


def in_groups(rows: DataFrame, keys: list[str], order: list[str], features: list[str]) -> DataFrame:
    """One row per key: its ``rows`` as structs in ``order``, and their ``features`` as ``points``."""
    record = F.struct(*order, *[c for c in rows.columns if c not in (*order, *keys)])
    gathered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(record)).alias("rows"))
    point = lambda row: F.array(*[row[f] for f in features])
    return gathered.withColumn("points", F.transform("rows", point))
