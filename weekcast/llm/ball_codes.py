"""Short codes for vectors: each part of a vector is replaced by the nearest entry of that part's codebook.

Codebooks are refined by Lloyd's rounds over metric trees (Moore, "The anchors hierarchy: using the triangle
inequality to survive high dimensional data", 2000). Each task builds one tree per part position over a block of its
vectors, middle-out: anchors take over the points that are nearer to them, which the triangle inequality finds
without measuring the others; pairs of anchors whose common ball is smallest are joined upwards; balls with
many points are divided downwards in the same way. A ball caches its centre, radius, sum and count. In a round each ball
inherits the candidate entries of the ball around it and strikes those that another one beats for every point
inside; when one entry is left, the ball is wholly owned and its cached sum and count are added at once.

All components are whole numbers. Distances that decide are exact; the triangle inequality is used with a margin
above its rounding error, so ties always reach the exact comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weekcast.operators.scale import spread_join
from weekcast.session import stage

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Points of a ball that isn't divided any further.
LEAF = 48
#: Numbers (vectors times components) in a block with its own trees.
BLOCK = 1 << 19
#: Components are held between these bounds; only values of x from 2 ** 30 on are changed by that.
FARTHEST = 1 << 40
#: Below this magnitude squared distances of wide parts are exact in double precision.
EXACT = 1 << 20


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -FARTHEST, FARTHEST).astype(np.int64)


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``points`` to all of ``entries``; beyond ``EXACT``, of Python's numbers."""
    large = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0)) >= EXACT or points.shape[1] > 1 << 10
    kind = object if large else np.float64
    p, e = points.astype(kind), entries.astype(kind)
    return (p * p).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e * e).sum(axis=1)[None, :]


def lengths(differences: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", differences, differences))


@dataclass
class Balls:
    """A tree over points: children follow their parent; leaves hold ``order[begin:end]``."""

    order: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    def packed(self) -> bytes:
        head = np.array([len(self.order), len(self.begin), self.sums.shape[1]], np.int32)
        numbers = [self.order, self.begin, self.end, self.left, self.right]
        return b"".join([head.tobytes(), *[x.astype(np.int32).tobytes() for x in numbers], self.radius.tobytes(), self.sums.tobytes()])

    @staticmethod
    def unpacked(blob: memoryview) -> tuple[Balls, int]:
        """The tree at the front of ``blob``, and how many bytes it takes."""
        n, nodes, width = np.frombuffer(blob, np.int32, 3).tolist()
        at, found = 12, []
        for kind, count in [(np.int32, n), *[(np.int32, nodes)] * 4, (np.float64, nodes), (np.int64, nodes * width)]:
            found.append(np.frombuffer(blob, kind, count, at))
            at += found[-1].nbytes
        return Balls(*found[:6], found[6].reshape(nodes, width)), at


def anchors(points: np.ndarray, wanted: int) -> list[np.ndarray]:
    """The points of each of at most ``wanted`` anchors: the farthest point of the widest one is the next anchor.

    An anchor's points lie in falling order of their distance, so those that a new anchor can take, being farther
    than half the way to it, are a front part of the list; no others are measured.
    """
    first = lengths(points - points[0])
    order = np.argsort(-first, kind="stable")
    at, owned, far = [0], [order], [first[order]]
    while len(at) < wanted:
        widest = int(np.argmax([d[0] for d in far]))
        if far[widest][0] <= 0:
            break
        new = int(owned[widest][0])
        apart = lengths(points[at] - points[new])
        taken, taken_far = [], []
        for k in range(len(at)):
            front = int(np.searchsorted(-far[k], -apart[k] / 2 * (1 - 1e-9), side="right"))
            if not front:
                continue
            near = lengths(points[owned[k][:front]] - points[new])
            wins = near < far[k][:front]
            if wins.any():
                taken.append(owned[k][:front][wins])
                taken_far.append(near[wins])
                stay = np.concatenate([~wins, np.ones(len(owned[k]) - front, bool)])
                owned[k], far[k] = owned[k][stay], far[k][stay]
        mine, distance = np.concatenate(taken), np.concatenate(taken_far)
        order = np.argsort(-distance, kind="stable")
        at.append(new)
        owned.append(mine[order])
        far.append(distance[order])
    return owned


def grow(points: np.ndarray, leaf: int = LEAF) -> Balls:
    """The tree over ``points`` (whole numbers), middle-out."""
    reals = points.astype(np.float64)
    rows: list[list] = []  # begin, end, left, right, radius, sum
    order: list[np.ndarray] = []
    placed = 0

    def divide(members: np.ndarray) -> list:
        """A ball as (count, sum, centre, radius, members or None, children)."""
        centre = reals[members].mean(axis=0)
        radius = float(lengths(reals[members] - centre).max())
        ball = [len(members), points[members].sum(axis=0), centre, radius, members, None]
        if len(members) <= leaf or radius == 0:
            return ball
        groups = anchors(reals[members], int(np.ceil(np.sqrt(len(members)))))
        if len(groups) == 1:
            return ball
        return upwards([divide(members[g]) for g in groups])

    def upwards(balls: list[list]) -> list:
        """Join the two balls whose common ball is smallest until one is left."""
        alive = np.ones(len(balls), bool)
        centres, radii = np.array([b[2] for b in balls]), np.array([b[3] for b in balls])
        gaps = np.sqrt(np.maximum(0, squared(centres, centres).astype(np.float64)))
        common = (gaps + radii[:, None] + radii[None, :]) / 2
        np.fill_diagonal(common, np.inf)
        for _ in range(len(balls) - 1):
            i, j = np.unravel_index(np.argmin(common), common.shape)
            a, b = balls[i], balls[j]
            count = a[0] + b[0]
            centre = (a[0] * a[2] + b[0] * b[2]) / count
            radius = max(float(np.linalg.norm(a[2] - centre)) + a[3], float(np.linalg.norm(b[2] - centre)) + b[3])
            balls[i] = [count, a[1] + b[1], centre, radius, None, (a, b)]
            alive[j] = False
            common[j, :] = common[:, j] = np.inf
            centres[i], radii[i] = centre, radius
            row = (lengths(centres - centre) + radii + radius) / 2
            row[~alive] = np.inf
            row[i] = np.inf
            common[i, :] = common[:, i] = row
        return balls[int(np.flatnonzero(alive)[0])]

    waiting = [(divide(np.arange(len(points))), None)]
    while waiting:
        ball, parent = waiting.pop()
        here = len(rows)
        if parent is not None:
            rows[parent[0]][2 + parent[1]] = here
        if ball[5] is None:
            rows.append([placed, placed + ball[0], -1, -1, ball[3], ball[1]])
            order.append(ball[4])
            placed += ball[0]
        else:
            rows.append([0, ball[0], -1, -1, ball[3], ball[1]])
            waiting += [(ball[5][1], (here, 1)), (ball[5][0], (here, 0))]
    begin, end, left, right, radius, sums = zip(*rows, strict=True)
    whole = [np.array(x, np.int64) for x in (begin, end, left, right)]
    return Balls(np.concatenate(order), *whole, np.array(radius), np.array(sums, np.int64).reshape(len(rows), -1))


def assign(points: np.ndarray, tree: Balls, entries: np.ndarray, each: bool) -> tuple:
    """Sums and counts of the points nearest to each entry; with ``each``, every point's entry and squared distance.

    Balls of one depth are looked at together. An inherited candidate is struck when some other entry is nearer to
    every point of the ball, which is so if it is nearer to the centre by more than the diameter.
    """
    sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    nearest, far = (np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)) if each else (None, None)
    reals = entries.astype(np.float64)
    half = (reals * reals).sum(axis=1)
    sizes = np.where(tree.left < 0, tree.end - tree.begin, tree.end)
    level, candidates = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    while len(level):
        centres = tree.sums[level] / sizes[level][:, None]
        distances = np.sqrt(np.maximum(0, (centres * centres).sum(axis=1)[:, None] - 2 * centres @ reals.T + half[None, :]))
        best = np.where(candidates, distances, np.inf).min(axis=1)
        margin = 1e-6 * (1 + distances.max(axis=1))
        candidates = candidates & (distances <= (best + 2 * tree.radius[level] + margin)[:, None])
        owned = candidates.sum(axis=1) == 1
        leaves = tree.left[level] < 0
        settled = owned & ~leaves if each else owned
        if not each:
            owner = candidates[settled].argmax(axis=1)
            np.add.at(sums, owner, tree.sums[level[settled]])
            np.add.at(counts, owner, sizes[level[settled]])
        for k in np.flatnonzero(leaves & (np.ones_like(owned) if each else ~owned)):
            ball = level[k]
            members = tree.order[tree.begin[ball] : tree.end[ball]]
            kept = np.flatnonzero(candidates[k])
            exact = squared(points[members], entries[kept])
            choice = exact.argmin(axis=1)  # the lowest index of equals, for ``kept`` ascends
            if each:
                nearest[members] = kept[choice]
                least = exact[np.arange(len(members)), choice]
                far[members] = np.minimum(least, np.iinfo(np.int64).max // PARTS).astype(np.int64)
            else:
                np.add.at(sums, kept[choice], points[members])
                np.add.at(counts, kept[choice], 1)
        inner = ~leaves if each else ~leaves & ~owned
        level, candidates = np.concatenate([tree.left[level[inner]], tree.right[level[inner]]]), np.concatenate([candidates[inner]] * 2)
    return nearest, far, sums, counts


def part_bounds(width: int, parts: int = PARTS) -> list[tuple[int, int]]:
    return [(k * width // parts, (k + 1) * width // parts) for k in range(parts)]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding of rows whose vector holds finite numbers only."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("embedding").isNotNull() & finite)


def _planted(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors with their trees."""
    most = max(1, BLOCK // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            rows = batch.slice(at, most)
            flat = rows.column(2).flatten().to_numpy(zero_copy_only=False)
            points = whole_numbers(flat.reshape(rows.num_rows, width))
            trees = b"".join(grow(points[:, a:b]).packed() for a, b in part_bounds(width)) if width else b""
            small = np.abs(points).max(initial=0) < 1 << 15
            stored = points.astype(np.int16 if small else np.int64)
            sink = pa.BufferOutputStream()
            named = rows.select(["vec_id", "label"])
            with pa.ipc.new_stream(sink, named.schema) as out:
                out.write_batch(named)
            yield pa.RecordBatch.from_arrays(
                [pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([stored.tobytes()], pa.binary()), pa.array([small]), pa.array([rows.num_rows], pa.int32()), pa.array([trees], pa.binary())],
                ["named", "points", "small", "n", "trees"],
            )


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[bytes, list[tuple[np.ndarray, Balls]], int]]:
    for batch in batches:
        for named, points, small, n, trees in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            grid = np.frombuffer(points, np.int16 if small else np.int64).reshape(n, width).astype(np.int64)
            parts, rest = [], memoryview(trees)
            for a, b in part_bounds(width) if width else []:
                tree, size = Balls.unpacked(rest)
                parts.append((grid[:, a:b], tree))
                rest = rest[size:]
            yield named, parts, n


def refine(blocks: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Codebooks after one round: each entry becomes the floor of the mean of its parts; unused ones stay."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.zeros(b.shape, np.int64), np.zeros(len(b), np.int64)) for b in books]
        for _, parts, _ in _blocks(batches, width):
            for k, (points, tree) in enumerate(parts):
                _, _, sums, counts = assign(points, tree, books[k], False)
                found[k] = (found[k][0] + sums, found[k][1] + counts)
        for k, (sums, counts) in enumerate(found):
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), k, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))],
                ["part", "entry", "count", "sums"],
            )

    summed = blocks.mapInArrow(totals, "part int, entry int, count long, sums array<long>")
    widest = max(b.shape[1] for b in books)
    exact = [F.sum(F.get("sums", F.lit(i)).cast("decimal(19,0)")).alias(f"s{i}") for i in range(widest)]
    books = [b.copy() for b in books]
    # PARTS * ENTRIES rows at most.
    for row in summed.groupBy("part", "entry").agg(F.sum("count").alias("count"), *exact).collect():
        size = books[row.part].shape[1]
        books[row.part][row.entry] = [int(row[f"s{i}"]) // row["count"] for i in range(size)]
    return books


def books_digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' components, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of ``vectors`` (vec_id, embedding, label) and the codebooks: vec_id, label, code, error, label_error.

    Rows whose vector is null or holds null or non-finite components go, and so do those whose vector isn't as long
    as that of the smallest vec_id that stays. A length that ``PARTS`` doesn't divide is cut at the floors of its
    quarters. Codebooks begin with the vectors of the smallest vec_ids, equal ones in the order of their vectors, a
    null one last; with fewer rows than entries they are shorter. Repeated rows have a code each. Codes name entries
    by two hexadecimal digits each, in the order of the parts. Other columns aren't read; an empty table gives no
    rows. ``label_error`` is the error summed over rows of equal label, null labels together.
    """
    spark, kept = vectors.sparkSession, usable(vectors)
    # ENTRIES rows at most.
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(entries).collect()
    width = len(first[0][0]) if first else 0
    same = kept.filter(F.size("embedding") == width)
    if any(len(r[0]) != width for r in first):
        first = same.orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(entries).collect()
    if not first or not width:
        whole = same.select("vec_id", "label", F.lit("00" * PARTS).alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return (whole if first else whole.limit(0)), [np.zeros((len(first), 0), np.int64)] * PARTS
    grid = whole_numbers(np.array([r[0] for r in first], np.float64))
    books = [grid[:, a:b] for a, b in part_bounds(width)]
    planted = same.mapInArrow(lambda b: _planted(b, width), "named binary, points binary, small boolean, n int, trees binary")
    blocks = stage(planted, "vector-blocks")
    for _ in range(rounds):
        books = refine(blocks, books, width)
    final = books

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for named, parts, n in _blocks(batches, width):
            with pa.ipc.open_stream(named) as rows:
                ids = rows.read_all().combine_chunks()
            found = [assign(points, tree, final[k], True) for k, (points, tree) in enumerate(parts)]
            bytes_ = np.column_stack([f[0] for f in found]).astype(np.uint8).tobytes().hex()
            size = 2 * len(parts)
            codes = pa.array([bytes_[size * k : size * (k + 1)] for k in range(n)], pa.string())
            error = pa.array(sum(f[1] for f in found), pa.int64())
            yield pa.RecordBatch.from_arrays([ids["vec_id"].combine_chunks(), ids["label"].combine_chunks(), codes, error], ["vec_id", "label", "code", "error"])

    coded = stage(blocks.mapInArrow(code, "vec_id long, label string, code string, error long"), "vector-codes")
    keyed = coded.withColumn("_none", F.col("label").isNull()).withColumn("_label", F.coalesce("label", F.lit("")))
    errors = stage(keyed.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "label-errors")
    summed = spread_join(keyed, errors, ["_none", "_label"], "inner", errors).select("vec_id", "label", "code", "error", "label_error")
    return summed, books
