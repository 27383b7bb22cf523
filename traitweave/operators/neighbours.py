"""Exact k nearest neighbours.

Few queries (their count and bytes are checked) go to every task; each partition
of the training table keeps its k nearest, which are merged per query, and the
training table is not shuffled.

Many queries: a few training rows act as pivots. Every row belongs to the cell of its nearest
pivot. The triangle inequality bounds, for each query cell, the distance within
which all k neighbours must lie. Cells that are near each other make up groups; a training
row is sent once to a group if it can meet the bound of one of its cells, and is
compared with those cells only. Groups and what is sent to them are cut to a bounded size, a
task holds one part of each, and it returns only k rows per query. In many dimensions the
bounds prune little; then every training row goes to every group.

Euclidean distances are screened: a matrix product in single precision gives each with a bound
of its error, and only pairs that may be among the k nearest are worked out in double precision.
The result is that of working out all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.hashing import md5_of
from ..plans.joins import lookup_join
from ..session import checkpointed

BLOCK_ROWS = 2048
MAX_PIVOTS = 128
# Queries, and bytes of them, that every task may hold.
FEW_QUERIES, FEW_BYTES = 8192, 64 << 20
# Distances, and gaps between single coordinates, that a task holds at a time.
CELLS = 1 << 21
# Queries and training rows of a task, with a screen and without, and numbers of their vectors.
SCREENED, PLAIN, VECTOR_CELLS = (32768, 131072), (8192, 8192), (4 << 20, 8 << 20)
# Tasks of a search whose parts fill them.
TASKS = 32
# Queries and training rows that are compared at a time.
ASKED_STEP, KNOWN_STEP = 512, 2048
# Share of a part's rows that a cell needs, from which it is compared with all of them.
NEARLY_ALL = 0.9
# Relative room for rounding in the distance bounds.
SLACK = 1e-9


def distances(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Minkowski distances, rows of ``a`` against rows of ``b``."""
    out = np.empty((len(a), len(b)))
    step = max(1, CELLS // max(1, b.size))
    for i in range(0, len(a), step):
        gap = np.abs(a[i : i + step, None, :] - b[None, :, :])
        out[i : i + step] = (gap * gap if p == 2 else gap**p).sum(axis=2)
    return np.sqrt(out) if p == 2 else out ** (1.0 / p)


def _mixed_distances(a: tuple, b: tuple, p: float, mark_cost: float) -> np.ndarray:
    """Distances of points: vectors and, or None, their marks."""
    dist = distances(a[0], b[0], p)
    if a[1] is not None:
        left, right = a[1], b[1]
        unlike = sum((left[:, None, c] != right[None, :, c]).astype(float) for c in range(left.shape[1]))
        dist = np.sqrt(dist**2 + unlike * mark_cost**2)
    return dist


def _points(frame: pd.DataFrame) -> tuple:
    return np.stack(frame["vec"].to_list()).astype(float), np.stack(frame["marks"].to_list()) if "marks" in frame else None


def _frame_distances(a: pd.DataFrame, b: pd.DataFrame, p: float, mark_cost: float) -> np.ndarray:
    return _mixed_distances(_points(a), _points(b), p, mark_cost)


class _Screen:
    """Squared distances in single precision, less the squared distance of the left row to the centre, and how far off they may be."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        good, known = np.isfinite(x).all(axis=1), np.isfinite(y).all(axis=1)
        x, y = (v if g.all() else np.where(g[:, None], v, 0.0) for v, g in ((x, good), (y, known)))
        # No number is above 2 now, so no product is too large or of any weight where it is too small.
        self.scale = max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0)) or 1.0
        x, y = x / self.scale, y / self.scale
        centre = y.mean(axis=0) if len(y) else 0.0
        x -= centre
        y -= centre
        self.near, far = (x * x).sum(axis=1), (y * y).sum(axis=1)
        width, reach = x.shape[1], np.sqrt(self.near) + np.sqrt(far.max(initial=0.0))
        # Twice what a sum of products may lose in single precision, and what the centred numbers lost in double precision.
        self.slack = reach**2 * (width + 8) * 2.0**-23 + reach * np.sqrt(width) * 2.0**-48 + 1e-30
        self.left, self.right = (np.empty((len(v), width + 1), np.float32) for v in (x, y))
        self.left[:, :-1], self.left[:, -1] = x, 1.0
        self.right[:, :-1], self.right[:, -1] = y, far
        self.right[:, :-1] *= -2.0
        # Rows without a distance.
        self.right[~known, -1] = np.inf
        self.good = good

        if self.scale < 1e-130:
            # The squares of such numbers are none.
            self.slack[:] = np.inf

    def seen(self, rows: slice, cols: slice, room: np.ndarray) -> np.ndarray:
        left, right = self.left[rows], self.right[cols]
        return np.matmul(left, right.T, out=room[:len(left) * len(right)].reshape(len(left), len(right)))

    def top(self, rows: slice, bound: np.ndarray) -> np.ndarray:
        """What is seen of a distance up to ``bound`` is at most this."""
        with np.errstate(over="ignore"):
            return (bound / self.scale) ** 2 - self.near[rows] + self.slack[rows]


def _places(hit: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Flat places of the few that are true, eight looked at together; ``hit`` lies at the start of ``room``."""
    size = hit.size
    room[size:size + 8] = False
    some = np.flatnonzero(room[:-(-size // 8) * 8].view(np.uint64))
    word, byte = np.nonzero(room[:-(-size // 8) * 8].reshape(-1, 8)[some])
    return some[word] * 8 + byte


def closest(
    a: tuple, b: tuple, k: int, p: float = 2.0, mark_cost: float = 0.0, own: tuple[np.ndarray, np.ndarray] | None = None, limit: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and distances of the k nearest points ``b`` of each point ``a``, ascending; of equal distances the first columns.

    ``own``: from which column up to which each row meets itself, and does not count.
    ``limit``: the distance above which a row asks for no more.
    """
    screen = _Screen(a[0], b[0]) if p == 2 and a[1] is None else None
    n, m, width, found = len(a[0]), len(b[0]), max(1, a[0].shape[1]), []
    known_step = KNOWN_STEP if screen is not None else max(1, min(KNOWN_STEP, CELLS // width))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    room, hits = (np.zeros(min(n, ASKED_STEP) * min(m, known_step) + 8, t) for t in (np.float32, bool))

    def exact(row: np.ndarray, col: np.ndarray) -> np.ndarray:
        out, step = np.empty(len(row)), max(1, CELLS // width)
        for i in range(0, len(row), step):
            gap = np.abs(a[0][row[i:i + step]] - b[0][col[i:i + step]])
            out[i:i + step] = (gap * gap).sum(axis=1)
        return np.sqrt(out)

    for i in range(0, n, ASKED_STEP):
        rows = slice(i, min(n, i + ASKED_STEP))
        size = rows.stop - i
        bound = np.full(size, np.inf) if limit is None else limit[rows].astype(float)
        if screen is not None:
            bound[~screen.good[rows]] = -1.0
        best, more, waiting, merge_at = none, [], 0, 1
        for part, j in enumerate(range(0, m, known_step), 1):
            cols = slice(j, min(m, j + known_step))
            if screen is not None:
                seen = screen.seen(rows, cols, room)
            else:
                seen = _mixed_distances(*[(v[0][s], None if v[1] is None else v[1][s]) for v, s in ((a, rows), (b, cols))], p, mark_cost)
            if own is not None:
                start, stop = own[0][rows] - j, own[1][rows] - j
                for r in np.flatnonzero((start < stop) & (start < cols.stop - j) & (stop > 0)):
                    seen[r, max(0, start[r]):stop[r]] = np.inf
            top = np.where(bound < 0, -np.inf, screen.top(rows, np.abs(bound))) if screen is not None else bound
            free = bound == np.inf
            if free.any():
                take = min(k, seen.shape[1])
                edge = np.partition(seen[free], take - 1, axis=1)[:, take - 1].astype(float)
                top = top.copy()
                top[free] = edge if screen is None else edge + 2 * screen.slack[rows][free]
            top = np.minimum(top, 3e38 if screen is not None else np.finfo(float).max).astype(seen.dtype)
            hit = _places(np.less_equal(seen, top[:, None], out=hits[:seen.size].reshape(seen.shape)), hits)
            if len(hit):
                row, col = np.divmod(hit, seen.shape[1])
                dist = seen[row, col] if screen is None else exact(row + i, col + j)
                some = (dist <= bound[row]) & np.isfinite(dist)
                more.append((row[some], col[some] + j, dist[some]))
                waiting += int(some.sum())
            # The bounds change ever less, so the best are picked ever more seldom.
            if waiting and (part >= merge_at or waiting > 4 * k * size + 10_000 or cols.stop == m):
                row, col, dist = (np.concatenate(x) for x in zip(best, *more, strict=True))
                order = np.lexsort((col, dist, row))
                row, col, dist = row[order], col[order], dist[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                full = place == k - 1
                bound[row[full]] = np.minimum(bound[row[full]], dist[full])
                keep = place < k
                best, more, waiting = (row[keep], col[keep], dist[keep]), [], 0
            if part >= merge_at:
                merge_at *= 2
        found.append((best[0] + i, best[1], best[2]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else none


def _own_columns(names: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From where up to where each name stands among sorted ids."""
    codes, kinds = pd.factorize(np.concatenate([ids, names]), use_na_sentinel=False)
    known, asked = codes[:len(ids)], codes[len(ids):]
    size = np.bincount(known, minlength=len(kinds))
    first = np.zeros(len(kinds), np.int64)
    first[known[::-1]] = np.arange(len(ids))[::-1]
    return first[asked], (first + size)[asked]


def _field(df: DataFrame, name: str) -> str:
    return f"{name} {df.schema[name].dataType.simpleString()}"


def _few_queries(asked: pd.DataFrame, train: DataFrame, k: int, p: float, exclude_self: bool, mark_cost: float, schema: str) -> DataFrame:
    """The k nearest rows of each partition for a table of queries that every task gets; the training table stays where it is."""
    shared = train.sparkSession.sparkContext.broadcast(asked)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, best = shared.value, None
        names, points = queries["id"].to_numpy(), _points(queries) if len(queries) else None
        limit = np.full(len(queries), np.inf)
        for batch in batches:
            if len(batch) and len(queries):
                known = batch.sort_values("id", ignore_index=True)
                ids = known["id"].to_numpy()
                own = _own_columns(names, ids) if exclude_self else None
                row, col, dist = closest(points, _points(known), k, p, mark_cost, own, limit)
                new = pd.DataFrame({"row": row, "id": ids[col], "dist": dist})
                both = new if best is None else pd.concat([best, new])
                best = both.sort_values(["row", "dist", "id"]).groupby("row").head(k)
                full = best[best.groupby("row").cumcount() == k - 1]
                limit[full["row"].to_numpy()] = full["dist"].to_numpy()
        if best is not None and len(best):
            yield pd.DataFrame({"query": names[best["row"].to_numpy()], "id": best["id"].to_numpy(), "dist": best["dist"].to_numpy()})

    return train.mapInPandas(scan, schema)


def _with_cell(df: DataFrame, pivots: pd.DataFrame, p: float, mark_cost: float) -> DataFrame:
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                # A row without a distance is as far as can be.
                cell, pdist = np.zeros(len(batch), np.int32), np.full(len(batch), np.nan)
                row, col, dist = closest(_points(batch), _points(pivots), 1, p, mark_cost)
                cell[row], pdist[row] = col, dist
                yield batch.assign(cell=cell, pdist=pdist)

    schema = ", ".join([_field(df, c) for c in df.columns] + ["cell int", "pdist double"])
    return checkpointed(df.mapInPandas(place, schema))


def _grouped(counts: dict[int, int], between: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The first group of each cell, how many it has, and how many there are: near cells together, large ones cut."""
    first, parts = np.zeros(len(between), np.int64), np.ones(len(between), np.int64)
    left, at, n, held = sorted(counts), None, -1, most
    while left:
        cell = left[0] if at is None else min(left, key=lambda c: (between[at, c], c))
        left.remove(cell)
        at, rows = cell, counts[cell]
        if rows > most:
            first[cell], parts[cell] = n + 1, -(-rows // most)
            n, held = n + parts[cell], most
            continue
        if held + rows > most:
            n, held = n + 1, 0
        first[cell], held = n, held + rows
    return first, parts, int(n + 1)


def _entry(values, place) -> Column:
    """The number at a place, of numbers that the driver holds."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), place + 1)


def _part_of(id_col: str, n_parts):
    return F.pmod(F.xxhash64(id_col), n_parts).cast("int")


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(
    queries: DataFrame, train: DataFrame, k: int, p: float = 2.0, exclude_self: bool = False, mark_cost: float = 0.0
) -> DataFrame:
    """``(query, id, dist, place)``: the k nearest training rows of every query.

    Both inputs have ``id`` and ``vec`` (array of doubles), and optionally
    ``marks`` (array of texts; each unlike mark costs ``mark_cost``, with p=2).
    Equal distances are ordered by id.
    """
    if p < 1:
        raise ValueError("the triangle inequality needs p >= 1")
    need = k + 1 if exclude_self else k
    best = Window.partitionBy("query").orderBy("dist", "id")
    schema = f"query {queries.schema['id'].dataType.simpleString()}, {_field(train, 'id')}, dist double"
    payload = ["id", "vec"] + (["marks"] if "marks" in train.columns else [])
    n_queries = queries.count()
    # Rows times width of one of them: what every task would hold.
    width = (queries.agg(F.max(F.size("vec"))).first()[0] or 0) * 8 + 64 * len(payload)
    if n_queries <= FEW_QUERIES and n_queries * width <= FEW_BYTES:
        found = _few_queries(queries.select(*payload).toPandas(), train.select(*payload), k, p, exclude_self, mark_cost, schema)
        return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    # A training row may have to go to every cell, so cells are not made smaller
    # than a good part of a block of queries.
    n_pivots = max(1, min(MAX_PIVOTS, int(train.count() ** 0.5), 4 * n_queries // BLOCK_ROWS))
    # At most MAX_PIVOTS rows come to the driver.
    pivots = train.orderBy(md5_of("pivot", "id")).limit(n_pivots).toPandas()
    n_pivots = len(pivots)
    if pivots.empty:
        return queries.sparkSession.createDataFrame([], schema + ", place int")
    asked = _with_cell(queries, pivots, p, mark_cost)
    known = _with_cell(train, pivots, p, mark_cost)

    cells = {r["cell"]: r for r in asked.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("pdist").alias("radius")).collect()}
    closest = Window.partitionBy("cell").orderBy("pdist")
    # At most MAX_PIVOTS * (k + 1) rows come to the driver.
    near = known.select("cell", "pdist", F.row_number().over(closest).alias("r")).where(F.col("r") <= need).toPandas()
    between = _frame_distances(pivots, pivots, p, mark_cost)
    floor = np.full((n_pivots, n_pivots), np.inf)  # [query cell, training cell]
    for cell, row in cells.items():
        reach = np.sort(row["radius"] + between[cell, near["cell"]] + near["pdist"].to_numpy())
        bound = reach[need - 1] if len(reach) >= need else np.inf
        floor[cell] = between[cell] - row["radius"] - bound
        floor[cell] -= SLACK * (1.0 + between[cell] + row["radius"])
    # Next to rows without a distance there is no bound.
    floor[np.isnan(floor)] = -np.inf

    cells_of = max(1, width // 8)
    asked_most, known_most = (max(1, min(n, c // cells_of)) for n, c in zip(SCREENED if p == 2 and "marks" not in payload else PLAIN, VECTOR_CELLS, strict=True))
    first, n_of, n_groups = _grouped({c: r["n"] for c, r in cells.items()}, between, asked_most)
    # The least distance to its pivot at which a row of each training cell may be needed by a group.
    needed = np.full((n_groups, n_pivots), np.inf)
    for cell in cells:
        needed[first[cell]:first[cell] + n_of[cell]] = np.minimum(needed[first[cell]:first[cell] + n_of[cell]], floor[cell])

    @F.pandas_udf("array<int>")
    def route(cell: pd.Series, pdist: pd.Series) -> pd.Series:
        meets = pdist.to_numpy()[:, None] >= needed[:, cell].T
        return pd.Series([np.flatnonzero(m).astype("int32") for m in meets], dtype=object)

    # Only the numbers of the groups come from Python; the copies of a row are made, and shuffled, without it.
    place = [*payload, "cell", "pdist"]
    routed = known.select(*place, F.explode(route("cell", "pdist")).alias("target"))
    sent = {r["target"]: r["count"] for r in known.select(F.explode(route("cell", "pdist")).alias("target")).groupBy("target").count().collect()}
    fill = max(1, TASKS // max(1, n_groups))
    parts = [max(1, -(-sent.get(g, 0) // known_most), min(fill, -(-sent.get(g, 0) // min(known_most, PLAIN[1])))) for g in range(n_groups)]
    start, n_units = np.cumsum([0, *parts])[:-1], sum(parts)

    group = _entry(first, F.col("cell")) + _part_of("id", _entry(n_of, F.col("cell")))
    unit = F.explode(F.sequence(_entry(start, F.col("target")), _entry(start, F.col("target")) + _entry(parts, F.col("target")) - 1))
    names = F.col("id").alias("query"), F.lit(None).cast(train.schema["id"].dataType).alias("id")
    left = asked.withColumn("target", group).select(unit.alias("unit"), F.lit(True).alias("asks"), *names, *place[1:])
    names = F.lit(None).cast(queries.schema["id"].dataType).alias("query"), F.col("id")
    right = routed.select((_entry(start, F.col("target")) + _part_of("id", _entry(parts, F.col("target")))).alias("unit"), F.lit(False).alias("asks"), *names, *place[1:])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All of a unit; one after the other if a task has several."""
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for u in pc.unique(batch.column("unit")):
                for side, asks in zip(held.setdefault(u.as_py(), ([], [])), (True, False), strict=True):
                    side.append(batch.filter(pc.and_(pc.equal(batch.column("unit"), u), pc.equal(batch.column("asks"), asks))))
        while held:
            yield from _compared(held.popitem()[1], floor, k, p, mark_cost, exclude_self)

    # A unit is a task, whatever its size.
    found = left.unionByName(right).repartitionById(n_units, "unit").mapInArrow(compare, schema)
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def _compared(sides: tuple[list, list], floor: np.ndarray, k: int, p: float, mark_cost: float, exclude_self: bool) -> Iterator[pa.RecordBatch]:
    """The k nearest training rows of the queries that are here, cell by cell."""
    asked, known = map(pa.Table.from_batches, sides)
    for side in sides:
        side.clear()
    asked = asked.take(pc.sort_indices(asked.column("cell")))
    known = known.take(pc.sort_indices(known.column("id"), null_placement="at_start"))
    if not len(asked) or not len(known):
        return
    points = [(_vectors(t.column("vec")), np.stack(t.column("marks").to_pandas().to_list()) if "marks" in t.column_names else None) for t in (asked, known)]
    names, ids = asked.column("query").combine_chunks(), known.column("id").combine_chunks()
    own = _own_columns(names.to_pandas().to_numpy(), ids.to_pandas().to_numpy()) if exclude_self else None
    cell, pdist = known.column("cell").to_numpy(), known.column("pdist").to_numpy()
    cells, starts = np.unique(asked.column("cell").to_numpy(), return_index=True)
    del asked, known

    def part(points: tuple, rows) -> tuple:
        return tuple(None if v is None else v[rows] for v in points)

    ends = [*starts[1:], len(names)]
    meets = [pdist >= floor[c, cell] for c in cells]
    c = 0
    while c < len(cells):
        last, cols = c + 1, np.flatnonzero(meets[c])
        if len(cols) >= NEARLY_ALL * len(ids):
            # Cells that need nearly all rows are compared with all, together.
            while last < len(cells) and meets[last].mean() >= NEARLY_ALL:
                last += 1
            cols = None
        rows = slice(starts[c], ends[last - 1])
        mine = None if own is None else [x[rows] if cols is None else np.searchsorted(cols, x[rows]) for x in own]
        row, col, dist = closest(part(points[0], rows), points[1] if cols is None else part(points[1], cols), k, p, mark_cost, mine)
        col = col if cols is None else cols[col]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(row + rows.start)), ids.take(pa.array(col)), pa.array(dist)], names=["query", "id", "dist"])
        c = last


def knn(
    train: DataFrame, test: DataFrame, k: int, p: float = 2.0, weights: str = "uniform",
    key: str = "key", vec: str = "vec", label: str = "label",
) -> DataFrame:
    """``(key, prediction, share)`` by the vote of the k nearest training rows.

    ``distance`` weighs votes by 1/d; exact matches then outvote all others.
    Equal votes go to the smallest label.
    """
    asked = test.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    known = train.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    near = nearest(asked, known, k, p)
    labelled = lookup_join(near, train.select(F.col(key).alias("id"), F.col(label).alias("label")), ["id"], "inner")
    weight = F.lit(1.0)
    if weights == "distance":
        exact = F.min("dist").over(Window.partitionBy("query")) == 0
        weight = F.when(exact, (F.col("dist") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("dist")))
    elif weights != "uniform":
        raise ValueError(f"weights: {weights}")
    votes = labelled.withColumn("w", weight).groupBy("query", "label").agg(F.sum("w").alias("w"))
    return votes.groupBy(F.col("query").alias(key)).agg(
        F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("prediction"),
        (F.max("w") / F.sum("w")).alias("share"),
    )
