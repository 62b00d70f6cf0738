"""Near-duplicate embeddings: an exact metric range join of unit vectors.

Cosine at ``least`` or more is a distance of ``sqrt(2 - 2 * least)`` or less between unit vectors. Pivots from a bounded
sample part the vectors: each belongs to the cell of its nearest pivot. A vector also visits every other cell that may
hold a vector within the radius, unless one of these rules it out, for each vector u of cell j and pivots p:

* triangle inequality: d(v, p_j) - r <= d(u, p_j) <= d(v, p_j) + r must meet the distances that occur in the cell;
* u is at least as near to p_j as to v's own pivot, and v is more than r away from the plane between the two.

Of two cells only one gives visitors to the other, so each pair of vectors meets once. Cells too large for one task are
cut into slices and each pair of slices is a task of its own. Inside a task vectors are sorted by distance from the pivot:
blocks are multiplied only with the ring that the triangle inequality leaves, and two vectors whose distances from the
pivot add up to r or less are linked without being compared. Equal vectors are one weighted vector, so copies meet
nothing twice. A task returns counts and a spanning forest of its links, never the links of a dense group.

Vectors without structure in many dimensions defeat every rule: then nearly all pairs are compared, in blocked matrix
products. That is the nature of the exact join; the sample and the pivots never change its result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetweave.llm.hot_keys import looked_up
from fleetweave.llm.linking import components
from fleetweave.llm.scratch import stored
from fleetweave.llm.text import mix, release

LEAST = 0.95
SAMPLE = 4096  # vectors that pivots are chosen from
CELL, FEWEST, MOST = 8192, 8, 4096  # vectors to a cell on average; pivots at least and at most
SLICE = 8192  # vectors of one side of a task
SLACK = 1e-6  # of distances, far above their rounding
ROWS = 1024  # vectors handled at a time
_MEMBER = ("size int, cell int, a int, b int, side int, node long, weight long, dist double, raw binary")


def _usable(column: pa.Array, kind) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) by length: non-empty vectors without null or non-finite entries that are not zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    values = pc.cast(column.flatten(), pa.float64())
    flat = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False)
    out = []
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        found = flat[starts[rows][:, None] + np.arange(size)]
        good = np.isfinite(found).all(axis=1) & (found != 0).any(axis=1)
        out.append((rows[good], (found[good] + 0.0).astype(kind)))
    return out


def _units(raw: list[bytes], kind) -> np.ndarray:
    found = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    found /= np.abs(found).max(axis=1, keepdims=True)
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def _keyed(vectors: DataFrame, id_col: str, vector_col: str, kind: str) -> DataFrame:
    """(id, key, raw) of every row; key and raw are null where a vector links with nothing."""
    def run(batches):
        for batch in batches:
            key, raw = [None] * batch.num_rows, [None] * batch.num_rows
            for rows, found in _usable(batch.column(1), kind):
                for k, vector in zip(rows.tolist(), found):
                    raw[k] = vector.tobytes()
                    key[k] = xxhash.xxh3_128_digest(raw[k])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.binary()), pa.array(raw, pa.binary())],
                                             names=["id", "key", "raw"])

    wanted = "array<float>" if kind == "f4" else "array<double>"
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(wanted)).mapInArrow(
        run, "id long, key binary, raw binary")


class Pivots:
    """Points that part the vectors; for vectors of another length they are cut, or filled up with zeros."""

    def __init__(self, points: np.ndarray, radius: float):
        self.points, self.radius = points, radius
        self.near = self.far = None  # distances that occur in each cell

    @staticmethod
    def of(sample: np.ndarray, wanted: int, radius: float) -> Pivots:
        """Sampled vectors apart by two radii, then one, until there are enough, each moved to the middle of its cell."""
        chosen = np.empty((0, sample.shape[1]))
        for apart in (2 * radius, radius):
            for vector in sample:
                if len(chosen) < wanted and (not len(chosen) or ((chosen - vector) ** 2).sum(axis=1).min() > apart ** 2):
                    chosen = np.vstack([chosen, vector])
        cell = (sample @ chosen.T).argmax(axis=1)
        middle = np.stack([sample[cell == k].mean(axis=0) if (cell == k).any() else chosen[k] for k in range(len(chosen))])
        norms = np.linalg.norm(middle, axis=1, keepdims=True)
        return Pivots(np.where(norms > 0.1, middle / np.maximum(norms, 0.1), chosen), radius)

    def distances(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Squared distances to all pivots, the nearest pivot, and the squared distances between pivots."""
        points = np.zeros((len(self.points), units.shape[1]))
        shared = min(units.shape[1], self.points.shape[1])
        points[:, :shared] = self.points[:, :shared]
        norms = (points ** 2).sum(axis=1)
        found = np.maximum(1 - 2 * units @ points.T + norms, 0)
        between = np.maximum(norms[:, None] + norms - 2 * points @ points.T, 0)
        return found, found.argmin(axis=1), between

    def visits(self, found: np.ndarray, own: np.ndarray, between: np.ndarray) -> np.ndarray:
        """Which cells each vector visits, besides its own."""
        reach, dist = self.radius + SLACK, np.sqrt(found)
        other = np.arange(len(self.points))
        sent = np.where((own[:, None] + other) % 2 == 1, own[:, None] < other, own[:, None] > other)
        beyond = found - found[np.arange(len(own)), own][:, None]
        sent &= beyond <= 2 * reach * np.sqrt(between[own]) + SLACK
        return sent & (dist <= self.far + reach) & (dist >= self.near - reach)


def _pieces(batch: pa.RecordBatch, kind: str):
    """(rows, unit vectors) of ``ROWS`` rows of one length at a time."""
    raw = batch.column("raw").to_pylist()
    sizes = np.array([len(r) for r in raw], np.int64)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        for start in range(0, len(rows), ROWS):
            part = rows[start:start + ROWS]
            yield part, _units([raw[k] for k in part.tolist()], kind)


def _cells(distinct: DataFrame, pivots: Pivots, kind: str) -> list:
    """(cell, vectors, least distance, greatest distance), as many rows as pivots."""
    def run(batches):
        for batch in batches:
            for _, units in _pieces(batch, kind):
                found, own, _ = pivots.distances(units)
                dist = np.sqrt(found[np.arange(len(own)), own])
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(dist)], names=["cell", "dist"])

    return (distinct.select("raw").mapInArrow(run, "cell int, dist double").groupBy("cell")
            .agg(F.count("*").alias("n"), F.min("dist").alias("near"), F.max("dist").alias("far")).collect())


def _visitors(distinct: DataFrame, pivots: Pivots, kind: str) -> list:
    """(cell, visitors), as many rows as pivots at most."""
    def run(batches):
        sums = np.zeros(len(pivots.points), np.int64)
        for batch in batches:
            for _, units in _pieces(batch, kind):
                sums += pivots.visits(*pivots.distances(units)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=["cell", "n"])

    return distinct.select("raw").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()


def _dealt(distinct: DataFrame, pivots: Pivots, kind: str, owners: np.ndarray, guests: np.ndarray) -> DataFrame:
    """Vectors for the tasks (cell, a, b) in which slice a of a cell's vectors meets slice b, visitors' slices being last.

    The task (cell, a, a + 1) also compares slice a with itself; a cell of one slice without visitors is (cell, 0, 0).
    """
    def run(batches):
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            for part, units in _pieces(batch, kind):
                found, own, between = pivots.distances(units)
                sent = pivots.visits(found, own, between)
                sent[np.arange(len(own)), own] = True
                row, cell = np.nonzero(sent)
                spread = mix(nodes[part[row]].astype(np.uint64))
                is_own = own[row] == cell
                slot = np.where(is_own, spread % owners[cell], owners[cell] + spread % np.maximum(guests[cell], np.uint64(1))).astype(np.int64)
                units_in = (owners[cell] + guests[cell]).astype(np.int64)
                copies = np.where(is_own, np.maximum(units_in - 1, 1), owners[cell].astype(np.int64))
                cuts = np.flatnonzero(np.diff(np.cumsum(copies) // (16 * ROWS))) + 1
                for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(row)]):
                    yield rows(batch, part, found, units.shape[1], row[low:high], cell[low:high], slot[low:high], units_in[low:high], copies[low:high])
            release()

    def rows(batch, part, found, size, row, cell, slot, units_in, copies):
        at = np.repeat(np.arange(len(row)), copies)
        other = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
        mine = slot[at]
        other = np.where(units_in[at] == 1, mine, other + (other >= mine))  # every other slice once
        a, b = np.minimum(mine, other), np.maximum(mine, other)
        source = pa.array(part[row[at]])
        dist = np.sqrt(found[row[at], cell[at]])
        ints = [pa.array(v.astype(np.int32)) for v in (np.full(len(at), size), cell[at], a, b, mine != a)]
        return pa.RecordBatch.from_arrays([*ints, batch.column("node").take(source), batch.column("weight").take(source), pa.array(dist),
                                           batch.column("raw").take(source)], names=[c.split()[0] for c in _MEMBER.split(", ")])

    return distinct.select("node", "weight", "raw").mapInArrow(run, _MEMBER)


class _Meeting:
    """The vectors of a task, those of side a first, each side by ascending distance from the pivot."""

    def __init__(self, units: np.ndarray, weight: np.ndarray, dist: np.ndarray, first: int, radius: float, least: float):
        self.units, self.weight, self.dist, self.first = units, weight.astype(np.float64), dist, first
        self.radius, self.least = radius + SLACK, least
        self.core = (radius - SLACK) / 2
        self.links, self.label, self.edges = np.zeros(len(units)), np.arange(len(units)), []

    def _connect(self, row: int, others: np.ndarray) -> None:
        labels, at = np.unique(self.label[others], return_index=True)
        new = labels != self.label[row]
        if new.any():
            self.edges += [(row, k) for k in others[at[new]].tolist()]
            self.label[np.isin(self.label, labels[new])] = self.label[row]

    def _blocks(self, low: int, high: int, inner: int):
        """Ranges of ``ROWS // 4`` rows; none lies on both sides of ``inner``."""
        for start, end in ((low, inner), (inner, high)):
            for k in range(start, end, ROWS // 4):
                yield k, min(k + ROWS // 4, end)

    def meet(self, low: int, high: int, same: bool) -> None:
        """Compare side a with the vectors ``low`` to ``high``, which are side a itself or side b."""
        own_core = int(np.searchsorted(self.dist[:self.first], self.core, "right"))
        core = low + int(np.searchsorted(self.dist[low:high], self.core, "right"))
        if own_core and core > low:
            inner, outer = slice(0, own_core), slice(low, core)
            self.links[inner] += self.weight[outer].sum()
            if same:
                self.links[inner] -= self.weight[inner]
            else:
                self.links[outer] += self.weight[inner].sum()
                self._connect(low, np.arange(own_core))
            self._connect(0, np.arange(low, core))
        for start, end in self._blocks(0, self.first, own_core):
            ring = self.dist[start] - self.radius, self.dist[end - 1] + self.radius
            left = low + int(np.searchsorted(self.dist[low:high], ring[0], "left"))
            right = low + int(np.searchsorted(self.dist[low:high], ring[1], "right"))
            left = max(left, core if end <= own_core else low, start if same else low)
            if left < right:
                self._multiply(start, end, left, right, same)

    def _multiply(self, start: int, end: int, left: int, right: int, same: bool) -> None:
        close = self.units[start:end] @ self.units[left:right].T >= self.least
        if same and left == start:
            close[np.arange(end - start), np.arange(end - start)] = False
        rows = np.flatnonzero(close.any(axis=1))
        if not len(rows):
            return
        found = close[rows].astype(np.float64)
        self.links[start + rows] += found @ self.weight[left:right]
        back = self.weight[start + rows] @ found
        if same:
            back[:max(0, end - left)] = 0  # these pairs have been counted from both ends
        self.links[left:right] += back
        for k in rows.tolist():
            self._connect(start + k, left + np.flatnonzero(close[k]))


def _links(dealt: DataFrame, radius: float, least: float, kind: str) -> DataFrame:
    """(node, links, other): weights of a node's partners in one task where ``other`` is null, else a link."""
    def run(table):
        table = table.sort_by([("side", "ascending"), ("dist", "ascending")])
        nodes, side = table.column("node").to_numpy(), table.column("side").to_numpy()
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        first = int((side == 0).sum())
        meeting = _Meeting(_units(table.column("raw").to_pylist(), kind), table.column("weight").to_numpy(), table.column("dist").to_numpy(),
                           first, radius, least)
        if first and b - a <= 1:
            meeting.meet(0, first, True)
        if first and first < len(nodes):
            meeting.meet(first, len(nodes), False)
        some = np.flatnonzero(meeting.links)
        edges = np.array(meeting.edges, np.int64).reshape(-1, 2)
        release()
        return pa.table({"node": np.concatenate((nodes[some], nodes[edges[:, 0]])),
                         "links": np.concatenate((meeting.links[some].astype(np.int64), np.zeros(len(edges), np.int64))),
                         "other": pa.array(np.concatenate((np.zeros(len(some), np.int64), nodes[edges[:, 1]])),
                                           mask=np.arange(len(some) + len(edges)) < len(some))})

    return dealt.groupBy("size", "cell", "a", "b").applyInArrow(run, "node long, links long, other long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    ``n_links`` counts the other rows at cosine ``least`` or more, in double precision; ``component_id`` is the smallest id
    that such links reach, itself included, and a row is kept if that is its own id. Vectors that are null, empty or zero,
    or hold null or non-finite entries, link with nothing, nor do vectors of different lengths. Repeated rows link with each
    other and are all kept if their id is the smallest. A null id is never the smallest; a component of null ids has none,
    and its rows are not kept. Other columns are not read.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    radius = float(np.sqrt(2 - 2 * least))
    kind = "f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "f8"
    rows = _keyed(vectors, id_col, vector_col, kind)
    distinct = (rows.where("key is not null").groupBy("key")
                .agg(F.count("*").alias("weight"), F.min("id").alias("least"), F.first("raw").alias("raw")))
    distinct = stored(distinct.withColumn("node", F.monotonically_increasing_id()))
    count, total = distinct.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    alone = rows.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if count == 0:
        return alone.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))

    sample = [r["raw"] for r in distinct.orderBy("key").limit(SAMPLE).select("raw").collect()]
    width = max(len(r) for r in sample)
    sample = _units([bytes(r) for r in sample if len(r) == width], kind)
    pivots = Pivots.of(sample, min(MOST, max(FEWEST, count // CELL)), radius)
    owners, guests = np.zeros(len(pivots.points), np.uint64), np.zeros(len(pivots.points), np.uint64)
    pivots.near, pivots.far = np.full(len(owners), np.inf), np.full(len(owners), -np.inf)
    for r in _cells(distinct, pivots, kind):
        owners[r["cell"]], pivots.near[r["cell"]], pivots.far[r["cell"]] = -(-r["n"] // SLICE), r["near"], r["far"]
    for r in _visitors(distinct, pivots, kind):
        guests[r["cell"]] = -(-r["n"] // SLICE)
    guests[owners > 1] = np.maximum(guests[owners > 1], 1)  # so that the last slice of a cell has a task of its own
    found = stored(_links(_dealt(distinct, pivots, kind, owners, guests), radius, least, kind))

    linked = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    nodes = stored(distinct.select("node", "key", "weight", "least").join(linked, "node", "left").join(roots, "node", "left")
                   .select("node", "key", "weight", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                           F.coalesce("root", "node").alias("root")))
    groups = stored(nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    named = looked_up(nodes.select("key", "weight", "n_links", "root"), groups, "root", F.col("members"), count)
    named = stored(named.select("key", "weight", "n_links", "component_id"))
    known = looked_up(rows.where("key is not null").select("id", "key"), named, "key", F.col("weight"), total)
    every = known.select("id", "n_links", "component_id").unionByName(alone)
    return every.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
