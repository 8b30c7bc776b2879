"""Vector codes: one codebook per part of the vectors, fitted with Drake-Hamerly adaptive bounds.

Components become integers, ``floor(SCALE * x)``, and vectors are cut into ``PARTS`` equal consecutive
parts. A round assigns every part to the nearest entry of its codebook and then moves each entry to
the floor of the mean of its parts. All of this is integer arithmetic, so results do not depend on
the order of rows, tasks or rounding.

Between rounds a part keeps its entry, the ``b`` closest other entries with a lower bound each, in
order, and one outer bound for all the rest. When entries move, a bound falls by the distance moved
(the outer one by the longest such distance). A part whose exact distance to its own entry is below
all bounds keeps it without a look at any other. Otherwise its distances to the ``b`` entries are
verified in integers, and to all entries only if the outer bound does not hold. Bounds are rounded
downwards and compared strictly, so ties always reach the integers, where the lower index wins. After
each round ``b`` falls to the smallest number that would have served all but ``SPARE`` of the parts.
Bounds are written with the codes, one folder a round, and the folder before is removed, so a lost
executor costs one task's rows.

Cases: rows whose vector is null or holds nulls or non-finite values are left out, and so are vectors whose
length differs from that of the smallest id, or cannot be cut into equal parts. Components beyond
``LIMIT`` (16 bits before the scale) stop there, so that all sums fit 64 bits. Null ids come last. With
fewer rows than entries the codebooks have as many entries as rows; with none the result is empty.
Repeated rows are rows like any other; unused entries stay where they are. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage, spread
from .names import quoted
from .vectors import blobs, block, discard, finite, folder, lists, summed, unblob, written

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
CLOSEST = 4
FEWEST = 2
SPARE = 0.01
LIMIT = 1 << 28
#: Parts compared at once inside a task.
AT_ONCE = 4096


def quantised(rows: DataFrame, vector: str) -> DataFrame:
    """Adds ``x``, the integers; rows without a proper vector are left out."""
    scaled = F.transform(quoted(vector), lambda v: F.floor(F.greatest(F.lit(-LIMIT / 1.0), F.least(F.lit(LIMIT / 1.0), v.cast("double") * SCALE))).cast("int"))
    return rows.filter(finite(quoted(vector))).withColumn("x", scaled)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, in integers; ``entries`` may differ per row."""
    apart = x[:, None, :] - (entries if entries.ndim == 3 else entries[None])
    return np.einsum("rec,rec->re", apart, apart)


def below(squared: np.ndarray) -> np.ndarray:
    """A 32-bit number not above the root."""
    root = np.sqrt(squared.astype(np.float64)) * (1 - 1e-12)
    return lowered(root)


def lowered(values: np.ndarray) -> np.ndarray:
    """Rounded down to 32 bits."""
    short = values.astype(np.float32)
    return np.where(short > values, np.nextafter(short, np.float32(-np.inf)), short)


@dataclass
class Bounds:
    """State of one part of many vectors: ``own`` entry, ``near`` entries with ``low`` bounds, ``outer`` bound, bounds ``used``."""

    own: np.ndarray
    near: np.ndarray
    low: np.ndarray
    outer: np.ndarray
    used: np.ndarray

    @staticmethod
    def fresh(x: np.ndarray, book: np.ndarray, b: int) -> tuple[Bounds, np.ndarray]:
        """All distances; also returns the one to the own entry."""
        d = distances(x, book)
        order = np.argsort(d, axis=1, kind="stable")
        ranked = np.take_along_axis(d, order, axis=1)
        rest = below(ranked[:, b + 1]) if book.shape[0] > b + 1 else np.full(len(x), np.inf, np.float32)
        used = np.zeros(len(x), np.uint8)
        return Bounds(order[:, 0].astype(np.uint8), order[:, 1 : b + 1].astype(np.uint8), below(ranked[:, 1 : b + 1]), rest, used), ranked[:, 0]

    def moved(self, drift: np.ndarray) -> None:
        """Let the bounds follow the entries, and put them in order again."""
        self.low = lowered(self.low.astype(np.float64) - drift[self.near])
        self.outer = lowered(self.outer.astype(np.float64) - drift.max(initial=0.0))
        self._sort()

    def _sort(self) -> None:
        order = np.argsort(self.low, axis=1, kind="stable")
        self.near, self.low = np.take_along_axis(self.near, order, axis=1), np.take_along_axis(self.low, order, axis=1)

    def narrowed(self, b: int) -> None:
        """Keep the first ``b`` bounds; the outer one covers the others."""
        if b < self.low.shape[1]:
            self.outer = np.minimum(self.outer, self.low[:, b])
            self.near, self.low = self.near[:, :b], self.low[:, :b]

    def assign(self, x: np.ndarray, book: np.ndarray) -> np.ndarray:
        """Verify what the bounds leave open; returns the exact distance to the own entry."""
        gap = x - book[self.own]
        d = np.einsum("rc,rc->r", gap, gap)
        reach = np.sqrt(d.astype(np.float64)) * (1 + 1e-12)
        # how many bounds it takes until all later ones exceed the distance
        open_ = self.low <= reach[:, None]
        b = self.low.shape[1]
        self.used = np.where(open_.any(axis=1), b - np.argmax(open_[:, ::-1], axis=1), 0).astype(np.uint8) if b else np.zeros(len(x), np.uint8)
        all_open = self.outer <= reach
        self.used[all_open] = b + 1
        some = np.flatnonzero((self.used > 0) & ~all_open)
        if len(some):
            near = np.concatenate([self.own[some][:, None], self.near[some]], axis=1)
            exact = distances(x[some], book[near])
            order = np.lexsort((near, exact), axis=1)
            near, exact = np.take_along_axis(near, order, axis=1), np.take_along_axis(exact, order, axis=1)
            self.own[some], self.near[some], self.low[some], d[some] = near[:, 0], near[:, 1:], below(exact[:, 1:]), exact[:, 0]
        full = np.flatnonzero(all_open)
        if len(full):
            new, exact = Bounds.fresh(x[full], book, b)
            self.own[full], self.near[full], self.low[full], self.outer[full], d[full] = new.own, new.near, new.low, new.outer, exact
        return d

    def pack(self) -> np.ndarray:
        """One row of bytes per vector."""
        floats = np.concatenate([self.low, self.outer[:, None]], axis=1).astype("<f4")
        return np.concatenate([self.own[:, None], self.used[:, None], self.near, floats.view(np.uint8).reshape(len(self.own), -1)], axis=1)

    @staticmethod
    def unpack(data: np.ndarray, b: int) -> Bounds:
        floats = np.ascontiguousarray(data[:, 2 + b :]).view("<f4")
        return Bounds(data[:, 0].copy(), data[:, 2 : 2 + b].copy(), floats[:, :b].copy(), floats[:, b].copy(), data[:, 1].copy())

    @staticmethod
    def width(b: int) -> int:
        return 2 + b + 4 * (b + 1)


def assigned(rows: DataFrame, books: np.ndarray, drift: np.ndarray | None, old_b: list[int], new_b: list[int], extra: str) -> DataFrame:
    """Rows with ``code`` (own entries), ``error`` and ``state`` against ``books``; without ``drift`` there is no state yet."""
    parts, _, step = books.shape
    cuts = np.concatenate([[0], np.cumsum([Bounds.width(b) for b in old_b])])
    carried = [c.split()[0] for c in extra.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                some = whole.slice(at, AT_ONCE)
                x = block(some.column("x"), parts * step).astype(np.int64)
                before = None if drift is None else unblob(some.column("state"), int(cuts[-1]))
                packed, error = [], np.zeros(len(x), np.int64)
                for p in range(parts):
                    mine = x[:, p * step : (p + 1) * step]
                    if before is None:
                        state, d = Bounds.fresh(mine, books[p], new_b[p])
                    else:
                        state = Bounds.unpack(before[:, cuts[p] : cuts[p + 1]], old_b[p])
                        state.narrowed(new_b[p])
                        state.moved(drift[p])
                        d = state.assign(mine, books[p])
                    error += d
                    packed.append((state.own, state.pack()))
                code = blobs(np.stack([own for own, _ in packed], axis=1))
                arrays = [*(some.column(c) for c in carried), some.column("x"), code, pa.array(error, pa.int64()), blobs(np.concatenate([s for _, s in packed], axis=1))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*carried, "x", "code", "error", "state"])

    names = [*carried, "x"] + ([] if drift is None else ["state"])
    return rows.select(*names).mapInArrow(run, f"{extra}, x array<int>, code binary, error long, state binary")


def totals(rows: DataFrame, parts: int, entries: int, step: int, b: list[int]) -> DataFrame:
    """Per task: counts and sums of the parts of every entry, and how many bounds were used how often."""
    cuts = np.concatenate([[0], np.cumsum([Bounds.width(n) for n in b])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, step + 1), np.int64)
        used = np.zeros((parts, ENTRIES + 2), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = block(batch.column("x"), parts * step).astype(np.int64)
            code = unblob(batch.column("code"), parts)
            state = unblob(batch.column("state"), int(cuts[-1]))
            for p in range(parts):
                own = code[:, p].astype(np.int64)
                mine = np.concatenate([x[:, p * step : (p + 1) * step], np.ones((len(x), 1), np.int64)], axis=1)
                np.add.at(sums[p], own, mine)
                used[p] += np.bincount(state[:, cuts[p] + 1], minlength=ENTRIES + 2)[: ENTRIES + 2]
        for p in range(parts):
            both = [sums[p].ravel(), used[p]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p] * 2, pa.int32()), pa.array([0, 1], pa.int32()), pa.array([v.tolist() for v in both], pa.list_(pa.int64()))],
                names=["part", "kind", "v"],
            )

    return rows.select("x", "code", "state").mapInArrow(run, "part int, kind int, v array<long>")


@dataclass
class Codes:
    """``rows`` with ``x``, ``code`` and ``error``; the final ``books`` (part, entry, component); bounds kept per round and part."""

    rows: DataFrame
    books: np.ndarray
    kept: list[list[int]]

    def digest(self) -> str:
        """Of all components as decimal text, part by part, entry by entry."""
        return hashlib.sha256(",".join(str(v) for v in self.books.ravel().tolist()).encode()).hexdigest()


def encode(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", carry: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes | None:
    """Fit the codebooks and encode all rows; None if no row has a vector that can be cut."""
    spark = rows.sparkSession
    columns = [F.col(quoted(key)).alias("vec_id"), *([F.col(quoted(carry)).alias("label")] if carry else [])]
    ready = quantised(rows, vector).select(*columns, "x")
    extra = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ready.schema.fields[:-1])
    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    one = ready.orderBy(*order).limit(1).collect()
    width = len(one[0]["x"]) if one else 0
    if not width or width % parts:
        return None
    step = width // parts
    ready = ready.filter(F.size("x") == width)
    seeds = ready.orderBy(*order).limit(entries).collect()
    books = np.array([r["x"] for r in seeds], np.int64).reshape(len(seeds), parts, step).transpose(1, 0, 2)
    k = len(seeds)
    b = [min(CLOSEST, k - 1)] * parts
    kept, drift, old_b = [b], None, b
    state, home, last = spread(ready), folder(spark, "codebooks"), None
    for turn in range(rounds + 1):
        now = f"{home}/{turn}"
        state = written(assigned(state, books, drift, old_b, b, extra), now)
        if last is not None:
            discard(spark, last)
        last, old_b = now, b
        if turn == rounds:
            break
        sums, used = np.zeros((parts, k * (step + 1)), object), np.zeros((parts, ENTRIES + 2), np.int64)
        for r in summed(totals(state, parts, k, step, b), ["part", "kind"], "v"):
            (used if r["kind"] else sums)[r["part"], r["pos"]] = r["total"]
        sums = sums.reshape(parts, k, step + 1)
        counts = sums[:, :, -1:]
        new = np.where(counts > 0, sums[:, :, :-1] // np.where(counts > 0, counts, 1), books).astype(np.int64)
        drift = np.sqrt(((new - books) ** 2).sum(axis=2).astype(np.float64)) * (1 + 1e-12)
        books = new
        if turn:  # the first round has used no bounds yet
            b = [fewer(used[p], b[p]) for p in range(parts)]
        kept.append(b)
    return Codes(state, books, kept)


def fewer(used: np.ndarray, b: int) -> int:
    """The smallest number of bounds that would have served all parts but a few; never more than now."""
    beyond = used.sum() - np.cumsum(used)  # parts that needed more than i bounds
    enough = int(np.argmax(beyond - used[b + 1] <= SPARE * used.sum()))
    return min(b, max(FEWEST, enough))


def label_errors(rows: DataFrame) -> DataFrame:
    """Adds ``label_error``: ``error`` summed over equal labels, nulls being a label of their own."""
    sums = cut_lineage(rows.groupBy(F.col("label").alias("_of")).agg(F.sum("error").alias("label_error")))
    return rows.join(broadcast_if_small(sums, sums.count()), F.col("label").eqNullSafe(F.col("_of")), "left").drop("_of")
