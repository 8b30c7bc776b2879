"""Document fingerprints from prefix polynomial hashes.

The hash of the span [i, j) of a text is ``sum(c[k] * B ** (k - i))`` over its code points, modulo two
primes. One prefix array per prime answers every span: ``(P[j] - P[i]) * B ** -i``. Equal spans have
equal hashes; different ones collide with a chance of about 2 ** -62. The longest common extension of
two places is the longest span that is still equal, found by binary search (``extensions``).

A fingerprint keeps the prefix hashes of a text at a bounded number of landmarks, so the same
arithmetic answers spans between landmarks without the text. A landmark stands where the hash of the
``WINDOW`` code points before it ends in ``level`` zero bits, so it moves with its surroundings when
something is inserted far away. The level follows the length (up to about ``LANDMARKS`` of them; in a
short text every place is one). Landmarks of a level are among those of every lower one, so
fingerprints of different lengths meet at the higher level. A text that repeats itself may have very
many landmarks or none: many are thinned. A grid of places at fixed distances from the start, coarser
than the landmarks, gives every text its common beginning with another.

``likeness`` walks over the spans between landmarks of one fingerprint, looks each up in the other,
takes the longest common extension there by binary search over landmarks, and returns
``2 * common / (length + length)`` in code points: 1 for equal texts, about 0 for unrelated ones. The
common beginning by the grid, again by binary search, counts instead where it is longer.

Cases: a null text counts as empty; the empty text has a fingerprint of its own, and its likeness is 1
to itself and 0 to others. Texts are hashed whole in slices and segments of bounded size, whatever their
length. Equal texts have equal fingerprints; repeated rows are kept. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import mix, slices, texts
from .names import quoted

PRIMES = (2147483647, 2147483629)
BASES = (1812433253, 1566083941)
#: Code points hashed at once; also the length of the power tables.
SEGMENT = 1 << 16
WINDOW = 8
LANDMARKS = 64
#: Instead of a level: a place of the grid.
GRID = 255
MARK = np.dtype([("at", "<u4"), ("level", "u1"), ("h0", "<u4"), ("h1", "<u4")])


@cache
def _powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """B ** k and B ** -k for k below ``SEGMENT``."""
    p, out = PRIMES[which], []
    for base in (BASES[which], pow(BASES[which], -1, PRIMES[which])):
        table = np.ones(1, np.uint64)
        while len(table) < SEGMENT:
            table = np.concatenate([table, table * np.uint64(pow(base, len(table), p)) % np.uint64(p)])
        out.append(table)
    return out[0], out[1]


@cache
def _far(which: int, block: int, sign: int) -> int:
    """B ** (sign * block * SEGMENT)."""
    p = PRIMES[which]
    return pow(pow(BASES[which], sign, p), block * SEGMENT, p)


def unshift(which: int, at: np.ndarray) -> np.ndarray:
    """B ** -at."""
    at = np.asarray(at, np.int64)
    low, last = _powers(which)[1][at % SEGMENT], int(at.max(initial=0)) // SEGMENT
    if not last:
        return low
    far = np.array([_far(which, b, -1) for b in range(last + 1)], np.uint64)
    return low * far[at // SEGMENT] % np.uint64(PRIMES[which])


def prefixes(points: np.ndarray, which: int) -> np.ndarray:
    """The prefix array, one longer than ``points``; values are below 2 ** 31."""
    p, out = np.uint64(PRIMES[which]), np.zeros(len(points) + 1, np.uint32)
    near, carry = _powers(which)[0], np.uint64(0)
    for block, low in enumerate(range(0, len(points), SEGMENT)):
        part = points[low : low + SEGMENT].astype(np.uint64) + np.uint64(1)
        sums = np.cumsum(part * near[: len(part)] % p) % p
        sums = (sums * np.uint64(_far(which, block, 1)) + carry) % p
        out[low + 1 : low + 1 + len(part)] = sums
        carry = sums[-1]
    return out


def span_hash(prefix: np.ndarray, which: int, start, end) -> np.ndarray:
    """Hashes of the spans [start, end)."""
    p = np.uint64(PRIMES[which])
    start, end = np.asarray(start, np.int64), np.asarray(end, np.int64)
    return (prefix[end].astype(np.uint64) + p - prefix[start]) % p * unshift(which, start) % p


class Hashed:
    """A text with both prefix arrays."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.prefix = [prefixes(points, w) for w in range(2)]

    def span(self, start: int, end: int) -> tuple[int, int]:
        return tuple(int(span_hash(self.prefix[w], w, start, end)) for w in range(2))

    def extension(self, start: int, other: Hashed, at: int) -> int:
        """Length of the longest common extension of two places, by binary search."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(start, start + middle) == other.span(at, at + middle):
                low = middle
            else:
                high = middle - 1
        return low


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def longest_extensions(pairs: DataFrame, left: str = "left", right: str = "right", at_left: str = "at_left", at_right: str = "at_right") -> DataFrame:
    """The rows with ``extension``: code points that both texts share from the two places on.

    Places are offsets in code points; one that is null counts as 0, one outside its text gives 0.
    An existing column ``extension`` is replaced.
    """
    names = [c for c in pairs.columns if c.lower() != "extension"]
    rows = pairs.select(*[F.col(quoted(c)) for c in names])
    schema = rows.withColumn("extension", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b, i, j in zip(*(batch.column(c).to_pylist() for c in (left, right, at_left, at_right))):
                a, b, i, j = a or "", b or "", i or 0, j or 0
                inside = 0 <= i <= len(a) and 0 <= j <= len(b)
                found.append(Hashed(code_points(a)).extension(i, Hashed(code_points(b)), j) if inside else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "extension"])

    return rows.mapInArrow(run, schema)


# --- fingerprints --------------------------------------------------------------------------------


def level_of(n: np.ndarray) -> np.ndarray:
    """Zero bits that leave about half of ``LANDMARKS`` to all of them in a text of this length."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / LANDMARKS))).astype(np.int64)


def kept_marks(at: np.ndarray, zeros: np.ndarray, level: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and levels of a text's marks: the candidates, thinned by distance if there are very many, the grid, and the end."""
    inside = int(np.searchsorted(at, n))
    at, zeros = at[:inside], zeros[:inside]
    if len(at) > 4 * LANDMARKS:
        least, picked, k = max(1, (1 << level) // 4), [], 0
        while k < len(at):
            picked.append(k)
            k = int(np.searchsorted(at, at[k] + least))
        at, zeros = at[picked], zeros[picked]
    grid = np.arange(2 << level, n, 2 << level) if level else at
    kinds = np.zeros(len(at) + len(grid) + 1, np.uint8)
    kinds[: len(at)], kinds[len(at) : -1] = zeros, GRID
    return np.concatenate([at, grid, [n]]), kinds


def landmarks(points: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The marks of each text of a slice, the last one at its end; texts lie at ``starts[i]:starts[i + 1]``."""
    prefix = [prefixes(points, w) for w in range(2)]
    n = np.diff(starts)
    level = level_of(n)
    places, bits = [], []
    mask = ((np.int64(1) << level) - 1).astype(np.uint64)
    for low in range(0, len(points), 1 << 20):  # ends of windows
        end = np.arange(low + 1, min(low + (1 << 20), len(points)) + 1)
        # the texts of this run, and how many of its places each has
        first, last = np.searchsorted(starts, [end[0] - 1, end[-1] - 1], "right") - 1
        some = slice(first, last + 1)
        share = np.minimum(starts[first + 1 : last + 2], end[-1]) - np.maximum(starts[some], low)
        h = mix(span_hash(prefix[0], 0, np.maximum(end - WINDOW, np.repeat(starts[some], share)), end))
        hit = np.flatnonzero((h & np.repeat(mask[some], share)) == 0)
        places.append(end[hit])
        bits.append(h[hit])
    at = np.concatenate([np.zeros(0, np.int64), *places])
    bits = np.concatenate([np.zeros(0, np.uint64), *bits])
    zeros = np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1)).astype(np.uint8)
    cut = np.searchsorted(at, starts, "right")
    kept = []
    for i in range(len(n)):
        mine = slice(cut[i], cut[i + 1])
        kept.append(kept_marks(at[mine] - starts[i], zeros[mine], int(level[i]), int(n[i])))
    sizes = np.array([len(k) for k, _ in kept])
    marks = np.zeros(int(sizes.sum()), MARK)
    marks["at"], marks["level"] = (np.concatenate([k[j] for k in kept]) for j in range(2))
    begin = np.repeat(starts[:-1], sizes)
    for w, field in enumerate(("h0", "h1")):  # prefix hashes of each text from its own start
        marks[field] = span_hash(prefix[w], w, begin, begin + marks["at"])
    return np.split(marks, np.cumsum(sizes)[:-1])


def fingerprints_of(strings: list[str]) -> list[str]:
    """Fingerprints as text: the marks, in base 64; the last one holds length and hash of the whole text."""
    joined = "".join(strings)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
    return [base64.b64encode(m.tobytes()).decode() for m in landmarks(code_points(joined), starts)]


class Print:
    """A fingerprint read back at a level: its grid, and prefix hashes at 0 and at the landmarks."""

    def __init__(self, marks: np.ndarray, level: int):
        grid = marks["level"] == GRID
        self.n, self.grid = int(marks["at"][-1]), marks[grid & (marks["at"] % (2 << level) == 0)].tolist()
        chosen = (marks["level"] >= level) & ~grid
        chosen[-1] = True
        some = np.zeros(int(chosen.sum()) + 1, MARK)
        some[1:] = marks[chosen]
        at = some["at"].astype(np.int64)
        self.at, self.prefix, self.back, hashes = at.tolist(), [], [], [np.diff(at).tolist()]
        for w, field in enumerate(("h0", "h1")):
            p, h, back = np.uint64(PRIMES[w]), some[field].astype(np.uint64), unshift(w, at)
            hashes.append(((h[1:] + p - h[:-1]) % p * back[:-1] % p).tolist())
            self.prefix.append(h.tolist())
            self.back.append(back.tolist())
        self.spans = list(zip(*hashes))

    def span(self, i: int, j: int) -> tuple[int, int, int]:
        """Length and hashes of the text between two landmarks."""
        h = [(self.prefix[w][j] - self.prefix[w][i]) * self.back[w][i] % PRIMES[w] for w in range(2)]
        return self.at[j] - self.at[i], h[0], h[1]


@lru_cache(16)
def _marks(text: str) -> tuple[np.ndarray, int]:
    marks = np.frombuffer(base64.b64decode(text), MARK)
    return marks, int(level_of(marks["at"][-1:].astype(np.int64))[0])


@lru_cache(16)
def _print(text: str, level: int) -> Print:
    return Print(_marks(text)[0], level)


def likeness(a: str, b: str) -> float:
    """Share of code points in common spans of two fingerprints, from 0 to 1."""
    if a == b:
        return 1.0
    level = max(_marks(a)[1], _marks(b)[1])
    x, y = _print(a, level), _print(b, level)
    if not x.n or not y.n:
        return 0.0
    places = defaultdict(list)
    for k in reversed(range(len(y.spans))):
        places[y.spans[k]].append(k)
    taken, common, i = set(), 0, 0
    while i < len(x.spans):
        free = places.get(x.spans[i])
        while free and free[-1] in taken:
            free.pop()
        if not free:
            i += 1
            continue
        j = free[-1]
        low, high = 1, min(len(x.spans) - i, len(y.spans) - j)
        while low < high:  # the longest common extension, in landmarks
            middle = (low + high + 1) // 2
            if x.span(i, i + middle) == y.span(j, j + middle):
                low = middle
            else:
                high = middle - 1
        whole = (i, j) == (0, 0) or (i + low, j + low) == (len(x.spans), len(y.spans))
        if not whole and x.at[i + low] - x.at[i] < WINDOW:  # a few letters agree anywhere
            i += 1
            continue
        for k in range(low):
            if j + k not in taken:
                taken.add(j + k)
                common += x.spans[i + k][0]
        i += low
    low, high = 0, min(len(x.grid), len(y.grid))
    while low < high:  # the longest common beginning, on the grid
        middle = (low + high + 1) // 2
        if x.grid[middle - 1] == y.grid[middle - 1]:
            low = middle
        else:
            high = middle - 1
    common = max(common, x.grid[low - 1][0] if low else 0)
    return min(1.0, 2 * common / (x.n + y.n))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_chars, fingerprint`` of every row."""
    rows = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            strings = texts(part).to_pylist()
            sizes = pa.array([len(s) for s in strings], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("key"), sizes, pa.array(fingerprints_of(strings))], names=["key", "n_chars", "fingerprint"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_chars long, fingerprint string").withColumnRenamed("key", key)


# --- every document, its edited form, and the next document ----------------------------------------


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _compared(strings: list[str], prints: list[str]) -> list[pa.Array]:
    """All texts but the last, each with the one behind it."""
    changed = [edited(a, b) for a, b in zip(strings, strings[1:])]
    changed_prints = fingerprints_of(changed)
    near = [(likeness(a, c), likeness(a, b)) for a, b, c in zip(prints, prints[1:], changed_prints)]
    return [
        pa.array([len(s) for s in strings[:-1]], pa.int64()),
        pa.array([hashlib.sha256(s.encode()).hexdigest() for s in changed], pa.string()),
        pa.array(prints[:-1], pa.string()), pa.array(changed_prints, pa.string()),
        pa.array([e for e, _ in near], pa.float64()), pa.array([n for _, n in near], pa.float64()),
    ]


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = ["doc_id", *(c.split()[0] for c in RESULT.split(", "))]


def _range_of(key: str, heads: list[Column]) -> Column:
    """Which head a key follows: the last one, in falling order, that is not below it; searched in two steps."""
    width = max(1, int(len(heads) ** 0.5))
    groups = [heads[k : k + width] for k in range(0, len(heads), width)]
    above = lambda some: F.greatest(F.lit(1), F.size(F.filter(F.array(*some) if isinstance(some, list) else some, lambda h: h >= F.col(key))))
    group = above([g[0] for g in groups])
    return ((group - 1) * width + above(F.element_at(F.array(*[F.array(*g) for g in groups]), group)) - 1).cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The next document has the next smaller id; after the last comes the first. Rows of one id follow
    each other by a hash of their text, null ids come last. A single document follows itself.

    Keys alone are sorted first and give the head of every range (one row per partition). Texts are then
    shuffled once, into these ranges, and sorted there; a task reads on slice by slice, so neighbours
    meet. The last row of a range meets the next range's head, whose text comes as a row behind it.
    Equal rows are told apart by their place in the input, so that very many of them need not share a
    range; the input should be a table that reads the same twice.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(F.col("doc_id").alias("a"), F.xxhash64("text").alias("b"), F.monotonically_increasing_id().alias("c"))
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", key.alias("key"))
    ranged = rows.select("key").repartitionByRange(parts, F.col("key").desc())
    heads = [r["head"] for r in ranged.groupBy(F.spark_partition_id()).agg(F.max("key").alias("head")).orderBy(F.col("head").desc()).collect()]
    kind = rows.schema["doc_id"].dataType.simpleString()
    if not heads:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, {RESULT}")
    kinds = rows.schema["key"].dataType.simpleString()
    literal = lambda h: F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(h, rows.schema["key"].dataType.fields)])
    placed = rows.withColumns({"range": _range_of("key", [literal(h) for h in heads]), "head": F.lit(0)})
    # the texts of the heads: any row with the same id and hash has the same text
    wanted = docs.sparkSession.createDataFrame([(i - 1 if i else len(heads) - 1, *h[:2]) for i, h in enumerate(heads)], f"range int, _a {kind}, _b long")
    same = F.col("key.a").eqNullSafe(F.col("_a")) & (F.col("key.b") == F.col("_b"))
    found = rows.join(F.broadcast(wanted), same).groupBy("range").agg(F.min("text").alias("text"))
    behind = found.select(F.lit(None).cast(kind).alias("doc_id"), "text", F.lit(None).cast(kinds).alias("key"), "range", F.lit(1).alias("head"))
    together = placed.unionByName(behind).repartitionByRange(parts, "range").sortWithinPartitions("range", "head", F.col("key").desc())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, heads, strings, prints = [], [], [], []
        for some in slices(batches):
            mine, column = texts(some).to_pylist(), some.column("doc_id")
            ids += [column.slice(k, 1) for k in range(len(mine))]
            heads, strings, prints = heads + some.column("head").to_pylist(), strings + mine, prints + fingerprints_of(mine)
            chosen = [k for k in range(len(strings) - 1) if not heads[k]]  # a head has had its turn as the next text
            if chosen:
                arrays = _compared(strings, prints)
                take = pa.array(chosen)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids[:-1]).take(take), *(a.take(take) for a in arrays)], names=NAMES)
            ids, heads, strings, prints = ids[-1:], heads[-1:], strings[-1:], prints[-1:]

    return together.select("doc_id", "text", "head").mapInArrow(walk, f"doc_id {kind}, {RESULT}")
