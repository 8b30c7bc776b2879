"""Codes through bounds against plain integer k-means."""

import hashlib
import random

import numpy as np
import pytest

from ratewise.llm import codebooks


def plain(rows, parts, entries, rounds):
    """``rows`` as (id, vector): codes per row, error per row, books."""
    x = [(i, [int(np.floor(4096 * float(np.float32(v)))) for v in vec]) for i, vec in rows]
    x.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ids, data = [i for i, _ in x], np.array([v for _, v in x], object)
    step = data.shape[1] // parts
    books = [[list(data[e, p * step : (p + 1) * step]) for e in range(min(entries, len(x)))] for p in range(parts)]

    def assign():
        out, error = [], []
        for row in data:
            code, total = [], 0
            for p in range(parts):
                mine = row[p * step : (p + 1) * step]
                d = [sum((a - b) ** 2 for a, b in zip(mine, e)) for e in books[p]]
                code.append(d.index(min(d)))
                total += min(d)
            out.append(code)
            error.append(total)
        return out, error

    for _ in range(rounds):
        codes, _ = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                members = [row[p * step : (p + 1) * step] for row, c in zip(data, codes) if c[p] == e]
                if members:
                    books[p][e] = [sum(v) // len(members) for v in zip(*members)]
    return ids, *assign(), books


def vectors(seed, n, width, grid=False):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(7)]
    out = []
    for i in range(n):
        c = rng.choice(centres)
        v = [a + rng.gauss(0, 0.2) for a in c]
        out.append((i * 3 % 1009, [round(a) * 1.0 for a in v] if grid else v))
    return out


def compare(spark, rows, parts, entries, rounds):
    df = spark.createDataFrame([(i, v, i % 3 if i else None, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, code string")
    found = codebooks.encode(df, parts=parts, entries=entries, rounds=rounds)
    ids, codes, error, books = plain(rows, parts, entries, rounds)
    got = sorted((r["vec_id"] is None, r["vec_id"] or 0, list(r["x"]), list(r["code"]), r["error"]) for r in found.rows.collect())
    x = [(i is None, i or 0) for i in ids]
    assert [(g[0], g[1]) for g in got] == x
    assert [g[3] for g in got] == codes and [g[4] for g in got] == error
    assert found.books.tolist() == books
    assert found.digest() == hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    return found


@pytest.mark.parametrize("seed, n, width, parts, entries, grid", [(1, 300, 8, 4, 16, False), (2, 200, 6, 2, 16, True), (3, 60, 4, 4, 5, True)])
def test_equal_to_plain_rounds(spark, seed, n, width, parts, entries, grid):
    compare(spark, vectors(seed, n, width, grid), parts, entries, 6)


def test_fewer_rows_than_entries_and_repeats(spark):
    rows = [(5, [1.0, -1.0]), (5, [1.0, -1.0]), (None, [0.25, 7.0]), (2, [-0.00001, 3.0])]
    compare(spark, rows, 2, 16, 3)
    compare(spark, rows[:1], 2, 16, 3)


def test_left_out_rows_and_labels(spark):
    bad = [None, [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], []]
    rows = [(i, v, None) for i, v in enumerate(bad, 10)] + [(1, [0.5, 0.25], None), (2, [0.0, 0.0], None), (3, [1.0, 1e30], 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = codebooks.encode(df, parts=2, entries=2, rounds=1)
    out = {r["vec_id"]: r for r in codebooks.label_errors(found.rows).collect()}
    assert set(out) == {1, 2, 3}
    assert out[1]["label_error"] == out[1]["error"] + out[2]["error"] and out[3]["label_error"] == out[3]["error"]
    assert codebooks.encode(df.filter("vec_id > 90")) is None


def test_bounds_are_used_and_fall(spark):
    """Clustered data: few parts look at other entries, so the number of bounds falls."""
    rows = vectors(9, 1500, 8)
    found = compare(spark, rows, 2, 16, 6)
    assert found.kept[0] == [4, 4] and max(found.kept[-1]) < 4


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x, book = rng.integers(-300, 300, (500, 4)), rng.integers(-300, 300, (16, 4))
    state, _ = codebooks.Bounds.fresh(x, book, 3)
    for _ in range(5):
        new = book + rng.integers(-40, 40, book.shape)
        state.moved(np.sqrt(((new - book) ** 2).sum(1)) * (1 + 1e-12))
        book = new
        exact = np.sqrt(codebooks.distances(x, book))
        assert (np.take_along_axis(exact, state.near.astype(int), 1) >= state.low).all()
        rest = exact.copy()
        np.put_along_axis(rest, np.concatenate([state.own[:, None], state.near], 1).astype(int), np.inf, 1)
        assert (rest.min(1) >= state.outer).all()
        d = state.assign(x, book)
        assert (d == codebooks.distances(x, book).min(1)).all()
        assert (state.own == codebooks.distances(x, book).argmin(1)).all()
        again = codebooks.Bounds.unpack(state.pack(), 3)
        assert (again.low == state.low).all() and (again.near == state.near).all() and (again.outer == state.outer).all()
