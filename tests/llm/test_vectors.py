"""Embedding near-dedup against all pairs."""

import numpy as np
import pytest

from busfleet.llm import vectors

DDL = "vec_id long, embedding array<double>, label int, component_id long, tile int"
INF, NAN = float("inf"), float("nan")


def planted(seed=3, n=260, d=12):
    """Clusters of near vectors, chains at the threshold, equal vectors, scaled copies, odd rows."""
    rng = np.random.default_rng(seed)
    rows, centres = [], rng.normal(size=(6, d))
    for i in range(n):
        kind = i % 5
        x = centres[rng.integers(6)] if kind < 3 else rng.normal(size=d)
        x = x + rng.normal(size=d) * (0, 0.05, 0.2, 0.1, 0)[kind]
        if kind == 1:
            x = x * 10.0 ** rng.integers(-150, 150)
        rows.append((i, x.tolist(), int(rng.integers(3))))
    a = np.deg2rad(11.4)  # cosine 0.98027 to the next of the chain, far below to the one after
    rows += [(1000 + k, [float(np.cos(a * k)), float(np.sin(a * k)), *[0.0] * (d - 2)], 7) for k in range(12)]
    x = rng.normal(size=d).tolist()
    rows += [(2000 + k, x, 8) for k in range(40)] + [(2000, x, 8), (2001, rows[0][1], 8)]
    odd = [None, [], [0.0] * d, [1.0] * (d - 1) + [NAN], [1.0] * (d - 1) + [None], [1.0] * (d - 1) + [INF], [1.0] * d, [1.0] * (d + 3), [1e-320] * d]
    rows += [(3000 + k, v, 9) for k, v in enumerate(odd + odd)]
    rows += [(4000, [1.0] * d, None), (4001, [1.0] * d, None), (None, [1.0] * d, 9)]
    return rows


def brute(rows, least=0.98):
    def key(row):
        i, v, label = row
        fine = i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        return (i, tuple(v), label) if fine else None

    entries = sorted({k for row in rows if (k := key(row))})
    units = [np.array(v) / np.abs(v).max() for _, v, _ in entries]
    units = [u / np.sqrt((u * u).sum()) for u in units]
    near = {x: [y for y in range(len(entries)) if y != x and entries[x][2] == entries[y][2] and len(units[x]) == len(units[y]) and units[x] @ units[y] >= least] for x in range(len(entries))}
    least_id = {}
    for start in range(len(entries)):
        if start not in least_id:
            seen, todo = {start}, [start]
            while todo:
                for y in near[todo.pop()]:
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            least_id |= dict.fromkeys(seen, min(entries[x][0] for x in seen))
    place = {e: x for x, e in enumerate(entries)}
    for row in rows:
        x = place.get(key(row)) if key(row) else None
        yield (row[0], 0, row[0], True) if x is None else (row[0], len(near[x]), least_id[x], row[0] == least_id[x])


@pytest.mark.parametrize("numbers", [1 << 17, 12 * 16])
def test_links(spark, monkeypatch, numbers):
    monkeypatch.setattr(vectors, "TILE_NUMBERS", numbers)
    monkeypatch.setattr(vectors, "TILE_LEAST", 8)
    rows = planted()
    table = spark.createDataFrame([(*r, -1, 5) for r in rows], DDL).repartition(3)
    got = vectors.near_duplicates(table)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = sorted(brute(rows), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(r[1] > 0 for r in want) > 100
    kept = vectors.deduplicate(table)
    assert kept.columns == table.columns and {r.vec_id for r in kept.collect()} == {r[0] for r in want if r[3]}


def test_empty(spark):
    table = spark.createDataFrame([], DDL)
    assert vectors.near_duplicates(table).collect() == [] and vectors.near_duplicates(table).columns == ["vec_id", "n_links", "component_id", "kept"]


def test_early_stop_and_forest():
    rng = np.random.default_rng(1)
    for d, same in ((5, True), (64, False), (40, True)):
        x = rng.normal(size=(90, d))
        x[30:60] = x[:30] + rng.normal(size=(30, d)) * 0.03
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        y = x if same else x[::-1].copy()
        basis = np.linalg.qr(rng.normal(size=(d, d)))[0]
        i, j = vectors.linked(x, y, basis, 0.98, same)
        wx, wy = np.nonzero(np.triu(x @ y.T >= 0.98, 1) if same else x @ y.T >= 0.98)
        assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(wx.tolist(), wy.tolist()))
        keep = vectors.spanning(i, j, 90)
        root = list(range(90))

        def find(a):
            while root[a] != a:
                a = root[a]
            return a

        for k in keep:
            a, b = find(int(i[k])), find(int(j[k]))
            assert a != b
            root[a] = b
        assert all(find(int(a)) == find(int(b)) for a, b in zip(i, j))
