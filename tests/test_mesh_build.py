"""The repaired mesh against plain loops."""

from collections import deque

import numpy as np
import pytest

from terrane.operators import mesh_build

GRID = "cell_id long, i int, j int, k int, active boolean, corners array<double>, known double"


def grid(nx, ny, nz, dead=(), flat=(), broken=()):
    rows = []
    for c in range(nx * ny * nz):
        i, j, k = c % nx, c // nx % ny, c // (nx * ny)
        x = [v for s in range(8) for v in (float(i + (s & 1)), float(j + (s >> 1 & 1)), float(k if c in flat else k + (s >> 2)))]
        rows.append((c, i, j, k, None if c == -1 else c not in dead, (None if c == broken[0] else [*x[:-1], float("nan")]) if c in broken else x, 1.0))
    return rows


def owners_by_search(rows, valid):
    """Steps to the nearest valid cells through active ones."""
    at = {r[1:4]: r[0] for r in rows if r[4]}
    hops, queue = {c: 0 for c in valid}, deque(valid)
    place = {c: p for p, c in at.items()}
    while queue:
        c = queue.popleft()
        for a in range(3):
            for s in (-1, 1):
                p = list(place[c])
                p[a] += s
                n = at.get(tuple(p))
                if n is not None and n not in hops:
                    hops[n] = hops[c] + 1
                    queue.append(n)
    return {c: hops.get(c, -1) for c in place}


def test_mesh_is_repaired(spark):
    rows = grid(4, 3, 3, dead=(3, 7, 11, 33, 34), flat=(0, 1, 5, 6, 17, 22), broken=(20, 21))
    rows += [(90, 9, 9, 9, True, None, None), (91, 8, 8, 8, False, None, None), (92, 8, 8, 7, None, None, None)]  # 90 is reached by no step
    m = mesh_build.build(spark.createDataFrame(rows, GRID).repartition(3), volume="known")
    cells = {r["cell_id"]: r for r in m.cells.collect()}
    valid = [r[0] for r in rows if r[4] and r[0] not in (0, 1, 5, 6, 17, 22, 20, 21, 90)]
    assert set(cells) == {r[0] for r in rows if r[4]} and {c for c, r in cells.items() if r["valid"]} == set(valid)
    hops = owners_by_search(rows, valid)
    place = {r[0]: np.array(r[1:4]) for r in rows}
    for c, r in cells.items():
        assert r["hops"] == hops[c] and r["owner"] in valid
        if hops[c] > 0:
            assert np.abs(place[c] - place[r["owner"]]).sum() >= hops[c] and r["cx"] == cells[r["owner"]]["cx"] and r["lz"] == 1.0
    assert cells[90]["owner"] == 35  # the nearest by place
    used = {tuple(place[c] + [s & 1, s >> 1 & 1, s >> 2]) for c in valid for s in range(8)}
    vertices = {r["vertex_id"]: (r["x"], r["y"], r["z"]) for r in m.vertices.collect()}
    assert sorted(vertices) == list(range(len(used))) and set(vertices.values()) == {tuple(map(float, p)) for p in used}
    of = {}
    for r in m.incidence.collect():
        of.setdefault(r["cell_id"], set()).add(vertices[r["vertex_id"]])
    for c, r in cells.items():
        assert of[c] == {tuple((place[r["owner"]] + [s & 1, s >> 1 & 1, s >> 2]).astype(float)) for s in range(8)}
    there = {r[1:4] for r in rows if r[4]}
    open_ = {(c, a, s) for c in valid for a in range(3) for s in (-1, 1) if tuple(place[c] + s * np.eye(3, dtype=int)[a]) not in there}
    quads = [tuple(vertices[v] for v in r["quad"]) for r in m.quads.collect()]
    assert len(quads) == len(open_) and all(len(set(q)) == 4 for q in quads)
    report = {(r["step"], r["measure"]): r["value"] for r in m.report.collect()}
    assert report["cells", "borrowing"] == len(cells) - len(valid) and report["cells", "most_hops"] == max(hops.values()) and report["cells", "by_centroid"] == 1
    assert report["kept", "vertices"] == len(used) and report["volume_error", "largest"] == 1.0 and report["cells", "volume"] == pytest.approx(len(valid))


def test_mesh_edges(spark):
    m = mesh_build.build(spark.createDataFrame([], GRID))
    assert m.cells.count() == m.vertices.count() == m.quads.count() == 0 and {r["value"] for r in m.report.collect()} == {0.0}
    with pytest.raises(ValueError, match="no seeds"):
        mesh_build.build(spark.createDataFrame(grid(2, 1, 1, flat=(0, 1)), GRID))
    with pytest.raises(ValueError, match="more than once"):
        mesh_build.build(spark.createDataFrame(grid(1, 1, 1) * 2, GRID))
