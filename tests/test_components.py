"""Components over blocks against a search voxel by voxel."""

import numpy as np
import pytest

from voxframe.operators import components


def plain(rows, near):
    """Of each (key, z, y, x) the name of the first voxel that it hangs together with."""
    left, out = set(rows), {}
    while left:
        start = min(left)
        part, todo = {start}, [start]
        left.remove(start)
        while todo:
            k, z, y, x = todo.pop()
            for dz, dy, dx in near:
                for s in (1, -1):
                    n = (k, z + s * dz, y + s * dy, x + s * dx)
                    if n in left:
                        left.remove(n), part.add(n), todo.append(n)
        name = min((z << 42) + (y << 21) + x for _, z, y, x in part)
        out.update(dict.fromkeys(part, name))
    return out


@pytest.mark.parametrize("shape", [(2, 3, 4), (1, 1, 1), (32, 128, 128)])
@pytest.mark.parametrize("kind", ["solid", "slice", "diagonal"])
def test_blocks_and_faces(spark, shape, kind):
    rng = np.random.default_rng(3)
    rows = {(int(rng.integers(0, 2)) * 5 + 1, z, y, x) for z in range(6) for y in range(9) for x in range(10) if rng.random() < 0.55}
    d = spark.createDataFrame([("v", *r) for r in rows] + [("w", *r) for r in list(rows)[:40]], "vol_id string, label long, z long, y long, x long").repartition(3)
    keys, steps, reach, near = {
        "solid": (["vol_id", "label"], [(1, 0), (0, 1)], 0, [(1, 0, 0), (0, 1, 0), (0, 0, 1)]),
        "slice": (["vol_id", "label", "z"], [(0, 1)], 0, [(0, 1, 0), (0, 0, 1)]),
        "diagonal": (["vol_id", "label", "z"], [(0, 1)], 1, [(0, 1, 0), (0, 0, 1), (0, 1, 1), (0, 1, -1)]),
    }[kind]
    got = components.voxel_components(d, keys, steps, reach, shape).collect()
    assert len(got) == len(rows) + 40
    want = plain(rows, near)
    assert {(r.label, r.z, r.y, r.x): r.component for r in got if r.vol_id == "v"} == want
    assert {(r.label, r.z, r.y, r.x): r.component for r in got if r.vol_id == "w"} == plain(list(rows)[:40], near)


def test_links_are_pulled_to_the_least():
    rng = np.random.default_rng(4)
    for n in (1, 2, 50, 2000):
        a, b = rng.integers(0, n, n), rng.integers(0, n, n)
        label = list(range(n))
        for _ in range(n):
            new = label[:]
            for i, j in zip(a, b):
                new[i] = new[j] = min(new[i], new[j])
            if new == label:
                break
            label = new
        assert components.joined(n, a, b).tolist() == label
    chain = np.arange(4999)
    assert (components.joined(5000, chain, chain + 1) == 0).all()


def test_no_voxels(spark):
    d = spark.createDataFrame([], "vol_id string, label long, z long, y long, x long")
    assert components.solid_components(d).count() == 0 and components.graph_components(spark.createDataFrame([], "a long, b long")).count() == 0
