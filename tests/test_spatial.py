"""Ways to choose a cell's neighbours, against plain loops."""

import numpy as np
import pytest

from voxframe.operators import spatial


@pytest.mark.parametrize("mode", spatial.MODES)
def test_neighbour_modes(spark, mode):
    x = np.random.default_rng(1).integers(0, 9, (40, 3)).astype(float)
    x[7] = x[8]
    cells = spark.createDataFrame([("v", k, *map(float, p)) for k, p in enumerate(x)] + [("v", 99, None, 1.0, 1.0)], "vol_id string, label long, centroid_z_um double, centroid_y_um double, centroid_x_um double")
    pairs = [(0, 1), (3, 30), (7, 8)]
    edges = spark.createDataFrame([("v", a, b, 1.0) for a, b in pairs], "vol_id string, label_a long, label_b long, contact_area_um2 double")
    got = spatial.neighbours(cells, mode, 4, 3.0, edges).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = {(i, j) for i in range(40) for _, j in sorted((d[i, j], j) for j in range(40) if j != i)[:4]}
    within = {(i, j) for i in range(40) for j in range(40) if i != j and d[i, j] <= 3}
    touch = {p for a, b in pairs for p in ((a, b), (b, a))}
    want = {"knn": near, "radius": within, "knn_radius": near & within, "contact": touch, "all": near | within | touch}[mode]
    assert len(got) == len(want) and {(r.label, r.other) for r in got} == want
    assert all(abs(r.distance - d[r.label, r.other]) < 1e-12 for r in got)


def test_unknown_mode_and_missing_edges(spark):
    cells = spark.createDataFrame([], "vol_id string, label long, centroid_z_um double, centroid_y_um double, centroid_x_um double")
    for mode, message in (("other", "unknown"), ("contact", "edges")):
        with pytest.raises(ValueError, match=message):
            spatial.neighbours(cells, mode)
