"""Hand-computed shapes and NumPy brute force for the voxel and cell operators."""

import collections
import itertools
import math

import numpy as np
import pytest

from voxframe.operators import cell, components, edits, geometry, patches, segment, spatial, voxel

SIZE = (2.0, 0.5, 0.5)


def volume(spark, array, vol="v"):
    rows = [(vol, int(z), int(y), int(x), int(array[z, y, x])) for z, y, x in zip(*np.nonzero(array))]
    vox = spark.createDataFrame(rows, "vol_id string, z long, y long, x long, label long")
    vol_row = spark.createDataFrame([(vol, *array.shape, *SIZE)], "vol_id string, nz int, ny int, nx int, vz double, vy double, vx double")
    return vox, vol_row


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


@pytest.fixture(scope="module")
def random_volume():
    rng = np.random.default_rng(1)
    return rng.integers(0, 4, (6, 7, 5))


def test_one_voxel(spark):
    a = np.zeros((3, 3, 3), int)
    a[1, 1, 1] = 7
    vox, vol = volume(spark, a)
    r = voxel.surface_area(vox, vol).first()
    assert r.surface_area_um2 == 2 * (SIZE[1] * SIZE[2] + 2 * SIZE[0] * SIZE[2])
    axes = voxel.pca_axes(vox, vol).first()
    assert axes.axis_major_um is None
    b = voxel.basic_features(vox, vol).first()
    assert not b.touch_border and b.volume_um3 == 0.5 and b.centroid_z == 1.0


def test_box_inside_and_on_border(spark):
    for at, border in ((1, False), (0, True)):
        a = np.zeros((6, 7, 8), int)
        a[at : at + 3, at : at + 4, at : at + 5] = 3
        vox, vol = volume(spark, a)
        assert voxel.surface_area(vox, vol).first().surface_area_um2 == pytest.approx(2 * (12 * 1.0 + 15 * 1.0 + 20 * 0.25))
        assert voxel.basic_features(vox, vol).first().touch_border is border
        n = 60
        axes = voxel.pca_axes(vox, vol).first()
        expect = sorted((2 * math.sqrt(5 * (k * k - 1) / 12 * n / (n - 1)) * s for k, s in zip((3, 4, 5), SIZE)), reverse=True)
        assert [axes.axis_major_um, axes.axis_intermediate_um, axes.axis_minor_um] == pytest.approx(expect, abs=1e-6)


def test_surface_and_contacts_against_brute_force(spark, random_volume):
    a = random_volume
    vox, vol = volume(spark, a)
    area = dict(zip("zyx", (SIZE[1] * SIZE[2], SIZE[0] * SIZE[2], SIZE[0] * SIZE[1])))
    surface, contact = dict.fromkeys((1, 2, 3), 0.0), {}
    pad = np.pad(a, 1)
    for p in np.argwhere(pad > 0):
        for ax, name in enumerate("zyx"):
            for d in (-1, 1):
                q = p.copy()
                q[ax] += d
                me, other = pad[tuple(p)], pad[tuple(q)]
                if me != other:
                    surface[me] += area[name]
                    if other:
                        k = (min(me, other), max(me, other))
                        contact[k] = contact.get(k, 0) + area[name] / 2
    got = {r.label: r.surface_area_um2 for r in voxel.surface_area(vox, vol).collect()}
    assert got == pytest.approx(surface)
    edges = voxel.contact_edges(vox, vol)
    assert {(r.label_a, r.label_b): r.contact_area_um2 for r in edges.collect()} == pytest.approx(contact)
    feats = rows(cell.contact_features(voxel.surface_area(vox, vol), edges), "label")
    assert sum(r.contact_neighbor_count for r in feats.values()) == 2 * len(contact)


def test_exposed_faces_match_surface(spark, random_volume):
    vox, vol = volume(spark, random_volume)
    n = geometry.exposed_faces(vox).groupBy("axis").count().collect()
    area = dict(zip("zyx", (0.25, 1.0, 1.0)))
    assert sum(area[r.axis] * r["count"] for r in n) == pytest.approx(sum(r.surface_area_um2 for r in voxel.surface_area(vox, vol).collect()))


def test_relabel_keeps_order(spark):
    a = np.zeros((1, 1, 5), int)
    a[0, 0] = [3, 10, 0, 11, 3]
    vox, _ = volume(spark, a)
    assert [(r.x, r.label) for r in voxel.relabel_sequential(vox).orderBy("x").collect()] == [(0, 1), (1, 2), (3, 3), (4, 1)]


def test_empty_volume_is_an_error(spark):
    vox, vol = volume(spark, np.zeros((2, 2, 2), int))
    with pytest.raises(ValueError):
        voxel.validated(vox, vol)


def test_constant_image_normalises_to_zero(spark):
    raw = spark.createDataFrame([("v", 0, 0, x, 5) for x in range(4)], "vol_id string, z long, y long, x long, value long")
    assert {r.norm for r in patches.percentile_normalize(raw).collect()} == {0.0}


def test_components_against_flood_fill(spark):
    rng = np.random.default_rng(3)
    a = (rng.random((5, 8, 9)) < 0.55).astype(int) * 4
    vox, _ = volume(spark, a)
    label = np.zeros_like(a)
    n = 0
    for p in np.argwhere(a):
        if not label[tuple(p)]:
            n += 1
            todo = [tuple(p)]
            while todo:
                q = todo.pop()
                if a[q] and not label[q]:
                    label[q] = n
                    for ax, d in itertools.product(range(3), (-1, 1)):
                        s = list(q)
                        s[ax] += d
                        if 0 <= s[ax] < a.shape[ax]:
                            todo.append(tuple(s))
    got = components.solid_components(vox).collect()
    pairs = {(r.component, label[r.z, r.y, r.x]) for r in got}
    assert len(pairs) == n == len({c for c, _ in pairs})
    split = components.split_disconnected(vox)
    assert split.select("label").distinct().count() == n and split.count() == (a > 0).sum()
    assert split.where("label = 4").count() > 0


def test_knn_and_radius_against_brute_force(spark):
    rng = np.random.default_rng(5)
    p = np.vstack([rng.random((60, 3)) * 10, [[100, 100, 100]], [[1, 1, 1], [1, 1, 1]]])
    df = spark.createDataFrame([("v", i, *map(float, q)) for i, q in enumerate(p)], "vol_id string, label long, centroid_z_um double, centroid_y_um double, centroid_x_um double")
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    got = {}
    for r in spatial.knn_join(df, 4).collect():
        got.setdefault(r.label, []).append((r["rank"], r.other, r.distance))
    for i in range(len(p)):
        order = sorted((d[i, j], j) for j in range(len(p)) if j != i)[:4]
        assert [j for _, j, _ in sorted(got[i])] == [j for _, j in order]
    near = {(r.label, r.other) for r in spatial.radius_join(df, 2.5).collect()}
    assert near == {(i, j) for i in range(len(p)) for j in range(len(p)) if i != j and d[i, j] <= 2.5}


def test_one_cell_has_no_neighbour(spark):
    df = spark.createDataFrame([("v", 1, 0.0, 0.0, 0.0)], "vol_id string, label long, centroid_z_um double, centroid_y_um double, centroid_x_um double")
    assert spatial.knn_features(df, (5,)).first().nearest_neighbor_distance_um is None


def test_padding_mirrors_like_numpy(spark):
    a = np.arange(2 * 5 * 4).reshape(2, 5, 4) + 1
    vox, vol = volume(spark, a)
    got = np.zeros((4, 8, 6), int)
    for r in patches.pad_volume(vox.withColumnRenamed("label", "value"), vol, (4, 8, 6), (4, 8, 6)).collect():
        got[r.z, r.y, r.x] = r.value
    assert (got == np.pad(a, ((0, 2), (0, 3), (0, 2)), mode="reflect")).all()


def test_edit_sequence(spark):
    a = np.zeros((1, 2, 4), int)
    a[0, 0] = 5
    vox, _ = volume(spark, a)
    roi = spark.createDataFrame([("v", 0, 0, 0), ("v", 0, 1, 0)], "vol_id string, z long, y long, x long")
    added = edits.add_roi(vox, roi, 9)
    assert added.where("label = 9").count() == 2 and added.count() == 5
    assert edits.subtract_roi(added, roi, 5).count() == 5
    log = spark.createDataFrame([("v", 1, 0, 0, 1, 8), ("v", 2, 0, 0, 1, 0), ("v", 3, 0, 1, 1, 8)], "vol_id string, seq long, z long, y long, x long, label long")
    out = {(r.y, r.x): r.label for r in edits.apply_edit_log(vox, log).collect()}
    assert out == {(0, 0): 5, (0, 2): 5, (0, 3): 5, (1, 1): 8}


def test_stitching_joins_one_cell_cut_in_two(spark):
    vol = spark.createDataFrame([("v", 8, 8, 20, *SIZE)], "vol_id string, nz int, ny int, nx int, vz double, vy double, vx double")
    grid = patches.patch_grid(vol, (8, 8, 12), (8, 8, 8))
    cellbox = [("v", z, y, x, 1, 0.5) for z in range(1, 7) for y in range(1, 7) for x in range(2, 18)]
    whole = spark.createDataFrame(cellbox, "vol_id string, z long, y long, x long, label long, confidence double")
    local = patches.voxels_in_patches(whole, grid).select("vol_id", "patch_id", "z", "y", "x", (voxel.F.col("label") + voxel.F.col("patch_id") * 0 + 1).alias("label"), "confidence")
    out = segment.stitch_patches(local, grid, vol, (8, 8, 8))
    assert out.count() == len(cellbox) and out.select("label").distinct().count() == 1


def test_flips_stay_in_each_patch(spark):
    from voxframe.plans import queries

    sf = "/root/testdata/sf0.001"
    got = [tuple(r) for r in queries.QUERIES["flip_rot90"](spark, sf).select("patch_name", "z", "y", "x", "label").collect()]
    before = [tuple(r) for r in queries.QUERIES["training_patches"](spark, sf).select("patch_name", "z", "y", "x", "label").collect()]
    assert len(got) == len(set(got)) == len(before) and set(got) != set(before)
    assert all(0 <= v < n for r in got for v, n in zip(r[1:4], queries.PATCH))
    count = lambda rows: collections.Counter(r[0] for r in rows)
    assert count(got) == count(before)


def test_flips_follow_the_size_of_each_patch(spark):
    from voxframe.operators import augment

    sizes = {f"p{i}": (3 + i % 3, 4, 4 + i % 2) for i in range(24)}
    d = spark.createDataFrame([(p, z, y, x, *n) for p, n in sizes.items() for z in range(n[0]) for y in range(n[1]) for x in range(n[2])], "patch_name string, z long, y long, x long, nz long, ny long, nx long")
    got = augment.flip_rot90(d, ("nz", "ny", "nx")).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in d.collect())
