"""Post-processing and stitching of predictions against plain sequential versions, on small random patches and two volumes."""

import collections

import numpy as np
import pytest

from voxframe.operators import learn, patches, segment


def flood(cells: set, near) -> list[set]:
    left, out = set(cells), []
    for start in sorted(cells):
        if start not in left:
            continue
        part, todo = {start}, [start]
        left.discard(start)
        while todo:
            c = todo.pop()
            for d in near:
                n = tuple(a + b for a, b in zip(c, d))
                if n in left:
                    left.discard(n)
                    part.add(n)
                    todo.append(n)
        out.append(part)
    return out


SIX = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def stitched(shape, corners, maps, patch, stride, min_core, min_iom, min_largest, min_ratio):
    """One patch after the other into one volume."""
    whole, following = np.zeros(shape, int), 1
    for corner, local in zip(corners, maps):
        parts, top = collections.OrderedDict(), local.max()
        extra = []
        for lid in range(1, top + 1):
            pieces = flood(set(map(tuple, np.argwhere(local == lid).tolist())), SIX)
            if pieces:
                parts[lid] = pieces[0]
                extra += pieces[1:]
        for k, piece in enumerate(extra):
            parts[top + 1 + k] = piece
        lo = [0 if c == 0 else c + (p - s) // 2 for c, p, s in zip(corner, patch, stride)]
        hi = [c + p if c + p >= n else c + (p - s) // 2 + s for c, p, s, n in zip(corner, patch, stride, shape)]
        own = {lid: [tuple(a + b for a, b in zip(v, corner)) for v in piece] for lid, piece in parts.items()}
        core = {lid: [v for v in piece if all(a <= x < b for x, a, b in zip(v, lo, hi))] for lid, piece in own.items()}
        names = {}
        for lid, inside in core.items():
            if len(inside) < min_core:
                continue
            found = []
            for axis in range(3):
                if lo[axis] == 0:
                    continue
                flat = [k for k in range(3) if k != axis]
                face = {tuple(v[k] for k in flat) for v in inside if v[axis] == lo[axis]}
                plane = whole.take(lo[axis] - 1, axis)[lo[flat[0]] : hi[flat[0]], lo[flat[1]] : hi[flat[1]]]
                below = {(a + lo[flat[0]], b + lo[flat[1]]): int(plane[a, b]) for a, b in np.argwhere(plane > 0)}
                for g in sorted({below[c] for c in face if c in below}):
                    touch = {c for c in face if below.get(c) == g}
                    largest = max(map(len, flood(touch, EIGHT)))
                    iom, ratio = len(touch) / (min(len(face), sum(x == g for x in below.values())) + 1e-6), largest / (len(touch) + 1e-6)
                    if iom >= min_iom and largest >= min_largest and ratio >= min_ratio:
                        found.append(((-largest, -ratio, -iom, -len(touch), axis, g), g))
            if found:
                names[lid] = min(found)[1]
            else:
                names[lid], following = following, following + 1
        for lid, g in names.items():
            for v in own[lid]:
                if all(x < n for x, n in zip(v, shape)):
                    whole[v] = g
    return whole


@pytest.mark.parametrize("seed", [0, 1])
def test_stitching_against_one_patch_after_the_other(spark, seed):
    rng = np.random.default_rng(seed)
    shape, patch, stride = (10, 26, 26), (6, 11, 11), (4, 7, 7)
    rows, expected = [], {}
    vol = spark.createDataFrame([(f"v{k}", *shape, 1.0, 1.0, 1.0) for k in range(2)], "vol_id string, nz long, ny long, nx long, vz double, vy double, vx double")
    grid = patches.patch_grid(vol, patch, stride)
    for k in range(2):
        centers = rng.uniform(0, 1, (14, 3)) * shape
        z, y, x = np.indices(shape)
        d = np.stack([((z - a) * 1.5) ** 2 + (y - b) ** 2 + (x - c) ** 2 for a, b, c in centers])
        truth = np.where(d.min(0) < 30, d.argmin(0) + 1, 0)
        corners, maps = [], []
        for g in sorted(grid.where(f"vol_id = 'v{k}'").collect(), key=lambda r: r.patch_id):
            c = (g.z0, g.y0, g.x0)
            local = truth[c[0] : c[0] + patch[0], c[1] : c[1] + patch[1], c[2] : c[2] + patch[2]].copy()
            local[rng.random(local.shape) < 0.05] = 0
            order = rng.permutation(15) + 1
            local = np.where(local > 0, order[local], 0)
            corners.append(c)
            maps.append(local)
            rows += [(f"v{k}", g.patch_id, int(p[0] + c[0]), int(p[1] + c[1]), int(p[2] + c[2]), int(local[tuple(p)]), 0.5) for p in np.argwhere(local > 0)]
        expected[f"v{k}"] = stitched(shape, corners, maps, patch, stride, 6, 0.2, 4, 0.5)
    local = spark.createDataFrame(rows, "vol_id string, patch_id long, z long, y long, x long, label long, confidence double")
    got = segment.stitch_patches(local, grid, vol, stride, min_core=6, min_largest=4).collect()
    for v, whole in expected.items():
        mine = np.zeros(shape, int)
        for r in got:
            if r.vol_id == v:
                mine[r.z, r.y, r.x] = r.label
        assert (mine == whole).all() and whole.max() > 5


def plain_conflicts(probs: dict, final: dict, threshold, min_pixels, min_voxels):
    """probs: (query, z) -> {(y, x): prob}. Conflicts of each slice on the state before."""
    out = {k: dict(v) for k, v in probs.items()}
    mask = {k: {c for c, p in v.items() if p > threshold} for k, v in probs.items()}
    lost, won = collections.defaultdict(set), collections.defaultdict(dict)
    for z in sorted({z for _, z in probs}):
        qs = sorted(q for q, zz in probs if zz == z)
        times = collections.Counter(c for q in qs for c in mask[q, z])
        for part in flood({c for c, n in times.items() if n > 1}, [(1, 0), (-1, 0), (0, 1), (0, -1)]):
            if len(part) < min_pixels:
                continue
            take = [q for q in qs if mask[q, z] & part]
            up = {q: q for q in take}
            for a in take:
                for b in take:
                    i = len(mask[a, z] & mask[b, z])
                    if a < b and i >= min_pixels and (i / (min(len(mask[a, z]), len(mask[b, z])) + 1e-6) > 0.5 or i / (len(mask[a, z] | mask[b, z]) + 1e-6) > 0.3):
                        ra, rb = up[a], up[b]
                        up = {q: ra if r == rb else r for q, r in up.items()}
            for root in set(up.values()):
                group = [q for q in take if up[q] == root]
                union = set().union(*(mask[q, z] for q in group))
                if len(group) < 2 or len(union) < min_voxels:
                    continue
                like = lambda q: max((len(union & mask.get((q, zz), set())) / (len(union | mask.get((q, zz), set())) + 1e-6) for zz in (z - 1, z + 1)), default=0)
                best = max(group, key=lambda q: (round(like(q), 6), final[q], -q))
                for q in group:
                    lost[q, z] |= union
                for c in union:
                    top = max(probs[q, z].get(c, 0) for q in group)
                    won[best, z][c] = max(top, won[best, z].get(c, 0))
    for k, gone in lost.items():
        out[k] = {c: p for c, p in out[k].items() if c not in gone}
    for k, new in won.items():
        out[k] = {**out[k], **new}
    return out


def test_conflicts_against_plain_version(spark):
    rng = np.random.default_rng(3)
    rows, final = [], {}
    probs = collections.defaultdict(lambda: collections.defaultdict(dict))
    for patch in (1, 2):
        for q in range(8):
            score, (cz, cy, cx) = float(rng.uniform(0.5, 1)), rng.uniform(2, 10, 3)
            final[patch, q] = score * 0.5
            for z in range(6):
                for y in range(14):
                    for x in range(14):
                        p = 1 - ((z - cz / 2) ** 2 + (y - cy) ** 2 + (x - cx) ** 2) / 30
                        if p > 0.1:
                            rows.append((patch, q, score, z, y, x, float(p)))
                            probs[patch][q, z][y, x] = float(p)
    d = spark.createDataFrame(rows, "patch_id long, query_id long, score double, z long, y long, x long, prob double")
    scores = spark.createDataFrame([(p, q, s) for (p, q), s in final.items()], "patch_id long, query_id long, final_score double")
    got = collections.defaultdict(dict)
    for r in segment.resolve_conflicts(d, 0.5, 4, 6, scores, 0.5, 0.3).collect():
        assert (r.y, r.x) not in got[r.patch_id, r.query_id, r.z]
        got[r.patch_id, r.query_id, r.z][r.y, r.x] = r.prob
    changed = 0
    for patch in (1, 2):
        own = {k: dict(v) for k, v in probs[patch].items()}
        want = plain_conflicts(own, {q: s for (p, q), s in final.items() if p == patch}, 0.5, 4, 6)
        changed += want != own
        assert {k: v for k, v in want.items() if v} == {(q, z): dict(v) for (p, q, z), v in got.items() if p == patch and v}
    assert changed


def test_outlier_factor_in_many_columns(spark):
    rng = np.random.default_rng(4)
    columns = [f"c{i}" for i in range(7)]
    x = {v: np.round(rng.normal(size=(n, 7)), 2) for v, n in (("v0", 70), ("v1", 23))}
    rows = [(v, i, *map(float, r)) for v, m in x.items() for i, r in enumerate(m)]
    d = spark.createDataFrame(rows, "vol_id string, label long, " + ", ".join(f"{c} double" for c in columns))
    near = learn.nearest_in_matrix(d, columns, 5, block=16).collect()
    got = {(r.vol_id, r.label): r.lof for r in learn.local_outlier_factor(d, columns, 5).collect()}
    for v, m in x.items():
        dist = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
        np.fill_diagonal(dist, np.inf)
        order = np.argsort(dist, 1, kind="stable")[:, :5]
        assert {(r.label, r["rank"], r.other) for r in near if r.vol_id == v} == {(i, k + 1, int(j)) for i, o in enumerate(order) for k, j in enumerate(o)}
        kd = np.take_along_axis(dist, order, 1).max(1)
        lrd = 1 / (np.maximum(np.take_along_axis(dist, order, 1), kd[order]).mean(1) + 1e-10)
        for i in range(len(m)):
            assert got[v, i] == pytest.approx(lrd[order[i]].mean() / lrd[i])


def test_isolation_forest_is_per_volume(spark):
    rng = np.random.default_rng(5)
    rows = [("v0", i, *map(float, rng.normal(size=3) + (20 if i == 7 else 0))) for i in range(300)] + [("v1", i, *map(float, 50 + rng.normal(size=3))) for i in range(40)] + [("v2", i, 0.0, 0.0, float(i)) for i in range(5)]
    d = spark.createDataFrame(rows, "vol_id string, label long, a double, b double, c double")
    got = {(r.vol_id, r.label): r.isolation_forest_score for r in learn.isolation_forest_score(d, ["a", "b", "c"], trees=30).collect()}
    assert len(got) == len(rows) and got["v0", 7] == 1.0 and all(got["v2", i] is None for i in range(5))
    assert max(s for (v, _), s in got.items() if v == "v1") == 1.0 and np.mean([s for (v, _), s in got.items() if v == "v1"]) < 0.7


def test_dice_of_all_pairs(spark):
    """F8: pairs without a common voxel were left out."""
    rows = lambda r: spark.createDataFrame(r, "vol_id string, z long, y long, x long, label long")
    pred = rows([("a", 0, 0, x, 1 + x // 3) for x in range(6)] + [("b", 0, 0, 0, 9)])
    truth = rows([("a", 0, 0, x, 10 * (1 + x // 2)) for x in range(6)] + [("c", 0, 0, 0, 8)])
    found = {(r.vol_id, r.pred, r.truth): (r.overlap, r.dice_cost, r.iou) for r in segment.dice_matrix(pred, truth).collect()}
    common = {(1, 10): 2, (1, 20): 1, (2, 20): 1, (2, 30): 2}
    assert found == {("a", p, t): (i, 1 - (2 * i + 1) / 6, i / (5 - i)) for p in (1, 2) for t in (10, 20, 30) for i in [common.get((p, t), 0)]}
    assert {(r.pred, r.truth) for r in segment.match_instances(pred, truth).collect()} == {(1, 10), (2, 30)}
