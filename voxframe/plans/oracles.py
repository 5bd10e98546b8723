"""SQL for DuckDB with the same rows as the registered queries, on the same tables."""

from __future__ import annotations

#: The derived volumes, as common table expressions.
FIXTURES = """
seeds AS (
  SELECT s_suppkey AS k, 8*(s_suppkey//100)+4+(s_suppkey*7)%3-1 AS cz, 8*((s_suppkey//10)%10)+4+(s_suppkey*11)%3-1 AS cy,
         8*(s_suppkey%10)+4+(s_suppkey*13)%3-1 AS cx, 10+(s_suppkey*5)%16 AS r2, 5*s_suppkey+2 AS label FROM supplier),
query_all AS (
  SELECT k//100 AS patch_id, label AS query_id, 0.5::DOUBLE+(k%50)/100.0::DOUBLE AS score, cz+dz AS z, cy+dy AS y, cx+dx AS x,
         dz*dz*(1+k%2)+dy*dy+dx*dx AS d2, r2
  FROM seeds, (SELECT unnest(range(-6,7)) AS dz), (SELECT unnest(range(-6,7)) AS dy), (SELECT unnest(range(-6,7)) AS dx)
  WHERE 2*(dz*dz*(1+k%2)+dy*dy+dx*dx) <= 3*r2 AND cz+dz>=0 AND cy+dy>=0 AND cx+dx>=0),
query_vox AS (SELECT patch_id, query_id, score, z, y, x, 1.0::DOUBLE - d2/(2.0::DOUBLE*r2) AS prob FROM query_all),
label_vox AS (SELECT 'v0' AS vol_id, z, y, x, min(query_id) AS label FROM query_all WHERE d2 <= r2 GROUP BY z, y, x),
volumes AS (
  SELECT 'v0' AS vol_id, max(z)+1 AS nz, max(y)+1 AS ny, max(x)+1 AS nx, 2.0::DOUBLE AS vz, 0.5::DOUBLE AS vy, 0.5::DOUBLE AS vx, max(label)+1 AS next_label_id FROM label_vox),
raw_vox AS (
  SELECT 'v0' AS vol_id, g.z, g.y, g.x, (g.z*131+g.y*37+g.x*17)%97 + CASE WHEN l.label IS NULL THEN 0 ELSE 100+(l.label*29)%50 END AS value
  FROM (SELECT z, y, x FROM volumes, (SELECT unnest(range(0,(SELECT nz FROM volumes))) AS z), (SELECT unnest(range(0,(SELECT ny FROM volumes))) AS y),
        (SELECT unnest(range(0,(SELECT nx FROM volumes))) AS x)) g LEFT JOIN label_vox l ON g.z=l.z AND g.y=l.y AND g.x=l.x),
pred_vox AS (SELECT vol_id, z, y, x+1 AS x, 2*label+1 AS label FROM label_vox WHERE label%7 <> 0),
axis_starts AS (
  SELECT DISTINCT axis, s FROM (
    SELECT axis, unnest(CASE WHEN n<=p THEN [0::BIGINT] ELSE list_append(range(0,n-p+1,st), n-p) END) AS s
    FROM (SELECT 'z' AS axis, nz AS n, 8 AS p, 6 AS st FROM volumes UNION ALL SELECT 'y', ny, 16, 12 FROM volumes UNION ALL SELECT 'x', nx, 16, 12 FROM volumes))),
patches AS (
  SELECT 'v0' AS vol_id, row_number() OVER (ORDER BY a.s, b.s, c.s) AS patch_id, a.s AS z0, b.s AS y0, c.s AS x0, 8::BIGINT AS pz, 16::BIGINT AS py, 16::BIGINT AS px
  FROM axis_starts a, axis_starts b, axis_starts c WHERE a.axis='z' AND b.axis='y' AND c.axis='x'),
roi_vertices AS (
  SELECT 'v0' AS vol_id, k AS roi_id, o AS ord, cz AS z, cy + CASE o WHEN 0 THEN -5 WHEN 2 THEN 5 ELSE 0 END AS y, cx + CASE o WHEN 1 THEN 5 WHEN 3 THEN -5 ELSE 0 END AS x
  FROM seeds, (SELECT unnest(range(0,4)) AS o) WHERE k%10=0),
curation_log AS (
  SELECT event_id AS seq, ts, CASE event_id%5 WHEN 0 THEN 'add to label' WHEN 1 THEN 'subtract from label' WHEN 2 THEN 'change label' WHEN 3 THEN 'delete current Z' ELSE 'delete all Z' END AS operation,
         5*(user_id%(SELECT count(*) FROM supplier))+2 AS label_id, event_id%(SELECT nz FROM volumes) AS z_index, 'seg_'||(user_id%4) AS layer_name, props AS note FROM events),
image_files AS (SELECT 'images/vol_'||p_partkey||'.npy' AS path FROM part WHERE p_partkey%3<>0),
label_files AS (SELECT 'labels/vol_'||p_partkey||'.npy' AS path FROM part WHERE p_partkey%5<>0),
points AS (SELECT 'v'||(vec_id%5) AS vol_id, vec_id AS label, embedding[1]::DOUBLE*100 AS cz, embedding[2]::DOUBLE*100 AS cy, embedding[3]::DOUBLE*100 AS cx FROM embeddings),
basic0 AS (
  SELECT vol_id, label, count(*) AS n, sum(z)::BIGINT AS sz, sum(y)::BIGINT AS sy, sum(x)::BIGINT AS sx, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1
  FROM label_vox GROUP BY vol_id, label),
basic AS (
  SELECT b.*, n*vz*vy*vx AS volume, sz/n::DOUBLE AS mz, sy/n::DOUBLE AS my, sx/n::DOUBLE AS mx, sz/n::DOUBLE*vz AS uz, sy/n::DOUBLE*vy AS uy, sx/n::DOUBLE*vx AS ux,
         (z0=0 OR z1=nz-1 OR y0=0 OR y1=ny-1 OR x0=0 OR x1=nx-1) AS border, nz, ny, nx, vz, vy, vx
  FROM basic0 b JOIN volumes USING (vol_id)),
faces AS (
  SELECT least(p.label, q.label) AS a, greatest(p.label, q.label) AS b, q.z-p.z AS fz, q.y-p.y AS fy, q.x-p.x AS fx
  FROM label_vox p, (VALUES (1,0,0),(0,1,0),(0,0,1)) d(dz,dy,dx), label_vox q WHERE q.z=p.z+dz AND q.y=p.y+dy AND q.x=p.x+dx),
surface AS (
  SELECT vol_id, label, 2*((n-iz)*vy*vx+(n-iy)*vz*vx+(n-ix)*vz*vy) AS area
  FROM basic LEFT JOIN (SELECT a, sum(fz) AS iz0, sum(fy) AS iy0, sum(fx) AS ix0 FROM faces WHERE a=b GROUP BY a) ON a=label, LATERAL (SELECT coalesce(iz0,0) AS iz, coalesce(iy0,0) AS iy, coalesce(ix0,0) AS ix)),
edges AS (
  SELECT vol_id, a, b, sum(fz*vy*vx+fy*vz*vx+fx*vz*vy) AS area FROM faces, volumes WHERE a<b GROUP BY vol_id, a, b),
contact AS (
  SELECT s.vol_id, s.label, coalesce(n,0) AS n, coalesce(t,0) AS total, coalesce(m,0) AS largest, s.area AS surface
  FROM surface s LEFT JOIN (SELECT l, count(*) AS n, sum(area) AS t, max(area) AS m FROM (SELECT a AS l, area FROM edges UNION ALL SELECT b, area FROM edges) GROUP BY l) ON l=s.label),
near AS (
  SELECT *, row_number() OVER (PARTITION BY vol_id, label ORDER BY d, other) AS rk FROM (
    SELECT p.vol_id, p.label, q.label AS other, sqrt((p.uz-q.uz)*(p.uz-q.uz)+(p.uy-q.uy)*(p.uy-q.uy)+(p.ux-q.ux)*(p.ux-q.ux)) AS d FROM basic p JOIN basic q ON p.label<>q.label)),
near_points AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vol_id, label ORDER BY d, other) AS rk FROM (
    SELECT p.vol_id, p.label, q.label AS other, sqrt((p.cz-q.cz)*(p.cz-q.cz)+(p.cy-q.cy)*(p.cy-q.cy)+(p.cx-q.cx)*(p.cx-q.cx)) AS d FROM points p JOIN points q ON p.vol_id=q.vol_id AND p.label<>q.label))),
norms AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi, min(value) AS mn, max(value) AS mx FROM raw_vox),
norm_vox AS (SELECT r.*, CASE WHEN hi<=lo THEN 0 ELSE (least(greatest(value::DOUBLE, lo), hi)-lo)/(hi-lo) END AS norm FROM raw_vox r, norms),
quality AS (
  SELECT patch_id, query_id, max(score) AS score, sum((prob>0.5)::INT)::BIGINT AS area, sum(CASE WHEN prob>0.5 THEN prob ELSE 0 END)/(sum((prob>0.5)::INT)+1e-6) AS quality FROM query_vox GROUP BY ALL),
ranked AS (SELECT *, score*quality AS final_score, row_number() OVER (PARTITION BY patch_id ORDER BY score*quality DESC, query_id) AS rk FROM quality WHERE score*quality > 0.4),
dice AS (
  SELECT vol_id, pred, truth, overlap, 1-(2*overlap+1)/(ps+ts+1)::DOUBLE AS cost, overlap/(ps+ts-overlap)::DOUBLE AS iou FROM (
    SELECT p.vol_id, p.label AS pred, t.label AS truth, count(*) AS overlap FROM pred_vox p JOIN label_vox t USING (z,y,x) GROUP BY ALL)
  JOIN (SELECT label AS pred, count(*) AS ps FROM pred_vox GROUP BY 1) USING (pred) JOIN (SELECT label AS truth, count(*) AS ts FROM label_vox GROUP BY 1) USING (truth)),
sides AS (
  SELECT vol_id, roi_id, z, y AS y1, x AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2
  FROM roi_vertices WINDOW w AS (PARTITION BY vol_id, roi_id ORDER BY ord)),
roi_pixels AS (
  SELECT DISTINCT s.vol_id, least(greatest(s.z,0),nz-1) AS z, py AS y, px AS x
  FROM (SELECT r.vol_id, r.roi_id, r.z, r.py, r.px, r.nz FROM (
          SELECT DISTINCT v.vol_id, v.roi_id, v.z, nz, ny, nx, cy+dy AS py, cx+dx AS px
          FROM (SELECT vol_id, roi_id, min(z) AS z, (min(y)+max(y))//2 AS cy, (min(x)+max(x))//2 AS cx FROM roi_vertices GROUP BY ALL) v JOIN volumes USING (vol_id),
               (SELECT unnest(range(-6,7)) AS dy), (SELECT unnest(range(-6,7)) AS dx)) r
        JOIN sides e ON e.roi_id=r.roi_id AND e.y1<>e.y2 AND least(e.y1,e.y2)<=r.py AND r.py<greatest(e.y1,e.y2) AND r.px > e.x1+(r.py-e.y1)*(e.x2-e.x1)/(e.y2-e.y1)::DOUBLE
        WHERE py>=0 AND px>=0 AND py<ny AND px<nx GROUP BY ALL HAVING count(*)%2=1) s)
"""

def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(({expr})::DOUBLE, {digits}) + 0.0 AS {name}"


CELL_BASIC = ", ".join([
    "vol_id", "label", "n AS voxel_count", r("volume", "volume_um3"), r("pow(6*volume/pi(), 1.0/3)", "equivalent_diameter_um"),
    *(r(f"m{a}", f"centroid_{a}") for a in "zyx"), *(r(f"u{a}", f"centroid_{a}_um") for a in "zyx"),
    *(f"{a}0 AS bbox_{a}_min, {a}1 AS bbox_{a}_max" for a in "zyx"), "border AS touch_border",
])
SPHERICITY, COMPACTNESS = "pow(pi(), 1.0/3)*pow(6*volume, 2.0/3)/(area+1e-12)", "pow(area, 1.5)/(volume+1e-12)"


def summary(source: str, features: dict[str, str]) -> str:
    """Tall (vol_id, metric, value) of features given as SQL over a source."""
    rows = [f"SELECT vol_id, 'cell_count_total' AS metric, count(*)::DOUBLE AS value FROM {source} GROUP BY vol_id"]
    for name, sql in features.items():
        for metric, agg in (("mean", "avg(v)"), ("median", "quantile_cont(v,0.5)"), ("std", "stddev_pop(v)"), ("q05", "quantile_cont(v,0.05)"), ("q95", "quantile_cont(v,0.95)")):
            rows.append(f"SELECT vol_id, '{name}_{metric}', round({agg}, 6)+0.0 FROM (SELECT vol_id, ({sql})::DOUBLE AS v FROM {source}) GROUP BY vol_id")
    return " UNION ALL ".join(rows)


BASIC_FEATURES = {
    "volume_um3": "volume", "equivalent_diameter_um": "pow(6*volume/pi(), 1.0/3)", "surface_area_um2": "area", "centroid_z_um": "uz", "centroid_y_um": "uy", "centroid_x_um": "ux",
    "sphericity": SPHERICITY, "compactness": COMPACTNESS,
}
WITH_SURFACE = "(SELECT b.*, s.area FROM basic b JOIN surface s ON b.label=s.label)"
CONTACT_FEATURES = {"contact_neighbor_count": "n", "contact_area_total_um2": "total", "contact_area_mean_um2": "total/(n+1e-12)", "contact_area_max_um2": "largest", "contact_fraction": "total/(surface+1e-12)"}
BALL = "(4.0/3.0*3.141592653589793)"
DIAMETER = "pow(6*{}volume/pi(), 1.0/3)"
LOCAL = "SELECT p.vol_id, p.label, p.volume, m, s FROM basic p LEFT JOIN (SELECT label, avg(volume) AS m, stddev_pop(volume) AS s FROM (SELECT e.label, q.volume FROM {} e JOIN basic q ON q.label=e.other) GROUP BY label) USING (label)"
RADIUS_PAIRS = "(SELECT p.label, q.label AS other FROM basic p JOIN basic q ON p.label<>q.label AND sqrt((p.mz-q.mz)*(p.mz-q.mz)+(p.my-q.my)*(p.my-q.my)+(p.mx-q.mx)*(p.mx-q.mx))<={})"
REGION = "SELECT vol_id, label, volume, nz, ny, nx, vz, vy, vx, " + ", ".join(f"least(greatest(floor(u{a}/(n{a}*v{a}/6)),0),5)::INT AS r{a}" for a in "zyx") + " FROM basic"
REGION_NAME = "format('z{:02d}_y{:02d}_x{:02d}', rz, ry, rx)"
PCA = (
    "SELECT vol_id, label, n, (n*szz-sz*sz)/(n*(n-1))::DOUBLE*vz*vz AS a, (n*syy-sy*sy)/(n*(n-1))::DOUBLE*vy*vy AS b, (n*sxx-sx*sx)/(n*(n-1))::DOUBLE*vx*vx AS c,"
    " (n*szy-sz*sy)/(n*(n-1))::DOUBLE*vz*vy AS d, (n*szx-sz*sx)/(n*(n-1))::DOUBLE*vz*vx AS e, (n*syx-sy*sx)/(n*(n-1))::DOUBLE*vy*vx AS f FROM ("
    "SELECT vol_id, label, count(*) AS n, sum(z)::BIGINT AS sz, sum(y)::BIGINT AS sy, sum(x)::BIGINT AS sx, sum(z*z)::BIGINT AS szz, sum(y*y)::BIGINT AS syy, sum(x*x)::BIGINT AS sxx,"
    " sum(z*y)::BIGINT AS szy, sum(z*x)::BIGINT AS szx, sum(y*x)::BIGINT AS syx FROM label_vox GROUP BY ALL HAVING count(*)>=5) JOIN volumes USING (vol_id)"
)
EIGEN = (
    f"SELECT vol_id, label, q+2*p*cos(phi) AS l1, q+2*p*cos(phi+2*pi()/3) AS l3, 3*q-(q+2*p*cos(phi))-(q+2*p*cos(phi+2*pi()/3)) AS l2 FROM ("
    f"SELECT *, acos(CASE WHEN p>0 THEN greatest(-1, least(1, ((a-q)*((b-q)*(c-q)-f*f)-d*(d*(c-q)-f*e)+e*(d*f-(b-q)*e))/(2*p*p*p))) ELSE 0 END)/3 AS phi FROM ("
    f"SELECT *, sqrt(((a-q)*(a-q)+(b-q)*(b-q)+(c-q)*(c-q)+2*(d*d+e*e+f*f))/6) AS p FROM (SELECT *, (a+b+c)/3 AS q FROM ({PCA}))))"
)
COVERED = "norm_vox v JOIN patches t ON v.z BETWEEN z0 AND z0+pz-1 AND v.y BETWEEN y0 AND y0+py-1 AND v.x BETWEEN x0 AND x0+px-1"
LABELLED = "label_vox v JOIN patches t ON v.z BETWEEN z0 AND z0+pz-1 AND v.y BETWEEN y0 AND y0+py-1 AND v.x BETWEEN x0 AND x0+px-1"
KEPT = f"(SELECT t.* , k.instances FROM patches t JOIN (SELECT patch_id, count(DISTINCT label) AS instances FROM {LABELLED} GROUP BY 1) k USING (patch_id) WHERE instances>=1)"
RENUMBERED = "SELECT vol_id, row_number() OVER (ORDER BY z0,y0,x0) AS patch_id, z0, y0, x0, pz, py, px, {} FROM patches JOIN ({}) USING (patch_id)"
WINNER = (
    "SELECT * FROM (SELECT q.patch_id, q.z, q.y, q.x, q.query_id, q.prob, r.final_score, r.rk, row_number() OVER (PARTITION BY q.patch_id, q.z, q.y, q.x ORDER BY q.prob*r.final_score DESC, r.rk) AS place"
    " FROM query_vox q JOIN ranked r USING (patch_id, query_id) WHERE r.rk<=300) WHERE place=1 AND prob>0.5"
)
OVERLAP = (
    "SELECT a.patch_id, a.z, a.query_id AS query_a, b.query_id AS query_b, count(*) AS overlap FROM (SELECT * FROM query_vox WHERE prob>0.3) a JOIN (SELECT * FROM query_vox WHERE prob>0.3) b"
    " ON a.patch_id=b.patch_id AND a.z=b.z AND a.y=b.y AND a.x=b.x AND a.query_id<b.query_id GROUP BY ALL"
)
AREAS = "(SELECT patch_id, z, query_id, count(*) AS area FROM query_vox WHERE prob>0.3 GROUP BY ALL)"
NO_ROI = "SELECT v.* FROM label_vox v ANTI JOIN roi_pixels p USING (vol_id,z,y,x)"
SLICES = (
    "WITH RECURSIVE start AS (SELECT label, z, y, x, (z<<42)+(y<<21)+x AS name FROM label_vox),"
    " reach AS (SELECT label, z, y, x, name FROM start UNION SELECT s.label, s.z, s.y, s.x, r.name FROM reach r JOIN start s ON s.label=r.label AND s.z=r.z AND abs(s.y-r.y)+abs(s.x-r.x)=1)"
)


def _resized(axis: str, n: str, m: str) -> str:
    return f"(SELECT t AS t{axis}, CASE WHEN {m}>1 THEN least(floor(t*({n}-1)/({m}-1)::DOUBLE+0.5), {n}-1) ELSE 0 END::BIGINT AS {axis} FROM volumes, (SELECT unnest(range(0, (SELECT {m} FROM volumes))) AS t))"


def _linear(axis: str, n: str, m: str) -> str:
    at = f"(CASE WHEN {m}>1 THEN t*({n}-1)/({m}-1)::DOUBLE ELSE 0 END)"
    return (
        f"(SELECT t AS t{axis}, least(floor({at})+k, {n}-1)::BIGINT AS {axis}, CASE k WHEN 0 THEN 1-({at}-floor({at})) ELSE {at}-floor({at}) END AS w{axis}"
        f" FROM volumes, (SELECT unnest(range(0, (SELECT {m} FROM volumes))) AS t), (SELECT unnest([0,1]) AS k))"
    )


def _mirror(axis: str, patch: int, stride: int) -> str:
    m = f"(CASE WHEN n{axis}<={patch} THEN {patch} ELSE {patch}+ceil((n{axis}-{patch})/{stride}.0)::BIGINT*{stride} END)"
    return f"(SELECT t AS t{axis}, CASE WHEN n{axis}<=1 THEN 0 WHEN t%(2*(n{axis}-1))<n{axis} THEN t%(2*(n{axis}-1)) ELSE 2*(n{axis}-1)-t%(2*(n{axis}-1)) END AS {axis} FROM volumes, (SELECT unnest(range(0, (SELECT {m} FROM volumes))) AS t))"


def _local(pairs: str, names: tuple[str, str, str]) -> str:
    m, s, z = names
    return f"SELECT vol_id, label, {r('volume', 'volume_um3')}, {r('m', m)}, {r('s', s)}, {r('(volume-m)/(s+1e-12)', z)} FROM ({LOCAL.format(pairs)})"


def _regions(features: dict[str, str], source: str) -> str:
    stats = ", ".join(f"{r(f'avg({c})', f'region_mean_{n}')}, {r(f'quantile_cont({c},0.5)', f'region_median_{n}')}, {r(f'stddev_pop({c})', f'region_std_{n}')}" for n, c in features.items())
    size = "any_value(nz*vz*ny*vy*nx*vx/216)"
    return f"SELECT vol_id, {REGION_NAME} AS region_id, count(*) AS region_cell_count, {r(size, 'region_volume_um3')}, {r(f'count(*)/({size}+1e-12)', 'region_cell_density_per_um3')}, {stats} FROM {source} GROUP BY vol_id, rz, ry, rx"


def _robust(x: str) -> str:
    """Median and median absolute deviation of an expression over ``scored``."""
    return f"(SELECT md, quantile_cont(abs({x}-md),0.5) AS mad FROM scored, (SELECT quantile_cont({x},0.5) AS md FROM scored) GROUP BY md)"


def _recursive(rows: str, same: str, near: str) -> str:
    """Of each row the least name along neighbouring rows."""
    return f"WITH RECURSIVE start AS ({rows}), reach AS (SELECT *, name AS root FROM start UNION SELECT s.*, r.root FROM reach r JOIN start s ON {same} AND {near})"


def _z_runs(label: str, near: str) -> str:
    """The run of slices around the first one of each label, over gaps of one."""
    return (
        "SELECT vol_id, label, s AS start_z, min(z) AS lo_z, max(z) AS hi_z, min(y0) AS lo_y, max(y1) AS hi_y, min(x0) AS lo_x, max(x1) AS hi_x FROM ("
        "SELECT *, sum(CASE WHEN z-p-1>1 THEN 1 ELSE 0 END) OVER (PARTITION BY vol_id, label ORDER BY z) AS island FROM (SELECT vol_id, label, z, s, lag(z) OVER (PARTITION BY vol_id, label ORDER BY z) AS p, y0, y1, x0, x1"
        f" FROM (SELECT *, min(z) OVER (PARTITION BY vol_id, label) AS s FROM (SELECT vol_id, {label} AS label, z, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM label_vox GROUP BY ALL)) WHERE {near})) WHERE island=0 GROUP BY vol_id, label, s"
    )


def _undone(depth: int, undo: str) -> str:
    """The log's edits that no undo takes back, where a layer remembers so many."""
    return (
        "SELECT * FROM (SELECT *, lead(kind) OVER (PARTITION BY layer_name, mark ORDER BY seq, kind) AS nxt FROM ("
        f"SELECT *, level+1 AS mark, 0 AS kind FROM levels WHERE {undo} UNION ALL SELECT *, level, 1 FROM levels WHERE NOT ({undo}) UNION ALL SELECT *, level-{depth}, 2 FROM levels WHERE NOT ({undo})) WHERE mark>0) WHERE kind=1 AND (nxt IS NULL OR nxt<>0)"
    ).replace("levels", (
        "(SELECT *, total-least(min(total) OVER (PARTITION BY layer_name ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS level FROM ("
        f"SELECT *, sum(CASE WHEN {undo} THEN -1 ELSE 1 END) OVER (PARTITION BY layer_name ORDER BY seq ROWS UNBOUNDED PRECEDING) AS total FROM curation_log))"
    ))


NEAR_SLICE, NEAR_SOLID = "s.z=r.z AND abs(s.y-r.y)+abs(s.x-r.x)=1", "abs(s.z-r.z)+abs(s.y-r.y)+abs(s.x-r.x)=1"
NAME = "(z<<42)+(y<<21)+x AS name"


def _solid(label: str) -> str:
    """Of each voxel the least name in its piece of equal labels, step by step in space."""
    return (
        f"WITH RECURSIVE start AS (SELECT {label} AS label, z, y, x, {NAME} FROM label_vox), reach AS (SELECT *, name AS root FROM start UNION SELECT s.*, r.root FROM"
        " (SELECT label, root, z+dz AS z, y+dy AS y, x+dx AS x FROM reach, (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) d(dz,dy,dx)) r JOIN start s USING (label, z, y, x) WHERE r.root<s.name)"
    )


CLICKS = "(SELECT roi_id AS click_id, z AS cz, y AS cy, x-5 AS cx FROM roi_vertices WHERE ord=1)"
CORNERS = (
    "(VALUES ('z',-1,0,0,0),('z',-1,0,0,1),('z',-1,0,1,1),('z',-1,0,1,0),('z',1,1,0,0),('z',1,1,1,0),('z',1,1,1,1),('z',1,1,0,1),"
    "('y',-1,0,0,0),('y',-1,1,0,0),('y',-1,1,0,1),('y',-1,0,0,1),('y',1,0,1,0),('y',1,0,1,1),('y',1,1,1,1),('y',1,1,1,0),"
    "('x',-1,0,0,0),('x',-1,0,1,0),('x',-1,1,1,0),('x',-1,1,0,0),('x',1,0,0,1),('x',1,1,0,1),('x',1,1,1,1),('x',1,0,1,1)) c(axis,side,cz,cy,cx)"
)
OPEN_FACES = (
    "(SELECT p.*, axis, side FROM label_vox p, (VALUES ('z',1,1,0,0),('z',-1,-1,0,0),('y',1,0,1,0),('y',-1,0,-1,0),('x',1,0,0,1),('x',-1,0,0,-1)) d(axis,side,dz,dy,dx)"
    " LEFT JOIN label_vox q ON q.z=p.z+dz AND q.y=p.y+dy AND q.x=p.x+dx AND q.label=p.label WHERE q.label IS NULL)"
)
MESH = f"(SELECT vol_id, label, count(DISTINCT (z+cz, y+cy, x+cx)) AS n_vertices, count(*)//2 AS n_triangles FROM {OPEN_FACES} JOIN {CORNERS} USING (axis, side) GROUP BY vol_id, label)"


def _at_least(axis: str, patch: int) -> str:
    return f"(SELECT t AS t{axis}, CASE WHEN n{axis}<=1 THEN 0 WHEN t%(2*(n{axis}-1))<n{axis} THEN t%(2*(n{axis}-1)) ELSE 2*(n{axis}-1)-t%(2*(n{axis}-1)) END AS {axis} FROM volumes, (SELECT unnest(range(0, (SELECT greatest(n{axis}, {patch}) FROM volumes))) AS t))"


MIRRORED = COVERED.replace("norm_vox v", f"(SELECT norm, tz AS z, ty AS y, tx AS x FROM norm_vox JOIN {_at_least('z', 8)} USING (z) JOIN {_at_least('y', 16)} USING (y) JOIN {_at_least('x', 16)} USING (x)) v")


SQL: dict[str, str] = {
    "label_sizes": "SELECT vol_id, label, n AS voxel_count FROM basic",
    "size_summary": "SELECT vol_id, count(*) AS n_labels, min(n) AS min_size, max(n) AS max_size FROM basic GROUP BY vol_id",
    "distinct_labels": "SELECT DISTINCT vol_id, label FROM label_vox",
    "label_width": "SELECT vol_id, CASE WHEN max(label)<=65535 THEN 'uint16' WHEN max(label)<=4294967295 THEN 'uint32' ELSE 'uint64' END AS label_type, max(label) AS max_label FROM label_vox GROUP BY vol_id",
    "cell_basic": f"SELECT {CELL_BASIC} FROM basic",
    "touch_border_cells": "SELECT vol_id, label FROM basic WHERE border",
    "cell_surface": f"SELECT vol_id, label, {r('area', 'surface_area_um2')} FROM surface",
    "cell_shape": f"SELECT vol_id, label, {r(SPHERICITY, 'sphericity')}, {r(COMPACTNESS, 'compactness')} FROM {WITH_SURFACE}",
    "cell_intensity": (
        f"SELECT vol_id, label, {r('m', 'mean_intensity')}, {r('sqrt(v)', 'std_intensity')}, {r('sqrt(v)/(abs(m)+1e-12)', 'cv_intensity')}, {r('mn', 'min_intensity')}, {r('mx', 'max_intensity')}, {r('s1', 'sum_intensity')},"
        f" {r('(m3-3*m*m2+2*m*m*m)/(pow(sqrt(v),3)+1e-12)', 'skewness_intensity')}, {r('(m4-4*m*m3+6*m*m*m2-3*m*m*m*m)/(v*v+1e-12)-3', 'kurtosis_intensity')} FROM ("
        "SELECT *, greatest(m2-m*m, 0) AS v FROM (SELECT vol_id, label, sum(value)::DOUBLE AS s1, sum(value)/count(*)::DOUBLE AS m, sum(value*value)/count(*)::DOUBLE AS m2, sum(value*value*value)/count(*)::DOUBLE AS m3,"
        " sum(value*value*value*value)/count(*)::DOUBLE AS m4, min(value) AS mn, max(value) AS mx FROM label_vox JOIN raw_vox USING (vol_id,z,y,x) GROUP BY ALL))"
    ),
    "cell_pca_axes": (
        f"SELECT vol_id, label, {r('j', 'axis_major_um', 4)}, {r('i', 'axis_intermediate_um', 4)}, {r('k', 'axis_minor_um', 4)}, {r('j/(k+1e-12)', 'elongation', 4)}, {r('j/(k+1e-12)', 'major_minor_ratio', 4)}, {r('i/(k+1e-12)', 'flatness', 4)}"
        f" FROM (SELECT vol_id, label, 2*sqrt(5*greatest(l1,0)) AS j, 2*sqrt(5*greatest(l2,0)) AS i, 2*sqrt(5*greatest(l3,0)) AS k FROM ({EIGEN}))"
    ),
    "basic_info": "SELECT vol_id, label AS label_id, " + ", ".join(r(v, k) for k, v in BASIC_FEATURES.items()) + f" FROM {WITH_SURFACE}",
    "summary_stats": summary(WITH_SURFACE, BASIC_FEATURES),
    "size_histogram": "SELECT vol_id, CASE WHEN hi=lo THEN 25 ELSE least(floor((n-lo)*50/(hi-lo)::DOUBLE),49) END::BIGINT AS bin, count(*) AS cells FROM basic, (SELECT min(n) AS lo, max(n) AS hi FROM basic) GROUP BY ALL",
    "relabel_sequential": "SELECT vol_id, z, y, x, dense_rank() OVER (PARTITION BY vol_id ORDER BY label) AS label FROM label_vox",
    "next_label_id": "SELECT vol_id, max(label)+1 AS next_label_id FROM label_vox GROUP BY vol_id",
    "foreground_per_slice": "SELECT vol_id, z, count(*) AS pixels, count(DISTINCT label) AS instances FROM label_vox GROUP BY ALL",
    "richest_slice": "SELECT vol_id, z, count(*) AS pixels FROM label_vox GROUP BY ALL ORDER BY pixels DESC, z LIMIT 1",
    "voxel_anisotropy": f"SELECT vol_id, {r('greatest(vz,vy,vx)/(least(vz,vy,vx)+1e-12)', 'voxel_anisotropy_ratio')} FROM volumes",
    "contact_edges": f"SELECT vol_id, a AS label_a, b AS label_b, {r('area', 'contact_area_um2')} FROM edges",
    "contact_features": "SELECT vol_id, label AS label_id, n::BIGINT AS contact_neighbor_count, " + ", ".join(r(v, k) for k, v in list(CONTACT_FEATURES.items())[1:]) + " FROM contact",
    "contact_summary": summary("contact", CONTACT_FEATURES),
    "knn_features": (
        f"SELECT p.vol_id, p.label, {r('min(d)', 'nearest_neighbor_distance_um')}, " + ", ".join(
            f"{r(f'avg(d) FILTER (rk<={k})', f'knn_mean_distance_k{k}_um')}, {r(f'quantile_cont(d, 0.5) FILTER (rk<={k})', f'knn_median_distance_k{k}_um')}, {r(f'count(d) FILTER (rk<={k})/({BALL}*pow(max(d) FILTER (rk<={k}), 3)+1e-12)', f'local_density_k{k}_per_um3')}" for k in (5, 10, 20)
        ) + " FROM basic p LEFT JOIN near e ON e.label=p.label AND rk<=20 GROUP BY p.vol_id, p.label"
    ),
    "knn_join_points": f"SELECT vol_id, label, other, {r('d', 'distance')}, rk AS rank FROM near_points WHERE rk<=10",
    "radius_features": f"SELECT p.vol_id, p.label, count(e.other) AS radius_neighbor_count_r20_px, {r(f'count(e.other)/({BALL}*8000+1e-12)', 'radius_density_r20_per_px3')} FROM basic p LEFT JOIN {RADIUS_PAIRS.format(20)} e ON e.label=p.label GROUP BY p.vol_id, p.label",
    "local_neighbour_stats": (
        f"SELECT p.vol_id, p.label, " + ", ".join(f"{r(c, n)}, {r(f'm{k}', f'neighbor_mean_{n}')}, {r(f's{k}', f'neighbor_std_{n}')}, {r(f'({c}-m{k})/(s{k}+1e-12)', f'self_vs_neighbor_{n}_zscore')}" for k, (n, c) in enumerate((("volume_um3", "p.volume"), ("equivalent_diameter_um", DIAMETER.format("p.")))))
        + f" FROM basic p LEFT JOIN (SELECT e.label, avg(q.volume) AS m0, stddev_pop(q.volume) AS s0, avg({DIAMETER.format('q.')}) AS m1, stddev_pop({DIAMETER.format('q.')}) AS s1 FROM near e JOIN basic q ON q.label=e.other WHERE rk<=10 GROUP BY e.label) USING (label)"
    ),
    "local_comparison_knn": _local("(SELECT label, other FROM near WHERE rk<=10)", ("local_neighbor_mean_volume_um3", "local_neighbor_std_volume_um3", "local_zscore_volume_um3")).replace("label,", "label AS label_id,", 1),
    "local_comparison_radius": _local(RADIUS_PAIRS.format(12), ("local_neighbor_mean_volume_um3", "local_neighbor_std_volume_um3", "local_zscore_volume_um3")).replace("label,", "label AS label_id,", 1),
    "neighborhood_task": (
        f"SELECT p.vol_id, p.label AS label_id, {r('min(d)', 'nearest_neighbor_distance_um')}, {r('avg(d)', 'knn_mean_distance_k10_um')}, {r('quantile_cont(d, 0.5)', 'knn_median_distance_k10_um')}, {r(f'count(d)/({BALL}*pow(max(d), 3)+1e-12)', 'local_density_k10_per_um3')}"
        " FROM basic p LEFT JOIN near e ON e.label=p.label AND rk<=10 GROUP BY p.vol_id, p.label"
    ),
    "region_bins": f"SELECT vol_id, label, rz AS region_z_bin, ry AS region_y_bin, rx AS region_x_bin, {REGION_NAME} AS region_id FROM ({REGION})",
    "region_features": _regions({"volume_um3": "volume", "equivalent_diameter_um": DIAMETER.format("")}, f"({REGION})"),
    "region_task": _regions(
        {"volume_um3": "volume", "equivalent_diameter_um": DIAMETER.format(""), "sphericity": SPHERICITY, "elongation": "j/(k+1e-12)", "flatness": "i/(k+1e-12)", "nearest_neighbor_distance_um": "nearest", **{f"local_density_k{k}_per_um3": f"density{k}" for k in (5, 10, 20)}},
        f"(SELECT * FROM ({REGION}) JOIN shapes USING (vol_id, label) JOIN densities USING (label))",
    ),
    "robust_zscores": f"SELECT vol_id, label, {r('0.6745*(volume-md)/(mad+1e-12)', 'robust_z_volume_um3')} FROM basic, (SELECT md, quantile_cont(abs(volume-md),0.5) AS mad FROM basic, (SELECT quantile_cont(volume,0.5) AS md FROM basic) GROUP BY md)",
    "normalize_scores": f"SELECT vol_id, label, {r('least(greatest((volume-lo)/(hi-lo+1e-12),0),1)', 'volume_um3_score')} FROM basic, (SELECT quantile_cont(volume,0.01) AS lo, quantile_cont(volume,0.99) AS hi FROM basic)",
    "feature_matrix": (
        f"SELECT vol_id, label, {r('(ln(1+volume)-q[2])/(CASE WHEN q[3]=q[1] THEN 1 ELSE q[3]-q[1] END)', 'volume_um3')}, {r('(uz-u[2])/(CASE WHEN u[3]=u[1] THEN 1 ELSE u[3]-u[1] END)', 'centroid_z_um')}"
        " FROM basic, (SELECT quantile_cont(ln(1+volume),[0.25,0.5,0.75]) AS q, quantile_cont(uz,[0.25,0.5,0.75]) AS u FROM basic)"
    ),
    "lof_scores": (
        f"SELECT vol_id, label, {r('avg(o.lrd)/any_value(l.lrd)', 'lof')} FROM (SELECT * FROM near_points WHERE rk<=20) e JOIN lrd l USING (vol_id, label) JOIN (SELECT vol_id, label AS other, lrd FROM lrd) o USING (vol_id, other) GROUP BY vol_id, label"
    ),
    "feature_map_uint16": (
        "SELECT vol_id, z, y, x, floor(least(greatest((volume-v[1])/(v[2]-v[1]+1e-12),0),1)*65535)::BIGINT AS volume_um3, floor(least(greatest((uz-u[1])/(u[2]-u[1]+1e-12),0),1)*65535)::BIGINT AS centroid_z_um"
        " FROM (SELECT l.vol_id, l.z, l.y, l.x, b.volume, b.uz FROM label_vox l JOIN basic b USING (label)), (SELECT quantile_cont(volume,[0.01,0.99]) AS v, quantile_cont(uz,[0.01,0.99]) AS u FROM basic)"
    ),
    "categorical_map": f"SELECT l.vol_id, l.z, l.y, l.x, (rz+1)::BIGINT AS region_z_bin, (rx+1)::BIGINT AS region_x_bin FROM label_vox l JOIN ({REGION}) b USING (label)",
    "percentile_normalize": f"SELECT vol_id, z, y, x, value, {r('norm', 'norm')} FROM norm_vox",
    "minmax_normalize": f"SELECT vol_id, z, y, x, value, {r('(value-mn)/(mx-mn+1e-8)', 'norm')} FROM raw_vox, norms",
    "normalized_threshold": f"SELECT 'v0' AS vol_id, {r('CASE WHEN hi<=lo THEN 0 ELSE least(greatest((20-lo)/(hi-lo),0),1) END', 'threshold')} FROM norms",
    "auto_contrast": (
        f"SELECT vol_id, {r('lo', 'contrast_low')}, {r('CASE WHEN hi>lo THEN hi ELSE lo+1 END', 'contrast_high')} FROM (SELECT vol_id, CASE WHEN q[2]>q[1] THEN q[1] ELSE mn END AS lo, CASE WHEN q[2]>q[1] THEN q[2] ELSE mx END AS hi FROM ("
        "SELECT vol_id, quantile_cont(value,[0.002,0.998]) AS q, min(value) AS mn, max(value) AS mx FROM raw_vox JOIN volumes USING (vol_id) WHERE z IN (0, nz//2, nz-1) GROUP BY vol_id))"
    ),
    "patch_grid": "SELECT * FROM patches",
    "inference_grid": (
        "SELECT 'v0' AS vol_id, row_number() OVER (ORDER BY z0,y0,x0) AS patch_id, z0, y0, x0, 8::BIGINT AS pz, 16::BIGINT AS py, 16::BIGINT AS px FROM "
        + ", ".join(f"(SELECT unnest(range(0, (SELECT CASE WHEN n{a}<={p} THEN 1 ELSE ceil((n{a}-{p})/{s}.0)::BIGINT*{s}+1 END FROM volumes), {s})) AS {a}0)" for a, p, s in (("z", 8, 4), ("y", 16, 8), ("x", 16, 8)))
    ),
    "pad_volume": f"SELECT vol_id, tz AS z, ty AS y, tx AS x, value FROM raw_vox JOIN {_mirror('z', 8, 6)} USING (z) JOIN {_mirror('y', 48, 36)} USING (y) JOIN {_mirror('x', 48, 36)} USING (x)",
    "crop_box": "SELECT vol_id, z-1 AS z, y-2 AS y, x-3 AS x, value FROM raw_vox WHERE z>=1 AND z<6 AND y>=2 AND y<20 AND x>=3 AND x<30",
    "instances_per_patch": f"SELECT t.vol_id, t.patch_id, coalesce(n,0) AS instances FROM patches t LEFT JOIN (SELECT patch_id, count(DISTINCT label) AS n FROM {LABELLED} GROUP BY 1) USING (patch_id)",
    "valid_patches_max": RENUMBERED.format("max_value", f"SELECT patch_id, max(value) AS max_value FROM {COVERED} GROUP BY 1 HAVING max(value)>=230"),
    "valid_patches_p999": RENUMBERED.format("round(p999,6)+0.0 AS p999", f"SELECT patch_id, quantile_cont(norm,0.999) AS p999 FROM {COVERED} GROUP BY 1 HAVING quantile_cont(norm,0.999)>=0.9"),
    "training_patches": (
        f"SELECT vol_id, format('v0_z{{:04d}}_y{{:04d}}_x{{:04d}}', z0, y0, x0) AS patch_name, z-z0 AS z, y-y0 AS y, x-x0 AS x, dense_rank() OVER (PARTITION BY patch_id ORDER BY label) AS label"
        f" FROM (SELECT t.vol_id, t.patch_id, z0, y0, x0, v.z, v.y, v.x, v.label FROM {LABELLED})"
    ),
    "patch_export_summary": (
        f"SELECT 'v0' AS vol_id, (SELECT count(*) FROM patches) AS all_patches, count(*) AS saved_patches, min(instances) AS min_instances, max(instances) AS max_instances, {r('avg(instances)', 'mean_instances')}, {r('any_value(lo)', 'p_low')}, {r('any_value(hi)', 'p_high')} FROM {KEPT}, norms"
    ),
    "mask_quality": f"SELECT patch_id, query_id, {r('score', 'score')}, area, {r('quality', 'quality')} FROM quality",
    "topk_queries": f"SELECT patch_id, query_id, {r('final_score', 'final_score')}, rk AS rank FROM ranked WHERE rk<=30",
    "mask_pair_overlap": (
        f"SELECT o.patch_id, o.z, query_a, query_b, overlap, {r('overlap/(least(a.area,b.area)+1e-6)', 'iom')}, {r('overlap/(a.area+b.area-overlap+1e-6)', 'iou')} FROM ({OVERLAP}) o"
        f" JOIN {AREAS} a ON a.patch_id=o.patch_id AND a.z=o.z AND a.query_id=query_a JOIN {AREAS} b ON b.patch_id=o.patch_id AND b.z=o.z AND b.query_id=query_b WHERE overlap>=2"
    ),
    "voxel_argmax": (
        f"SELECT w.patch_id, z, y, x, k.label, w.query_id, {r('w.final_score', 'confidence')} FROM ({WINNER}) w JOIN (SELECT patch_id, query_id, row_number() OVER (PARTITION BY patch_id ORDER BY min(rk)) AS label FROM ({WINNER}) GROUP BY patch_id, query_id HAVING count(*)>=20) k USING (patch_id, query_id)"
    ),
    "dice_matrix": (
        f"SELECT vol_id, pred, truth, coalesce(i,0) AS overlap, {r('1-(2*coalesce(i,0)+1)/(ps+ts+1)::DOUBLE', 'dice_cost')}, {r('coalesce(i,0)/(ps+ts-coalesce(i,0))::DOUBLE', 'iou')} FROM (SELECT vol_id, label AS pred, count(*) AS ps FROM pred_vox GROUP BY ALL)"
        " JOIN (SELECT vol_id, label AS truth, count(*) AS ts FROM label_vox GROUP BY ALL) USING (vol_id)"
        " LEFT JOIN (SELECT p.vol_id, p.label AS pred, t.label AS truth, count(*) AS i FROM pred_vox p JOIN label_vox t USING (vol_id,z,y,x) GROUP BY ALL) USING (vol_id, pred, truth)"
    ),
    "match_instances": (
        f"SELECT vol_id, pred, truth, overlap, {r('cost', 'dice_cost')}, {r('iou', 'iou')} FROM (SELECT *, row_number() OVER (PARTITION BY pred ORDER BY cost, truth) AS i, row_number() OVER (PARTITION BY truth ORDER BY cost, pred) AS j FROM dice) WHERE i=1 AND j=1"
    ),
    "confidence_mean": f"SELECT z, y, x, {r('avg(prob)', 'confidence')}, count(*) AS written FROM query_vox GROUP BY z, y, x",
    "filter_instances": (
        "SELECT vol_id, z, y, x, dense_rank() OVER (ORDER BY label) AS label FROM label_vox SEMI JOIN (SELECT label FROM label_vox JOIN raw_vox USING (vol_id,z,y,x) GROUP BY label HAVING count(*) BETWEEN 30 AND 400 AND avg(value)>=150) USING (label)"
    ),
    "slice_components": f"{SLICES} SELECT 'v0' AS vol_id, label, z, y, x, min(name) AS component FROM reach GROUP BY label, z, y, x",
    "resize_nearest": f"SELECT vol_id, tz AS z, ty AS y, tx AS x, label FROM label_vox JOIN {_resized('z', 'nz', '(nz+3)')} USING (z) JOIN {_resized('y', 'ny', '(ny//2)')} USING (y) JOIN {_resized('x', 'nx', 'nx')} USING (x)",
    "resize_linear": f"SELECT vol_id, tz AS z, ty AS y, tx AS x, {r('sum(value*wz*wy*wx)', 'value')} FROM raw_vox JOIN {_linear('z', 'nz', 'nz')} USING (z) JOIN {_linear('y', 'ny', 'greatest(round_even(ny/2.0,0),1)::BIGINT')} USING (y) JOIN {_linear('x', 'nx', 'greatest(round_even(nx/2.0,0),1)::BIGINT')} USING (x) WHERE wz>0 AND wy>0 AND wx>0 GROUP BY ALL",
    "exposed_faces": (
        "SELECT p.vol_id, p.label, axis, count(*) AS faces FROM label_vox p, (VALUES ('z',1,0,0),('z',-1,0,0),('y',0,1,0),('y',0,-1,0),('x',0,0,1),('x',0,0,-1)) d(axis,dz,dy,dx) LEFT JOIN label_vox q ON q.z=p.z+dz AND q.y=p.y+dy AND q.x=p.x+dx AND q.label=p.label WHERE q.label IS NULL GROUP BY ALL"
    ),
    "rasterize_polygons": "SELECT vol_id, z, y, x FROM roi_pixels",
    "add_roi": f"{NO_ROI} UNION ALL SELECT vol_id, z, y, x, 9999 FROM roi_pixels",
    "subtract_roi": "SELECT v.* FROM label_vox v LEFT JOIN roi_pixels p USING (vol_id,z,y,x) WHERE NOT (p.z IS NOT NULL AND label=52)",
    "new_label": f"{NO_ROI} UNION ALL SELECT vol_id, z, y, x, (SELECT max(label)+1 FROM label_vox) FROM roi_pixels",
    "change_label": "SELECT vol_id, z, y, x, CASE WHEN z=4 AND label=12 THEN 4321 ELSE label END::BIGINT AS label FROM label_vox",
    "delete_on_slice": "SELECT * FROM label_vox WHERE NOT (label=12 AND z=4)",
    "delete_near": "SELECT * FROM label_vox WHERE NOT (label=12 AND z>=2 AND z<6)",
    "delete_inside_roi": "SELECT v.* FROM label_vox v WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT label, z FROM label_vox JOIN roi_pixels USING (vol_id,z,y,x)) h WHERE h.label=v.label AND v.z BETWEEN h.z-2 AND h.z+2)",
    "replace_cell": (
        "SELECT v.* FROM label_vox v LEFT JOIN m USING (vol_id,z,y,x) WHERE NOT (v.label=52 AND v.z<10 AND v.y<40 AND v.x<40) AND m.z IS NULL UNION ALL SELECT vol_id, z, y, x, 52 FROM m"
    ),
    "edit_delta": "SELECT v.vol_id, label, count(*) AS old_voxels, count(*) FILTER (NOT (p.z IS NOT NULL AND label=52)) AS new_voxels FROM label_vox v LEFT JOIN roi_pixels p USING (vol_id,z,y,x) GROUP BY ALL",
    "apply_edit_log": (
        "SELECT vol_id, z, y, x, label FROM (SELECT v.vol_id, v.z, v.y, v.x, coalesce(e.label, v.label) AS label FROM label_vox v LEFT JOIN (SELECT label_id, z_index, arg_max(CASE WHEN operation LIKE 'delete%' OR operation LIKE 'subtract%' THEN 0 WHEN operation='change label' THEN label_id+1 ELSE label_id END, seq) AS label"
        " FROM curation_log GROUP BY ALL) e ON e.label_id=v.label AND e.z_index=v.z) WHERE label>0"
    ),
    "latest_edits": "SELECT layer_name, seq, place FROM (SELECT layer_name, seq, row_number() OVER (PARTITION BY layer_name ORDER BY seq DESC) AS place FROM curation_log) WHERE place<=20",
    "edit_audit": "SELECT operation, count(*) AS edits, count(DISTINCT label_id) AS labels, count(DISTINCT z_index) AS slices, max(ts) AS last_ts FROM curation_log GROUP BY operation",
    "z_run_bbox": _z_runs("label%7*1000+y*100+x", "true"),
    "z_run_near_click": _z_runs("label", "z-s<=3"),
    "pair_files": "SELECT regexp_extract(i.path, 'vol_\\d+') AS stem, i.path AS image, l.path AS label FROM image_files i JOIN label_files l ON regexp_extract(i.path, 'vol_\\d+')=regexp_extract(l.path, 'vol_\\d+')",
    "common_stems": "SELECT regexp_extract(path, 'vol_\\d+') AS stem FROM image_files INTERSECT SELECT regexp_extract(path, 'vol_\\d+') FROM label_files",
    "training_records": "SELECT image_id, image, l.path AS label FROM (SELECT path AS image, row_number() OVER (ORDER BY path)-1 AS image_id FROM image_files) JOIN label_files l ON regexp_extract(image, 'vol_\\d+')=regexp_extract(l.path, 'vol_\\d+')",
    "batch_summary": "SELECT CASE WHEN l.path IS NULL THEN 'todo' ELSE 'skipped' END AS status, count(*) AS files FROM image_files i LEFT JOIN label_files l ON regexp_extract(i.path, 'vol_\\d+')=regexp_extract(l.path, 'vol_\\d+') GROUP BY 1",
    "edit_rate": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, operation, count(*) AS edits FROM curation_log GROUP BY ALL",
    "edit_sessions": (
        "SELECT layer_name, min(ts) AS session_start, max(ts) + INTERVAL 10 MINUTE AS session_end, count(*) AS edits FROM (SELECT *, sum(CASE WHEN ts > p + INTERVAL 10 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY layer_name ORDER BY ts, seq) AS s"
        " FROM (SELECT *, lag(ts) OVER (PARTITION BY layer_name ORDER BY ts, seq) AS p FROM curation_log)) GROUP BY layer_name, s"
    ),
    "dedup_log": "SELECT DISTINCT ts, operation, label_id, z_index, layer_name FROM curation_log",
    "online_confidence": f"SELECT 'v0' AS vol_id, z, y, x, {r('avg(prob)', 'confidence')}, count(*) AS written FROM query_vox GROUP BY z, y, x",
    "online_label_sizes": "SELECT label_id AS label, sum(CASE operation WHEN 'add to label' THEN n WHEN 'subtract from label' THEN -n ELSE 0 END)::BIGINT AS voxel_count FROM curation_log JOIN basic ON label=label_id GROUP BY label_id",
}

SQL |= {
    "npy_slices": "SELECT vol_id||'/'||z AS path, y, x, value::DOUBLE AS value FROM raw_vox",
    "volume_store": "SELECT * FROM label_vox WHERE z>=2 AND z<7",
    "chunked_store": "SELECT * FROM label_vox",
    "chunked_box": "SELECT * FROM label_vox WHERE z>=1 AND z<6 AND y>=10 AND y<40 AND x>=3 AND x<30",
    "npy_volume": "SELECT z, y, x, value::DOUBLE AS value FROM raw_vox",
    "time_series": "SELECT t, z, y, x, (value+1000*t)::DOUBLE AS value FROM raw_vox, (SELECT unnest([1,2])::BIGINT AS t) WHERE z BETWEEN 1 AND 3",
    "mapped_features": f"SELECT vol_id, label, 'volume_um3' AS feature, {r('volume', 'value')} FROM basic UNION ALL SELECT vol_id, label, 'equivalent_diameter_um', {r('pow(6*volume/pi(), 1.0/3)', 'value')} FROM basic",
    "rolled_frames": "SELECT t, z, (y+2*t)%ny AS y, (x+2*t)%nx AS x, label FROM label_vox JOIN volumes USING (vol_id), (SELECT unnest([0,1,2])::BIGINT AS t)",
    "validated_voxels": "SELECT * FROM label_vox",
    "empty_label": f"SELECT vol_id, nz, ny, nx, {r('vz', 'vz')}, {r('vy', 'vy')}, {r('vx', 'vx')}, 1::BIGINT AS next_label_id, 0::BIGINT AS voxels FROM volumes",
    "task_csv": f"SELECT vol_id, label AS label_id, {r('volume', 'volume_um3')} FROM basic",
    "run_parameters": f"SELECT 10::BIGINT AS knn_k, 'shape' AS feature_set, nz, {r('vz*vy*vx', 'voxel_volume_um3')} FROM volumes",
    "feature_map_store": (
        "SELECT 'volume_um3' AS feature, count(*) AS voxels, sum(floor(least(greatest((volume-v[1])/(v[2]-v[1]+1e-12),0),1)*65535))::BIGINT AS total, 'morphology' AS \"group\" FROM label_vox JOIN basic USING (label), (SELECT quantile_cont(volume,[0.01,0.99]) AS v FROM basic)"
        f" UNION ALL SELECT 'region_z_bin', count(*), sum(rz+1)::BIGINT, 'region' FROM label_vox JOIN ({REGION}) USING (label)"
    ),
    "appended_log": "SELECT seq, operation, label_id, z_index, layer_name FROM curation_log",
    "mesh_store": "SELECT vol_id, label, n_vertices, n_triangles AS n_faces, 4.0::DOUBLE AS z_ratio FROM " + MESH,
    "surface_faces": "SELECT vol_id, label, n_vertices, n_triangles FROM " + MESH,
    "patch_store": (
        f"SELECT format('v0_z{{:04d}}_y{{:04d}}_x{{:04d}}', z0, y0, x0) AS patch_name, voxels, {r('mean_norm', 'mean_norm')}, labels, labelled FROM"
        f" (SELECT t.patch_id, z0, y0, x0, count(*) AS voxels, avg(norm) AS mean_norm FROM {MIRRORED} GROUP BY ALL HAVING quantile_cont(norm, 0.999)>=0.5) JOIN (SELECT t.patch_id, count(DISTINCT label) AS labels, count(*) AS labelled FROM {LABELLED} GROUP BY ALL) USING (patch_id)"
    ),
    "all_files": "SELECT path FROM image_files UNION SELECT path FROM label_files",
    "original_labels": "SELECT vol_id, label, n AS voxel_count FROM basic",
    "cell_preview": f"SELECT vol_id, label, {r('volume', 'volume_um3')} FROM basic ORDER BY vol_id, label LIMIT 20",
    "strided_voxels": "SELECT vol_id, z, y, x, label FROM (SELECT *, row_number() OVER (ORDER BY z, y, x)-1 AS place, greatest(ceil(count(*) OVER ()/500.0), 1) AS step FROM label_vox) WHERE place % step = 0",
    "logits_to_prob": (
        f"SELECT patch_id, query_id, z, y, x, {r('CASE WHEN raw THEN 1/(1+exp(-logit)) ELSE logit END', 'prob')} FROM (SELECT *, min(logit) OVER w < 0 OR max(logit) OVER w > 1 AS raw FROM"
        " (SELECT *, CASE WHEN patch_id%2=0 THEN prob*4-1 ELSE prob END AS logit FROM query_vox) WINDOW w AS (PARTITION BY patch_id))"
    ),
    "class_topk": (
        f"SELECT patch_id, query_id, class, {r('score', 'score')}, rank FROM (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY score DESC, query_id, class) AS rank FROM (SELECT *, exp(logit)/sum(exp(logit)) OVER (PARTITION BY patch_id, query_id) AS score"
        " FROM (SELECT patch_id, query_id, class, ((query_id*7+class*13)%11)/4.0::DOUBLE+class*query_id/10000.0::DOUBLE AS logit FROM (SELECT DISTINCT patch_id, query_id FROM query_vox), (SELECT unnest([0,1,2]) AS class))) WHERE class<2) WHERE rank<=60"
    ),
    "mask_costs": (
        f"SELECT vol_id, query_id, label, {r('1-(2*coalesce(i,0)+1)/(p+t+1)', 'dice_cost')}, {r('(neg+(100000-rows)*-ln(1-1e-7)+coalesce(gain,0)+(t-coalesce(c,0))*(-ln(1e-7)+ln(1-1e-7)))/100000', 'bce_cost')} FROM"
        " (SELECT query_id, sum(prob) AS p, sum(-ln(1-q)) AS neg, count(*) AS rows FROM clipped GROUP BY 1) CROSS JOIN (SELECT vol_id, label, count(*) AS t FROM label_vox GROUP BY ALL)"
        " LEFT JOIN (SELECT query_id, label, sum(prob) AS i, sum(-ln(q)+ln(1-q)) AS gain, count(*) AS c FROM clipped JOIN label_vox USING (z,y,x) GROUP BY ALL) USING (query_id, label)"
    ),
    "conflict_components": (
        _recursive(f"SELECT patch_id, z, y, x, {NAME} FROM query_vox WHERE prob>0.3 GROUP BY ALL HAVING count(*)>1", "s.patch_id=r.patch_id", NEAR_SLICE)
        + ", found AS (SELECT patch_id, z, y, x, min(root) AS component FROM reach GROUP BY ALL) SELECT * FROM found SEMI JOIN (SELECT patch_id, z, component FROM found GROUP BY ALL HAVING count(*)>=3) USING (patch_id, z, component)"
    ),
    "contact_continuity": (
        _recursive(f"SELECT a.vol_id, a.label, b.label AS below, a.z, a.y, a.x, (a.y<<21)+a.x AS name FROM label_vox a JOIN label_vox b ON b.z=a.z-1 AND b.y=a.y AND b.x=a.x AND b.label<>a.label", "s.label=r.label AND s.below=r.below AND s.z=r.z", "abs(s.y-r.y)<=1 AND abs(s.x-r.x)<=1")
        + f" SELECT vol_id, label, below, z AS slice, sum(n)::BIGINT AS contact_total, max(n) AS contact_largest, {r('max(n)/(sum(n)+1e-6)', 'contact_ratio')} FROM (SELECT vol_id, label, below, z, root, count(*) AS n FROM (SELECT vol_id, label, below, z, y, x, min(root) AS root FROM reach GROUP BY ALL) GROUP BY ALL) GROUP BY ALL"
    ),
    "merge_groups": (
        "WITH RECURSIVE " + "e AS (SELECT o.patch_id, o.z, query_a AS a, query_b AS b FROM (" + OVERLAP + f") o JOIN {AREAS} a ON a.patch_id=o.patch_id AND a.z=o.z AND a.query_id=query_a JOIN {AREAS} b ON b.patch_id=o.patch_id AND b.z=o.z AND b.query_id=query_b"
        " WHERE overlap/(least(a.area,b.area)+1e-6)>0.05 OR overlap/(a.area+b.area-overlap+1e-6)>0.02), both_ways AS (SELECT * FROM e UNION SELECT patch_id, z, b, a FROM e),"
        " reach AS (SELECT patch_id, z, a AS query_id, a AS root FROM both_ways UNION SELECT w.patch_id, w.z, w.b, r.root FROM reach r JOIN both_ways w ON w.patch_id=r.patch_id AND w.z=r.z AND w.a=r.query_id)"
        " SELECT patch_id, z, query_id, min(root) AS \"group\" FROM reach GROUP BY ALL"
    ),
    "split_disconnected": (
        _solid("label%7+1")
        + ", found AS (SELECT label, z, y, x, min(root) AS component FROM reach GROUP BY ALL), pieces AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY component) AS n FROM (SELECT DISTINCT label, component FROM found)),"
        " more AS (SELECT label, component, row_number() OVER (ORDER BY label, component)+(SELECT max(label) FROM found) AS fresh FROM pieces WHERE n>1) SELECT 'v0' AS vol_id, z, y, x, coalesce(fresh, label) AS label FROM found LEFT JOIN more USING (label, component)"
    ),
    "clicked_component": (
        _solid("label%7+1")
        + ", found AS (SELECT label, z, y, x, min(root) AS component FROM reach GROUP BY ALL), hit AS (SELECT click_id, label, component FROM found JOIN " + CLICKS + " c ON c.cz=z AND c.cy=y AND c.cx=x),"
        " large AS (SELECT label, component FROM found GROUP BY ALL HAVING count(*)>=20) SELECT 'v0' AS vol_id, click_id, z, y, x, label FROM found JOIN hit USING (label, component) JOIN large USING (label, component)"
    ),
    "clean_instances": (
        f"{SLICES}, found AS (SELECT label, z, y, x, min(name) AS component FROM reach GROUP BY ALL), kept AS (SELECT * FROM found SEMI JOIN (SELECT label, z, component FROM found GROUP BY ALL HAVING count(*)>=10) USING (label, z, component))"
        " SELECT 'v0' AS vol_id, z, y, x, dense_rank() OVER (ORDER BY label) AS label FROM kept SEMI JOIN (SELECT label FROM kept GROUP BY label HAVING count(*)>=30) USING (label)"
    ),
    "crop_centered": (
        "SELECT vol_id, click_id, lz AS local_z, ly AS local_y, lx AS local_x, value FROM (SELECT click_id, lz, ly, lx, " + ", ".join(f"CASE WHEN (m{a})%(2*(n{a}-1))<n{a} THEN (m{a})%(2*(n{a}-1)) ELSE 2*(n{a}-1)-(m{a})%(2*(n{a}-1)) END AS {a}" for a in "zyx")
        + " FROM (SELECT *, " + ", ".join(f"((c{a}-{p // 2}+l{a})%(2*(n{a}-1))+2*(n{a}-1)) AS m{a}" for a, p in (("z", 8), ("y", 16), ("x", 16))) + f" FROM {CLICKS}, volumes, (SELECT unnest(range(0,8)) AS lz), (SELECT unnest(range(0,16)) AS ly), (SELECT unnest(range(0,16)) AS lx))) JOIN raw_vox USING (z,y,x)"
    ),
    "select_clicked_query": (
        f"SELECT click_id, patch_id, query_id, {r('click_prob', 'click_prob')}, valid, {r('rank_score', 'rank_score')}, {r('CASE WHEN click_prob<=0.5 THEN greatest(0.05, 0.85*click_prob) ELSE 0.5 END', 'mask_threshold')} FROM ("
        "SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY valid DESC, rank_score DESC, patch_id, query_id) AS n FROM (SELECT *, CASE WHEN valid THEN click_prob*score*quality ELSE click_prob END AS rank_score FROM ("
        "SELECT *, score>=0.05 AND click_prob>=0.10 AND area>=20 AS valid FROM (SELECT click_id, patch_id, query_id, max(prob) AS click_prob FROM query_vox JOIN "
        + CLICKS + " c ON abs(z-cz)<=1 AND abs(y-cy)<=3 AND abs(x-cx)<=3 GROUP BY ALL) JOIN quality USING (patch_id, query_id)))) WHERE n=1"
    ),
    "smooth_polygons": (
        f"SELECT b.vol_id, b.roi_id, b.ord*16+k AS ord, b.z, {r('0.5*(2*b.y+(c.y-a.y)*t+(2*a.y-5*b.y+4*c.y-d.y)*t*t+(3*b.y-a.y-3*c.y+d.y)*t*t*t)', 'y')}, {r('0.5*(2*b.x+(c.x-a.x)*t+(2*a.x-5*b.x+4*c.x-d.x)*t*t+(3*b.x-a.x-3*c.x+d.x)*t*t*t)', 'x')} FROM roi_vertices b JOIN roi_vertices a ON a.roi_id=b.roi_id AND a.ord=(b.ord+3)%4 JOIN roi_vertices c ON c.roi_id=b.roi_id AND c.ord=(b.ord+1)%4"
        " JOIN roi_vertices d ON d.roi_id=b.roi_id AND d.ord=(b.ord+2)%4, (SELECT k, k/16.0::DOUBLE AS t FROM (SELECT unnest(range(0,16)) AS k))"
    ),
    "grown_boxes": "SELECT vol_id, label, " + ", ".join(f"least(greatest(floor(({a}0+{a}1+1-g{a})/2.0), 0), n{a}-g{a})::BIGINT AS lo_{a}, least(greatest(floor(({a}0+{a}1+1-g{a})/2.0), 0), n{a}-g{a})::BIGINT+g{a} AS hi_{a}" for a in "zyx") + " FROM (SELECT *, " + ", ".join(f"least(greatest(({a}1+1-{a}0)*2, 5), n{a})::BIGINT AS g{a}" for a in "zyx") + " FROM basic)",
    "united_boxes": "SELECT vol_id, label%7 AS \"group\", " + ", ".join(f"greatest(min({a}0)-2, 0) AS lo_{a}, least(max({a}1)+1+2, any_value(n{a})) AS hi_{a}" for a in "zyx") + " FROM basic GROUP BY ALL",
    "bright_display": (
        f"SELECT vol_id, z, y, x, {r('pow(least(greatest((value-lo)/(CASE WHEN hi>lo THEN hi ELSE lo+1 END-lo),0),1), 0.75)', 'display')} FROM seen, (SELECT CASE WHEN q[2]>q[1] THEN q[1] ELSE mn END AS lo, CASE WHEN q[2]>q[1] THEN q[2] ELSE mx END AS hi FROM ("
        "SELECT quantile_cont(value,[0.002,0.998]) AS q, min(value) AS mn, max(value) AS mx FROM seen WHERE z IN (0, nz//2, nz-1)))"
    ),
    "coarse_patches": f"SELECT vol_id AS patch_name, z, y, x, {r('avg((value-mn)/(mx-mn+1e-8)) OVER (PARTITION BY z, y//3, x//3)', 'norm')} FROM raw_vox, norms",
    "log_notes": "SELECT seq, format('{} label={}; z={}; voxels {} -> {}', operation, label_id, z_index, seq%100, seq%70) AS line FROM curation_log",
    "active_edits": f"SELECT seq, layer_name, operation FROM ({_undone(20, 'seq%5=4')})",
    "shallow_undo": f"SELECT seq, layer_name, operation FROM ({_undone(3, 'seq%5>2')})",
    "undo_stream": f"SELECT seq, layer_name FROM ({_undone(3, 'seq%5>2')})",
    "anomaly_from_scores": (
        f"SELECT vol_id, label, {r('s', 'anomaly_score')}, s>=cut AS is_anomaly, CASE WHEN why='' THEN 'none' ELSE why END AS anomaly_reason FROM (SELECT *, quantile_cont(s, 0.98) OVER () AS cut FROM (SELECT vol_id, label, (" + "+".join(f"least(greatest((c{k}-p{k}[1])/(p{k}[2]-p{k}[1]+1e-12),0),1)" for k in range(6))
        + "+(label%101)/100.0::DOUBLE+(label%89)/88.0::DOUBLE)/8 AS s, concat_ws(';', CASE WHEN zv>3 THEN 'large_volume' END, CASE WHEN zv<-3 THEN 'small_volume' END, CASE WHEN zs<-3 THEN 'low_sphericity' END, CASE WHEN ze>3 THEN 'high_elongation' END,"
        " CASE WHEN c3>3 THEN 'local_volume_outlier' END, CASE WHEN c4>3 THEN 'local_sphericity_outlier' END, CASE WHEN c5>3 THEN 'local_elongation_outlier' END) AS why FROM parts, (SELECT " + ", ".join(f"quantile_cont(c{k},[0.01,0.99]) AS p{k}" for k in range(6)) + " FROM parts)))"
    ),
    "lof_on_features": (
        f"SELECT label, vol_id, {r('avg(o.lrd)/any_value(l.lrd)', 'lof')} FROM (SELECT * FROM close WHERE rk<=20) e JOIN lrd l USING (label) JOIN (SELECT label AS other, lrd FROM lrd) o USING (other), (SELECT vol_id FROM volumes) GROUP BY label, vol_id"
    ),
    "finalized_labels": (
        _recursive(f"SELECT label, z, y, x, {NAME} FROM painted", "s.label=r.label", NEAR_SLICE)
        + ", found AS (SELECT label, z, y, x, min(root) AS component FROM reach GROUP BY ALL), kept AS (SELECT * FROM found SEMI JOIN (SELECT label, z, component FROM found GROUP BY ALL HAVING count(*)>=4) USING (label, z, component)),"
        " good AS (SELECT label FROM kept JOIN raw_vox USING (z,y,x) GROUP BY label HAVING count(*)>=30 AND avg(value)>=120), final AS (SELECT z, y, x, dense_rank() OVER (ORDER BY label) AS label FROM kept SEMI JOIN good USING (label)),"
        f" small AS (SELECT tz AS z, ty AS y, tx AS x, label FROM final JOIN {_resized('z', 'nz', 'nz')} USING (z) JOIN {_resized('y', 'ny', '(ny//2)')} USING (y) JOIN {_resized('x', 'nx', '(nx//2)')} USING (x))"
        f" SELECT 'v0' AS vol_id, z, y, x, {r('confidence+1e-9', 'confidence')}, coalesce(label, 0) AS label FROM (SELECT tz AS z, ty AS y, tx AS x, sum(confidence*wz*wy*wx) AS confidence FROM painted SEMI JOIN final USING (z,y,x) JOIN {_linear('z', 'nz', 'nz')} USING (z) JOIN {_linear('y', 'ny', '(ny//2)')} USING (y) JOIN {_linear('x', 'nx', '(nx//2)')} USING (x) WHERE wz>0 AND wy>0 AND wx>0 GROUP BY ALL) LEFT JOIN small USING (z,y,x)"
    ),
}
SQL["isolation_forest_points"] = f"WITH RECURSIVE SELECT vol_id, label, {r('least(greatest((raw-p[1])/(p[2]-p[1]+1e-12),0),1)', 'isolation_forest_score')} FROM forest JOIN (SELECT vol_id, quantile_cont(raw,[0.01,0.99]) AS p FROM forest GROUP BY vol_id) USING (vol_id)"
SQL["chunked_clicks"] = SQL["crop_centered"]
SQL["intensity_task"] = f"SELECT * FROM ({SQL['cell_basic']}) JOIN ({SQL['cell_intensity']}) USING (vol_id, label)"

def _matrix(features: dict[str, str], source: str) -> str:
    """Common table expressions up to ``f``: features by (value - median) / (width of the middle half) of their volume."""
    return (
        "raw_f AS (SELECT vol_id, label, " + ", ".join(f"({e})::DOUBLE AS {x}" for x, e in features.items()) + f" FROM {source}),"
        " q AS (SELECT vol_id, " + ", ".join(f"quantile_cont({x},[0.25,0.5,0.75]) AS q{x}" for x in features) + " FROM raw_f GROUP BY vol_id), f AS (SELECT vol_id, label, "
        + ", ".join(f"(coalesce({x},q{x}[2])-q{x}[2])/(CASE WHEN q{x}[3]=q{x}[1] THEN 1 ELSE q{x}[3]-q{x}[1] END) AS {x}" for x in features) + " FROM raw_f JOIN q USING (vol_id))"
    )


def _draw(*values: str) -> str:
    """A hashed draw of whole numbers."""
    h = "0::BIGINT"
    for v in values:
        h = f"((xor({h}, ({v})::BIGINT % 2147483647)*48271) % 2147483647)"
        h = f"(list_transform([{h}], lambda h: (xor(h, h>>13)*69621) % 2147483647)[1])"
    return h


def _forest(columns: list[str], trees: int = 200, sample: int = 256) -> str:
    """Common table expressions up to ``forest`` (vol_id, label, raw): the whole forest over ``f``, by recursion; all cells walk, those drawn into a tree count."""
    listed = ", ".join(f"round({c}, 9)" for c in columns)
    ends = lambda g: "[" + ", ".join(f"{g}(x[{k + 1}]) FILTER (drawn) OVER w" for k in range(len(columns))) + "]"
    return (
        f"walkers AS (SELECT vol_id, label, tree, [{listed}] AS x, row_number() OVER (PARTITION BY vol_id, tree ORDER BY {_draw('tree', 'label')}, label) <= {sample} AS drawn FROM f, (SELECT unnest(range({trees})) AS tree)),"
        " deep AS (SELECT vol_id, ceil(log2(greatest(2, least(count(*), " + str(sample) + "))))::INT AS most, least(count(*), " + str(sample) + ") AS seen FROM f GROUP BY vol_id),"
        " walk AS (SELECT vol_id, label, tree, x, drawn, 1::BIGINT AS node, 0 AS depth FROM walkers UNION ALL SELECT vol_id, label, tree, x, drawn, 2*node+(CASE WHEN x[c]<(CASE WHEN cut>lo[c] THEN cut ELSE hi[c] END) THEN 0 ELSE 1 END), depth+1 FROM ("
        f"SELECT *, lo[c]+({_draw('tree', 'node', '2')}/2147483647.0::DOUBLE)*(hi[c]-lo[c]) AS cut FROM (SELECT *, wide[1+{_draw('tree', 'node', '1')}*len(wide)//2147483647] AS c FROM ("
        f"SELECT *, list_filter(range(1, {len(columns) + 1}), lambda k: hi[k]>lo[k]) AS wide FROM (SELECT *, {ends('min')} AS lo, {ends('max')} AS hi, count(*) FILTER (drawn) OVER w AS n FROM walk WINDOW w AS (PARTITION BY vol_id, tree, node)) JOIN deep USING (vol_id)"
        " WHERE n>1 AND depth<most) WHERE len(wide)>0))),"
        " leaves AS (SELECT *, count(*) FILTER (drawn) OVER (PARTITION BY vol_id, tree, node) AS n FROM (SELECT *, row_number() OVER (PARTITION BY vol_id, tree, label ORDER BY depth DESC) AS last FROM walk) WHERE last=1),"
        " path AS (SELECT *, CASE WHEN n<=1 THEN 0 WHEN n=2 THEN 1 ELSE 2*(ln(n-1)+0.5772156649015329)-2*(n-1)/n::DOUBLE END AS more FROM leaves),"
        " forest AS (SELECT vol_id, label, pow(2, -avg(depth+more)/(2*(ln(any_value(seen)-1)+0.5772156649015329)-2*(any_value(seen)-1)/any_value(seen)::DOUBLE)) AS raw FROM path JOIN deep USING (vol_id) GROUP BY vol_id, label)"
    )


#: More expressions that single queries need.
SHAPES = f"shapes AS (SELECT e.vol_id, e.label, s.area, 2*sqrt(5*greatest(l1,0)) AS j, 2*sqrt(5*greatest(l2,0)) AS i, 2*sqrt(5*greatest(l3,0)) AS k FROM ({EIGEN}) e JOIN surface s USING (vol_id, label))"
MORE = {
    "region_task": SHAPES + ", densities AS (SELECT label, min(d) AS nearest, " + ", ".join(f"count(d) FILTER (rk<={k})/({BALL}*pow(max(d) FILTER (rk<={k}), 3)+1e-12) AS density{k}" for k in (5, 10, 20)) + " FROM near WHERE rk<=20 GROUP BY label)",
    "mask_costs": "clipped AS (SELECT *, least(greatest(prob, 1e-7), 1-1e-7) AS q FROM query_vox)",
    "anomaly_from_scores": (
        SHAPES + f", scored AS (SELECT vol_id, label, volume AS f0, ln(1+volume) AS lv, {SPHERICITY} AS f1, j/(k+1e-12) AS f2 FROM basic JOIN shapes USING (vol_id, label)),"
        " around AS (SELECT e.label, " + ", ".join(f"avg(f{k}) AS m{k}, stddev_pop(f{k}) AS s{k}" for k in range(3)) + " FROM near e JOIN scored q ON q.label=e.other WHERE rk<=10 GROUP BY e.label),"
        " parts AS (SELECT vol_id, label, zv, zs, ze, abs(zv) AS c0, greatest(-zs,0) AS c1, greatest(ze,0) AS c2, " + ", ".join(f"abs((f{k}-m{k})/(s{k}+1e-12)) AS c{k + 3}" for k in range(3))
        + " FROM (SELECT *, 0.6745*(lv-a.md)/(a.mad+1e-12) AS zv, 0.6745*(f1-b.md)/(b.mad+1e-12) AS zs, 0.6745*(f2-c.md)/(c.mad+1e-12) AS ze FROM scored, " + f"{_robust('lv')} a, {_robust('f1')} b, {_robust('f2')} c) JOIN around USING (label))"
    ),
    "lof_on_features": (
        SHAPES + f", raw_f AS (SELECT label, ln(1+volume) AS a, ln(1+area) AS b, {SPHERICITY} AS c, j/(k+1e-12) AS d FROM basic JOIN shapes USING (vol_id, label)),"
        " q AS (SELECT " + ", ".join(f"quantile_cont({x},[0.25,0.5,0.75]) AS q{x}" for x in "abcd") + " FROM raw_f), f AS (SELECT label, " + ", ".join(f"({x}-q{x}[2])/(CASE WHEN q{x}[3]=q{x}[1] THEN 1 ELSE q{x}[3]-q{x}[1] END) AS {x}" for x in "abcd") + " FROM raw_f, q),"
        " close AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, other) AS rk FROM (SELECT p.label, o.label AS other, sqrt(" + "+".join(f"(p.{x}-o.{x})*(p.{x}-o.{x})" for x in "abcd") + ") AS dist FROM f p JOIN f o ON p.label<>o.label)),"
        " far AS (SELECT label, max(dist) AS kd FROM close WHERE rk<=20 GROUP BY label), lrd AS (SELECT e.label, 1/(avg(greatest(e.dist, w.kd))+1e-10) AS lrd FROM close e JOIN far w ON w.label=e.other WHERE e.rk<=20 GROUP BY e.label)"
    ),
    "finalized_labels": "painted AS (SELECT z, y, x, min(query_id) AS label, max(prob) AS confidence FROM query_vox JOIN volumes ON z<nz AND y<ny AND x<nx WHERE prob>0.5 GROUP BY z, y, x)",
    "isolation_forest_points": _matrix({"a": "cz", "b": "cy", "c": "cx"}, "points") + ", " + _forest(list("abc")),
    "lof_scores": (
        "far AS (SELECT vol_id, label, max(d) AS kd FROM near_points WHERE rk<=20 GROUP BY ALL), lrd AS (SELECT e.vol_id, e.label, 1/(avg(greatest(e.d, f.kd))+1e-10) AS lrd FROM near_points e JOIN far f ON f.vol_id=e.vol_id AND f.label=e.other WHERE e.rk<=20 GROUP BY e.vol_id, e.label)"
    ),
    "bright_display": "seen AS MATERIALIZED (SELECT r.*, nz FROM raw_vox r JOIN volumes USING (vol_id))",
    "replace_cell": "m AS (SELECT p.* FROM roi_pixels p ANTI JOIN (SELECT * FROM label_vox WHERE label<>52) o USING (vol_id,z,y,x) WHERE p.z<10 AND p.y<40 AND p.x<40)",
}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, sql in SQL.items():
        head = FIXTURES + (f", {MORE[name]}" if name in MORE else "")
        if sql.startswith("WITH RECURSIVE SELECT "):
            out[name] = f"WITH RECURSIVE {head} {sql.removeprefix('WITH RECURSIVE ')}"
        elif sql.startswith("WITH RECURSIVE "):
            out[name] = f"WITH RECURSIVE {head}, {sql.removeprefix('WITH RECURSIVE ')}"
        else:
            out[name] = f"WITH {head} {sql}"
    return out
