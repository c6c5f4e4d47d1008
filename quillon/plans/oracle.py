"""SQL text of the geometry pipeline, in steps that queries share.  Each function returns common table
expressions; a query joins the ones it needs."""

from __future__ import annotations

DIMS = 64


def matrix(width: int = DIMS, table: str = "embeddings") -> str:
    cols = ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS f{k}" for k in range(width))
    return f"x AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, {cols} FROM {table})"


def robust(width: int = DIMS, clip: float = 4.5) -> str:
    fs = range(width)
    first = ", ".join(f"quantile_cont(f{k}, 0.5) AS m{k}, quantile_cont(f{k}, 0.75) - quantile_cont(f{k}, 0.25) AS q{k}, stddev_pop(f{k}) AS s{k}" for k in fs)
    second = ", ".join(f"1.4826 * median(abs(f{k} - m{k})) AS d{k}" for k in fs)
    scale = ", ".join(f"CASE WHEN d{k} > 1e-12 THEN d{k} WHEN q{k} / 1.349 > 1e-12 THEN q{k} / 1.349 WHEN s{k} > 1e-12 THEN s{k} ELSE 1 END AS c{k}, m{k}" for k in fs)
    z = ", ".join(f"greatest(-{clip}, least({clip}, (f{k} - m{k}) / c{k})) AS f{k}" for k in fs)
    return f"""st AS MATERIALIZED (SELECT {first} FROM x), dv AS MATERIALIZED (SELECT {second} FROM x, st),
sc AS MATERIALIZED (SELECT {scale} FROM st, dv), z AS MATERIALIZED (SELECT vec_id, pos, {z} FROM x, sc)"""


def slots(n: str, target: int) -> str:
    """Edges of the round robin; ``n``: SQL for the number of rows."""
    return f"""nn AS MATERIALIZED (SELECT CAST({n} AS BIGINT) AS n, CAST({n} AS BIGINT) + CAST({n} AS BIGINT) % 2 AS m),
grid AS (SELECT r, q, n, m FROM nn, range(0, (SELECT m - 1 FROM nn)) a(r), range(0, (SELECT m // 2 FROM nn)) b(q)),
edges AS (SELECT r, q, n, CASE WHEN q = 0 THEN 0 ELSE 1 + ((q - 1 - r) % (m - 1) + (m - 1)) % (m - 1) END AS l, 1 + ((m - 2 - q - r) % (m - 1) + (m - 1)) % (m - 1) AS t FROM grid),
slots AS MATERIALIZED (SELECT row_number() OVER (ORDER BY r, q) - 1 AS seq, l, t FROM edges WHERE greatest(l, t) < n QUALIFY seq < {target})"""


def balanced(key: str, target: int, seed: int = 0, table: str = "x") -> str:
    return f"""{slots(f"(SELECT count(*) FROM {table})", target)},
sl AS MATERIALIZED (SELECT pos, row_number() OVER (ORDER BY md5('pair:{seed}:' || {key}), {key}) - 1 AS slot FROM {table}),
pairs AS MATERIALIZED (SELECT seq AS pair_id, least(a.pos, b.pos) AS i, greatest(a.pos, b.pos) AS j FROM slots JOIN sl a ON a.slot = l JOIN sl b ON b.slot = t)"""


def geometry(width: int = DIMS) -> str:
    return "g AS MATERIALIZED (SELECT pair_id, i, j, " + ", ".join(f"(a.f{k} - b.f{k}) * (a.f{k} - b.f{k}) AS f{k}" for k in range(width)) + " FROM pairs JOIN z a ON a.pos = i JOIN z b ON b.pos = j)"


def profiles(width: int = DIMS) -> str:
    fs = range(width)
    return f"""ms AS MATERIALIZED (SELECT {", ".join(f"sum(f{k}) AS m{k}" for k in fs)} FROM g),
p AS MATERIALIZED (SELECT pair_id, i, j, {", ".join(f"f{k} / (m{k} + 1e-12) AS f{k}" for k in fs)} FROM g, ms),
r0 AS MATERIALIZED (SELECT pair_id, {", ".join(f"({' + '.join(f'f{c}' for c in fs)} - f{k}) / {max(width - 1, 1)}.0 AS f{k}" for k in fs)} FROM p),
rs AS MATERIALIZED (SELECT {", ".join(f"sum(f{k}) AS m{k}" for k in fs)} FROM r0),
rest AS MATERIALIZED (SELECT pair_id, {", ".join(f"f{k} / (m{k} + 1e-12) AS r{k}" for k in fs)} FROM r0, rs)"""


def longer(name: str, source: str, by: str, width: int = DIMS, extra: str = "") -> str:
    """by, feature, v."""
    return f"{name} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {by}{', ' if by else ''}'f{k}' AS feature, f{k} AS v{extra} FROM {source}" for k in range(width)) + ")"


def observed(width: int = DIMS) -> str:
    """aff, cov: feature, v."""
    fs = range(width)
    affs = ", ".join(f"sum(sqrt(p.f{k} * r{k})) AS f{k}" for k in fs)
    return f"""aw AS (SELECT {affs} FROM p JOIN rest USING (pair_id)), {longer("aff", "aw", "", width)},
{longer("gl", "g", "i, j", width)}, {coverage("cov", "gl", "feature")}"""


def coverage(name: str, source: str, by: str) -> str:
    """source: by, i, j, v."""
    return f"""{name}_e AS MATERIALIZED (SELECT {by}, s, sum(v) AS v FROM (SELECT {by}, i AS s, v FROM {source} UNION ALL SELECT {by}, j AS s, v FROM {source}) GROUP BY {by}, s),
{name}_t AS (SELECT {by}, sum(v) AS t FROM {name}_e GROUP BY {by}),
{name} AS MATERIALIZED (SELECT {by}, exp(-sum(v / (t + 1e-12) * ln(v / (t + 1e-12) + 1e-12))) / (SELECT count(*) FROM x) AS v FROM {name}_e JOIN {name}_t USING ({by}) GROUP BY {by})"""


def bank(draws: int, seed: int = 0, key: str = "vec_id") -> str:
    return f"bank AS MATERIALIZED (SELECT b, pos AS src, row_number() OVER (PARTITION BY b ORDER BY md5('perm:{seed}:' || b || ':' || {key}), {key}) - 1 AS pos FROM x, range(0, {draws}) t(b))"


def null(width: int = DIMS) -> str:
    """naff, ncov: b, feature, v."""
    fs = range(width)
    return f"""zb AS MATERIALIZED (SELECT b, bank.pos AS pos, {", ".join(f"z.f{k}" for k in fs)} FROM bank JOIN z ON z.pos = bank.src),
ng AS MATERIALIZED (SELECT b, pair_id, i, j, {", ".join(f"(u.f{k} - w.f{k}) * (u.f{k} - w.f{k}) AS f{k}" for k in fs)} FROM zb u JOIN pairs ON u.pos = i JOIN (SELECT * RENAME (b AS b2) FROM zb) w ON w.pos = j AND w.b2 = u.b),
na AS (SELECT b, {", ".join(f"sum(sqrt(ng.f{k} * r{k})) / sqrt(sum(ng.f{k}) + 1e-12) AS f{k}" for k in fs)} FROM ng JOIN rest USING (pair_id) GROUP BY b),
{longer("naff", "na", "b", width)}, {longer("ngl", "ng", "b, i, j", width)}, {coverage("ncov", "ngl", "b, feature")}"""


def calibrated(draws: int, power: float = 2.0, alpha: float = 0.05) -> str:
    """sup: feature, aff, cov, med, scale, zr, eff; neff: b, feature, eff; thr: one row."""
    import math

    place = math.ceil((draws - 1) * (1 - alpha) - 1e-9)
    return f"""med AS MATERIALIZED (SELECT feature, median(v) AS med, stddev_samp(v) AS sd FROM naff GROUP BY feature),
mad AS MATERIALIZED (SELECT feature, 1.4826 * median(abs(v - med)) AS d FROM naff JOIN med USING (feature) GROUP BY feature),
scl AS MATERIALIZED (SELECT feature, med, greatest(CASE WHEN d <= 1e-12 THEN sd ELSE d END, 1e-12) AS scale FROM med JOIN mad USING (feature)),
sup AS MATERIALIZED (SELECT feature, aff.v AS aff, cov.v AS cov, med, scale, greatest((aff.v - med) / scale, 0) AS zr, greatest((aff.v - med) / scale, 0) * pow(cov.v, {power}) AS eff FROM scl JOIN aff USING (feature) JOIN cov USING (feature)),
neff AS MATERIALIZED (SELECT b, feature, greatest((naff.v - med) / scale, 0) * pow(ncov.v, {power}) AS eff FROM naff JOIN ncov USING (b, feature) JOIN scl USING (feature)),
mx AS MATERIALIZED (SELECT b, max(eff) AS eff FROM neff GROUP BY b),
thr AS MATERIALIZED (SELECT eff AS t FROM mx ORDER BY eff LIMIT 1 OFFSET {place}),
adj AS MATERIALIZED (SELECT feature, (1 + (SELECT count(*) FROM mx WHERE mx.eff >= sup.eff)) / ({draws} + 1.0) AS p FROM sup)"""


def unit_gram(width: int = DIMS) -> str:
    """h: a, b (feature numbers), c."""
    values = ", ".join(f"f{k}" for k in range(width))
    return f"""gl2 AS MATERIALIZED (SELECT pair_id, unnest(range(0, {width})) AS a, unnest([{values}]) AS v FROM g),
gm AS MATERIALIZED (SELECT u.a, w.a AS b, sum(u.v * w.v) AS c FROM gl2 u JOIN gl2 w USING (pair_id) GROUP BY u.a, w.a), nr AS MATERIALIZED (SELECT a, sqrt(c) + 1e-12 AS s FROM gm WHERE a = b),
h AS MATERIALIZED (SELECT gm.a, gm.b, c / u.s / w.s AS c FROM gm JOIN nr u ON u.a = gm.a JOIN nr w ON w.a = gm.b)"""


def greedy_two(power: float = 0.5) -> str:
    """s1, s2: j, r, s (score) of two steps by the closed form of one basis vector."""
    return f"""e AS MATERIALIZED (SELECT CAST(substr(feature, 2) AS INT) AS j, * FROM sup),
s1 AS MATERIALIZED (SELECT j, 1.0 AS r, eff AS s FROM e ORDER BY eff DESC, j LIMIT 1),
res1 AS MATERIALIZED (SELECT e.j, greatest(0, least(1, (d.c - pow(greatest(h.c / greatest(q.c, 1e-12), 0), 2) * q.c * CASE WHEN h.c > 0 THEN 1 ELSE 0 END) / (d.c + 1e-12))) AS r, eff
  FROM e, s1 JOIN h ON h.a = s1.j JOIN h d ON d.a = h.b AND d.b = h.b JOIN h q ON q.a = s1.j AND q.b = s1.j WHERE e.j = h.b AND e.j <> s1.j),
s2 AS MATERIALIZED (SELECT j, r, eff * pow(r, {power}) AS s FROM res1 ORDER BY s DESC, j LIMIT 1)"""


def base(pairs: int, width: int = DIMS) -> str:
    return ",\n".join([matrix(width), robust(width), balanced("vec_id", pairs), geometry(width)])


def full(pairs: int, draws: int, width: int = DIMS) -> str:
    return ",\n".join([base(pairs, width), profiles(width), observed(width), bank(draws), null(width), calibrated(draws)])
