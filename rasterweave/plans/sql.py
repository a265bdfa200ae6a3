"""The raster queries once more, as SQL over the driver's tables (DuckDB)."""

from __future__ import annotations

import re

from ..sources.fixtures import SQL as FIXTURES


def over(source: str, body: str) -> str:
    """body after the fixture's table px; it may begin with more table expressions."""
    return f"WITH RECURSIVE {FIXTURES[source]}{' ' if body.lstrip().startswith('SELECT') else ', '}{body}"


NORMALIZE = "SELECT y, x, CASE WHEN hi > lo THEN least(255, greatest(0, trunc(256.0::DOUBLE / (hi - lo) * (v - lo)))) ELSE 0 END::INT AS v FROM {src}, (SELECT min(v) AS lo, max(v) AS hi FROM {src}) e"

RECT_NORM = """SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  least(l_orderkey, l_suppkey)::INT AS "left", greatest(l_orderkey, l_suppkey)::INT AS "right",
  least(l_partkey, l_linenumber)::INT AS top, greatest(l_partkey, l_linenumber)::INT AS bottom FROM lineitem"""

RGB_TO_YUV = """u AS (SELECT y, x, c0 / 255.0::DOUBLE AS r, c1 / 255.0::DOUBLE AS g, c2 / 255.0::DOUBLE AS b FROM px)
SELECT y, x,
  least(255, greatest(0, trunc((r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE) * 255)))::INT AS c0,
  least(255, greatest(0, trunc((r * -0.14713::DOUBLE + g * -0.28886::DOUBLE + b * 0.436::DOUBLE + 0.436::DOUBLE) / (2 * 0.436::DOUBLE) * 255)))::INT AS c1,
  least(255, greatest(0, trunc((r * 0.615::DOUBLE + g * -0.51499::DOUBLE + b * -0.10001::DOUBLE + 0.615::DOUBLE) / (2 * 0.615::DOUBLE) * 255)))::INT AS c2
FROM u"""

YUV_TO_RGB = """w AS (SELECT y, x, c0 / 255.0::DOUBLE AS l, c1 / 255.0::DOUBLE * (2 * 0.436::DOUBLE) - 0.436::DOUBLE AS u, c2 / 255.0::DOUBLE * (2 * 0.615::DOUBLE) - 0.615::DOUBLE AS k FROM px)
SELECT y, x,
  least(255, greatest(0, trunc((l + k * 1.13983::DOUBLE) * 255)))::INT AS c0,
  least(255, greatest(0, trunc((l + u * -0.39465::DOUBLE + k * -0.58060::DOUBLE) * 255)))::INT AS c1,
  least(255, greatest(0, trunc((l + u * 2.03211::DOUBLE) * 255)))::INT AS c2
FROM w"""


def binomial(passes: int) -> str:
    parts, src = [], "px"
    for i in range(passes):
        for k, (a, b) in (("r", ("y", "x")), ("c", ("x", "y"))):
            parts.append(f"{k}{i} AS (SELECT y, x, coalesce((lag(v) OVER w >> 2) + (v >> 1) + (lead(v) OVER w >> 2), v) AS v FROM {src} WINDOW w AS (PARTITION BY {a} ORDER BY {b}))")
            src = f"{k}{i}"
    return ", ".join(parts) + f" SELECT y, x, v::INT AS v FROM {src}"


def sobel(axis: str, absolute: bool) -> str:
    """As nine neighbours."""
    taps = [(dy, dx, (dx if axis == "x" else dy) * (2 - abs(dy if axis == "x" else dx))) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    total = " + ".join(f"coalesce({w} * max(CASE WHEN q.y = p.y + {dy} AND q.x = p.x + {dx} THEN q.v END), 0)" for dy, dx, w in taps if w)
    value = f"CASE WHEN count(*) < 9 THEN 0 ELSE {'abs' if absolute else ''}({total}) END"
    return f"n AS (SELECT y + i AS py, x + j AS px_, y, x, v FROM px, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)) SELECT p.y, p.x, ({value})::INT AS v FROM px p JOIN n q ON q.py = p.y AND q.px_ = p.x GROUP BY p.y, p.x"


def extrema_cte(src: str, part: str, order: str, name: str = "ex") -> str:
    return f"""{name}_g AS (SELECT *, sign(v - lag(v) OVER w) AS s, lag(v) OVER w AS b, lead(v) OVER w AS a FROM {src} WINDOW w AS (PARTITION BY {part} ORDER BY {order})),
{name}_h AS (SELECT *, last_value(CASE WHEN s <> 0 THEN s END IGNORE NULLS) OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS way, lead(s) OVER (PARTITION BY {part} ORDER BY {order}) AS nx FROM {name}_g),
{name} AS (SELECT y, x, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND nx <> 0 AND nx = -way THEN a ELSE 0 END AS v FROM {name}_h)"""


def extrema(src: str, part: str, order: str) -> str:
    return extrema_cte(src, part, order) + " SELECT y, x, v::INT AS v FROM ex"


def integral(channels: dict[str, tuple[str, str]]) -> str:
    rows = ", ".join(f"sum({c}) OVER w AS {a}, sum({c} * {c}) OVER w AS {b}" for c, (a, b) in channels.items())
    cols = ", ".join(f"(sum({n}) OVER w)::BIGINT AS {n}" for pair in channels.values() for n in pair)
    return f"rr AS (SELECT y, x, {rows} FROM px WINDOW w AS (PARTITION BY y ORDER BY x)) SELECT y, x, {cols} FROM rr WINDOW w AS (PARTITION BY x ORDER BY y)"


def box_cte(radius: int, name: str, src: str = "px", keep: str = "v", low: bool = False) -> str:
    lo1 = ", min(v) OVER w AS lo" if low else ""
    lo2 = ", min(lo) OVER w AS lo" if low else ""
    k = f"RANGE BETWEEN {radius} PRECEDING AND {radius} FOLLOWING"
    return f"""{name}_r AS (SELECT y, x, {keep}, count(*) OVER w AS n, sum(v) OVER w AS s, sum(v * v) OVER w AS s2{lo1} FROM {src} WINDOW w AS (PARTITION BY y ORDER BY x {k})),
{name} AS (SELECT y, x, {keep}, (sum(n) OVER w)::BIGINT AS n, (sum(s) OVER w)::BIGINT AS s, (sum(s2) OVER w)::BIGINT AS s2{lo2} FROM {name}_r WINDOW w AS (PARTITION BY x ORDER BY y {k}))"""


BOX = box_cte(3, "bx") + " SELECT y, x, v, n, s, s2 FROM bx"
_DEV = "sqrt(greatest(0.0::DOUBLE, s2 / n - (s / n) * (s / n)))"


def rects(cols: tuple[str, ...]) -> str:
    out = {
        "n": "count(v)", "s": "coalesce(sum(v), 0)::BIGINT", "s2": "coalesce(sum(v * v), 0)::BIGINT", "lo": "coalesce(min(v), 0)", "hi": "coalesce(max(v), 0)",
        "mean": "round(CASE WHEN count(v) > 0 THEN sum(v)::DOUBLE / count(v) ELSE 0 END, 6)",
        "variance": "round(CASE WHEN count(v) > 0 THEN greatest(0.0::DOUBLE, sum(v * v)::DOUBLE / count(v) - (sum(v)::DOUBLE / count(v)) * (sum(v)::DOUBLE / count(v))) ELSE 0 END, 6)",
        "deviation": "round(CASE WHEN count(v) > 0 THEN sqrt(greatest(0.0::DOUBLE, sum(v * v)::DOUBLE / count(v) - (sum(v)::DOUBLE / count(v)) * (sum(v)::DOUBLE / count(v)))) ELSE 0 END, 6)",
    }
    return f"rc AS (SELECT c_custkey::INT AS rect, c_custkey % 70 - 4 AS rx, c_custkey * 7 % 520 - 10 AS ry, c_custkey % 13 AS w, c_custkey % 17 AS h FROM customer) SELECT rect, {', '.join(f'{out[c]} AS {c}' for c in cols)} FROM rc LEFT JOIN px ON x >= rx AND x < rx + w AND y >= ry AND y < ry + h GROUP BY rect"


RECT_CLIP = """sz AS (SELECT max(x) + 1 AS iw, max(y) + 1 AS ih FROM px)
SELECT rect, greatest(x, 0) AS x1, greatest(y, 0) AS y1, least(x + w, iw) AS x2, least(y + h, ih) AS y2,
  (greatest(least(x + w, iw) - greatest(x, 0), 0) * greatest(least(y + h, ih) - greatest(y, 0), 0))::BIGINT AS n
FROM sz, (SELECT c_custkey::INT AS rect, (c_custkey % 70 - 4)::INT AS x, (c_custkey * 7 % 520 - 10)::INT AS y, (c_custkey % 13)::INT AS w, (c_custkey % 17)::INT AS h FROM customer)"""


def sauvola(r: str, invert: bool = False) -> str:
    on, off = (0, 255) if invert else (255, 0)
    return f"""{box_cte(3, "bx")}, dev AS (SELECT y, x, v, s / n AS m, {_DEV} AS d FROM bx), rr AS (SELECT {r} AS r)
SELECT y, x, CASE WHEN v > floor(m * (1.0::DOUBLE + (CASE WHEN r <> 0 THEN d / r ELSE 1.0 END - 1.0) * 0.3::DOUBLE)) THEN {on} ELSE {off} END AS v FROM dev, rr"""


def feng(estimate: bool, inverted: bool = False, tail: str = "SELECT y, x, v FROM out") -> str:
    on, off = (0, 255) if inverted else (255, 0)
    low = f"greatest(0.0::DOUBLE, s / n - {_DEV} * 3.0::DOUBLE)" if estimate else "lo"
    return f"""{box_cte(2, "b1", low=not estimate)}, f1 AS (SELECT y, x, v, s / n AS m, {_DEV} AS d, {low} AS lo FROM b1),
{box_cte(4, "b2", "f1", "v, m, d, lo")}, f2 AS (SELECT y, x, v, m, lo, d / greatest(1.0::DOUBLE, {_DEV}) AS a FROM b2),
out AS (SELECT y, x, CASE WHEN v > floor(m * 0.88::DOUBLE + a * a * 0.25::DOUBLE * a * (m - lo) + a * a * 0.04::DOUBLE * lo) THEN {on} ELSE {off} END AS v FROM f2) {tail}"""


def contrast_cte(direction: str, kind: str, name: str = "g", width: int = 4, length: int = 6, src: str = "px") -> str:
    across, along = ("y", "x") if direction == "v" else ("x", "y")
    n = width * length
    m = f"(sa::DOUBLE / {n})", f"(sb::DOUBLE / {n})"
    var = f"(qa::DOUBLE / {n} - {m[0]} * {m[0]}) + (qb::DOUBLE / {n} - {m[1]} * {m[1]})"
    g = f"({m[1]} - {m[0]}) / sqrt(greatest(1.0::DOUBLE, {var}))" if kind == "signed" else f"({m[1]} - {m[0]}) * ({m[1]} - {m[0]}) / greatest(1.0::DOUBLE, {var})"
    return f"""{name}_l AS (SELECT {across} // {width} AS strip, {along} AS pos, sum(v) AS s, sum(v * v) AS q FROM {src} WHERE {across} // {width} < (SELECT (max({across}) + 1) // {width} FROM {src}) GROUP BY ALL),
{name}_b AS (SELECT strip, pos, sum(s) OVER a AS sa, sum(q) OVER a AS qa, count(*) OVER a AS na, sum(s) OVER b AS sb, sum(q) OVER b AS qb, count(*) OVER b AS nb FROM {name}_l
  WINDOW a AS (PARTITION BY strip ORDER BY pos ROWS BETWEEN {length} PRECEDING AND 1 PRECEDING), b AS (PARTITION BY strip ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {length} FOLLOWING)),
{name} AS (SELECT strip, pos, {g} AS g FROM {name}_b WHERE na = {length} AND nb = {length})"""


def contrast(direction: str, kind: str, tail: str) -> str:
    return contrast_cte(direction, kind) + (" " if tail.lstrip().startswith("SELECT") else ", ") + tail


def edges_cte(g: str, name: str) -> str:
    w = "PARTITION BY strip ORDER BY pos"
    return f"""{name}_s AS (SELECT *, sign(g - lag(g) OVER ({w})) AS st FROM {g}),
{name}_t AS (SELECT *, last_value(CASE WHEN st <> 0 THEN st END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS way, lead(st) OVER ({w}) AS nx FROM {name}_s),
{name} AS (SELECT strip, pos, greatest(-128, least(127, trunc(g)))::INT AS strength FROM {name}_t WHERE nx <> 0 AND nx = -way AND trunc(g) <> 0)"""


EDGES = edges_cte("g", "ed") + " SELECT strip, pos, strength FROM ed"
RESPONSE_CTE = contrast_cte("v", "unsigned") + """, k AS (SELECT (max(y) + 1 - 4 + 3) // 4 AS k FROM px),
rs AS (SELECT p.y, p.x, CASE WHEN p.y // 4 < k.k THEN coalesce(trunc(g.g), 0) ELSE 0 END::INT AS v FROM px p CROSS JOIN k LEFT JOIN g ON g.strip = p.y // 4 AND g.pos = p.x)"""
RESPONSE = RESPONSE_CTE + " SELECT y, x, v FROM rs"
EDGES_X_BOX = RESPONSE_CTE + ", " + extrema_cte("rs", "y", "x") + " " + NORMALIZE.format(src="ex")
_PAINTED = f"""{contrast_cte("v", "signed", "gv")}, {edges_cte("gv", "ev")}, {contrast_cte("h", "signed", "gh")}, {edges_cte("gh", "eh")},
bo AS (SELECT p.y, p.x, p.v, a.strength AS vs, b.strength AS hs FROM px p LEFT JOIN ev a ON a.strip = p.y // 4 AND a.pos = p.x LEFT JOIN eh b ON b.strip = p.x // 4 AND b.pos = p.y)"""
PAINT_GREY = _PAINTED + ", pa AS (SELECT y, x, coalesce(hs, vs, 0) AS v FROM bo) " + NORMALIZE.format(src="pa")
PAINT_OVER = _PAINTED + """, o1 AS (SELECT y, x, hs, CASE WHEN vs IS NULL THEN v WHEN v < 128 THEN 255 ELSE 0 END AS v FROM bo)
SELECT y, x, CASE WHEN hs IS NULL THEN v WHEN v < 128 THEN 255 ELSE 0 END AS v FROM o1"""

_CC = """st AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY y ORDER BY x) THEN 0 ELSE 1 END AS new FROM bw),
nr AS (SELECT *, sum(new) OVER (PARTITION BY y ORDER BY x) AS run FROM st),
runs AS MATERIALIZED (SELECT y, min(x) AS x1, max(x) AS x2, min(v) AS v, y * 4294967296::BIGINT + min(x) AS id FROM nr GROUP BY y, run),
ed AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM runs a JOIN runs b ON b.y = a.y + 1 AND a.v = b.v AND a.x1 <= b.x2 AND b.x1 <= a.x2),
both_ AS MATERIALIZED (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed),
lab(id, label) USING KEY (id) AS (
  SELECT id, id FROM runs
  UNION
  SELECT e.b, min(l.label) FROM lab l JOIN both_ e ON e.a = l.id JOIN recurring.lab r ON r.id = e.b WHERE l.label < r.label GROUP BY e.b)
"""
CC = "bw AS (SELECT y, x, CASE WHEN v >= 120 THEN 255 ELSE 0 END AS v FROM px), " + _CC
CC_REGIONS = "SELECT label, min(x1) AS x1, min(y) AS y1, max(x2) AS x2, max(y) AS y2, sum(x2 - x1 + 1)::BIGINT AS n FROM runs JOIN lab USING (id) GROUP BY label"
CC_PROGRAM = feng(True, inverted=True, tail=f", bw AS (SELECT y, x, v FROM out), {_CC} {CC_REGIONS}")


def colour(label: str, otherwise: str = "") -> str:
    """c0, c1, c2 of a label, or the other value where it is null."""
    one = lambda i: f"((({label} % 16777213 * 2654435 % 16777213) >> {8 * i}) % 256)::INT"
    return ", ".join(f"{f'CASE WHEN {label} IS NULL THEN {otherwise} ELSE {one(i)} END' if otherwise else one(i)} AS c{i}" for i in range(3))


CC_DRAW = CC + f"SELECT r.y, p.x::INT AS x, {colour('l.label')} FROM runs r JOIN lab l USING (id), unnest(range(x1, x2 + 1)) p(x)"
FIND_EDGES_PROGRAM = binomial(2).rpartition(" SELECT")[0] + ", bi AS (SELECT y, x, v::INT AS v FROM c1), " + re.sub(r"\bpx\b", "bi", PAINT_OVER)
BORDER = """bw AS (SELECT y, x, CASE WHEN v >= 120 THEN 255 ELSE 0 END AS v FROM px)
SELECT y, x, coalesce(v <> lag(v) OVER r, false) OR coalesce(v <> lead(v) OVER r, false) OR coalesce(v <> lag(v) OVER c, false) OR coalesce(v <> lead(v) OVER c, false) AS is_border
FROM bw WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y)"""


def grid_cte(largest: int) -> str:
    return f"""gr AS (SELECT (h // {largest}) AS rows, (w // {largest}) AS cols, (w - w // {largest} * {largest}) // 2 AS dx, (h - h // {largest} * {largest}) // 2 AS dy FROM (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM px)),
gp AS (SELECT y, x, v, y - dy AS gy, x - dx AS gx, dy, dx FROM px, gr WHERE y >= dy AND x >= dx AND y - dy < rows * {largest} AND x - dx < cols * {largest})"""


_STATS = "round(s / n, 6) + 0.0 AS mean, round(greatest(0.0::DOUBLE, s2 / n - (s / n) * (s / n)), 6) + 0.0 AS variance, round(sqrt(greatest(0.0::DOUBLE, s2 / n - (s / n) * (s / n))), 6) + 0.0 AS deviation"


def blocks_cte(largest: int, size: int, name: str = "r") -> str:
    return f"{name} AS (SELECT {size} AS size, (gy // {size} * {size} + any_value(dy))::INT AS y, (gx // {size} * {size} + any_value(dx))::INT AS x, (gy // {size})::INT AS r, (gx // {size})::INT AS c, count(*) AS n, sum(v)::BIGINT AS s, sum(v * v)::BIGINT AS s2 FROM gp GROUP BY gy // {size}, gx // {size})"


def blocks(largest: int, size: int) -> str:
    return f"{grid_cte(largest)}, {blocks_cte(largest, size)} SELECT size, y, x, n, s, s2, {_STATS} FROM r"


NEIGHBOURHOOD = f"""{grid_cte(16)}, {blocks_cte(16, 16)}, nb AS (SELECT r.y, r.x, count(*) AS n, sum(p.v)::BIGINT AS s, sum(p.v * p.v)::BIGINT AS s2 FROM r JOIN px p ON p.y BETWEEN r.y - 8 AND r.y + 23 AND p.x BETWEEN r.x - 8 AND r.x + 23 GROUP BY r.y, r.x)
SELECT y, x, n, s, s2, {_STATS} FROM nb"""


def split(kind: str) -> str:
    """Blocks of 16, 8 and 4 (l16, l8, l4) and leaves lf."""
    parts = [grid_cte(16)] + [blocks_cte(16, k, f"l{k}") for k in (16, 8, 4)]
    for big, small in ((16, 8), (8, 4)):
        if kind == "deviation":
            parts.append(f"d{big} AS (SELECT r, c FROM l{big} WHERE {_DEV} > 18.0)")
        else:
            w = f"greatest(3.0::DOUBLE, {_DEV} * 3.0::DOUBLE)"
            parts.append(f"k{small} AS (SELECT r // 2 AS r, c // 2 AS c, min(greatest(0.0::DOUBLE, s / n - {w})) AS a, max(greatest(0.0::DOUBLE, s / n - {w})) AS b, min(least(255.0::DOUBLE, s / n + {w})) AS e, max(least(255.0::DOUBLE, s / n + {w})) AS f FROM l{small} GROUP BY r // 2, c // 2)")
            parts.append(f"d{big} AS (SELECT r, c FROM k{small} WHERE CASE WHEN b > e THEN 0.0 ELSE greatest(1.0::DOUBLE, e - b) END / greatest(1.0::DOUBLE, f - a) < 0.5)")
    cols = "size, y, x, n, s, s2"
    parts.append(f"""lf AS MATERIALIZED (
  SELECT {cols} FROM l16 ANTI JOIN d16 USING (r, c)
  UNION ALL SELECT {cols} FROM l8 WHERE (r // 2, c // 2) IN (SELECT (r, c) FROM d16) AND (r, c) NOT IN (SELECT (r, c) FROM d8)
  UNION ALL SELECT {cols} FROM l4 WHERE (r // 4, c // 4) IN (SELECT (r, c) FROM d16) AND (r // 2, c // 2) IN (SELECT (r, c) FROM d8))""")
    return ", ".join(parts) + " "


LEAVES = "SELECT size, y, x, n, s, s2 FROM lf"
LEAF_NEIGHBOURS = """SELECT a.y AS ay, a.x AS ax, a.size AS asize, b.y AS by, b.x AS bx, b.size AS bsize, 'E' AS side FROM lf a JOIN lf b ON a.x + a.size = b.x AND a.y < b.y + b.size AND b.y < a.y + a.size
UNION ALL SELECT a.y, a.x, a.size, b.y, b.x, b.size, 'S' FROM lf a JOIN lf b ON a.y + a.size = b.y AND a.x < b.x + b.size AND b.x < a.x + a.size"""
DRAW = "SELECT p.y, p.x, trunc(l.s / l.n)::INT AS v FROM px p JOIN lf l ON p.y >= l.y AND p.y < l.y + l.size AND p.x >= l.x AND p.x < l.x + l.size"
_ROOT = "(y - (y - dy) % 16) * 4294967296::BIGINT + x - (x - dx) % 16"
_UNDER = "LEFT JOIN {t} l ON p.y >= l.y AND p.y < l.y + l.size AND p.x >= l.x AND p.x < l.x + l.size"
DRAW_IMAGE = "SELECT p.y, p.x, " + ", ".join(f"coalesce(trunc(l.s / l.n), 0)::INT AS c{i}" for i in range(3)) + " FROM px p " + _UNDER.format(t="lf")
_SEGS = f", ls AS MATERIALIZED (SELECT *, {_ROOT} AS segment, sum(s) OVER w AS ss, sum(n) OVER w AS sn, min(size) OVER w AS least FROM lf, gr WINDOW w AS (PARTITION BY {_ROOT})) "
DRAW_SEGMENTS = _SEGS + "SELECT p.y, p.x, " + ", ".join(f"coalesce(trunc(l.ss / l.sn), 0)::INT AS c{i}" for i in range(3)) + " FROM px p " + _UNDER.format(t="ls")
DRAW_COLOURS = _SEGS + f"SELECT p.y, p.x, {colour('l.segment', '0')} FROM px p " + _UNDER.format(t="ls")
HIGHLIGHT = _SEGS + "SELECT p.y, p.x, " + ", ".join(f"CASE WHEN l.least = 4 THEN {c} ELSE p.v END AS c{i}" for i, c in enumerate((250, 120, 0))) + " FROM px p " + _UNDER.format(t="ls")
LINKS = f"""{grid_cte(16)}, {blocks_cte(16, 16)}, links AS (
  SELECT a.y AS ay, a.x AS ax, b.y AS "by", b.x AS bx, CASE WHEN b.y > a.y THEN atan2((a.y - b.y)::DOUBLE, (b.x - a.x)::DOUBLE) + 2 * 3.141592653589793::DOUBLE ELSE 0.0::DOUBLE END AS angle
  FROM r a JOIN r b ON (b.r = a.r AND b.c = a.c + 1) OR (b.r = a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1)) """


def tree_edges(size: int, largest: int) -> str:
    """te: r, c, n, s, s2, dx, dy, mag, ang."""
    length = max(size // 2, 4)
    parts = [grid_cte(largest), blocks_cte(largest, size)]
    parts.append(f"pv AS (SELECT y - dy AS y, x, v FROM px, gr WHERE y >= dy AND y - dy < rows * {largest})")
    parts.append(f"ph AS (SELECT y, x - dx AS x, v FROM px, gr WHERE x >= dx AND x - dx < cols * {largest})")
    parts += [contrast_cte(k, "signed", f"g{k}", size, length, f"p{k}") for k in "vh"]
    f = f"sum(round(g * 1e9)::BIGINT)::BIGINT / 1e9::DOUBLE / {size}"
    parts.append(f"mv AS (SELECT strip AS r, (pos - dx) // {size} AS c, {f} AS dx FROM gv, gr WHERE pos >= gr.dx AND (pos - gr.dx) // {size} < cols * {largest // size} GROUP BY ALL)")
    parts.append(f"mh AS (SELECT (pos - dy) // {size} AS r, strip AS c, {f} AS dy FROM gh, gr WHERE pos >= gr.dy AND (pos - gr.dy) // {size} < rows * {largest // size} GROUP BY ALL)")
    parts.append("t0 AS (SELECT r.r, r.c, n, s, s2, coalesce(mv.dx, 0.0)::DOUBLE AS dx, coalesce(mh.dy, 0.0)::DOUBLE AS dy FROM r LEFT JOIN mv ON mv.r = r.r AND mv.c = r.c LEFT JOIN mh ON mh.r = r.r AND mh.c = r.c)")
    parts.append("te AS MATERIALIZED (SELECT *, sqrt(dx * dx + dy * dy) AS mag, CASE WHEN atan2(dx, dy) < 0 THEN atan2(dx, dy) + 2 * 3.141592653589793::DOUBLE ELSE atan2(dx, dy) END AS ang FROM t0)")
    return ", ".join(parts) + " "


def propagate_cte(src: str, value: str, rounds: int, way: str, name: str) -> str:
    """name: r, c and value after some rounds over the grid src."""
    sides = {"N4": "NESW", "H": "EW", "V": "NS"}[way]
    where = {"N": (-1, 0), "E": (0, 1), "S": (1, 0), "W": (0, -1)}
    parts, at = [], src
    for i in range(rounds):
        new = f"{name}_{i}" if i < rounds - 1 else name
        taps = " + ".join(f"coalesce(n{k}.{value}, a.{value}) / 8" for k in sides)
        joins = " ".join(f"LEFT JOIN {at} n{k} ON n{k}.r = a.r + ({where[k][0]}) AND n{k}.c = a.c + ({where[k][1]})" for k in sides)
        parts.append(f"{new} AS MATERIALIZED (SELECT a.r, a.c, a.{value} / 2 + {taps} AS {value} FROM {at} a {joins})")
        at = new
    return ", ".join(parts)


def propagate(way: str, rounds: int) -> str:
    return f"{grid_cte(4)}, {blocks_cte(4, 4)}, m AS MATERIALIZED (SELECT r, c, s / n AS v FROM r), {propagate_cte('m', 'v', rounds, way, 'o')} SELECT r, c, round(v, 6) + 0.0 AS v FROM o"


_MX = "CASE WHEN abs({t}.dx) + abs({t}.dy) < 0.01 THEN 0.5 ELSE abs({t}.{d}) / (abs({t}.dx) + abs({t}.dy)) END::DOUBLE * {t}.v / 4"


def _m_round(src: str, name: str) -> str:
    taps, joins = [], []
    for k, (dr, dc), d in (("n", (-1, 0), "dx"), ("e", (0, 1), "dy"), ("s", (1, 0), "dx"), ("w", (0, -1), "dy")):
        taps.append(f"CASE WHEN {k}.r IS NULL THEN {_MX.format(t='a', d=d)} ELSE {_MX.format(t=k, d=d)} END")
        joins.append(f"LEFT JOIN {src} {k} ON {k}.r = a.r + ({dr}) AND {k}.c = a.c + ({dc})")
    return f"{name} AS MATERIALIZED (SELECT a.r, a.c, a.dx, a.dy, a.v / 2 + {' + '.join(taps)} AS v FROM {src} a {' '.join(joins)})"


PROPAGATE_M = f"{tree_edges(8, 8)}, m0 AS MATERIALIZED (SELECT r, c, dx, dy, mag AS v FROM te), {_m_round('m0', 'm1')}, {_m_round('m1', 'm2')} SELECT r, c, round(v, 6) + 0.0 AS v FROM m2"


def stands_cte(src: str, value: str, rounds: int, name: str, column: str) -> str:
    return f"""{name}_a AS MATERIALIZED (SELECT r, c, {value} AS a FROM {src}), {name}_b AS MATERIALIZED (SELECT r, c, {value} * {value} AS b FROM {src}),
{propagate_cte(f'{name}_a', 'a', rounds, 'N4', f'{name}_p')}, {propagate_cte(f'{name}_b', 'b', rounds, 'N4', f'{name}_q')},
{name} AS MATERIALIZED (SELECT t.*, p.a AS pm, sqrt(greatest(0.0::DOUBLE, q.b - p.a * p.a)) AS pd, {value} > greatest(p.a, p.a + 0.0 - sqrt(greatest(0.0::DOUBLE, q.b - p.a * p.a))) AS {column} FROM {src} t JOIN {name}_p p USING (r, c) JOIN {name}_q q USING (r, c))"""


FIND_EDGES = f"{tree_edges(8, 8)}, {stands_cte('te', 'mag', 2, 'fe', 'has_edge')} "
SEGMENT_EDGES = FIND_EDGES + f""", s0 AS MATERIALIZED (SELECT r, c, dx, dy, CASE WHEN has_edge THEN 10.0 ELSE 0.0 END::DOUBLE AS v FROM fe), {_m_round('s0', 's1')},
onn AS MATERIALIZED (SELECT r, c, r * 4294967296::BIGINT + c AS id FROM fe JOIN s1 USING (r, c) WHERE has_edge OR s1.v > 2.6),
eb AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM onn a JOIN onn b ON abs(a.r - b.r) + abs(a.c - b.c) = 1),
lab(id, label) USING KEY (id) AS (
  SELECT id, id FROM onn UNION
  SELECT e.b, min(l.label) FROM lab l JOIN eb e ON e.a = l.id JOIN recurring.lab k ON k.id = e.b WHERE l.label < k.label GROUP BY e.b),
seg AS (SELECT r, c, label AS segment FROM onn JOIN lab USING (id)) """
WANTED = SEGMENT_EDGES + ", wanted AS (SELECT segment FROM seg GROUP BY segment HAVING count(*) >= 3) "
WANTED_ROWS = WANTED.replace("abs(a.r - b.r) + abs(a.c - b.c) = 1", "a.r = b.r AND abs(a.c - b.c) = 1")
MASK = WANTED + """, ws AS (SELECT r, c FROM seg JOIN wanted USING (segment)), wb AS (SELECT min(r) AS r1, max(r) AS r2, min(c) AS c1, max(c) AS c2 FROM ws)
SELECT (p.y - dy - r1 * 8)::INT AS y, (p.x - dx - c1 * 8)::INT AS x, CASE WHEN ws.r IS NULL THEN 0 ELSE 255 END AS v
FROM px p JOIN gr ON TRUE JOIN wb ON floor((p.y - dy) / 8.0) BETWEEN r1 AND r2 AND floor((p.x - dx) / 8.0) BETWEEN c1 AND c2
LEFT JOIN ws ON ws.r = floor((p.y - dy) / 8.0) AND ws.c = floor((p.x - dx) / 8.0)"""


def boundaries(size: int, rounds: int = 2) -> str:
    """fb: trees with dev, pm, pd and has_boundary."""
    return f"{tree_edges(size, size)}, td AS MATERIALIZED (SELECT *, {_DEV} AS dev FROM te), {stands_cte('td', 'dev', rounds, 'fb', 'has_boundary')} "


BOUNDARIES = boundaries(8)
_COMPASS = {"N": (-1, 0), "NE": (-1, 1), "E": (0, 1), "SE": (1, 1), "S": (1, 0), "SW": (1, -1), "W": (0, -1), "NW": (-1, -1)}
#: Where boundary trees look for the next and the previous one, by kind of direction.
_LOOK = {"steep": "N/S", "flat": "W/E", "up wide": "N NE E/S SW W", "up": "N NE/S SW", "down wide": "W NW N/E SE S", "down": "NW N/SE S"}
_DIRS = ", ".join(f"('{k}', '{side}', {p}, {_COMPASS[w][0]}, {_COMPASS[w][1]})" for k, both in _LOOK.items() for side, ways in zip(("next", "prev"), both.split("/"), strict=True) for p, w in enumerate(ways.split()))
AGREE = f""", dirs(k, side, p, dr, dc) AS (VALUES {_DIRS}),
bt AS MATERIALIZED (SELECT *, CASE WHEN abs(dx) > abs(dy) AND dy = 0 THEN 'steep' WHEN abs(dx) <= abs(dy) AND dx = 0 THEN 'flat'
  ELSE CASE WHEN dx * dy > 0 THEN 'up' ELSE 'down' END || CASE WHEN abs(dx) < 2 * abs(dy) THEN ' wide' ELSE '' END END AS k FROM fb WHERE has_boundary),
agree AS MATERIALIZED (SELECT a.r, a.c, d.side, d.p, b.r AS nr, b.c AS nc, b.pd FROM bt a JOIN dirs d USING (k) JOIN bt b ON b.r = a.r + d.dr AND b.c = a.c + d.dc AND sign(a.dx) = sign(b.dx) AND sign(a.dy) = sign(b.dy))"""
CHAIN_LINKS = boundaries(4) + AGREE + " SELECT r, c, side, nr, nc FROM agree QUALIFY row_number() OVER (PARTITION BY r, c, side ORDER BY pd DESC, p) = 1"
HYSTERESIS = boundaries(8) + AGREE + """, kept(r, c) AS (
  SELECT r, c FROM agree WHERE nr > r OR nr = r AND nc > c
  UNION SELECT a.r, a.c FROM kept k JOIN agree a ON a.nr = k.r AND a.nc = k.c AND (a.nr < a.r OR a.nr = a.r AND a.nc < a.c))
SELECT f.r, f.c, has_boundary AND k.r IS NOT NULL AS has_boundary FROM fb f LEFT JOIN kept k USING (r, c)"""
PARSE_BOUNDARIES = f"""{tree_edges(8, 8)}, td AS MATERIALIZED (SELECT r, c, s / n AS mean, {_DEV} AS dev FROM te),
{propagate_cte('td', 'mean', 2, 'N4', 'qm')}, {propagate_cte('td', 'dev', 3, 'N4', 'qd')},
rg AS (SELECT r, c, greatest(0.0, qm.mean - greatest(1.0, qd.dev)) AS a1, least(255.0, qm.mean + greatest(1.0, qd.dev)) AS a2,
  greatest(0.0, td.mean - greatest(1.0, td.dev)) AS b1, least(255.0, td.mean + greatest(1.0, td.dev)) AS b2 FROM td JOIN qm USING (r, c) JOIN qd USING (r, c))
SELECT r, c, CASE WHEN greatest(a2, b2) > least(a1, b1) THEN greatest(0.0, least(a2, b2) - greatest(a1, b1)) / (greatest(a2, b2) - least(a1, b1)) < 0.5 ELSE false END AS has_boundary FROM rg"""


def parse(rounds: int) -> str:
    pi = "3.141592653589793::DOUBLE"
    parts = [f"""wy(dr, dc, al) AS (VALUES {", ".join(f"({r}, {c}, {i}::DOUBLE / 4 * {pi})" for i, (r, c) in enumerate(_COMPASS[k] for k in ("E", "NE", "N", "NW", "W", "SW", "S", "SE")))}),
tn AS (SELECT a.r, a.c, b.r AS tr, b.c AS tc, a.dev < a.pm AND b.dev < b.pm AS calm, a.pm - abs(a.dev - b.dev) AS flat, abs(a.pd - b.pd) AS steep,
  abs(CASE WHEN al > {pi} THEN al - {pi} ELSE al END - CASE WHEN a.ang > {pi} THEN a.ang - {pi} ELSE a.ang END) AS turn
  FROM fb a JOIN wy ON TRUE JOIN fb b ON b.r = a.r + dr AND b.c = a.c + dc),
tc0 AS (SELECT r, c, tr, tc, CASE WHEN calm THEN greatest(0.0::DOUBLE, flat) ELSE CASE WHEN turn > {pi} / 2 THEN {pi} - turn ELSE turn END / ({pi} / 2) * steep END AS cost FROM tn),
hd AS MATERIALIZED (SELECT r, c, tr, tc, CASE WHEN cost < 1e-7 THEN 0.001::DOUBLE ELSE cost END AS cost FROM tc0),
a0 AS MATERIALIZED (SELECT r, c FROM fb WHERE has_boundary), s0 AS MATERIALIZED (SELECT r, c, tr, tc, 0.0::DOUBLE AS acc, 0 AS len FROM hd)"""]
    for i in range(1, rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, c FROM a{i - 1} UNION SELECT tr, tc FROM hd JOIN a{i - 1} USING (r, c)),
k{i} AS (SELECT hd.*, acc, len, CASE WHEN len > 0 THEN row_number() OVER (PARTITION BY r, c ORDER BY CASE WHEN len > 0 THEN 0 ELSE 1 END, acc, tr, tc) END AS k FROM hd JOIN a{i} USING (r, c) JOIN s{i - 1} USING (r, c, tr, tc)),
p{i} AS MATERIALIZED (SELECT x.r, x.c, x.tr, x.tc, x.cost + coalesce(y.acc, 0) AS pool, coalesce(y.len, 0) AS plen FROM k{i} x LEFT JOIN k{i} y ON y.r = x.r AND y.c = x.c AND y.k = CASE WHEN x.k = 1 THEN 2 ELSE 1 END),
s{i} AS MATERIALIZED (SELECT s.r, s.c, s.tr, s.tc, CASE WHEN o.r IS NULL OR m.r IS NULL THEN s.acc ELSE hd.cost + o.pool END AS acc, CASE WHEN o.r IS NULL OR m.r IS NULL THEN s.len ELSE o.plen + 1 END AS len
  FROM s{i - 1} s JOIN hd USING (r, c, tr, tc) LEFT JOIN p{i} o ON o.r = s.tr AND o.c = s.tc AND o.tr = s.r AND o.tc = s.c LEFT JOIN a{i} m ON m.r = s.r AND m.c = s.c)""")
    parts.append(f"lk AS (SELECT a.r, a.c, a.tr, a.tc, (a.acc + b.acc) / (a.len + b.len) AS s FROM s{rounds} a JOIN s{rounds} b ON b.r = a.tr AND b.c = a.tc AND b.tr = a.r AND b.tc = a.c JOIN a{rounds} m ON m.r = a.r AND m.c = a.c JOIN a{rounds} n ON n.r = a.tr AND n.c = a.tc WHERE a.r < a.tr OR a.r = a.tr AND a.c < a.tc)")
    return f"{boundaries(8, rounds + 1)}, {', '.join(parts)} SELECT r, c, tr, tc, round(CASE WHEN max(s) OVER () > min(s) OVER () THEN 1 - (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) ELSE 0 END, 6) + 0.0 AS strength FROM lk"


MOTION = f"""bl AS (SELECT frame, (y // 2)::INT AS r, (x // 2)::INT AS c, count(*) AS n, sum(v) AS s, sum(v * v) AS s2 FROM px GROUP BY ALL),
ms AS (SELECT frame, r, c, s / n AS m, {_DEV} AS d FROM bl)
SELECT frame, r, c, coalesce(abs(m - lag(m) OVER w) > greatest(1.0, d) + greatest(1.0, lag(d) OVER w), false) AS changed FROM ms WINDOW w AS (PARTITION BY r, c ORDER BY frame)"""
_MOVING = MOTION.partition("\nSELECT")[0] + """, ch AS MATERIALIZED (SELECT frame, r, c, m, d, frame * 1099511627776::BIGINT + r * 1048576::BIGINT + c AS node,
  coalesce(abs(m - lag(m) OVER w) > greatest(1.0, d) + greatest(1.0, lag(d) OVER w), false) AS changed FROM ms WINDOW w AS (PARTITION BY r, c ORDER BY frame)),
gw AS MATERIALIZED (SELECT DISTINCT b.frame, b.r, b.c, b.node FROM ch a JOIN ch b ON a.frame = b.frame AND abs(a.r - b.r) + abs(a.c - b.c) <= 1
  WHERE a.changed AND (b.changed OR abs(a.m - b.m) < greatest(1.0, a.d) + greatest(1.0, b.d))),
ge AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM gw a JOIN gw b ON a.frame = b.frame AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
gl(node, label) USING KEY (node) AS (
  SELECT node, node FROM gw UNION
  SELECT e.b, min(l.label) FROM gl l JOIN ge e ON e.a = l.node JOIN recurring.gl k ON k.node = e.b WHERE l.label < k.label GROUP BY e.b),
sg AS (SELECT frame, r, c, label % 1099511627776 // 1048576 * 4294967296 + label % 1048576 AS segment FROM gw JOIN gl USING (node))"""
MOTION_SEGMENTS = _MOVING + " SELECT frame, r, c, segment FROM sg"
MOTION_DRAW = _MOVING + f" SELECT p.frame, p.y, p.x, {colour("g.segment", "trunc(b.m)::INT")} FROM px p JOIN ms b ON b.frame = p.frame AND b.r = p.y // 2 AND b.c = p.x // 2 LEFT JOIN sg g ON g.frame = p.frame AND g.r = p.y // 2 AND g.c = p.x // 2"
MOTION_COUNTS = _MOVING + " SELECT frame, count(DISTINCT segment) AS segments FROM sg GROUP BY frame"
MOTION_BOXES = _MOVING + " SELECT frame, segment, sum(n)::BIGINT AS n, sum(s)::BIGINT AS s, sum(s2)::BIGINT AS s2, min(r) * 2 AS y1, min(c) * 2 AS x1, max(r) * 2 + 1 AS y2, max(c) * 2 + 1 AS x2 FROM sg JOIN bl USING (frame, r, c) GROUP BY frame, segment"
