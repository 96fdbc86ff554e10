"""DuckDB SQL for operators that work step by step: recursive queries whose one row is the state, in lists by pixel (from 1)."""

from __future__ import annotations

from gridwright.plans import sql
from gridwright.sources.tables import WIDTH

#: The scalar image on 255 levels: img(f, n), and lev(i, v) by pixel.
IMAGE = f"{sql.PX}, img AS (SELECT list(CAST(floor(round(g, 9) * 255) AS BIGINT) ORDER BY p) AS f, CAST(count(*) AS INT) AS n FROM px)"


def around(values: str) -> list[str]:
    """What a list has east, south, west and north of pixel i; null beyond the border."""
    column = f"(i - 1) % {WIDTH}"
    return [f"CASE WHEN {column} < {WIDTH - 1} THEN {values}[i + 1] END", f"{values}[i + {WIDTH}]", f"CASE WHEN {column} > 0 THEN {values}[i - 1] END", f"CASE WHEN i > {WIDTH} THEN {values}[i - {WIDTH}] END"]


def _fill(f: str, height: int) -> str:
    """CTE full(v): minima of img's list `f` that are shallower than `height` filled, by geodesic erosion until nothing changes."""
    return f"""erode(it, v, stable) AS (SELECT 0, list_transform({f}, lambda x: x + {height}), FALSE FROM img
UNION ALL SELECT it + 1, w, w = v FROM (SELECT it, v, list_transform(range(1, n + 1), lambda i: greatest({f}[i], least(v[i], {', '.join(around('v'))}))) AS w FROM erode, img WHERE NOT stable)),
full_image AS (SELECT v FROM erode WHERE stable)"""


def _flat(source: str, end: str = "") -> str:
    """CTEs over source(i, v): zone(i, z): flat zones by their first pixel; low(i, k): pixels of regional minima, numbered in raster order."""
    near = f"((abs(a.i - b.i) = {WIDTH}) OR (abs(a.i - b.i) = 1 AND (a.i - 1) // {WIDTH} = (b.i - 1) // {WIDTH}))"
    return f"""touch{end} AS (SELECT a.i AS a, b.i AS b, a.v AS va, b.v AS vb FROM {source} a JOIN {source} b ON {near}),
same{end}(a, b) AS (SELECT i, i FROM {source} UNION SELECT same{end}.a, t.b FROM same{end} JOIN touch{end} t ON t.a = same{end}.b AND t.va = t.vb),
zone{end} AS (SELECT a AS i, min(b) AS z FROM same{end} GROUP BY a),
open{end} AS (SELECT DISTINCT z FROM zone{end} JOIN touch{end} t ON t.a = zone{end}.i WHERE t.vb < t.va),
low{end} AS (SELECT i, dense_rank() OVER (ORDER BY z) AS k FROM zone{end} WHERE z NOT IN (SELECT z FROM open{end}))"""


_PLACE = f"CAST(0 AS BIGINT) AS image_id, CAST((i - 1) // {WIDTH} AS INT) AS y, CAST((i - 1) % {WIDTH} AS INT) AS x"


def _signed(sign: int) -> str:
    return IMAGE.replace("CAST(floor(round(g, 9) * 255) AS BIGINT)", f"{sign} * CAST(floor(round(g, 9) * 255) AS BIGINT)")


def filled(sign: int, height: int = 12) -> str:
    """h-minima (1) or h-maxima (-1)."""
    return f"WITH RECURSIVE {_signed(sign)}, {_fill('f', height)} SELECT {_PLACE}, {sign} * v[i] AS v FROM full_image, img, range(1, n + 1) t(i)"


def extrema(sign: int) -> str:
    return f"WITH RECURSIVE {_signed(sign)}, lev AS (SELECT i, f[i] AS v FROM img, range(1, n + 1) t(i)), {_flat('lev')} SELECT {_PLACE}, CAST(coalesce(k, 0) AS BIGINT) AS v FROM lev LEFT JOIN low USING (i)"


#: Pixels b that a reaches over pixels of at least a's value; canon: the last pixel of a's value among them names the component.
_PEAKS = f"""lev AS (SELECT i, f[i] AS v FROM img, range(1, n + 1) t(i)), step AS (SELECT a.i AS a, b.i AS b, b.v FROM lev a JOIN lev b ON abs(a.i - b.i) = {WIDTH} OR (abs(a.i - b.i) = 1 AND (a.i - 1) // {WIDTH} = (b.i - 1) // {WIDTH})),
reach(a, v, b) AS (SELECT i, v, i FROM lev UNION SELECT reach.a, reach.v, step.b FROM reach JOIN step ON step.a = reach.b AND step.v >= reach.v)"""
COMPONENT_TREE = f"""WITH RECURSIVE {IMAGE}, {_PEAKS}, canon AS (SELECT reach.a AS i, reach.v, max(b) FILTER (lev.v = reach.v) AS c, count(*) AS area, sum(lev.v) AS total FROM reach JOIN lev ON lev.i = reach.b GROUP BY ALL),
around_it AS (SELECT x.i, arg_max(o.c, o.v) AS parent, max(o.v) AS pv FROM canon x JOIN reach ON reach.b = x.i JOIN canon o ON o.i = reach.a WHERE o.v < x.v GROUP BY x.i)
SELECT CAST(0 AS BIGINT) AS image_id, CAST(i - 1 AS BIGINT) AS pixel, CAST(CASE WHEN i = c THEN coalesce(parent, c) ELSE c END - 1 AS BIGINT) AS parent, CAST(CASE WHEN i = c THEN area ELSE 1 END AS BIGINT) AS area,
 CAST(CASE WHEN i = c THEN total - area * coalesce(pv, v) ELSE 0 END AS DOUBLE) AS volume FROM canon LEFT JOIN around_it USING (i)"""
#: Of each regional maximum, by its first pixel: how far it stands over the highest level on which it meets a higher one.
STRONGEST = f"""WITH RECURSIVE {IMAGE}, {_PEAKS}, down AS (SELECT i, -v AS v FROM lev), {_flat('down')}, peak AS (SELECT k, min(i) AS i, any_value(v) AS v FROM low JOIN lev USING (i) GROUP BY k),
met AS (SELECT p.k, max(r.v) AS level FROM peak p JOIN reach r ON r.b = p.i JOIN reach o ON o.a = r.a JOIN peak h ON h.i = o.b WHERE h.k <> p.k AND (h.v > p.v OR (h.v = p.v AND h.i < p.i)) GROUP BY p.k),
best AS (SELECT k FROM peak LEFT JOIN met USING (k) ORDER BY level IS NULL DESC, v - level DESC, k LIMIT 10) SELECT {_PLACE}, CAST(CASE WHEN k IN (SELECT k FROM best) THEN 1 ELSE 0 END AS BIGINT) AS v FROM lev LEFT JOIN low USING (i)"""

#: cut(i, v): the image without peaks lower than 12; _flat over its negative numbers what stays.
_CUT = f"WITH RECURSIVE {_signed(-1)}, {_fill('f', 12)}, cut AS (SELECT i, v[i] AS v FROM full_image, img, range(1, n + 1) t(i)), {_flat('cut')}"
HEIGHT_SEGMENTS = f"{_CUT} SELECT {_PLACE}, CAST(coalesce(k, 0) AS BIGINT) AS v FROM cut LEFT JOIN low USING (i)"
#: Of each pixel the maxima in its component at or above its level: it belongs to a single one.
HEIGHT_SEGMENTS_GROWN = f"""{_CUT}, reach(a, v, b) AS (SELECT i, v, i FROM cut UNION SELECT reach.a, reach.v, t.b FROM reach JOIN touch t ON t.a = reach.b AND t.vb <= reach.v),
held AS (SELECT reach.a AS i, min(k) AS k FROM reach JOIN low ON low.i = reach.b GROUP BY reach.a HAVING min(k) = max(k)) SELECT {_PLACE}, CAST(coalesce(k, 0) AS BIGINT) AS v FROM cut LEFT JOIN held USING (i)"""
#: Beside the cut image, every pixel keeps the highest level at which its component holds a chosen peak.
HEIGHT_OPENING = f"""{_CUT}, lev AS (SELECT i, -f[i] AS v FROM img, range(1, n + 1) t(i)), peak AS (SELECT k, arg_min(i, (-lev.v, i)) AS i FROM low JOIN lev USING (i) GROUP BY k),
step AS (SELECT a, b, lev.v FROM touch JOIN lev ON lev.i = b), reach(a, v, b) AS (SELECT i, v, i FROM lev UNION SELECT reach.a, reach.v, step.b FROM reach JOIN step ON step.a = reach.b AND step.v >= reach.v),
whole AS (SELECT r.b AS i, max(r.v) AS v FROM reach r JOIN (SELECT DISTINCT reach.a FROM reach JOIN peak ON peak.i = reach.b) USING (a) GROUP BY r.b) SELECT {_PLACE}, CAST(greatest(-cut.v, whole.v) AS BIGINT) AS v FROM cut LEFT JOIN whole USING (i)"""

#: Flooding in order of (level, turn); b: basin, -1 on divides, 0 where not settled; lev, turn: of queued pixels; val: as it comes out.
_NEAREST = ", ".join(f"CASE WHEN {m} > 0 THEN {k} * 4 + {o} END" for o, (m, k) in enumerate(zip((around("b0")[2], around("b0")[3], around("b0")[0], around("b0")[1]), ("(i - 1)", f"(i - {WIDTH})", "(i + 1)", f"(i + {WIDTH})"))))
_ORDER = f"CASE i - here WHEN 1 THEN 0 WHEN {WIDTH} THEN 1 WHEN -1 THEN 2 ELSE 3 END"
_BESIDE = f"(abs(i - here) = {WIDTH} OR (abs(i - here) = 1 AND (i - 1) // {WIDTH} = (here - 1) // {WIDTH}))"
WATERSHED = f"""WITH RECURSIVE {IMAGE}, {_fill('f', 12)}, lev AS (SELECT i, v[i] AS v FROM full_image, img, range(1, n + 1) t(i)), {_flat('lev')}, floors AS (SELECT list(v ORDER BY k) AS fl, count(*) AS many FROM (SELECT DISTINCT k, v FROM low JOIN lev USING (i))),
smooth AS (SELECT list(v ORDER BY i) AS s, list(coalesce(k, 0) ORDER BY i) AS b0 FROM lev LEFT JOIN low USING (i)),
start AS (SELECT n, s, b0, fl, many, list_transform(range(1, n + 1), lambda i: CASE WHEN b0[i] = 0 THEN least({_NEAREST}) END) AS turn0 FROM smooth, floors, img),
flood(it, b, lev, turn, val, here) AS (SELECT n + 1, b0, list_transform(range(1, n + 1), lambda i: CASE WHEN turn0[i] IS NOT NULL THEN s[i] END), turn0, list_transform(range(1, n + 1), lambda i: CASE WHEN b0[i] > 0 THEN fl[b0[i]] ELSE s[i] END), 0 FROM start
UNION ALL SELECT it + 1, list_transform(range(1, n + 1), lambda i: CASE WHEN i = here THEN own ELSE b[i] END),
 list_transform(range(1, n + 1), lambda i: CASE WHEN own > 0 AND lev[i] IS NULL AND b[i] = 0 AND {_BESIDE} THEN greatest(level, s[i]) ELSE lev[i] END),
 list_transform(range(1, n + 1), lambda i: CASE WHEN own > 0 AND lev[i] IS NULL AND b[i] = 0 AND {_BESIDE} THEN it * 4 + {_ORDER} ELSE turn[i] END),
 list_transform(range(1, n + 1), lambda i: CASE WHEN i = here THEN CASE WHEN own > 0 THEN fl[own] ELSE level END ELSE val[i] END), here
 FROM (SELECT *, CASE WHEN len(basins) = 1 THEN basins[1] ELSE -1 END AS own FROM (SELECT *, list_distinct(list_filter(near, lambda x: x > 0)) AS basins FROM (SELECT *, list_transform([here], lambda i: [{', '.join(around('b'))}])[1] AS near
 FROM (SELECT it, b, lev, turn, val, n, s, fl, pick.l AS level, CAST(pick.i AS INT) AS here FROM (SELECT flood.* EXCLUDE (here), n, s, fl, list_min(list_filter(list_transform(range(1, n + 1), lambda i: CASE WHEN lev[i] IS NOT NULL AND b[i] = 0 THEN {{'l': lev[i], 't': turn[i], 'i': i}} END), lambda x: x IS NOT NULL)) AS pick FROM flood, start) WHERE pick IS NOT NULL))))),
last AS (SELECT b, val, n, many FROM flood, start ORDER BY it DESC LIMIT 1)
SELECT {_PLACE}, round(val[i] / 255, 6) AS v, CAST(greatest(b[i], 0) AS BIGINT) AS basin, CAST(many AS BIGINT) AS n_minima, CAST(many + 1 AS BIGINT) AS n_labels FROM last, range(1, n + 1) t(i)"""

WATERSHED_MINIMA = f"WITH RECURSIVE {IMAGE}, {_fill('f', 12)}, lev AS (SELECT i, v[i] AS v FROM full_image, img, range(1, n + 1) t(i)), {_flat('lev')} SELECT DISTINCT CAST(0 AS BIGINT) AS image_id, CAST(k AS BIGINT) AS basin, CAST((SELECT max(k) FROM low) AS BIGINT) AS n_minima, round(v / 255, 6) AS v FROM low JOIN lev USING (i)"


def _joined(weight: str, thres: float, minsize: int) -> str:
    """CTE parted(lab): labels by pixel after both passes over the edges in order of weight, row, column, plane."""
    merge = lambda: "list_transform(lab, lambda l: CASE WHEN l = hi THEN lo ELSE l END)"
    at = lambda name, value: f"list_transform(range(0, len({name})), lambda j: CASE WHEN j = lo THEN {value} ELSE {name}[j + 1] END)"
    return f"""{sql.PX}, {sql.edges('e', weight, 2)}, o AS (SELECT *, row_number() OVER (ORDER BY w, y, x, plane) AS nr FROM e), m AS (SELECT count(*) AS m FROM o),
pass(it, lab, size, lim) AS (SELECT 0, (SELECT list(p ORDER BY p) FROM px), (SELECT list(1::BIGINT) FROM px), (SELECT list({thres}::DOUBLE) FROM px)
UNION ALL SELECT it + 1, CASE WHEN ok THEN {merge()} ELSE lab END, CASE WHEN ok THEN {at('size', 'size[lo + 1] + size[hi + 1]')} ELSE size END, CASE WHEN ok THEN {at('lim', f'w + {thres}::DOUBLE / (size[lo + 1] + size[hi + 1])')} ELSE lim END
 FROM (SELECT *, lo <> hi AND CASE WHEN it < m THEN w <= lim[lo + 1] AND w <= lim[hi + 1] ELSE least(size[lo + 1], size[hi + 1]) < {minsize} END AS ok FROM (SELECT pass.*, m, o.w, least(lab[src + 1], lab[dst + 1]) AS lo, greatest(lab[src + 1], lab[dst + 1]) AS hi FROM pass, m JOIN o ON TRUE WHERE o.nr = it % m + 1 AND it < 2 * m))),
parted AS (SELECT lab FROM pass ORDER BY it DESC LIMIT 1)"""


def segment(weight: str, name: str, thres: float = 3, minsize: int = 20) -> str:
    return f"WITH RECURSIVE {_joined(weight, thres, minsize)} SELECT image_id, y, x, lab[p + 1] AS {name} FROM px, parted"


#: best[z + 1]: the cheapest cut between node z's leaves and what is above z, in units of 1 / 100000; sons come before fathers.
CUT_MINIMUM = f"""WITH RECURSIVE {sql._TREE}, wt AS (SELECT tree.node, father, is_leaf, k, CAST(trunc(({sql.WEIGHT}) * 100000) AS BIGINT) AS cost FROM tree),
pair AS (SELECT k, min(id) AS a, max(id) AS b FROM son GROUP BY k), every AS (SELECT node, father, is_leaf, cost, a, b FROM wt LEFT JOIN pair USING (k)),
dp(z, best) AS (SELECT -1, []::BIGINT[] UNION ALL SELECT z + 1, list_append(best, least(cost, CASE WHEN is_leaf THEN 100000 ELSE best[a + 1] + best[b + 1] END)) FROM dp JOIN every ON every.node = z + 1),
done AS (SELECT best FROM dp ORDER BY z DESC LIMIT 1), judged AS (SELECT node, father, is_leaf OR cost < best[a + 1] + best[b + 1] AS here FROM every, done),
walk(node, here) AS (SELECT node, here FROM judged WHERE father < 0 UNION ALL SELECT j.node, j.here FROM walk JOIN judged j ON j.father = walk.node WHERE NOT walk.here)
SELECT CAST(0 AS BIGINT) AS image_id, CAST(node + 1 AS INT) AS node FROM walk WHERE here"""

#: Rows of each product of the demonstration.
DEMO = f"""WITH RECURSIVE {_joined(sql.SCALAR, 3, 20)}, px_n AS (SELECT count(*) AS n FROM px), four AS (SELECT count(*) AS n FROM e), {sql.edges('e8', sql.SCALAR, 4)}
SELECT 'graph4' AS product, n FROM four UNION ALL SELECT 'saliency', n FROM four UNION ALL SELECT 'graph8', count(*) FROM e8 UNION ALL SELECT 'segments', len(list_distinct(lab)) FROM parted
UNION ALL SELECT unnest(['components', 'gradient', 'watershed', 'saliency_map']), n FROM px_n"""
