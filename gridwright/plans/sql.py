"""SQL for DuckDB that the queries of the catalog are compared with."""

from __future__ import annotations

PX = "px AS (SELECT CAST(0 AS BIGINT) AS image_id, CAST(vec_id // 25 AS INT) AS y, CAST(vec_id % 25 AS INT) AS x, CAST(vec_id AS BIGINT) AS p, CAST(embedding AS DOUBLE[]) AS f, (CAST(embedding[1] AS DOUBLE) + 0.6) / 1.2 AS g, CAST(label AS BIGINT) AS label FROM embeddings)"
OFFSETS = "(VALUES (0, 0, 1), (1, 1, 0), (2, 1, 1), (3, -1, 1)) AS o(plane, dy, dx)"
EUCLID = "list_distance(a.f, b.f)"
MAXIMUM = "list_max(list_transform(range(1, len(a.f) + 1), lambda i: abs(a.f[i] - b.f[i])))"
ANGLE = "acos(greatest(-1.0, least(1.0, list_dot_product(a.f, b.f) / (sqrt(list_dot_product(a.f, a.f)) * sqrt(list_dot_product(b.f, b.f)) + 1e-8))))"
SCALAR = "sqrt((a.g - b.g) * (a.g - b.g))"


def edges(name: str, weight: str, planes: int) -> str:
    return f"{name} AS (SELECT a.image_id, o.plane, a.y, a.x, a.p AS src, b.p AS dst, {weight} AS w FROM px a JOIN {OFFSETS} ON o.plane < {planes} JOIN px b ON b.y = a.y + o.dy AND b.x = a.x + o.dx)"


def graph(weight: str, planes: int) -> str:
    return f"WITH {PX}, {edges('e', weight, planes)} SELECT image_id, plane, y, x, src, dst, round(w, 6) AS w FROM e"


def gradient(planes: int) -> str:
    return f"WITH {PX}, {edges('e', EUCLID, planes)} SELECT px.image_id, px.y, px.x, round(coalesce(m, -1), 6) AS v FROM px LEFT JOIN (SELECT p, max(w) AS m FROM (SELECT src AS p, w FROM e UNION ALL SELECT dst, w FROM e) GROUP BY p) USING (p)"


def labels(planes: int, test: str) -> str:
    """CTEs ending in lab(p, label): components of edges for which the test holds."""
    return f"""{PX}, {edges('e', EUCLID, planes)}, near AS (SELECT src AS a, dst AS b FROM e WHERE {test} UNION SELECT dst, src FROM e WHERE {test}),
reach(a, b) AS (SELECT p, p FROM px UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b), lab AS (SELECT a AS p, min(b) AS label FROM reach GROUP BY a)"""


def components_of(planes: int, test: str) -> str:
    return f"WITH RECURSIVE {labels(planes, test)} SELECT image_id, y, x, lab.label FROM px JOIN lab USING (p)"


GEOMETRY = """avg(x + 1) AS centroid_x, avg(y + 1) AS centroid_y, count(*) AS surface, min(x) + 1 AS bbox_left, max(x) + 1 AS bbox_right, min(y) + 1 AS bbox_top, max(y) + 1 AS bbox_bottom,
 max(x) - min(x) + 1 AS bbox_width, max(y) - min(y) + 1 AS bbox_height, (max(x) + min(x) + 2) / 2 AS bbox_x, (max(y) + min(y) + 2) / 2 AS bbox_y"""
ROUNDED = "image_id, id, round(centroid_x, 6) AS centroid_x, round(centroid_y, 6) AS centroid_y, surface, bbox_left, bbox_right, bbox_top, bbox_bottom, bbox_width, bbox_height, bbox_x, bbox_y"
COMPONENTS = f"WITH RECURSIVE {labels(2, 'w < 1.35')} SELECT {ROUNDED} FROM (SELECT image_id, lab.label AS id, {GEOMETRY} FROM px JOIN lab USING (p) GROUP BY 1, 2)"
PATCHES = f"""WITH RECURSIVE {labels(2, 'w < 1.35')}, box AS (SELECT lab.label AS id, min(x) AS l, max(x) AS r, min(y) AS t, max(y) AS b FROM px JOIN lab USING (p) GROUP BY 1 HAVING count(*) >= 3)
SELECT image_id, id, y - t AS y, x - l AS x, round(f[1], 6) AS f0, lab.label = id AS inside FROM box JOIN px ON x BETWEEN l AND r AND y BETWEEN t AND b JOIN lab USING (p)"""

#: Weights on 255 levels, and the order of ties in merge trees.
LEVELS, TIES = "CAST(floor(least(greatest(round(w, 9) * 255, 0), 255)) AS INT)", "plane, y, x"


def forest(level: str = LEVELS, ties: str = TIES) -> str:
    """CTEs: edges r of the scalar image, ranked as they are merged by q and ties, and those of the spanning tree, mst, numbered by k."""
    return f"""{PX}, {edges('e', SCALAR, 2)}, q AS (SELECT *, {level} AS q FROM e),
r AS (SELECT *, row_number() OVER (ORDER BY q, {ties}) AS rank FROM q), ways AS (SELECT rank, src AS a, dst AS b FROM r UNION ALL SELECT rank, dst, src FROM r),
seen(rank, node) AS (SELECT rank, src FROM r UNION SELECT seen.rank, ways.b FROM seen JOIN ways ON ways.a = seen.node AND ways.rank < seen.rank),
mst AS (SELECT *, row_number() OVER (ORDER BY rank) AS k FROM r WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.rank = r.rank AND seen.node = r.dst))"""


def nodes(mst: str = "mst", end: str = "") -> str:
    """CTEs over a numbered forest: side(k, s, node): pixels on both sides of the k-th merge; son(k, s, id): the node on each side;
    num.n: number of pixels; tree: all nodes."""
    return f"""ends{end} AS (SELECT k, src AS a, dst AS b FROM {mst} UNION ALL SELECT k, dst, src FROM {mst}),
side{end}(k, s, node) AS (SELECT k, s, node FROM (SELECT k, 0 AS s, src AS node FROM {mst} UNION ALL SELECT k, 1, dst FROM {mst}) UNION SELECT side{end}.k, side{end}.s, ends{end}.b FROM side{end} JOIN ends{end} ON ends{end}.a = side{end}.node AND ends{end}.k < side{end}.k),
num{end} AS (SELECT count(*) AS n FROM px),
son{end} AS (SELECT s.k, s.s, coalesce((SELECT n FROM num{end}) - 1 + max(t.k), min(node)) AS id FROM side{end} s LEFT JOIN ends{end} t ON t.a = s.node AND t.k < s.k GROUP BY 1, 2),
node{end} AS (SELECT p AS node, TRUE AS is_leaf, 0 AS level, CAST(NULL AS BIGINT) AS k FROM px UNION ALL SELECT (SELECT n FROM num{end}) - 1 + k, FALSE, q, k FROM {mst}),
tree{end} AS (SELECT CAST(t.node AS INT) AS node, CAST(coalesce((SELECT n FROM num{end}) - 1 + u.k, -1) AS INT) AS father, is_leaf, level, t.k FROM node{end} t LEFT JOIN son{end} u ON u.id = t.node)"""


_RANKED = forest()
_TREE = f"{_RANKED}, {nodes()}"


def tree(select: str) -> str:
    return f"WITH RECURSIVE {_TREE} {select}"


MST = f"WITH RECURSIVE {_RANKED} SELECT src, dst, q FROM mst"
MERGE_TREE = tree("SELECT CAST(0 AS BIGINT) AS image_id, tree.node, father, is_leaf, level, level AS altitude, CAST(CASE WHEN is_leaf THEN tree.node END AS BIGINT) AS pixel, mst.src AS merge_src, mst.dst AS merge_dst FROM tree LEFT JOIN mst USING (k)")
TREE_LEVELS = tree("SELECT CAST(0 AS BIGINT) AS image_id, node, level FROM tree")
TREE_ADJACENCY = tree("SELECT CAST(0 AS BIGINT) AS image_id, CAST(node + 1 AS BIGINT) AS id, CAST(father + 1 AS BIGINT) AS neighbor FROM tree WHERE father >= 0 UNION ALL SELECT 0, father + 1, node + 1 FROM tree WHERE father >= 0")
TREE_WEIGHTS = tree("SELECT CAST(0 AS BIGINT) AS image_id, node, CASE WHEN node % 3 = 2 THEN 0.0 ELSE round(((node + 1) * 37 % 101) / 101, 6) END AS weight FROM tree")
SALIENCY = tree("""SELECT e.image_id, e.plane, e.y, e.x, e.src, e.dst, round(q / 255, 6) AS w FROM e JOIN (SELECT e.plane, e.y, e.x, min(a.k) AS k FROM e JOIN side a ON a.node = e.src JOIN side b ON b.k = a.k AND b.node = e.dst GROUP BY ALL) m
ON m.plane = e.plane AND m.y = e.y AND m.x = e.x JOIN mst USING (k)""")
TREE_COMPONENTS = tree(f"SELECT {ROUNDED} FROM (SELECT CAST(0 AS BIGINT) AS image_id, CAST(id AS BIGINT) AS id, {GEOMETRY} FROM (SELECT p + 1 AS id, y, x FROM px UNION ALL SELECT (SELECT n FROM num) + k, y, x FROM side JOIN px ON px.p = side.node) GROUP BY 1, 2)")
FILTER_SURFACE = tree("""SELECT CAST(0 AS BIGINT) AS image_id, tree.node, level AS altitude, round(coalesce(s, 0), 6) AS attr_altitude FROM tree LEFT JOIN
(SELECT CAST((SELECT n FROM num) - 1 + row_number() OVER (ORDER BY s, k) AS INT) AS node, CAST(s AS DOUBLE) AS s FROM (SELECT k, min(c) AS s FROM (SELECT k, s, count(*) AS c FROM side GROUP BY 1, 2) GROUP BY k)) USING (node)""")
WEIGHT = "CASE WHEN 10 * node >= 18 * (SELECT n FROM num) THEN (10007 + node * 7919 % 10007) / 20014 ELSE (1 + node * 7919 % 10007) / (20014 * (SELECT n FROM num)) END"
MIN_COVER = f"""WITH RECURSIVE {_TREE}, wt AS (SELECT node, father, is_leaf, {WEIGHT} AS w FROM tree),
walk(node, is_leaf, w, pick) AS (SELECT node, is_leaf, w, node FROM wt WHERE father = -1 UNION ALL SELECT wt.node, wt.is_leaf, wt.w, CASE WHEN wt.w < walk.w THEN wt.node ELSE walk.pick END FROM walk JOIN wt ON wt.father = walk.node)
SELECT DISTINCT CAST(0 AS BIGINT) AS image_id, pick + 1 AS node FROM walk WHERE is_leaf"""
LABEL_AT_LEVEL = f"""WITH RECURSIVE {PX}, {edges('e', SCALAR, 2)}, near AS (SELECT src AS a, dst AS b FROM e WHERE floor(round(w, 9) * 255) <= 20 UNION SELECT dst, src FROM e WHERE floor(round(w, 9) * 255) <= 20),
reach(a, b) AS (SELECT p, p FROM px UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b) SELECT CAST(0 AS BIGINT) AS image_id, a AS pixel, min(b) AS label FROM reach GROUP BY a"""

KHALIMSKY = f"""WITH {PX}, {edges('e', EUCLID, 2)}, c AS (SELECT image_id, 2 * y AS y, 2 * x AS x, 0.0 AS v FROM px
UNION ALL SELECT image_id, 2 * y + (plane = 1)::INT, 2 * x + (plane = 0)::INT, w FROM e
UNION ALL SELECT image_id, 2 * y + 1, 2 * x + 1, w FROM e UNION ALL SELECT image_id, 2 * y - 1, 2 * x + 1, w FROM e WHERE plane = 0 AND y > 0 UNION ALL SELECT image_id, 2 * y + 1, 2 * x - 1, w FROM e WHERE plane = 1 AND x > 0)
SELECT image_id, y, x, round(max(v), 6) AS v FROM c GROUP BY ALL"""
MAT2GRAPH = f"""WITH {PX} SELECT image_id, plane, y // 2 AS y, x // 2 AS x, CAST((y // 2) * 12 + x // 2 AS BIGINT) AS src, CAST((y // 2) * 12 + x // 2 + CASE WHEN plane = 0 THEN 1 ELSE 12 END AS BIGINT) AS dst, round(g, 6) AS w
FROM px, (VALUES (0), (1)) AS t(plane) WHERE y % 2 = 0 AND x % 2 = 0 AND y < 2 * ((SELECT max(y) FROM px) // 2) AND x < 24"""


def pooling(maximum: bool, confidence: float) -> str:
    sure = "TRUE" if confidence <= 0 else f"list_sort(f, 'DESC')[1] - list_sort(f, 'DESC')[2] >= {confidence}"
    value = "CAST(ch = last AS DOUBLE)" if maximum else "round(m, 6)"
    return f"""WITH {PX}, s AS (SELECT *, {sure} AS sure FROM px), c AS (SELECT label, count(*) FILTER (sure) + 1 AS n FROM s GROUP BY label),
u AS (SELECT label, sure, unnest(range(1, len(f) + 1)) AS ch, unnest(f) AS v FROM s), m AS (SELECT label, ch, coalesce(sum(v) FILTER (sure), 0) / any_value(n) AS m FROM u JOIN c USING (label) GROUP BY 1, 2),
l AS (SELECT label, max(ch) AS last FROM (SELECT label, ch, m, max(m) OVER (PARTITION BY label) AS top FROM m) WHERE m = top GROUP BY label)
SELECT px.image_id, px.y, px.x, ch, {value} AS v FROM px JOIN m USING (label) JOIN l USING (label)"""


NEAR = "n AS (SELECT a.image_id, a.label AS a, b.label AS b FROM px a JOIN px b ON (b.y = a.y AND b.x = a.x + 1) OR (b.y = a.y + 1 AND b.x = a.x) WHERE a.label <> b.label)"
ADJACENCY = f"WITH {PX}, {NEAR} SELECT image_id, a AS id, b AS neighbor FROM n UNION SELECT image_id, b, a FROM n"
ADJACENCY_LISTS = f"WITH {PX}, {NEAR} SELECT image_id, a AS id, string_agg(DISTINCT CAST(b AS VARCHAR), ',' ORDER BY CAST(b AS VARCHAR)) AS neighbors FROM (SELECT * FROM n UNION SELECT image_id, b, a FROM n) GROUP BY 1, 2"
OVERLAP = f"""WITH {PX}, s AS (SELECT * FROM px WHERE g >= 0.5) SELECT CAST(0 AS BIGINT) AS image_id, CAST(c AS INT) AS class, round((SELECT count(*) FROM s WHERE label = c) / (SELECT count(*) FROM s), 6) AS ratio FROM range(1, 12) t(c)"""
DECISION = f"""WITH {PX}, prop AS (SELECT image_id, label AS seg, y, x, f FROM px UNION ALL SELECT image_id, (label + 9) % 10, y, x, f FROM px),
sc AS (SELECT seg, c - 1 AS class, abs(avg(f[c])) AS f FROM prop, range(1, 65) t(c) GROUP BY seg, c), lead AS (SELECT seg FROM sc ORDER BY f DESC, seg LIMIT 1),
n AS (SELECT seg, count(*) AS n FROM prop GROUP BY seg), lp AS (SELECT y, x FROM prop WHERE seg = (SELECT seg FROM lead)),
k AS (SELECT seg, count(*) AS k FROM prop JOIN lp USING (y, x) GROUP BY seg), voters AS (SELECT seg FROM k JOIN n USING (seg) WHERE k / least(n, (SELECT count(*) FROM lp)) > 0.3),
g AS (SELECT y, x, class, sum(sc.f) AS g FROM prop JOIN voters USING (seg) JOIN sc USING (seg) GROUP BY 1, 2, 3), top AS (SELECT y, x, max(g) AS g, arg_min(class, (-g, class)) AS class FROM g GROUP BY 1, 2)
SELECT px.image_id, y, x, CAST(CASE WHEN coalesce(top.g, 0) < 0.01 THEN 2 ELSE coalesce(class, 0) + 3 END AS INT) AS class FROM px LEFT JOIN top USING (y, x)"""
COLORIZE = f"WITH {PX} SELECT image_id, y, x, label / 10 AS r, 1 - label / 10 AS g, CAST(0.5 AS DOUBLE) AS b FROM px"
COLORMAP = "SELECT CAST(id AS BIGINT) AS id, CASE WHEN id % 3 = 0 THEN id / 10 ELSE 0.25 END AS r, CAST(CASE WHEN id % 3 = 0 THEN 0.5 ELSE 0.25 END AS DOUBLE) AS g FROM range(0, (SELECT max(label) FROM embeddings WHERE label % 3 = 0) + 1) t(id)"
EVENTS = """WITH c AS (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INT) AS y, CAST(user_id AS INT) AS x, event_type AS t, sum(value) AS v FROM events GROUP BY ALL),
k AS (SELECT DISTINCT y, x FROM c), t AS (SELECT DISTINCT t FROM c), px AS (SELECT k.y, k.x, t.t, coalesce(c.v, 0) AS v FROM k CROSS JOIN t LEFT JOIN c ON c.y = k.y AND c.x = k.x AND c.t = t.t),
d AS (SELECT a.y, a.x, o.plane, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS w FROM px a JOIN (VALUES (0, 0, 1), (1, 1, 0)) AS o(plane, dy, dx) ON TRUE JOIN px b ON b.y = a.y + o.dy AND b.x = a.x + o.dx AND b.t = a.t GROUP BY ALL)
SELECT plane, y, x, round(w, 4) AS w FROM d"""

BINARY_LABELS = f"""WITH RECURSIVE {PX}, bright AS (SELECT * FROM px WHERE g >= 0.5), near AS (SELECT a.p AS a, b.p AS b FROM bright a JOIN bright b ON abs(a.y - b.y) + abs(a.x - b.x) = 1),
reach(a, b) AS (SELECT p, p FROM bright UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b) SELECT image_id, y, x, label FROM (SELECT a AS p, min(b) AS label FROM reach GROUP BY a) l JOIN (SELECT image_id, y, x, p FROM px) px USING (p)"""
CONNECTED_OVERLAP = f"""WITH RECURSIVE {labels(2, 'w < 1.35')}, s AS (SELECT image_id, p, lab.label AS segment, px.label AS label FROM px JOIN lab USING (p)),
like_near AS (SELECT a.p AS a, b.p AS b FROM px a JOIN px b ON abs(a.y - b.y) + abs(a.x - b.x) = 1 AND a.label = b.label),
flood(a, b) AS (SELECT p, p FROM px UNION SELECT flood.a, like_near.b FROM flood JOIN like_near ON like_near.a = flood.b), reg AS (SELECT a AS p, min(b) AS region FROM flood GROUP BY a),
sized AS (SELECT region, count(*) AS n FROM reg GROUP BY 1), met AS (SELECT image_id, segment, label, region, count(*) AS i FROM s JOIN reg USING (p) GROUP BY ALL),
joint AS (SELECT image_id, segment, label, sum(i) AS i, sum(n) AS nb FROM met JOIN sized USING (region) GROUP BY ALL), a AS (SELECT segment, count(*) AS na FROM s GROUP BY 1)
SELECT image_id, segment, label, round(i / (na + nb - i), 6) AS iou FROM joint JOIN a USING (segment)"""

#: Sons of each merge, in order.
_SONS = "sons AS (SELECT k, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY id) AS t FROM son GROUP BY k)"
_DUMP = """dumped AS (SELECT -1 AS line_no, concat('root ', (SELECT max(node) FROM tree WHERE father < 0), ' nbnodes ', (SELECT count(*) FROM tree), ' nbsoncells ', (SELECT count(*) FROM son)) AS line
UNION ALL SELECT node, concat('node ', node, ' father ', father, ' level ', level, ' sons ' || t) FROM tree LEFT JOIN sons USING (k))"""
TREE_MASKS = tree("SELECT CAST(0 AS BIGINT) AS image_id, CAST(p + 1 AS BIGINT) AS id, p AS pixel FROM px UNION ALL SELECT 0, (SELECT n FROM num) + k, node FROM side")
TREE_DUMP = f"WITH RECURSIVE {_TREE}, {_SONS}, {_DUMP} SELECT CAST(0 AS BIGINT) AS image_id, line_no, line FROM dumped"
TREE_TEXT = f"WITH RECURSIVE {_TREE}, {_SONS}, {_DUMP}, whole AS (SELECT string_agg(line, chr(10) ORDER BY line_no) AS t FROM dumped) SELECT CAST(0 AS BIGINT) AS image_id, CASE WHEN length(t) > 9216 THEN substr(t, 1, 9216) || '...' ELSE t END AS listing FROM whole"
TREE_GRAPHVIZ = tree("""SELECT CAST(0 AS BIGINT) AS image_id, 0 AS line_no, 'digraph tree {' AS line UNION ALL SELECT 0, 1, concat('  ', father, ' -> ', node, ';') FROM tree WHERE father >= 0
UNION ALL SELECT 0, 1, concat('  ', node, ' [label="', node, ':', level, '"];') FROM tree UNION ALL SELECT 0, 2, '}'""")
_FULL = "SELECT CAST(0 AS BIGINT) AS image_id, {t}.node, {t}.father, {t}.is_leaf, {t}.level, {altitude} AS altitude, CAST(CASE WHEN {t}.is_leaf THEN {t}.node END AS BIGINT) AS pixel, {mst}.src AS merge_src, {mst}.dst AS merge_dst"


def filter_tree(mode: str) -> str:
    """The spanning edges ranked anew by the smaller attribute of their sides. The attributes of a side have closed forms, as leaves lie at level 0: its
    pixels times its level, the level of the merge that ends it, and the range of the levels of the merges in it."""
    own = "side_of AS (SELECT side.k, side.s, count(*) AS area FROM side GROUP BY 1, 2), within AS (SELECT side.k, side.s, max(m.q) AS high, min(m.q) AS low FROM side JOIN mst m ON m.src = side.node AND m.k < side.k GROUP BY 1, 2)"
    attr = {"volume": "area * coalesce(high, 0)", "dynamic": "mst.q", "alphaomega": "coalesce(high - low, 0)"}[mode]
    value = f"worth AS (SELECT k, CAST(min({attr}) AS DOUBLE) AS value FROM side_of LEFT JOIN within USING (k, s) JOIN mst USING (k) GROUP BY k)"
    again = "mst2 AS (SELECT src, dst, q, value, row_number() OVER (ORDER BY value, k) AS k FROM mst JOIN worth USING (k))"
    out = _FULL.format(t="tree2", mst="mst2", altitude="tree.level")
    return f"WITH RECURSIVE {_TREE}, {own}, {value}, {again}, {nodes('mst2', '2')} {out}, round(coalesce(value, 0), 6) AS attr_altitude FROM tree2 JOIN tree USING (node) LEFT JOIN mst2 ON mst2.k = tree2.k"


#: The level of a merge is the largest of what the sides of all merges within it ask for.
HIERARCHY_SCALE = f"""WITH RECURSIVE {forest('w * 255', 'y, x, plane')}, {nodes()},
asked AS (SELECT t.k AS k, max(greatest(0, CAST(trunc((m.q - coalesce(o.q, 0)) * c.area) AS BIGINT))) AS scale FROM (SELECT k, s, count(*) AS area FROM side GROUP BY 1, 2) c JOIN son USING (k, s) JOIN node d ON d.node = son.id LEFT JOIN mst o ON o.k = d.k JOIN mst m ON m.k = c.k JOIN (SELECT k AS j, k FROM mst UNION SELECT m.k, side.k FROM side JOIN mst m ON m.src = side.node AND m.k < side.k) t ON t.j = c.k GROUP BY 1)
SELECT CAST(0 AS BIGINT) AS image_id, tree.node, father, is_leaf, CAST(coalesce(scale, 0) AS INT) AS level, CAST(coalesce(scale, 0) AS INT) AS altitude, CAST(CASE WHEN is_leaf THEN tree.node END AS BIGINT) AS pixel, mst.src AS merge_src, mst.dst AS merge_dst FROM tree LEFT JOIN mst USING (k) LEFT JOIN asked USING (k)"""


def tree_bands(bounds: tuple[float, ...], least: int) -> str:
    """A node stays if it is a leaf, a root, or large enough and of another band than its father; bands never fall upwards."""
    band = " + ".join(f"(level >= {b})::INT" for b in bounds)
    return f"""WITH RECURSIVE {_TREE}, size AS (SELECT k, count(*) AS area FROM side GROUP BY k), b AS (SELECT tree.*, CASE WHEN is_leaf THEN 0 ELSE 1 + {band} END AS band, coalesce(area, 1) AS area FROM tree LEFT JOIN size USING (k)),
stay AS (SELECT b.*, row_number() OVER (ORDER BY b.node) - 1 AS nr FROM b LEFT JOIN b f ON f.node = b.father WHERE b.is_leaf OR b.father < 0 OR (b.area >= {least} AND b.band <> f.band)),
up(node, place) AS (SELECT node, father FROM stay UNION ALL SELECT up.node, b.father FROM up JOIN b ON b.node = up.place WHERE up.place NOT IN (SELECT node FROM stay)),
hung AS (SELECT up.node, s.nr FROM up JOIN stay s ON s.node = up.place)
SELECT CAST(0 AS BIGINT) AS image_id, CAST(stay.nr AS INT) AS node, CAST(coalesce(hung.nr, -1) AS INT) AS father, CAST(band AS INT) AS band, CAST(area AS BIGINT) AS area, stay.node AS source FROM stay LEFT JOIN hung USING (node)"""


#: A node is on the leaves' side if a way to a marker under a leaf has a larger least weight than the way to the marker over the root; where both ways
#: start with the same least edge, it goes with its father. All weights differ, so forests by Kruskal, Prim and the power watershed cut alike.
CUT_FOREST = f"""WITH RECURSIVE {_TREE}, wt AS (SELECT node, father, is_leaf, {WEIGHT} AS w FROM tree),
way(node, place, low) AS (SELECT node, node, CAST(1 AS DOUBLE) FROM wt UNION ALL SELECT way.node, wt.father, least(low, w) FROM way JOIN wt ON wt.node = way.place WHERE wt.father >= 0),
below AS (SELECT place AS node, max(low) AS below FROM way JOIN wt USING (node) WHERE is_leaf GROUP BY 1),
best AS (SELECT way.node, max(least(low, below)) AS best FROM way JOIN below ON below.node = way.place GROUP BY 1),
root AS (SELECT node, least(low, (SELECT w FROM wt WHERE father < 0)) AS up FROM way WHERE place = (SELECT node FROM wt WHERE father < 0)),
side_of(node, leaves) AS (SELECT node, best > up FROM wt JOIN best USING (node) JOIN root USING (node) WHERE father < 0 UNION ALL SELECT wt.node, CASE WHEN best = up THEN leaves ELSE best > up END FROM side_of f JOIN wt ON wt.father = f.node JOIN best ON best.node = wt.node JOIN root ON root.node = wt.node),
cut AS (SELECT node FROM wt JOIN side_of USING (node) JOIN (SELECT node AS father, leaves AS above FROM side_of) USING (father) WHERE leaves <> above UNION SELECT node FROM wt JOIN side_of USING (node) WHERE is_leaf AND NOT leaves)
SELECT CAST(0 AS BIGINT) AS image_id, CAST(node + 1 AS INT) AS node FROM (SELECT node FROM cut UNION ALL SELECT node FROM wt WHERE father < 0 AND NOT EXISTS (SELECT 1 FROM cut))"""

_HASHED = "CAST('0x' || substr(md5({0} || ':{1}'), 1, 5) AS INT) / 1048576 AS {2}"
_COLOURS = ", ".join(_HASHED.format("label", i, c) for i, c in enumerate("rgb"))
COLORIZE_HASH = f"WITH {PX} SELECT image_id, y, x, {_COLOURS} FROM px"
COLORIZE_DRAWN = f"WITH {PX} SELECT DISTINCT label AS id, {_COLOURS} FROM px"

#: Pairs of labelled pixels that each merge of the spanning tree (by weight itself) joins: alike and unlike.
_MALIS = f"""{forest('w', 'plane, y, x')}, {nodes()}, c AS (SELECT k, s, label, count(*) AS c FROM side JOIN px ON px.p = side.node WHERE label <> 0 GROUP BY ALL),
pairs AS (SELECT a.k, sum(a.c * b.c) FILTER (a.label = b.label) AS alike, sum(a.c * b.c) FILTER (a.label <> b.label) AS unlike FROM c a JOIN c b ON a.k = b.k AND a.s = 0 AND b.s = 1 GROUP BY 1),
judged AS (SELECT mst.*, coalesce(alike, 0) AS alike, coalesce(unlike, 0) AS unlike, 0.05 - (0.1 - w) AS low, 0.05 + (0.1 - w) AS high FROM mst JOIN pairs USING (k)), norm AS (SELECT n * (n - 1) / 2 AS norm FROM (SELECT count(*) AS n FROM px WHERE label <> 0))"""
MALIS_LOSS = f"WITH RECURSIVE {_MALIS} SELECT CAST(0 AS BIGINT) AS image_id, round(sum(alike * greatest(0, low) + unlike * greatest(0, high)) / (SELECT norm FROM norm), 6) AS value FROM judged"
MALIS_GRADIENT = f"WITH RECURSIVE {_MALIS} SELECT e.image_id, e.plane, e.y, e.x, round(coalesce(alike * (low > 0)::INT - unlike * (high > 0)::INT, 0) / (SELECT norm FROM norm), 9) AS gradient FROM e LEFT JOIN judged USING (plane, y, x)"

#: Kernels of the recursive filters as sums over 121 taps; the borders repeat.
_SMOOTH = "(1 + abs(t)) * exp(-abs(t)) * ((1 - exp(-1)) * (1 - exp(-1)) / (1 + 2 * exp(-1) - exp(-2)))"
_DERIVE = "t * exp(1 - abs(t)) * ((1 - exp(-1)) ** 3 / (2 * (1 + exp(-1))))"
_EXPONENTIAL = "0.5::DOUBLE * pow(0.5::DOUBLE, abs(t)) / 1.5::DOUBLE"


def _line(name: str, source: str, axis: str, kernel: str) -> str:
    """CTE: the source image (y, x, v) filtered along an axis."""
    y, x = ("greatest(0, least((SELECT max(y) FROM px), o.y + t))", "o.x") if axis == "y" else ("o.y", "greatest(0, least(24, o.x + t))")
    return f"{name} AS (SELECT o.y, o.x, sum(i.v * {kernel}) AS v FROM {source} o JOIN range(-60, 61) r(t) ON TRUE JOIN {source} i ON i.y = {y} AND i.x = {x} GROUP BY 1, 2)"


def _difference(name: str, source: str, axis: str) -> str:
    """CTE: second differences along an axis; the borders repeat."""
    other = {"y": "x", "x": "y"}[axis]
    window = f"OVER (PARTITION BY {other} ORDER BY {axis})"
    return f"{name} AS (SELECT y, x, coalesce(lead(v) {window}, v) - 2 * v + coalesce(lag(v) {window}, v) AS v FROM {source})"


def deriche(mode: str) -> str:
    base = f"WITH {PX}, f AS (SELECT y, x, g AS v FROM px), "
    parts = [_line("sx", "f", "x", _SMOOTH), _line("sy", "f", "y", _SMOOTH)]
    if mode == "smooth":
        parts, value, source = [parts[1], _line("b", "sy", "x", _SMOOTH)], "b.v", "b"
    elif mode in ("laplacian", "sharpen"):
        parts += [_difference("lx", "sx", "x"), _difference("ly", "sy", "y")]
        value, source = ("lx.v + ly.v" if mode == "laplacian" else "f.v - (lx.v + ly.v)"), "f JOIN lx USING (y, x) JOIN ly USING (y, x)"
    else:
        parts += [_line("dx", "sy", "x", _DERIVE), _line("dy", "sx", "y", _DERIVE)]
        value = {"modulus": "sqrt(dx.v * dx.v + dy.v * dy.v)", "direction": "CASE WHEN abs(dx.v) < 1e-20 THEN pi() / 2 ELSE atan(dy.v / dx.v) END", "dx": "abs(dx.v)", "dy": "abs(dy.v)"}[mode]
        source = "dx JOIN dy USING (y, x)"
    return f"{base}{', '.join(parts)} SELECT CAST(0 AS BIGINT) AS image_id, y, x, round({value}, 9) AS v FROM {source}"


def _slope(axis: str) -> str:
    window = f"OVER (PARTITION BY {'x' if axis == 'y' else 'y'} ORDER BY {axis})"
    return f"(coalesce(lead(v) {window}, v) - coalesce(lag(v) {window}, v)) / CASE WHEN lead(v) {window} IS NULL OR lag(v) {window} IS NULL THEN 1 ELSE 2 END"


SHEN_CASTAN = f"WITH {PX}, f AS (SELECT y, x, g AS v FROM px), {_line('a', 'f', 'y', _EXPONENTIAL)}, {_line('b', 'a', 'x', _EXPONENTIAL)}, g AS (SELECT y, x, {_slope('y')} AS dy, {_slope('x')} AS dx FROM b) SELECT CAST(0 AS BIGINT) AS image_id, y, x, round(sqrt(dx * dx + dy * dy), 9) AS v FROM g"


#: Slices of five rows of the scalar image.
_VOXELS = f"{PX}, vx AS (SELECT image_id, y // 5 AS z, y % 5 AS y, x, p, g FROM px)"


def _beside(connex: int) -> str:
    return f"greatest(abs(a.z - b.z), abs(a.y - b.y), abs(a.x - b.x)) = 1 AND abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) <= {dict(((6, 1), (18, 2), (26, 3)))[connex]}"


def volume_labels(connex: int, least: float) -> str:
    return f"""WITH RECURSIVE {_VOXELS}, bright AS (SELECT * FROM vx WHERE g >= {least}), near AS (SELECT a.p AS a, b.p AS b FROM bright a JOIN bright b ON {_beside(connex)}),
reach(a, b) AS (SELECT p, p FROM bright UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b)
SELECT image_id, z, y, x, label FROM bright JOIN (SELECT a AS p, min(b) AS label FROM reach GROUP BY a) l USING (p)"""


def volume_extrema(connex: int, kind: str) -> str:
    return f"""WITH RECURSIVE {_VOXELS}, lev AS (SELECT *, CAST(floor(round(g, 9) * 64) AS BIGINT) AS q FROM vx), near AS (SELECT a.p AS a, b.p AS b, a.q AS qa, b.q AS qb FROM lev a JOIN lev b ON {_beside(connex)}),
reach(a, b) AS (SELECT p, p FROM lev UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b AND qa = qb), flat AS (SELECT a AS p, min(b) AS label FROM reach GROUP BY a),
lost AS (SELECT DISTINCT label FROM flat JOIN near ON near.a = flat.p WHERE {"qb < qa" if kind == "minima" else "qb > qa"})
SELECT image_id, z, y, x, label FROM lev JOIN flat USING (p) WHERE label NOT IN (SELECT label FROM lost)"""


def volume_tree(connex: int) -> str:
    """Voxels b that a reaches over voxels of at least a's value; the last of a's value among them names the component."""
    return f"""WITH RECURSIVE {_VOXELS}, lev AS (SELECT *, CAST(floor(round(g, 9) * 64) AS BIGINT) AS v FROM vx), step AS (SELECT a.p AS a, b.p AS b, b.v FROM lev a JOIN lev b ON {_beside(connex)}),
reach(a, v, b) AS (SELECT p, v, p FROM lev UNION SELECT reach.a, reach.v, step.b FROM reach JOIN step ON step.a = reach.b AND step.v >= reach.v),
canon AS (SELECT reach.a AS p, reach.v, max(b) FILTER (lev.v = reach.v) AS c, count(*) AS area, sum(lev.v) AS total FROM reach JOIN lev ON lev.p = reach.b GROUP BY ALL),
around_it AS (SELECT x.p, arg_max(o.c, o.v) AS parent, max(o.v) AS pv FROM canon x JOIN reach ON reach.b = x.p JOIN canon o ON o.p = reach.a WHERE o.v < x.v GROUP BY x.p)
SELECT CAST(0 AS BIGINT) AS image_id, p AS pixel, CASE WHEN p = c THEN coalesce(parent, c) ELSE c END AS parent, CAST(CASE WHEN p = c THEN area ELSE 1 END AS BIGINT) AS area, CAST(CASE WHEN p = c THEN total - area * coalesce(pv, v) ELSE 0 END AS DOUBLE) AS volume FROM canon LEFT JOIN around_it USING (p)"""


#: Labels as nodes: capacities to the terminals are counts of bright and dark pixels, those between labels a 24th of their shared borders.
_NETWORK = f"""{PX}, ends AS (SELECT label AS node, count(*) FILTER (g >= 0.5) AS s, count(*) FILTER (g < 0.5) AS t FROM px GROUP BY label),
lines AS (SELECT least(a.label, b.label) AS u, greatest(a.label, b.label) AS v, count(*) // 24 AS cap FROM px a JOIN px b ON (b.y = a.y AND b.x = a.x + 1) OR (b.y = a.y + 1 AND b.x = a.x) WHERE a.label <> b.label GROUP BY 1, 2)"""


def _least_cut(ends: str, lines: str, end: str) -> str:
    """CTE best(m, cost): the cheapest of all sets of nodes on the source's side, as bits; of equals the smallest."""
    return f"""best{end} AS (SELECT m, cost FROM (SELECT m, (SELECT sum(CASE WHEN (m >> node) & 1 = 1 THEN t ELSE s END) FROM {ends}) + (SELECT coalesce(sum(cap), 0) FROM {lines} WHERE (m >> u) & 1 <> (m >> v) & 1) AS cost
FROM range(1 << (SELECT max(node) + 1 FROM ends)) r(m) WHERE NOT EXISTS (FROM range((SELECT max(node) + 1 FROM ends)) q(i) WHERE (m >> i) & 1 = 1 AND i NOT IN (SELECT node FROM ends))) ORDER BY cost, bit_count(m) LIMIT 1)"""


MAX_FLOW = f"""WITH {_NETWORK}, {_least_cut("ends", "lines", "")} SELECT CAST(0 AS BIGINT) AS graph_id, node, (m >> node) & 1 = 1 AS at_source, CAST(cost AS DOUBLE) AS flow, FALSE AS changed FROM ends, best"""
#: The same after every third node has swapped its terminals and every fourth arc has gone.
MAX_FLOW_CHANGED = f"""WITH {_NETWORK}, ends2 AS (SELECT node, CASE WHEN node % 3 = 1 THEN t ELSE s END AS s, CASE WHEN node % 3 = 1 THEN s ELSE t END AS t FROM ends), lines2 AS (SELECT u, v, CASE WHEN (u + v) % 4 = 0 THEN 0 ELSE cap END AS cap FROM lines),
{_least_cut("ends", "lines", "")}, {_least_cut("ends2", "lines2", "2")} SELECT CAST(0 AS BIGINT) AS graph_id, node, (best2.m >> node) & 1 = 1 AS at_source, CAST(best2.cost AS DOUBLE) AS flow, (best2.m >> node) & 1 <> (best.m >> node) & 1 AS changed FROM ends, best, best2"""

_LISTED = "SELECT CAST(0 AS BIGINT) AS image_id, part.id, part.surface, coalesce((SELECT string_agg(CAST(t.b AS VARCHAR), ',' ORDER BY t.b) FROM touch t JOIN part o ON o.id = t.b WHERE t.a = part.id), '') AS neighbors FROM part"
COMPONENTS_NEIGHBORS = f"""WITH RECURSIVE {labels(2, 'w < 1.35')}, seg AS (SELECT y, x, lab.label AS id FROM px JOIN lab USING (p)), part AS (SELECT id, count(*) AS surface FROM seg GROUP BY id HAVING count(*) >= 3),
touch AS (SELECT DISTINCT a.id AS a, b.id AS b FROM seg a JOIN seg b ON abs(a.y - b.y) + abs(a.x - b.x) = 1 AND a.id <> b.id) {_LISTED}"""
TREE_COMPONENTS_NEIGHBORS = f"""WITH RECURSIVE {_TREE}, part AS (SELECT CAST((SELECT n FROM num) + k AS BIGINT) AS id, count(*) AS surface FROM side GROUP BY k HAVING count(*) >= 2),
up AS (SELECT CAST(node + 1 AS BIGINT) AS a, CAST(father + 1 AS BIGINT) AS b FROM tree WHERE father >= 0), touch AS (SELECT a, b FROM up UNION SELECT b, a FROM up) {_LISTED}"""
