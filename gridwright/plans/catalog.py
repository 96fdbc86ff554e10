"""Registry of the queries over the driver's tables, and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.operators import cuts, distributed, graph, large_trees, malis, morphology, regions, segment, tree, volumes
from gridwright.plans import demo, sequential, sql
from gridwright.sources import tables
from gridwright.sources.tables import WIDTH

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None, **rounded: int):
    """Registers a query; its columns named in `rounded` are rounded to so many places."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(c, n) for c, n in rounded.items()}) if rounded else df

        QUERIES[name] = run
        if oracle:
            ORACLE_SQL[name] = oracle
        return run

    return register


def _graph(spark: SparkSession, sf_dir: str, connex: int = 4, metric: str = "euclid") -> DataFrame:
    return graph.graph(tables.embedding_pixels(spark, sf_dir), connex, metric, WIDTH)


def _scalar_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph(tables.scalar_pixels(spark, sf_dir), 4, "euclid", WIDTH)


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.merge_tree(_scalar_graph(spark, sf_dir), tables.scalar_map(spark, sf_dir), WIDTH)


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge tree with a weight for every node, all different, large at the top and small below, so that cuts run through the tree."""
    t = _tree(spark, sf_dir)
    n = t.where("is_leaf").groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    mixed = F.col("node") * 7919 % 10007
    weight = F.when(10 * F.col("node") >= 18 * F.col("n"), (10007 + mixed) / 20014).otherwise((1 + mixed) / (20014 * F.col("n")))
    return tree.weight_tree(t, t.join(n, "image_id").select("image_id", (F.col("node") + 1).alias("node"), weight.alias("weight")))


for _name, _connex, _metric, _weight in (("graph_euclid4", 4, "euclid", sql.EUCLID), ("graph_max4", 4, "max", sql.MAXIMUM), ("graph_angle4", 4, "angle", sql.ANGLE), ("graph_euclid8", 8, "euclid", sql.EUCLID)):
    query(_name, sql.graph(_weight, _connex // 2), w=6)(lambda s, d, c=_connex, m=_metric: _graph(s, d, c, m))
for _connex in (4, 8):
    query(f"gradient{_connex}", sql.gradient(_connex // 2), v=6)(lambda s, d, c=_connex: graph.gradient(_graph(s, d, c), WIDTH, tables.label_segm(s, d)))
    query(f"connected_components{_connex}", sql.components_of(_connex // 2, "w < 1.35"))(lambda s, d, c=_connex: segment.connected_components(_graph(s, d, c), tables.label_segm(s, d), WIDTH, 1.35))


@query("graph_events", sql.EVENTS, w=4)
def graph_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = tables.event_raster(spark, sf_dir)
    return graph.graph(pixels, 4).select("plane", "y", "x", "w")


@query("mat2graph", sql.MAT2GRAPH, w=6)
def mat2graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = tables.scalar_map(spark, sf_dir)
    return graph.mat2graph(image, (image.agg(F.max("y")).first()[0] or 0) // 2, (WIDTH - 1) // 2)


@query("khalimsky", sql.KHALIMSKY, v=6)
def khalimsky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.khalimsky(_graph(spark, sf_dir), tables.label_segm(spark, sf_dir))


@query("connected_components_rounds", sql.components_of(2, "w < 1.35"))
def connected_components_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.connected_components(_graph(spark, sf_dir), tables.label_segm(spark, sf_dir), WIDTH, 1.35, per_image=False)


@query("components", sql.COMPONENTS, centroid_x=6, centroid_y=6)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.components(segment.connected_components(_graph(spark, sf_dir), tables.label_segm(spark, sf_dir), WIDTH, 1.35))


def _listed(df: DataFrame) -> DataFrame:
    return df.select("image_id", "id", "surface", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


@query("components_neighbors", sql.COMPONENTS_NEIGHBORS)
def components_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    segm = segment.connected_components(_graph(spark, sf_dir), tables.label_segm(spark, sf_dir), WIDTH, 1.35)
    return _listed(regions.with_neighbours(regions.components(segm, 3), regions.adjacency(segm)))


@query("tree_components_neighbors", sql.TREE_COMPONENTS_NEIGHBORS)
def tree_components_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tree(spark, sf_dir)
    return _listed(regions.with_neighbours(tree.components(t, WIDTH).where("surface >= 2"), tree.adjacency(t)))


@query("components_patch", sql.PATCHES, f0=6)
def components_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    segm = segment.connected_components(_graph(spark, sf_dir), tables.label_segm(spark, sf_dir), WIDTH, 1.35)
    return regions.patches(tables.embedding_pixels(spark, sf_dir), segm, "bbox", 3).select("image_id", "id", "y", "x", F.col("f")[0].cast("double").alias("f0"), "inside")


@query("segment_constant", sql.components_of(2, "w <= 1.38"))
def segment_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment(_graph(spark, sf_dir), tables.label_segm(spark, sf_dir), WIDTH, 1.38, 1, adaptive=False)


@query("segment_adaptive", sequential.segment(sql.EUCLID, "label"))
def segment_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment(_graph(spark, sf_dir), tables.label_segm(spark, sf_dir), WIDTH, 3, 20)


@query("segment_sparse")
def segment_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment_sparse(tables.order_graph(spark, sf_dir), 0.2, 5)


query("watershed", v=6)(lambda s, d: segment.watershed(tables.scalar_map(s, d), 0.05, 4))
query("watershed_thin", sequential.WATERSHED, v=6)(lambda s, d: segment.watershed(tables.scalar_map(s, d), 0.05, 4, topological=False))


@query("watershed_minima", sequential.WATERSHED_MINIMA, v=6)
def watershed_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What no order of flooding changes: the minimum and the number of each basin."""
    return segment.watershed(tables.scalar_map(spark, sf_dir), 0.05, 4).where("basin > 0").groupBy("image_id", "basin", "n_minima").agg(F.min("v").alias("v"), F.max("v").alias("highest")).where("v = highest").drop("highest")


@query("mst_edges", sql.MST)
def mst_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boruvka over the levels; the number of an edge breaks ties as the merge tree does."""
    q = F.floor(F.least(F.greatest(F.round("w", 9) * 255, F.lit(0)), F.lit(255))).cast("int")
    edges = _scalar_graph(spark, sf_dir).select(F.shiftleft(F.col("plane").cast("long"), 40).bitwiseOR(F.col("src")).alias("e"), F.col("src").alias("u"), F.col("dst").alias("v"), q.alias("w"))
    return distributed.spanning_forest(edges).select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("w").alias("q"))


@query("merge_tree", sql.MERGE_TREE)
def merge_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).drop("sons", "weight")


@query("merge_tree_blocks", sql.MERGE_TREE)
def merge_tree_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tree as images of any size get it: a distributed forest, merged in blocks."""
    t = large_trees.merge_tree(_scalar_graph(spark, sf_dir), tables.scalar_map(spark, sf_dir), WIDTH, 700)
    return t.drop("sons", "weight").withColumns({c: F.col(c).cast("int") for c in ("node", "father")})


@query("hierarchy_arb", sql.MERGE_TREE)
def hierarchy_arb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tree from levels that are computed beforehand."""
    levels = _scalar_graph(spark, sf_dir).withColumn("w", F.floor(F.least(F.greatest(F.round("w", 9) * 255, F.lit(0)), F.lit(255))).cast("double"))
    return tree.hierarchy_arb(levels, tables.scalar_map(spark, sf_dir), WIDTH).drop("sons", "weight")


@query("hierarchy_scale", sql.HIERARCHY_SCALE)
def hierarchy_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = _scalar_graph(spark, sf_dir).withColumn("w", F.col("w") * 255)
    return tree.hierarchy_scale(levels, tables.scalar_map(spark, sf_dir), WIDTH).drop("sons", "weight")


query("tree_levels", sql.TREE_LEVELS)(lambda s, d: tree.levels(_tree(s, d)))
query("tree_adjacency", sql.TREE_ADJACENCY)(lambda s, d: tree.adjacency(_tree(s, d)))
query("tree_components", sql.TREE_COMPONENTS, centroid_x=6, centroid_y=6)(lambda s, d: tree.components(_tree(s, d), WIDTH))
query("tree_masks", sql.TREE_MASKS)(lambda s, d: tree.masks(_tree(s, d)))
query("tree_dump", sql.TREE_DUMP)(lambda s, d: tree.dump(_tree(s, d)))
query("tree_text", sql.TREE_TEXT)(lambda s, d: tree.text(_tree(s, d)))
query("tree_graphviz", sql.TREE_GRAPHVIZ)(lambda s, d: tree.graphviz(_tree(s, d)))
query("tree_bands", sql.tree_bands((4, 8, 16, 24, 40), 3))(lambda s, d: tree.flatten(_tree(s, d), (4, 8, 16, 24, 40), 3))
query("label_at_level", sql.LABEL_AT_LEVEL)(lambda s, d: tree.label_at_level(_tree(s, d), 20))
query("saliency", sql.SALIENCY, w=6)(lambda s, d: tree.saliency(_tree(s, d), _scalar_graph(s, d)))
query("filter_surface", sql.FILTER_SURFACE, attr_altitude=6)(lambda s, d: tree.filter_tree(_tree(s, d), "surface").select("image_id", "node", "altitude", "attr_altitude"))
for _mode in ("volume", "dynamic", "alphaomega"):
    query(f"filter_{_mode}", sql.filter_tree(_mode), attr_altitude=6)(lambda s, d, m=_mode: tree.filter_tree(_tree(s, d), m).drop("sons", "weight"))


@query("tree_weights", sql.TREE_WEIGHTS, weight=6)
def tree_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tree(spark, sf_dir)
    some = t.where("node % 3 <> 2").select("image_id", (F.col("node") + 1).alias("node"), ((F.col("node") + 1) * 37 % 101 / 101).alias("weight"))
    return tree.weight_tree(t, some).select("image_id", "node", "weight")


for _key, _mode, _sql in (("cut_kruskal", "Kruskal", sql.CUT_FOREST), ("cut_prim", "Prim", sql.CUT_FOREST), ("cut_power_watershed", "PWatershed", sql.CUT_FOREST), ("cut_graph", "Graphcuts", sequential.CUT_MINIMUM)):
    query(_key, _sql)(lambda s, d, m=_mode: cuts.cut_tree(_weighted(s, d), m))
query("min_cover", sql.MIN_COVER)(lambda s, d: cuts.cut_tree(_weighted(s, d), "MinCover"))


def _network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels as nodes: capacities to the terminals are counts of bright and dark pixels, those between labels a 24th of their shared borders."""
    pixels = tables.scalar_map(spark, sf_dir).join(tables.label_segm(spark, sf_dir), regions.PLACE).select("y", "x", "v", "label")
    graph_id = F.lit(0).cast("long").alias("graph_id")
    ends = pixels.groupBy(F.col("label").alias("node")).agg(F.count(F.when(F.col("v") >= 0.5, 1)).alias("cap_source"), F.count(F.when(F.col("v") < 0.5, 1)).alias("cap_sink")).select(graph_id, "*")
    moved = pixels.withColumn("o", F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, 0))])))
    near = moved.select((F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.col("label").alias("other")).join(pixels, ["y", "x"]).where("label <> other")
    lines = near.groupBy(graph_id, F.least("label", "other").alias("src"), F.greatest("label", "other").alias("dst")).agg(F.floor(F.count(F.lit(1)) / 24).alias("cap"))
    return ends, lines.withColumn("rev_cap", F.col("cap"))


query("max_flow", sql.MAX_FLOW)(lambda s, d: cuts.max_flow(*_network(s, d)))


@query("max_flow_changed", sql.MAX_FLOW_CHANGED)
def max_flow_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow after every third node has swapped its terminals and every fourth arc has gone, from the flow before."""
    ends, lines = _network(spark, sf_dir)
    swapped = ends.where("node % 3 = 1").select("graph_id", "node", F.col("cap_sink").alias("cap_source"), F.col("cap_source").alias("cap_sink"))
    gone = lines.where("(src + dst) % 4 = 0").select("graph_id", "src", "dst", F.lit(0).alias("cap"), F.lit(0).alias("rev_cap"))
    return cuts.max_flow(ends, lines, swapped, gone)


def _pooled(spark: SparkSession, sf_dir: str, histmax: bool, confidence: float) -> DataFrame:
    pooled, _ = regions.hist_pooling(tables.embedding_pixels(spark, sf_dir), tables.label_segm(spark, sf_dir), histmax, confidence)
    return pooled.select("image_id", "y", "x", F.posexplode("f").alias("ch", "v")).withColumn("ch", (F.col("ch") + 1).cast("long"))


query("hist_pooling", sql.pooling(False, 0), v=6)(lambda s, d: _pooled(s, d, False, 0))
query("hist_pooling_max", sql.pooling(True, 0), v=6)(lambda s, d: _pooled(s, d, True, 0))
query("hist_pooling_conf", sql.pooling(False, 0.03), v=6)(lambda s, d: _pooled(s, d, False, 0.03))
query("segm_adjacency", sql.ADJACENCY)(lambda s, d: regions.adjacency(tables.label_segm(s, d)))
query("segm_adjacency_list", sql.ADJACENCY_LISTS)(lambda s, d: regions.adjacency_lists(regions.adjacency(tables.label_segm(s, d))).withColumn("neighbors", F.array_join(F.array_sort(F.col("neighbors").cast("array<string>")), ",")))


@query("overlap", sql.OVERLAP, ratio=6)
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    bright = tables.scalar_map(spark, sf_dir).withColumn("v", (F.col("v") >= 0.5).cast("double"))
    return regions.overlap(bright, tables.label_segm(spark, sf_dir), 11)


@query("decision_fusion", sql.DECISION)
def decision_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals are pairs of neighbouring labels; scores are means of the channels."""
    rows = tables.embedding_pixels(spark, sf_dir).join(tables.label_segm(spark, sf_dir), regions.PLACE)
    rows = rows.withColumn("seg", F.explode(F.array("label", (F.col("label") + 9) % 10)))
    scores = rows.select("image_id", "seg", F.posexplode("f").alias("class", "v")).groupBy("image_id", "seg", "class").agg(F.abs(F.avg(F.col("v").cast("double"))).alias("f"))
    return regions.decision(rows.select("image_id", "seg", "y", "x"), scores, tables.label_segm(spark, sf_dir), 0.3, 0.01)


@query("colorize_map", sql.COLORIZE)
def colorize_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    segm = tables.label_segm(spark, sf_dir)
    colours = segm.select(F.col("label").alias("id")).distinct().select("id", F.array(F.col("id") / 10, 1 - F.col("id") / 10, F.lit(0.5)).alias("color"))
    return regions.colorize(segm, colours).select("image_id", "y", "x", *[F.col("color")[i].alias(c) for i, c in enumerate("rgb")])


def _rgb(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.col("color")[i].alias(c) for i, c in enumerate("rgb")])


query("colorize_hash", sql.COLORIZE_HASH)(lambda s, d: _rgb(regions.colorize(tables.label_segm(s, d)), "image_id", "y", "x"))
query("colorize_drawn", sql.COLORIZE_DRAWN)(lambda s, d: _rgb(regions.drawn_colormap(tables.label_segm(s, d)), "id"))


@query("colormap", sql.COLORMAP)
def colormap(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = tables.label_segm(spark, sf_dir).where("label % 3 = 0").select(F.col("label").alias("id")).distinct()
    out = regions.colormap(some.select("id", F.array(F.col("id") / 10, F.lit(0.5)).alias("color")), 0.25)
    return out.select("id", F.col("color")[0].alias("r"), F.col("color")[1].alias("g"))


def _malis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return malis.malis(_scalar_graph(spark, sf_dir), tables.label_segm(spark, sf_dir), WIDTH, "min", 0.1, 0.05)


query("malis_loss", sql.MALIS_LOSS, value=6)(lambda s, d: malis.metric(_malis(s, d), "loss"))
query("malis_gradient", sql.MALIS_GRADIENT, gradient=9)(lambda s, d: _malis(s, d).select("image_id", "plane", "y", "x", "gradient"))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scalar_map(spark, sf_dir).withColumn("v", F.floor(F.round("v", 9) * 255).cast("long"))


for _mode in ("modulus", "direction", "laplacian", "sharpen", "smooth", "dx", "dy"):
    query(f"deriche_{_mode}", sql.deriche(_mode), v=9)(lambda s, d, m=_mode: morphology.deriche(tables.scalar_map(s, d), 1.0, m, width=WIDTH))
query("shen_castan", sql.SHEN_CASTAN, v=9)(lambda s, d: morphology.shen_castan(tables.scalar_map(s, d), 0.5, WIDTH))
query("h_minima", sequential.filled(1))(lambda s, d: morphology.h_minima(_levels(s, d), 12))
query("h_maxima", sequential.filled(-1))(lambda s, d: morphology.h_maxima(_levels(s, d), 12))
query("regional_minima", sequential.extrema(1))(lambda s, d: morphology.extrema(_levels(s, d), "minima"))
query("regional_maxima", sequential.extrema(-1))(lambda s, d: morphology.extrema(_levels(s, d), "maxima"))
query("component_tree", sequential.COMPONENT_TREE)(lambda s, d: morphology.component_tree(_levels(s, d)))
query("height_segments", sequential.HEIGHT_SEGMENTS)(lambda s, d: morphology.height_segments(_levels(s, d), 12))
query("height_segments_grown", sequential.HEIGHT_SEGMENTS_GROWN)(lambda s, d: morphology.height_segments(_levels(s, d), 12, grown=True))
query("height_opening", sequential.HEIGHT_OPENING)(lambda s, d: morphology.height_opening(_levels(s, d), 12))
query("strongest_maxima", sequential.STRONGEST)(lambda s, d: morphology.strongest(_levels(s, d), 10))
query("binary_labels", sql.BINARY_LABELS)(lambda s, d: morphology.binary_labels(tables.scalar_map(s, d).withColumn("v", (F.col("v") >= 0.5).cast("int")), WIDTH))


def _bright_volume(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    return tables.scalar_volume(spark, sf_dir).withColumn("v", (F.col("v") >= least).cast("int"))


for _connex, _least in ((6, 0.55), (18, 0.6), (26, 0.6)):
    query(f"volume_labels{_connex}", sql.volume_labels(_connex, _least))(lambda s, d, c=_connex, m=_least: volumes.labels(_bright_volume(s, d, m), c))
for _connex in (6, 26):
    query(f"volume_tree{_connex}", sql.volume_tree(_connex))(lambda s, d, c=_connex: morphology.volume_tree(tables.scalar_volume(s, d).withColumn("v", F.floor(F.round("v", 9) * 64).cast("long")), c))
for _connex, _kind in ((6, "minima"), (18, "maxima"), (26, "minima")):
    query(f"volume_{_kind}{_connex}", sql.volume_extrema(_connex, _kind))(
        lambda s, d, c=_connex, k=_kind: volumes.extrema(tables.scalar_volume(s, d).withColumn("v", F.floor(F.round("v", 9) * 64).cast("long")), k, c)
    )


@query("connected_overlap", sql.CONNECTED_OVERLAP, iou=6)
def connected_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    segm = segment.connected_components(_graph(spark, sf_dir), tables.label_segm(spark, sf_dir), WIDTH, 1.35)
    return regions.flooded_overlap(segm, tables.label_segm(spark, sf_dir), WIDTH)


query("demo_products", sequential.DEMO)(lambda s, d: demo.counts(tables.scalar_pixels(s, d), WIDTH))
