"""Queries over the given relational tables, each with the SQL that must give the same rows.

The tables play these parts: customers are cells (one quadrilateral each on a lattice that grows
with the table), orders are bins or cells of serial sections, line items are the entries of the
sparse matrix and the pixels of the raster, parts are genes, and nations, regions and labels are
metadata. Every part grows with its table at constant density.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceweave.functions import geometry as G
from sliceweave.functions.scalar import MICRON_PER_PIXEL, PIXEL_PER_MICRON
from sliceweave.operators import assemble as AS
from sliceweave.operators import chains as CH
from sliceweave.operators import components as CO
from sliceweave.operators import matching as MT
from sliceweave.operators import matrix as MX
from sliceweave.operators import merge as M
from sliceweave.operators import neighbourhood as NB
from sliceweave.operators import overlay as OV
from sliceweave.operators import raster as RA
from sliceweave.operators import rings as R
from sliceweave.operators import spatial_join as SJ
from sliceweave.operators import tiles as TI
from sliceweave.operators import tps as TP
from sliceweave.plans import bins_to_cells as B2C
from sliceweave.plans import segmentation as SG
from sliceweave.session import materialize, step_path
from sliceweave.sources import bundles as BU
from sliceweave.sources import coordinate_text as CT
from sliceweave.sources import features as FE
from sliceweave.sources import tables as TA

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --------------------------------------------------------------------------- the parts

_K = "c_custkey"
_CX, _CY = f"(({_K} % 100) * 10 + 5)", f"(floor({_K} / 100) * 10 + 5)"
_A, _B = f"({_K} % 4)", f"({_K} % 3)"
# corner offsets of the cell of customer k, counter-clockwise
_CORNERS = [
    (f"{_CX} - 3 - {_A}", f"{_CY} - 2"),
    (f"{_CX} + 4", f"{_CY} - 3 - {_B}"),
    (f"{_CX} + 3 + {_A}", f"{_CY} + 3"),
    (f"{_CX} - 2", f"{_CY} + 4 + {_B}"),
]


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    """Vertex table: four vertices per customer."""
    corners = ", ".join(
        f"struct({i} as i, cast({x} as double) as x, cast({y} as double) as y)" for i, (x, y) in enumerate(_CORNERS)
    )
    spread = table(spark, sf, "customer").select("c_custkey", F.expr(f"explode(array({corners})) as c"))
    return spread.select(
        F.col("c_custkey").alias("cell_id"),
        (F.col("c_custkey") * 4 + F.col("c.i")).alias("ordinal"),
        F.col("c.x").alias("vertex_x"),
        F.col("c.y").alias("vertex_y"),
    )


SQL_EDGES = "vert AS (" + " UNION ALL ".join(
    f"SELECT c_custkey AS cell_id, {i} AS i, CAST({x} AS DOUBLE) AS vx, CAST({y} AS DOUBLE) AS vy FROM customer"
    for i, (x, y) in enumerate(_CORNERS)
) + """),
edge AS (SELECT a.cell_id, a.i, a.vx AS x1, a.vy AS y1, b.vx AS x2, b.vy AS y2
         FROM vert a JOIN vert b ON a.cell_id = b.cell_id AND b.i = (a.i + 1) % 4),
box AS (SELECT cell_id, min(vx) AS xmin, min(vy) AS ymin, max(vx) AS xmax, max(vy) AS ymax FROM vert GROUP BY 1)"""


def bins(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("bin_id"),
        F.expr("o_totalprice % 1000.0D").alias("x"),
        F.expr("cast(floor(o_custkey / 100) * 10 as double) + (o_orderkey % 40) * 0.25D").alias("y"),
    )


SQL_BINS = """bins AS (SELECT o_orderkey AS bin_id, o_totalprice % 1000.0::DOUBLE AS x,
  CAST(floor(o_custkey / 100) * 10 AS DOUBLE) + (o_orderkey % 40) * 0.25::DOUBLE AS y FROM orders)"""


def sql_hits(points: str = "bins", point_id: str = "bin_id", scale: str = "1.0::DOUBLE") -> str:
    """Brute-force strict point-in-polygon over all edges: odd crossings and on no edge."""
    return f"""sp AS (SELECT {point_id} AS pid, x * {scale} AS px, y * {scale} AS py FROM {points}),
se AS (SELECT cell_id, x1 * {scale} AS x1, y1 * {scale} AS y1, x2 * {scale} AS x2, y2 * {scale} AS y2 FROM edge),
sb AS (SELECT cell_id, xmin * {scale} AS xmin, ymin * {scale} AS ymin, xmax * {scale} AS xmax, ymax * {scale} AS ymax FROM box),
cand AS (SELECT pid, px, py, cell_id FROM sp JOIN sb ON px >= xmin AND px <= xmax AND py >= ymin AND py <= ymax),
test AS (SELECT pid, c.cell_id, (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) AS cr, px, py, x1, y1, x2, y2
         FROM cand c JOIN se USING (cell_id)),
hits AS (SELECT pid AS {point_id}, cell_id FROM test GROUP BY 1, 2
  HAVING sum(CASE WHEN (y1 <= py AND y2 > py AND cr > 0) OR (y1 > py AND y2 <= py AND cr < 0) THEN 1 ELSE 0 END) % 2 = 1
     AND sum(CASE WHEN cr = 0 AND px BETWEEN least(x1, x2) AND greatest(x1, x2)
                   AND py BETWEEN least(y1, y2) AND greatest(y1, y2) THEN 1 ELSE 0 END) = 0)"""


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse matrix entries: order x part -> quantity."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("bin_id"), F.col("l_partkey").alias("gene"), F.col("l_quantity").alias("value")
    )


def genes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("gene"), F.col("p_name").alias("symbol"))


def order_matrix(spark: SparkSession, sf: str) -> MX.Matrix:
    """Order-by-part matrix; repeated entries are summed first."""
    x = entries(spark, sf).groupBy("bin_id", "gene").agg(F.sum("value").alias("value"))
    obs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("bin_id"), "o_orderstatus")
    return MX.Matrix(obs, genes(spark, sf), x, "bin_id", "gene")


def polygons(spark: SparkSession, sf: str) -> DataFrame:
    return R.polygons_from_vertices(vertices(spark, sf)).drop("first_ordinal")


# ------------------------------------------------------------------- keyed tables


@query("scale_points", f"""
SELECT p_partkey, CAST(p_size AS DOUBLE) * {PIXEL_PER_MICRON!r}::DOUBLE AS px,
       p_retailprice * {PIXEL_PER_MICRON!r}::DOUBLE AS py FROM part""")
def scale_points(spark, sf):
    k = F.lit(PIXEL_PER_MICRON)
    return table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size").cast("double") * k).alias("px"), (F.col("p_retailprice") * k).alias("py")
    )


@query("marker_points", """
SELECT l_orderkey, l_linenumber, l_tax * (1.0::DOUBLE / (0.2125::DOUBLE * 4)) AS "axis-1",
       l_extendedprice * (1.0::DOUBLE / (0.2125::DOUBLE * 4)) AS "axis-0"
FROM lineitem WHERE l_returnflag IN ('R', 'N')""")
def marker_points(spark, sf):
    from sliceweave.operators.transcripts import marker_points as marker

    src = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("feature_name"),
        F.col("l_extendedprice").alias("x_location"), F.col("l_tax").alias("y_location"),
    )
    return marker(src, ["R", "N"], level=2, carry=["l_orderkey", "l_linenumber"])


@query("merge_left_single", """
SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey""")
def merge_left_single(spark, sf):
    features = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    metadata = table(spark, sf, "nation").filter("n_regionkey <> 2")
    return M.add_property(features, metadata, ["cell_id", "c_nationkey"], "n_nationkey", ["n_name"])


@query("merge_left_composite_fill_all", """
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, l_shipmode_x AS kind,
  coalesce(CAST(k AS VARCHAR), 'Unassigned') AS k, coalesce(CAST(n AS VARCHAR), 'Unassigned') AS n,
  coalesce(seen, 'Unassigned') AS seen
FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS l_shipmode_x FROM lineitem)
LEFT JOIN (SELECT l_orderkey AS k, l_linenumber AS n, min(l_linestatus) AS seen FROM lineitem
           WHERE l_returnflag = 'R' GROUP BY 1, 2) ON l_orderkey = k AND l_linenumber = n""")
def merge_left_composite_fill_all(spark, sf):
    items = table(spark, sf, "lineitem")
    left = items.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("kind"))
    right = items.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    right = right.agg(F.min("l_linestatus").alias("seen"))
    return M.merge(left, right, ["l_orderkey", "l_linenumber"], ["k", "n"], "left", fill="all", na="Unassigned")


def _composite_sql(how: str) -> str:
    return f"""SELECT coalesce(CAST(l_orderkey AS VARCHAR), 'Unassigned') AS l_orderkey, coalesce(CAST(l_linenumber AS VARCHAR), 'Unassigned') AS l_linenumber, coalesce(kind, 'Unassigned') AS kind,
  coalesce(CAST(k AS VARCHAR), 'Unassigned') AS k, coalesce(CAST(n AS VARCHAR), 'Unassigned') AS n, coalesce(seen, 'Unassigned') AS seen
FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS kind FROM lineitem) {how} JOIN
  (SELECT l_orderkey AS k, l_linenumber + 1 AS n, min(l_linestatus) AS seen FROM lineitem GROUP BY 1, 2) ON l_orderkey = k AND l_linenumber = n"""


def _composite(spark, sf, how: str) -> DataFrame:
    """Every line item with the line before it of the same order."""
    items = table(spark, sf, "lineitem")
    left = items.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("kind"))
    right = items.groupBy(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") + 1).alias("n")).agg(F.min("l_linestatus").alias("seen"))
    return M.merge(left, right, ["l_orderkey", "l_linenumber"], ["k", "n"], how, fill="all", na="Unassigned")


@query("merge_inner_composite", _composite_sql("INNER"))
def merge_inner_composite(spark, sf):
    return _composite(spark, sf, "inner")


@query("merge_right_composite", _composite_sql("RIGHT"))
def merge_right_composite(spark, sf):
    return _composite(spark, sf, "right")


@query("merge_outer_composite", _composite_sql("FULL OUTER"))
def merge_outer_composite(spark, sf):
    return _composite(spark, sf, "outer")


@query("merge_inner_dedup", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, CAST(l_orderkey AS VARCHAR) AS l_orderkey,
       l_linenumber, l_partkey
FROM orders JOIN (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem WHERE l_returnflag = 'A') ON o_orderkey = l_orderkey
WHERE rn = 1""")
def merge_inner_dedup(spark, sf):
    left = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    right = table(spark, sf, "lineitem").filter("l_returnflag = 'A'")
    right = right.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    out = M.merge(left, right, ["o_orderkey"], ["l_orderkey"], "inner", dedup_order=order, fill="text", na="Unassigned")
    return out.drop("l_suppkey")


@query("merge_left_dedup_text", """
SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, lang, quality, coalesce(verdict, 'Unassigned') AS verdict
FROM documents d LEFT JOIN (SELECT doc_id, quality, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS verdict FROM labels) l
ON d.doc_id = l.doc_id""")
def merge_left_dedup_text(spark, sf):
    left = table(spark, sf, "documents").select("doc_id", "lang")
    right = table(spark, sf, "labels").select(
        "doc_id", "quality", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("verdict")
    )
    order = [F.col("quality"), F.col("verdict")]
    return M.merge(left, right, ["doc_id"], ["doc_id"], "left", dedup_order=order, fill="text", na="Unassigned")


@query("attach_metadata", """
WITH x AS (SELECT l_orderkey, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1)
SELECT o_orderkey AS bin_id, o_orderstatus, coalesce(first_flag, 'Unassigned') AS first_flag, n AS entries
FROM orders LEFT JOIN (SELECT l_orderkey AS k, min(l_returnflag) AS first_flag FROM lineitem GROUP BY 1)
  ON o_orderkey = k JOIN x ON o_orderkey = l_orderkey""")
def attach_metadata(spark, sf):
    meta = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("first_flag"))
    m = MX.attach_metadata(order_matrix(spark, sf), meta, ["_index_"], order=[F.col("first_flag")])
    sizes = m.x.groupBy("bin_id").agg(F.count(F.lit(1)).alias("entries"))
    return m.obs.select("bin_id", "o_orderstatus", "first_flag").join(sizes, "bin_id")


@query("subset_by_ids", """
SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def subset_by_ids(spark, sf):
    ids = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return M.subset_by_ids(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), ids, ["cell_id", "doc_id"])


@query("keep_labels", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#2', 'Brand#17', 'Brand#5')")
def keep_labels(spark, sf):
    return M.keep_labels(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", ["Brand#2", "Brand#17", "Brand#5"])


@query("drop_labels", """
SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL OR quality <> 1""")
def drop_labels(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return M.keep_labels(joined.select("doc_id", "quality"), "quality", ["1"], invert=True)


@query("subset_matrix_labels", """
SELECT o_orderstatus, count(*) AS entries, CAST(sum(v) AS BIGINT) AS total
FROM (SELECT l_orderkey, l_partkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderstatus IN ('F', 'P') GROUP BY 1""")
def subset_matrix_labels(spark, sf):
    m = MX.subset_labels(order_matrix(spark, sf), "o_orderstatus", ["F", "P"])
    joined = m.x.join(m.obs, "bin_id").groupBy("o_orderstatus")
    return joined.agg(F.count(F.lit(1)).alias("entries"), F.sum("value").cast("long").alias("total"))


@query("split_by_group", """
SELECT event_type, user_id, count(*) AS n FROM events WHERE event_type IS NOT NULL AND user_id = 8 GROUP BY 1, 2""")
def split_by_group(spark, sf):
    rows = M.split_groups(table(spark, sf, "events").select("event_id", "user_id", "event_type"), "event_type", "user_id=8")
    return rows.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("stack_z", """
WITH s AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events),
z AS (SELECT d, 12.0::DOUBLE * (row_number() OVER (ORDER BY d) - 1) AS warp_z FROM s)
SELECT event_id, CAST(d AS VARCHAR) AS slicename, warp_z FROM events JOIN z ON CAST(ts AS DATE) = d""")
def stack_z(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("ts").cast("date").cast("string").alias("slicename"))
    depth = M.section_z(rows.select("slicename").distinct(), "slicename", 0.0, 12.0)
    return rows.join(depth, "slicename")


@query("point_columns", f"""SELECT c_custkey, CAST({_CX} AS DOUBLE) AS warp_x, CAST({_CY} AS DOUBLE) AS warp_y, CAST(c_nationkey AS DOUBLE) AS warp_z FROM customer""")
def point_columns(spark, sf):
    """Points with a depth, as coordinate columns."""
    place = F.struct(F.expr(f"cast({_CX} as double)").alias("x"), F.expr(f"cast({_CY} as double)").alias("y"), F.col("c_nationkey").cast("double").alias("z"))
    shape = F.struct(F.lit("Point").alias("kind"), F.array(F.array(F.array(place))).alias("parts"))
    return M.point_columns(table(spark, sf, "customer").select("c_custkey", shape.alias("geometry")))


@query("union_outer", """
SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS s_name FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier""")
def union_outer(spark, sf):
    a = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), "s_name")
    return M.stack_tables([a, b], "outer")


@query("union_inner", """
SELECT c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier""")
def union_inner(spark, sf):
    a = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), "s_name")
    return M.stack_tables([a, b], "inner")


# ------------------------------------------------------------- polygons and point joins


@query("rings", f"""WITH {SQL_EDGES}
SELECT cell_id, CAST(i AS BIGINT) AS i, vx AS x, vy AS y FROM vert UNION ALL SELECT cell_id, 4, vx, vy FROM vert WHERE i = 0""")
def rings(spark, sf):
    spread = polygons(spark, sf).select("cell_id", F.posexplode(F.col("geometry")["parts"][0][0]).alias("i", "v"))
    return spread.select("cell_id", F.col("i").cast("long").alias("i"), F.col("v.x").alias("x"), F.col("v.y").alias("y"))


@query("ring_area_centroid", f"""WITH {SQL_EDGES},
m AS (SELECT cell_id, sum(x1 * y2 - x2 * y1) / 2 AS a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / 6 AS mx,
      sum((y1 + y2) * (x1 * y2 - x2 * y1)) / 6 AS my FROM edge GROUP BY 1)
SELECT cell_id, round(a, 6) AS polygon_area, round(mx / a, 6) AS centroid_x, round(my / a, 6) AS centroid_y FROM m""")
def ring_area_centroid(spark, sf):
    c = G.centroid(F.col("geometry"))
    return polygons(spark, sf).select(
        "cell_id", F.round(G.area(F.col("geometry")), 6).alias("polygon_area"),
        F.round(c["x"], 6).alias("centroid_x"), F.round(c["y"], 6).alias("centroid_y"))


@query("build_barcodes", f"""WITH {SQL_EDGES}, f AS (SELECT cell_id, CASE WHEN cell_id % 7 = 3 THEN '' ELSE
  'cell-' || cell_id END AS id, row_number() OVER (ORDER BY cell_id) - 1 AS pos FROM box)
SELECT cell_id, CASE WHEN id <> '' THEN id ELSE 'polygon_' || lpad(CAST(pos AS VARCHAR), 6, '0') END AS barcode FROM f""")
def build_barcodes(spark, sf):
    named = polygons(spark, sf).withColumn(
        "id", F.when(F.col("cell_id") % 7 == 3, "").otherwise(F.concat(F.lit("cell-"), F.col("cell_id").cast("string"))))
    return R.load_features(named, ["cell_id"], "id").select("cell_id", "barcode")


def masks(spark, sf) -> DataFrame:
    """Two overlapping pixel masks per customer cell row: all left ones first, then all right ones."""
    rows = table(spark, sf, "customer").select((F.floor(F.col("c_custkey") / 100)).alias("r")).distinct()
    k = PIXEL_PER_MICRON

    def box(x0, x1):
        return G.rectangle(F.lit(x0 * k), (F.col("r") * 10 + 1) * F.lit(k), F.lit(x1 * k), (F.col("r") * 10 + 8) * F.lit(k))

    left = rows.select("r", F.lit("leftTG").alias("tglabel"), F.lit(0).alias("mask_order"), box(0.0, 600.0).alias("geometry"))
    right = rows.select("r", F.lit("rightTG").alias("tglabel"), F.lit(1).alias("mask_order"), box(400.0, 950.0).alias("geometry"))
    return left.union(right).withColumn("section", F.pmod("r", F.lit(3)).cast("string")).filter("section <> '2'").drop("r")


_S = f"(1.0::DOUBLE / {MICRON_PER_PIXEL!r}::DOUBLE)"
_P = f"{PIXEL_PER_MICRON!r}::DOUBLE"


@query("pip_label_last_wins", f"""WITH {SQL_BINS}, b AS (SELECT *, x * {_S} AS px, y * {_S} AS py,
    (bin_id // 7) % 3 AS section FROM bins),
r AS (SELECT DISTINCT c_custkey // 100 AS r FROM customer),
m AS (SELECT r % 3 AS section, 0.0::DOUBLE * {_P} AS x0, 600.0::DOUBLE * {_P} AS x1, (r * 10 + 1) * {_P} AS y0,
      (r * 10 + 8) * {_P} AS y1, 'leftTG' AS l, 0 AS o FROM r WHERE r % 3 <> 2
      UNION ALL SELECT r % 3, 400.0::DOUBLE * {_P}, 950.0::DOUBLE * {_P}, (r * 10 + 1) * {_P}, (r * 10 + 8) * {_P}, 'rightTG', 1
      FROM r WHERE r % 3 <> 2),
h AS (SELECT bin_id, max(o) AS o FROM b JOIN m ON b.section = m.section AND px > x0 AND px < x1 AND py > y0 AND py < y1 GROUP BY 1)
SELECT b.bin_id, CAST(section AS VARCHAR) AS section,
  CASE o WHEN 0 THEN 'leftTG' WHEN 1 THEN 'rightTG' ELSE 'Unassigned' END AS tglabel
FROM b LEFT JOIN h ON b.bin_id = h.bin_id""")
def pip_label_last_wins(spark, sf):
    cells = bins(spark, sf).withColumn("section", F.expr("cast((bin_id div 7) % 3 as string)"))
    out = SJ.label_points(cells, masks(spark, sf), "bin_id", "x", "y", ["section"], micron_per_pixel=MICRON_PER_PIXEL)
    return out.select("bin_id", "section", "tglabel")


@query("pip_unique_assign", f"""WITH {SQL_EDGES}, {SQL_BINS}, {sql_hits()}
SELECT bin_id, min(cell_id) AS cell_id FROM hits GROUP BY 1 HAVING count(*) = 1""")
def pip_unique_assign(spark, sf):
    return SJ.unique_assignment(bins(spark, sf), polygons(spark, sf), "bin_id", "cell_id")


@query("pip_bin_counts", f"""WITH {SQL_EDGES}, {SQL_BINS}, {sql_hits()},
u AS (SELECT bin_id, min(cell_id) AS cell_id FROM hits GROUP BY 1 HAVING count(*) = 1)
SELECT box.cell_id, count(u.bin_id) AS num_assigned_bins FROM box LEFT JOIN u ON box.cell_id = u.cell_id GROUP BY 1""")
def pip_bin_counts(spark, sf):
    cells = polygons(spark, sf)
    assigned = SJ.unique_assignment(bins(spark, sf), cells, "bin_id", "cell_id")
    n = assigned.groupBy("cell_id").agg(F.count(F.lit(1)).alias("num_assigned_bins"))
    out = cells.select("cell_id").join(n, "cell_id", "left")
    return out.withColumn("num_assigned_bins", F.coalesce("num_assigned_bins", F.lit(0)))


@query("assignment_report", f"""WITH {SQL_EDGES}, {SQL_BINS}, {sql_hits()},
n AS (SELECT bin_id, count(*) AS n FROM hits GROUP BY 1)
SELECT (SELECT count(*) FROM bins) AS points, count(*) FILTER (n = 1) AS assigned, count(*) FILTER (n > 1) AS ambiguous,
  (SELECT count(*) FROM bins) - count(*) AS outside FROM n""")
def assignment_report(spark, sf):
    pts, cells = bins(spark, sf), polygons(spark, sf)
    hits = SJ.points_within(pts, cells)
    return SJ.assignment_report(pts, SJ.unique_assignment(pts, cells, "bin_id", "cell_id"), hits, "bin_id")


def _ratio(spark, sf, **kw):
    flags = table(spark, sf, "orders").select(F.col("o_orderkey").alias("bin_id"), "o_orderstatus")
    pts = bins(spark, sf).join(flags, "bin_id")
    a, b = (pts.filter(F.col("o_orderstatus") == s).select("x", "y") for s in ("F", "O"))
    return SJ.transcript_ratio(polygons(spark, sf), a, b, "cell_id", **kw)


_RATIO_SQL = f"""WITH {SQL_EDGES}, {SQL_BINS}, {sql_hits()},
n AS (SELECT cell_id, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b
      FROM hits JOIN orders ON bin_id = o_orderkey GROUP BY 1),
f AS (SELECT box.cell_id, greatest(coalesce(a, 0), 1) AS a, greatest(coalesce(b, 0), 1) AS b
      FROM box LEFT JOIN n ON box.cell_id = n.cell_id)"""


@query("ratio_filter", _RATIO_SQL + " SELECT cell_id FROM f WHERE a::DOUBLE / (a + b) >= 0.4::DOUBLE")
def ratio_filter(spark, sf):
    return _ratio(spark, sf, ratio=0.4).select("cell_id")


@query("ratio_table", _RATIO_SQL + """ SELECT cell_id, CAST(a AS BIGINT) AS nonneuron_count,
  CAST(b AS BIGINT) AS neuron_count, a::DOUBLE / (a + b) AS ratio FROM f""")
def ratio_table(spark, sf):
    return _ratio(spark, sf, keep_all=True).drop("geometry")


# ------------------------------------------------------------------- sparse matrices

_CELLS_TO_GENES = f"""WITH {SQL_EDGES}, {SQL_BINS}, {sql_hits(scale=_P)},
u AS (SELECT bin_id, min(cell_id) AS cell_id FROM hits GROUP BY 1 HAVING count(*) = 1),
g AS (SELECT cell_id, l_partkey AS gene, sum(l_quantity) AS v FROM u JOIN lineitem ON bin_id = l_orderkey GROUP BY 1, 2),
c AS (SELECT cell_id, sum(v) AS n FROM g GROUP BY 1 HAVING sum(v) >= 60),
k AS (SELECT g.* FROM g JOIN c USING (cell_id)),
w AS (SELECT gene FROM k GROUP BY 1 HAVING sum(v) >= 60)"""


@query("bins_to_cells", _CELLS_TO_GENES + """,
nb AS (SELECT cell_id, count(*) AS n FROM u GROUP BY 1)
SELECT CAST(k.cell_id AS VARCHAR) AS barcode, k.gene, CAST(v AS BIGINT) AS value, nb.n AS num_assigned_bins,
  CAST(c.n AS BIGINT) AS n_counts, coalesce(n_name, 'Unassigned') AS nation
FROM k JOIN w ON k.gene = w.gene JOIN c ON k.cell_id = c.cell_id JOIN nb ON k.cell_id = nb.cell_id
JOIN customer ON c_custkey = k.cell_id LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 0) ON c_nationkey = n_nationkey""")
def bins_to_cells(spark, sf):
    k = F.lit(PIXEL_PER_MICRON)
    pts = bins(spark, sf).withColumns({"x": F.col("x") * k, "y": F.col("y") * k})
    nations = table(spark, sf, "nation").filter("n_regionkey <> 0")
    meta = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    meta = meta.select("c_custkey", F.col("n_name").alias("nation"))
    m = B2C.bins_to_cells(vertices(spark, sf), pts, entries(spark, sf), genes(spark, sf), meta, "c_custkey",
                          "bin_id", "gene", "value", PIXEL_PER_MICRON, min_count=60, keep=True)
    obs = m.obs.select("barcode", "num_assigned_bins", F.col("n_counts").cast("long").alias("n_counts"), "nation")
    return m.x.withColumn("value", F.col("value").cast("long")).join(obs, "barcode")


@query("instrument_bins_to_cells", _CELLS_TO_GENES.replace("FROM orders)", "FROM orders WHERE o_orderstatus <> 'P')") + """,
nb AS (SELECT cell_id, count(*) AS n FROM u GROUP BY 1)
SELECT CAST(k.cell_id AS VARCHAR) AS barcode, p_name AS symbol, k.gene, CAST(v AS BIGINT) AS value, nb.n AS num_assigned_bins
FROM k JOIN w ON k.gene = w.gene JOIN nb ON k.cell_id = nb.cell_id JOIN part ON p_partkey = k.gene""")
def instrument_bins_to_cells(spark, sf):
    """The same from an instrument folder: positions of all orders, a raw matrix, and a filtered one without pending orders."""
    folder, k = step_path(spark), F.lit(PIXEL_PER_MICRON)
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("bin_id"), F.concat(F.lit("bin-"), F.col("o_orderkey")).alias("barcode"), "o_orderstatus")
    at = f"{folder}/binned_outputs/square_002um"
    places = bins(spark, sf).join(orders, "bin_id").select(
        "barcode", F.lit(1).alias("in_tissue"), (F.col("bin_id") % 40).cast("int").alias("array_row"), F.floor("x").cast("int").alias("array_col"),
        (F.col("y") * k).alias("pxl_row_in_fullres"), (F.col("x") * k).alias("pxl_col_in_fullres"))
    places.write.parquet(f"{at}/spatial/tissue_positions.parquet")
    var = genes(spark, sf).withColumn("kind", F.lit("Gene Expression"))
    for kind, kept in (("raw", orders), ("filtered", orders.filter("o_orderstatus <> 'P'"))):
        CT.write_counts(MX.Matrix(kept, var, entries(spark, sf), "bin_id", "gene"), f"{at}/{kind}_feature_bc_matrix", "barcode", ["gene", "symbol", "kind"])
    got = BU.counts_of(BU.read_visium_hd(spark, folder, spacing=1.0, counts=True), "square_002um")
    m = B2C.bins_to_cells(vertices(spark, sf), got.obs, got.x, got.var, None, "", "obs_pos", "var_pos", "value", PIXEL_PER_MICRON, min_count=60, keep=True)
    return m.x.join(m.var.select("var_pos", "symbol", F.col("feature_id").cast("long").alias("gene")), "var_pos").join(
        m.obs.select("barcode", "num_assigned_bins"), "barcode").select("barcode", "symbol", "gene", F.col("value").cast("long").alias("value"), "num_assigned_bins")


@query("group_sum", """
SELECT o_custkey AS cell, l_partkey AS gene, CAST(sum(l_quantity) AS BIGINT) AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def group_sum(spark, sf):
    assign = table(spark, sf, "orders").select(F.col("o_orderkey").alias("bin_id"), F.col("o_custkey").alias("cell"))
    out = MX.group_sum(entries(spark, sf), assign, "bin_id", "cell", "gene", "value")
    return out.withColumn("value", F.col("value").cast("long"))


@query("count_filter_keep", """
WITH x AS (SELECT l_orderkey AS bin_id, l_partkey AS gene, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
c AS (SELECT bin_id FROM x GROUP BY 1 HAVING sum(v) >= 120), y AS (SELECT x.* FROM x JOIN c USING (bin_id)),
g AS (SELECT gene FROM y GROUP BY 1 HAVING sum(v) >= 120)
SELECT bin_id, gene, CAST(v AS BIGINT) AS value FROM y JOIN g USING (gene)""")
def count_filter_keep(spark, sf):
    m = MX.filter_by_counts(order_matrix(spark, sf), 120, keep=True)
    return m.x.select("bin_id", "gene", F.col("value").cast("long").alias("value"))


@query("count_filter_joint", """
WITH x AS (SELECT l_orderkey AS bin_id, l_partkey AS gene, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
c AS (SELECT bin_id FROM x GROUP BY 1 HAVING sum(v) >= 120), g AS (SELECT gene FROM x GROUP BY 1 HAVING sum(v) >= 120)
SELECT bin_id, gene, CAST(v AS BIGINT) AS value FROM x JOIN c USING (bin_id) JOIN g USING (gene)""")
def count_filter_joint(spark, sf):
    m = MX.filter_by_counts(order_matrix(spark, sf), 120, keep=False)
    return m.x.select("bin_id", "gene", F.col("value").cast("long").alias("value"))


# ------------------------------------------------- matching and merging serial sections

NEURON_TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]


def section_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as cells of five serial sections; the plane grows with the table."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pos"),
        F.expr("concat('s', o_orderkey % 5)").alias("sampleid"),
        F.expr("concat('c', o_orderkey)").alias("cell_id"),
        F.col("o_orderpriority").alias("final_annot"),
        F.expr("o_totalprice % 1000.0D").alias("warp_x"),
        F.expr("cast(floor(o_custkey / 100) * 10 as double) + ((o_orderkey div 5) % 40) * 0.25D").alias("warp_y"),
        F.expr("cast((o_orderkey % 5) * 12 as double)").alias("warp_z"),
        F.expr("concat('V', o_custkey % 3 + 1)").alias("branchlabel"),
        F.col("o_orderstatus").alias("spot_class"),
        F.expr("cast(o_orderkey % 7 as double)").alias("total_counts"),
        F.expr("(o_custkey % 50) * 0.5D").alias("cell_area"),
    )


SQL_SECTIONS = """cells AS (SELECT o_orderkey AS pos, 's' || (o_orderkey % 5) AS sampleid, 'c' || o_orderkey AS cell_id,
  o_orderpriority AS final_annot, o_totalprice % 1000.0::DOUBLE AS warp_x,
  CAST(floor(o_custkey / 100) * 10 AS DOUBLE) + ((o_orderkey // 5) % 40) * 0.25::DOUBLE AS warp_y,
  CAST((o_orderkey % 5) * 12 AS DOUBLE) AS warp_z, 'V' || (o_custkey % 3 + 1) AS branchlabel, o_orderstatus AS spot_class,
  CAST(o_orderkey % 7 AS DOUBLE) AS total_counts, (o_custkey % 50) * 0.5::DOUBLE AS cell_area FROM orders),
blk AS (SELECT sampleid, arg_min(warp_z, pos) AS z, count(*) FILTER (final_annot <> '5-LOW') AS neurons FROM cells GROUP BY 1),
sec AS (SELECT *, row_number() OVER (ORDER BY z, sampleid) - 1 AS ord FROM blk WHERE neurons > 100),
neu AS (SELECT ord, pos, final_annot AS ct, warp_x AS x, warp_y AS y FROM cells JOIN sec USING (sampleid) WHERE final_annot <> '5-LOW')"""

SQL_LINKS = SQL_SECTIONS + """,
cnd AS (SELECT a.ord, a.pos AS a, b.pos AS b, a.ct, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS "by",
        sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS dist
        FROM neu a JOIN neu b ON b.ord = a.ord + 1 AND a.ct = b.ct AND b.x >= a.x - 31 AND b.x <= a.x + 31
        AND abs(b.y - a.y) <= 31),
near AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY dist, a) AS rb
         FROM cnd WHERE dist <= 30),
links AS (SELECT ord, a, b, dist, ct, ax, ay, bx, "by" FROM near WHERE ra = 1 AND rb = 1)"""


def _neurons(spark, sf):
    cells = section_cells(spark, sf)
    return MT.block_neurons(cells, MT.neuron_block(cells, NEURON_TYPES), NEURON_TYPES)


def mbn(spark, sf) -> DataFrame:
    return MT.mutual_best(materialize(_neurons(spark, sf)), 30.0)


@query("section_block", f"WITH {SQL_SECTIONS} SELECT sampleid, z, neurons, ord FROM sec")
def section_block(spark, sf):
    block = MT.neuron_block(section_cells(spark, sf), NEURON_TYPES)
    return block.select("sampleid", "z", "neurons", F.col("ord").cast("long").alias("ord"))


@query("mbn_links", f"WITH {SQL_LINKS} SELECT a, b, dist, ct FROM links")
def mbn_links(spark, sf):
    return mbn(spark, sf).select("a", "b", "dist", "ct")


_TURN = lambda a, b, c: f"(({b}x - {a}x) * ({c}y - {a}y) - ({b}y - {a}y) * ({c}x - {a}x))"


SQL_CROSSINGS = f"""{SQL_LINKS.replace("links AS (", "links AS MATERIALIZED (", 1)},
cell AS MATERIALIZED (SELECT *, floor(ax / 61) AS gx, floor(ay / 61) AS gy FROM links),
hood AS MATERIALIZED (SELECT cell.*, gx + u AS hx, gy + w AS hy FROM cell, range(-1, 2) i(u), range(-1, 2) j(w)),
p AS (SELECT s.ord, s.a AS i, t.a AS j, s.dist AS di, t.dist AS dj, s.ax AS p1x, s.ay AS p1y, s.bx AS p2x, s."by" AS p2y,
      t.ax AS q1x, t.ay AS q1y, t.bx AS q2x, t."by" AS q2y
      FROM hood s JOIN cell t ON s.ord = t.ord AND s.hx = t.gx AND s.hy = t.gy AND s.a < t.a),
d AS (SELECT *, {_TURN('q1', 'q2', 'p1')} AS d1, {_TURN('q1', 'q2', 'p2')} AS d2, {_TURN('p1', 'p2', 'q1')} AS d3,
      {_TURN('p1', 'p2', 'q2')} AS d4 FROM p),
crs AS MATERIALIZED (SELECT ord, CASE WHEN di >= dj THEN i ELSE j END AS hi, CASE WHEN di >= dj THEN j ELSE i END AS lo FROM d
WHERE ((d1 > 1e-9 AND d2 < -1e-9) OR (d1 < -1e-9 AND d2 > 1e-9)) AND ((d3 > 1e-9 AND d4 < -1e-9) OR (d3 < -1e-9 AND d4 > 1e-9)))"""


@query("crossings", f"WITH {SQL_CROSSINGS} SELECT ord, hi, lo FROM crs")
def crossings(spark, sf):
    return MT.crossings(materialize(mbn(spark, sf))).select(F.col("ord").cast("long").alias("ord"), "hi", "lo")


# one link at a time in every section pair: each crossing votes against its longer link, most votes go first
SQL_STAY = f"""{SQL_CROSSINGS},
rem(round, ord, hi, lo) AS (SELECT 0, ord, hi, lo FROM crs UNION ALL
  SELECT round + 1, rem.ord, hi, lo FROM rem JOIN (SELECT ord, arg_min(hi, (-v, hi)) AS top FROM (SELECT ord, hi, count(*) AS v FROM rem GROUP BY 1, 2) GROUP BY 1) t
    ON rem.ord = t.ord AND hi <> top AND lo <> top),
gone AS (SELECT round, ord, arg_min(hi, (-v, hi)) AS a FROM (SELECT round, ord, hi, count(*) AS v FROM rem GROUP BY 1, 2, 3) GROUP BY 1, 2),
stay AS (SELECT * FROM links WHERE (ord, a) NOT IN (SELECT (ord, a) FROM gone))"""


@query("crossing_removal", f"WITH RECURSIVE {SQL_STAY} SELECT a, b, dist, ct FROM stay")
def crossing_removal(spark, sf):
    return MT.remove_crossings(materialize(mbn(spark, sf))).select("a", "b", "dist", "ct")


# sections of 300 cells, of which 60 from two rows stand as a small section of their own
_PAIR = f"(cast(floor({_K} / 300) as bigint) * 2 + CASE WHEN {_K} % 300 >= 81 AND {_K} % 300 < 141 THEN 1 ELSE 0 END)"
# weights of a spline: second differences along a row of three cells, so that they are orthogonal to planes, but at row ends
# and at the end of the table
_TRIPLE = f"(cast(floor({_K} / 3) as bigint) * 3)"
_WEIGHT = (f"(CASE WHEN floor({_TRIPLE} / 100) = floor(({_TRIPLE} + 2) / 100) AND {_TRIPLE} > 0 AND {_TRIPLE} + 2 <= last THEN "
           f"(CASE WHEN {_K} % 3 = 1 THEN -2 ELSE 1 END) * ({_TRIPLE} % 7 - 3) ELSE 0 END)")
_SQL_SPLINE = f"""k AS (SELECT c_custkey AS pos, {_PAIR} AS ord, CAST({_CX} AS DOUBLE) AS x, CAST({_CY} AS DOUBLE) AS y, CAST({_WEIGHT} AS DOUBLE) * 0.002::DOUBLE AS wx,
  CAST({_WEIGHT} AS DOUBLE) * -0.003::DOUBLE AS wy FROM customer, (SELECT max(c_custkey) AS last FROM customer)),
t AS (SELECT p.pos, p.x + 1.5::DOUBLE AS x, p.y - 2.5::DOUBLE AS y, j.wx, j.wy, (p.x + 1.5 - j.x) * (p.x + 1.5 - j.x) + (p.y - 2.5 - j.y) * (p.y - 2.5 - j.y) AS s FROM k p JOIN k j USING (ord))"""


@query("tps_warp", f"""WITH {_SQL_SPLINE}
SELECT pos, round(1.02::DOUBLE * x - 0.03::DOUBLE * y + 5 + sum(wx * CASE WHEN s > 0 THEN 0.5::DOUBLE * s * ln(s) ELSE 0 END), 5) AS x,
  round(0.02::DOUBLE * x + 0.98::DOUBLE * y - 3 + sum(wy * CASE WHEN s > 0 THEN 0.5::DOUBLE * s * ln(s) ELSE 0 END), 5) AS y FROM t GROUP BY pos, t.x, t.y""")
def tps_warp(spark, sf):
    """Anchors that a spline of known weights moves: the fit finds that spline, whether it is solved in one task or in tiles."""
    customers = table(spark, sf, "customer")
    last = customers.agg(F.max("c_custkey")).first()[0] or 0
    src = customers.withColumn("last", F.lit(last)).select("c_custkey", F.expr(f"cast({_PAIR} as long)").alias("ord"), F.expr(f"cast({_CX} as double)").alias("ax"), F.expr(f"cast({_CY} as double)").alias("ay"),
                                                   F.expr(f"cast({_WEIGHT} as double)").alias("w"))
    src = materialize(src)
    other = src.filter("w != 0").select("ord", F.col("ax").alias("jx"), F.col("ay").alias("jy"), F.col("w").alias("jw"))
    s = (F.col("ax") - F.col("jx")) ** 2 + (F.col("ay") - F.col("jy")) ** 2
    # a section is of bounded size
    bent = src.join(other, "ord", "left").groupBy("ord", "c_custkey", "ax", "ay", "w").agg(
        F.coalesce(F.sum(F.col("jw") * F.when(s > 0, 0.5 * s * F.log(s)).otherwise(0.0)), F.lit(0.0)).alias("u"))
    x, y, off = F.col("ax"), F.col("ay"), F.col("u") + 0.1 * F.col("w")
    anchors = bent.select("ord", F.col("c_custkey").alias("a"), "ax", "ay", (x * 1.02 - y * 0.03 + 5 + 0.002 * off).alias("bx"), (x * 0.02 + y * 0.98 - 3 - 0.003 * off).alias("by"))
    model = TP.fit_tps(materialize(anchors), smoothing=0.1, dense_limit=100, tile=64)
    out = TP.warp_points(src.select("ord", F.col("c_custkey").alias("pos"), (x + 1.5).alias("x"), (y - 2.5).alias("y")), model)
    return out.select("pos", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("tps_links")
def tps_links(spark, sf):
    return MT.match_sections(section_cells(spark, sf), NEURON_TYPES)[1]


@query("match_statistics")
def match_statistics(spark, sf):
    return MT.match_statistics(*MT.match_sections(section_cells(spark, sf), NEURON_TYPES))


SQL_THREADS = SQL_LINKS.replace("WITH", "") + """,
walk AS (SELECT a, b, dist, ct, a AS head, 0 AS hop FROM links WHERE a NOT IN (SELECT b FROM links)
         UNION ALL SELECT l.a, l.b, l.dist, l.ct, w.head, w.hop + 1 FROM walk w JOIN links l ON l.a = w.b)"""

SQL_PICKS = SQL_THREADS + """,
thr AS (SELECT head, count(*) AS m, list(30.0::DOUBLE - dist ORDER BY hop) AS w FROM walk GROUP BY 1),
msk AS (SELECT head, m, w, k FROM thr, range(0, 16) r(k) WHERE k < (1 << m) AND (k & (k >> 1) & (k >> 2)) = 0),
scr AS (SELECT head, k, list_sum(list_transform(range(0, m), lambda i: CASE WHEN (k >> i) & 1 = 1 THEN w[i + 1] ELSE 0.0::DOUBLE END)) AS s
        FROM msk),
bst AS (SELECT head, arg_max(k, s) AS k FROM scr GROUP BY 1),
sel AS (SELECT a, b, dist, ct, walk.head, hop FROM walk JOIN bst ON walk.head = bst.head WHERE (k >> hop) & 1 = 1)"""

SQL_CHAINS = SQL_PICKS + """,
grp AS (SELECT *, hop - row_number() OVER (PARTITION BY head ORDER BY hop) AS g FROM sel),
mem AS (SELECT head, g, a AS pos FROM grp UNION SELECT head, g, b FROM grp),
chn AS (SELECT min(pos) AS chain, list(pos ORDER BY pos) AS members FROM mem GROUP BY head, g)"""


@query("threads", f"WITH RECURSIVE {SQL_THREADS} SELECT a, b, dist, ct, head, CAST(hop AS BIGINT) AS hop FROM walk")
def threads(spark, sf):
    return CH.thread_links(materialize(mbn(spark, sf)).select("a", "b", "dist", "ct"))


def _chosen(spark, sf):
    return CH.choose_links(CH.threads(materialize(mbn(spark, sf))), 30.0, 3)


@query("dp_links", f"WITH RECURSIVE {SQL_PICKS} SELECT a, b, dist, ct FROM sel")
def dp_links(spark, sf):
    return CH.selected_links(_chosen(spark, sf))


@query("chains", f"WITH RECURSIVE {SQL_CHAINS} SELECT chain, array_to_string(members, ',') AS members FROM chn")
def chains(spark, sf):
    out = CH.chains(_chosen(spark, sf))
    return out.select("chain", F.array_join(F.transform("members", lambda v: v.cast("string")), ",").alias("members"))


@query("assemble", f"""WITH RECURSIVE {SQL_CHAINS},
fr AS (SELECT chain, c.* FROM chn, unnest(members) u(p) JOIN cells c ON c.pos = p),
md AS (SELECT chain, branchlabel, row_number() OVER (PARTITION BY chain ORDER BY count(*) DESC, branchlabel) AS r FROM fr GROUP BY 1, 2),
rp AS (SELECT chain, sampleid, row_number() OVER (PARTITION BY chain ORDER BY total_counts DESC, pos) AS r FROM fr),
mg AS (SELECT f.chain AS source_pos, 'neuron' AS cell_class, true AS is_merged, count(*) AS chain_length,
  count(DISTINCT f.sampleid) AS n_sections, arg_min(final_annot, pos) AS final_annot, any_value(md.branchlabel) AS branchlabel,
  'merged_neuron' AS spot_class, avg(warp_x) AS warp_x, avg(warp_y) AS warp_y, avg(warp_z) AS warp_z, sum(cell_area) AS total_cell_area,
  avg(cell_area) AS mean_cell_area, sum(total_counts) AS total_counts, any_value(rp.sampleid) AS sampleid,
  string_agg(f.sampleid, ',' ORDER BY pos) AS sampleid_list, string_agg(cell_id, ',' ORDER BY pos) AS cell_id_list,
  string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS block_pos_list
  FROM fr f JOIN md ON md.chain = f.chain AND md.r = 1 JOIN rp ON rp.chain = f.chain AND rp.r = 1 GROUP BY 1),
sg AS (SELECT pos, CASE WHEN final_annot <> '5-LOW' THEN 'neuron' ELSE 'non-neuron' END, false, 1, 1, final_annot, branchlabel, spot_class,
  warp_x, warp_y, warp_z, cell_area, cell_area, total_counts, sampleid, sampleid, cell_id, CAST(pos AS VARCHAR)
  FROM cells WHERE pos NOT IN (SELECT pos FROM fr)),
al AS (SELECT * FROM mg UNION ALL SELECT * FROM sg)
SELECT * REPLACE (round(warp_x, 6) AS warp_x, round(warp_y, 6) AS warp_y, round(warp_z, 6) AS warp_z,
  round(mean_cell_area, 6) AS mean_cell_area) FROM al""")
def assemble(spark, sf):
    cells = section_cells(spark, sf)
    obs = AS.assemble(cells, materialize(CH.chains(_chosen(spark, sf))), NEURON_TYPES)
    return obs.withColumns({c: F.round(c, 6) for c in ("warp_x", "warp_y", "warp_z", "mean_cell_area")})


@query("assemble_expression", f"""WITH RECURSIVE {SQL_CHAINS}, mp AS (SELECT chain, unnest(members) AS pos FROM chn)
SELECT coalesce(chain, l_orderkey) AS source_pos, l_partkey AS gene, CAST(sum(l_quantity) AS BIGINT) AS value
FROM lineitem LEFT JOIN mp ON pos = l_orderkey GROUP BY 1, 2""")
def assemble_expression(spark, sf):
    chain_table = materialize(CH.chains(_chosen(spark, sf)))
    out = AS.assemble_matrix(order_matrix(spark, sf), section_cells(spark, sf), chain_table, NEURON_TYPES)
    return out.x.withColumn("value", F.col("value").cast("long"))


@query("assemble_names", f"""WITH RECURSIVE {SQL_CHAINS}, mp AS (SELECT chain, unnest(members) AS pos FROM chn)
SELECT chain AS source_pos, 'merged_' || (row_number() OVER (ORDER BY chain) - 1) AS obs_name FROM chn
UNION ALL SELECT pos, 'cell_' || (row_number() OVER (ORDER BY pos) - 1) FROM cells WHERE pos NOT IN (SELECT pos FROM mp)""")
def assemble_names(spark, sf):
    cells = section_cells(spark, sf)
    obs = AS.assemble(cells, materialize(CH.chains(_chosen(spark, sf))), NEURON_TYPES)
    return AS.name_rows(obs).select("source_pos", "obs_name")


# ------------------------------------------------------------------------------ rasters

IMAGE_W, IMAGE_H = 128, 64


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Images of 128 x 64 pixels and four channels: order -> pixel, line number -> channel, quantity -> value."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") % 4).alias("ch")).agg(
        (F.sum("l_quantity") * 16).cast("long").alias("q"))
    grid = table(spark, sf, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ch"))
    full = grid.join(lines, (F.col("o_orderkey") == F.col("l_orderkey")) & (grid["ch"] == lines["ch"]), "left")
    return full.select(
        F.expr(f"o_orderkey div {IMAGE_W * IMAGE_H}").alias("img"), grid["ch"],
        F.expr(f"cast((o_orderkey % {IMAGE_W * IMAGE_H}) div {IMAGE_W} as int)").alias("y"),
        F.expr(f"cast(o_orderkey % {IMAGE_W} as int)").alias("x"), F.coalesce("q", F.lit(0)).alias("v"))


SQL_PIXELS = f"""px AS (SELECT o_orderkey // {IMAGE_W * IMAGE_H} AS img, CAST(c AS INTEGER) AS ch,
  CAST((o_orderkey % {IMAGE_W * IMAGE_H}) // {IMAGE_W} AS INTEGER) AS y, CAST(o_orderkey % {IMAGE_W} AS INTEGER) AS x,
  coalesce(q, 0) AS v FROM orders CROSS JOIN range(0, 4) r(c)
  LEFT JOIN (SELECT l_orderkey, l_linenumber % 4 AS ch, CAST(sum(l_quantity) * 16 AS BIGINT) AS q FROM lineitem GROUP BY 1, 2) l
  ON o_orderkey = l.l_orderkey AND l.ch = c)"""


#: Side of the tiles: several to an image.
TILE = 48


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    """The same images in tiles, stored as a raster would be."""
    return materialize(TI.to_tiles(pixels(spark, sf), tile=TILE))


def channel(spark, sf, ch: int) -> DataFrame:
    return pixels(spark, sf).filter(F.col("ch") == ch)


@query("stack_channels", f"""WITH {SQL_PIXELS} SELECT img, CASE ch WHEN 2 THEN 0 WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS ch, y, x, v FROM px""")
def stack_channels(spark, sf):
    return RA.stack_channels([channel(spark, sf, c).drop("ch") for c in (2, 0, 3, 1)])


@query("raster_threshold", f"""WITH {SQL_PIXELS} SELECT img, ch, y, x,
  CASE WHEN v >= [200, 1000, 2000, 500][ch + 1] THEN v ELSE 0 END AS v FROM px""")
def raster_threshold(spark, sf):
    return RA.threshold(pixels(spark, sf), [200, 1000, 2000, 500])


@query("raster_threshold_invert", f"""WITH {SQL_PIXELS} SELECT img, ch, y, x,
  CASE WHEN v <= [200, 1000, 2000, 500][ch + 1] THEN v ELSE 65535 END AS v FROM px""")
def raster_threshold_invert(spark, sf):
    return RA.threshold(pixels(spark, sf), [200, 1000, 2000, 500], invert=True)


@query("raster_invert", f"WITH {SQL_PIXELS} SELECT img, ch, y, x, 65535 - v AS v FROM px")
def raster_invert(spark, sf):
    return RA.invert(pixels(spark, sf), 65535)


@query("raster_mask", f"""WITH {SQL_PIXELS.replace("px AS (", "px AS MATERIALIZED (", 1)},
m AS MATERIALIZED (SELECT img, y, x, max(v) AS top FROM px WHERE ch IN (1, 3) GROUP BY 1, 2, 3)
SELECT img, ch, y, x, CASE WHEN top > 600 THEN v ELSE 0 END AS v FROM px JOIN m USING (img, y, x)""")
def raster_mask(spark, sf):
    """A mask of two channels."""
    src = tiles(spark, sf)
    return TI.from_tiles(TI.mask_by_raster(src, src.filter("ch in (1, 3)"), 600), TILE)


@query("raster_flip_rotate", f"""WITH {SQL_PIXELS}, d AS (SELECT img, max(y) + 1 AS h, max(x) + 1 AS w FROM px GROUP BY 1)
SELECT img, ch, CAST(x AS INTEGER) AS y, CAST(y AS INTEGER) AS x, v FROM px JOIN d USING (img)""")
def raster_flip_rotate(spark, sf):
    src = pixels(spark, sf)
    size = RA.image_size(src)
    turned = RA.rotate90(RA.flip(src, "horizon", size), 1, size)
    return turned.withColumns({"y": F.col("y").cast("int"), "x": F.col("x").cast("int")})


@query("rgb_blend", f"""WITH {SQL_PIXELS}, e AS (SELECT img, ch, CAST(min(v) AS FLOAT) AS lo, CAST(max(v) AS FLOAT) AS hi FROM px GROUP BY 1, 2),
n AS (SELECT img, ch, y, x, CAST((CAST(v AS FLOAT) - lo) / CAST(CAST(hi - lo AS FLOAT) + CAST(1e-8 AS FLOAT) AS FLOAT) AS FLOAT) AS n FROM px JOIN e USING (img, ch)),
w AS (SELECT img, y, x, max(n) FILTER (ch = 0) AS a, max(n) FILTER (ch = 1) AS b, max(n) FILTER (ch = 2) AS c, max(n) FILTER (ch = 3) AS d FROM n GROUP BY 1, 2, 3),
s AS (SELECT img, y, x, CAST(CAST(CAST(b AS DOUBLE) AS FLOAT)::DOUBLE + c::DOUBLE AS FLOAT) AS r0, d, a, b, c FROM w),
t AS (SELECT img, y, x, CAST(r0::DOUBLE + d::DOUBLE AS FLOAT) AS r, CAST(a::DOUBLE + b::DOUBLE AS FLOAT) AS g, CAST(a::DOUBLE + c::DOUBLE AS FLOAT) AS bl FROM s)
SELECT img, y, x, 255 - CAST(round_even(CAST(least(r, 1::FLOAT) * 255::FLOAT AS FLOAT)::DOUBLE, 0) AS BIGINT) AS r,
  255 - CAST(round_even(CAST(least(g, 1::FLOAT) * 255::FLOAT AS FLOAT)::DOUBLE, 0) AS BIGINT) AS g,
  255 - CAST(round_even(CAST(least(bl, 1::FLOAT) * 255::FLOAT AS FLOAT)::DOUBLE, 0) AS BIGINT) AS b FROM t""")
def rgb_blend(spark, sf):
    return TI.rgb_pixels(TI.blend_rgb(tiles(spark, sf), inverted=True), TILE)


@query("intensity_hist", f"""WITH {SQL_PIXELS}, k AS (SELECT img, log10(v + 1e-6::DOUBLE) AS u FROM px WHERE ch = 2 AND v > 1),
e AS (SELECT img, min(u) AS lo, max(u) AS hi FROM k GROUP BY 1),
b AS (SELECT img, least(CAST(floor((u - lo) * (100.0::DOUBLE / (hi - lo))) AS BIGINT), 99) AS b, u, lo, (hi - lo) / 100.0::DOUBLE AS w FROM k JOIN e USING (img)),
f AS (SELECT img, lo, w, CASE WHEN u < lo + b * w THEN b - 1 WHEN u >= lo + (b + 1) * w AND b < 99 THEN b + 1 ELSE b END AS bin FROM b)
SELECT img, bin, round(lo + bin * w, 9) AS lower, round(lo + (bin + 1) * w, 9) AS upper, count(*) AS n FROM f GROUP BY ALL""")
def intensity_hist(spark, sf):
    out = RA.intensity_histogram(pixels(spark, sf), 2, 100, 1, log=True)
    return out.withColumns({"lower": F.round("lower", 9), "upper": F.round("upper", 9)})


_SQL_8BIT = SQL_PIXELS + """, e8 AS (SELECT img, ch, max(v) AS top FROM px GROUP BY 1, 2),
p8 AS (SELECT img, ch, y, x, CASE WHEN top > 0 THEN CAST(floor(v::DOUBLE / top::DOUBLE * 255) AS BIGINT) ELSE 0 END AS v
       FROM px JOIN e8 USING (img, ch))"""


@query("scale_8bit", f"WITH {_SQL_8BIT} SELECT img, ch, y, x, v FROM p8")
def scale_8bit(spark, sf):
    return RA.to_8bit(pixels(spark, sf))


@query("otsu", f"""WITH {_SQL_8BIT}, h AS (SELECT img, ch, v, count(*)::DOUBLE AS n FROM p8 GROUP BY 1, 2, 3),
c AS (SELECT img, ch, v, sum(n) OVER u AS n1, sum(n * v) OVER u AS s1, sum(n) OVER a AS nt, sum(n * v) OVER a AS st FROM h
      WINDOW u AS (PARTITION BY img, ch ORDER BY v), a AS (PARTITION BY img, ch)),
s AS (SELECT img, ch, v, CASE WHEN n1 < nt THEN n1 * (nt - n1) * (s1 / n1 - (st - s1) / (nt - n1)) * (s1 / n1 - (st - s1) / (nt - n1)) ELSE 0 END AS s FROM c)
SELECT img, ch, v AS t FROM (SELECT *, row_number() OVER (PARTITION BY img, ch ORDER BY s DESC, v) AS r FROM s) WHERE r = 1""")
def otsu(spark, sf):
    return RA.otsu(RA.to_8bit(pixels(spark, sf)))


_SQL_GRID = """, d AS (SELECT img, max(y) + 1 AS h, max(x) + 1 AS w FROM px GROUP BY 1),
g AS (SELECT img, CAST(c AS INTEGER) AS ch, CAST(yy AS INTEGER) AS y, CAST(xx AS INTEGER) AS x, h, w
      FROM d, range(0, h) a(yy), range(0, w) b(xx), range(0, 4) r(c))"""


@query("blur", f"""WITH {_SQL_8BIT}{_SQL_GRID},
k AS (SELECT CAST(o AS INTEGER) AS o, exp(-(o * o) / 8.0::DOUBLE) AS e FROM range(-5, 6) r(o)),
kn AS (SELECT o, e / (SELECT sum(e) FROM k) AS wt FROM k),
c AS (SELECT g.img, g.ch, g.y, g.x, wt, o, abs(g.y + o) % (2 * h - 2) AS m, h FROM g, kn),
v1 AS (SELECT c.img, c.ch, c.y, c.x, sum(wt * v) AS s FROM c JOIN p8 i ON i.img = c.img AND i.ch = c.ch AND i.x = c.x
       AND i.y = CASE WHEN m >= h THEN 2 * h - 2 - m ELSE m END GROUP BY 1, 2, 3, 4),
c2 AS (SELECT g.img, g.ch, g.y, g.x, wt, abs(g.x + o) % (2 * w - 2) AS m, w FROM g, kn)
SELECT c2.img, c2.ch, c2.y, c2.x, CAST(round_even(sum(wt * s), 0) AS BIGINT) AS v FROM c2 JOIN v1 ON v1.img = c2.img AND v1.ch = c2.ch AND v1.y = c2.y
  AND v1.x = CASE WHEN m >= w THEN 2 * w - 2 - m ELSE m END GROUP BY 1, 2, 3, 4""")
def blur(spark, sf):
    return TI.from_tiles(TI.blur(TI.to_8bit(tiles(spark, sf)), 11, TILE), TILE)


_SET = "v > CASE WHEN ch = 3 THEN 600 ELSE 740 END"


def islands_mask(spark, sf) -> DataFrame:
    """Sparse set pixels: high values in every channel."""
    return pixels(spark, sf).withColumn("v", F.when(F.expr(_SET), 255).otherwise(0).cast("long"))


_SQL_MASK = SQL_PIXELS + _SQL_GRID + f", mk AS (SELECT img, ch, y, x FROM px WHERE {_SET})"


def _sql_grow(name: str, src: str, k: int) -> str:
    lo, hi = -(k // 2), k - 1 - k // 2
    return f"""{name} AS (SELECT DISTINCT g.img, g.ch, g.y, g.x FROM {src} s, range({lo}, {hi + 1}) a(dy), range({lo}, {hi + 1}) b(dx), g
      WHERE g.img = s.img AND g.ch = s.ch AND g.y = s.y - dy AND g.x = s.x - dx)"""


@query("dilate", f"""WITH {_SQL_MASK}, {_sql_grow('dl', 'mk', 5)}
SELECT g.img, g.ch, g.y, g.x, CAST(CASE WHEN dl.img IS NULL THEN 0 ELSE 255 END AS BIGINT) AS v FROM g
LEFT JOIN dl ON dl.img = g.img AND dl.ch = g.ch AND dl.y = g.y AND dl.x = g.x""")
def dilate(spark, sf):
    return TI.from_tiles(TI.dilate(TI.to_tiles(islands_mask(spark, sf), tile=TILE), 5, TILE), TILE)


@query("close", f"""WITH {_SQL_MASK}, {_sql_grow('dl', 'mk', 3)},
cl AS (SELECT g.img, g.ch, g.y, g.x FROM g LEFT JOIN (SELECT DISTINCT z.img, z.ch, z.y - dy AS y, z.x - dx AS x
        FROM (SELECT g.img, g.ch, g.y, g.x FROM g ANTI JOIN dl ON dl.img = g.img AND dl.ch = g.ch AND dl.y = g.y AND dl.x = g.x) z,
        range(-1, 2) a(dy), range(-1, 2) b(dx)) u
       ON u.img = g.img AND u.ch = g.ch AND u.y = g.y AND u.x = g.x WHERE u.img IS NULL)
SELECT g.img, g.ch, g.y, g.x, CAST(CASE WHEN cl.img IS NULL THEN 0 ELSE 255 END AS BIGINT) AS v FROM g
LEFT JOIN cl ON cl.img = g.img AND cl.ch = g.ch AND cl.y = g.y AND cl.x = g.x""")
def close(spark, sf):
    return TI.from_tiles(TI.close(TI.to_tiles(islands_mask(spark, sf), tile=TILE), 3, TILE), TILE)


_SQL_ISLANDS = f"""WITH RECURSIVE {_SQL_MASK},
rc(img, ch, y, x, ly, lx) AS (SELECT img, ch, y, x, y, x FROM mk UNION
  SELECT m.img, m.ch, m.y, m.x, r.ly, r.lx FROM rc r JOIN mk m ON m.img = r.img AND m.ch = r.ch AND m.y BETWEEN r.y - 1 AND r.y + 1 AND m.x BETWEEN r.x - 1 AND r.x + 1),
lb AS (SELECT img, ch, y, x, min(CAST(ly AS BIGINT) * 2147483648 + lx) AS label FROM rc GROUP BY 1, 2, 3, 4)"""


@query("components", f"{_SQL_ISLANDS} SELECT img, ch, y, x, label FROM lb")
def components(spark, sf):
    return CO.label_islands(islands_mask(spark, sf), tile=32)


@query("island_area", f"""{_SQL_ISLANDS} SELECT img, ch, y, x, label, CAST(255 AS BIGINT) AS v FROM lb
JOIN (SELECT img, ch, label FROM lb GROUP BY 1, 2, 3 HAVING count(*) >= 6) USING (img, ch, label)""")
def island_area(spark, sf):
    return CO.large_islands(CO.label_islands(islands_mask(spark, sf), tile=32), 6)


@query("island_contours")
def island_contours(spark, sf):
    """Whole island step: 8 bits, blur, Otsu, closing, islands by area, growth, outer contours."""
    _, contours = SG.island_mask(pixels(spark, sf), kernel=3, grow=3, min_area=20, ksize=5)
    return contours.select("img", "ch", "label", G.area(F.col("geometry")).alias("area"))


# outlines of the mask, in pixels: a bent one with a hole, and one over its edge; several corners and edges are on pixel centres
_MASKS = [[[(20.5, 5.5), (90.25, 5.25), (70.0, 30.0), (90.25, 45.5), (20.5, 45.5), (40.0, 25.0)], [(45.0, 12.0), (60.5, 12.5), (52.5, 22.0)]], [[(80.5, 10.5), (120.25, 20.5), (80.5, 55.0)]]]
_MASK_EDGES = ", ".join(f"({p}, {x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)" for p, rings in enumerate(_MASKS) for ring in rings
                        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]))


@query("mask_by_polygon", f"""WITH {SQL_PIXELS}, e(p, x1, y1, x2, y2) AS (VALUES {_MASK_EDGES}),
c AS (SELECT DISTINCT img, y, x, x + 0.5::DOUBLE AS px, y + 0.5::DOUBLE - img % 3 AS py FROM px),
t AS (SELECT *, (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) AS cr FROM c, e),
h AS (SELECT img, y, x, p FROM t GROUP BY 1, 2, 3, 4
  HAVING sum(CASE WHEN (y1 <= py AND y2 > py AND cr > 0) OR (y1 > py AND y2 <= py AND cr < 0) THEN 1 ELSE 0 END) % 2 = 1
     AND sum(CASE WHEN cr = 0 AND px BETWEEN least(x1, x2) AND greatest(x1, x2) AND py BETWEEN least(y1, y2) AND greatest(y1, y2) THEN 1 ELSE 0 END) = 0)
SELECT img, ch, y, x, CASE WHEN (img, y, x) IN (SELECT (img, y, x) FROM h) THEN v ELSE 0 END AS v FROM px""")
def mask_by_polygon(spark, sf):
    place = lambda x, y: G.vertex(F.lit(x), F.lit(y) + F.col("img") % 3)
    shapes = [G.geometry(F.array(F.array(*[F.array(*[place(*c) for c in (*ring, ring[0])]) for ring in rings]))) for rings in _MASKS]
    src = tiles(spark, sf)
    return TI.from_tiles(TI.mask_by_polygon(src, src.select("img").distinct().select("img", F.explode(F.array(*shapes)).alias("geometry")), tile=TILE), TILE)


# ------------------------------------------------------------------------ polygon overlay

_TINY = "(c_custkey % 11 = 0)"
_BX, _BY = f"({_CX} + 3 + c_custkey % 5)", f"({_CY} + c_custkey % 3 - 1)"
_BH = "(1 + (c_custkey % 4) * 0.5)"
_AX, _AY = f"(CASE WHEN {_TINY} THEN {_BX} ELSE {_CX} END)", f"(CASE WHEN {_TINY} THEN {_BY} ELSE {_CY} END)"
_AH = f"(CASE WHEN {_TINY} THEN 0.5 ELSE 4.0 END)"


def overlay_layers(spark, sf):
    """Square neurons, and square non-neurons that reach into one or two of them."""
    src = table(spark, sf, "customer").select("c_custkey")
    side = lambda c, h, s: F.expr(f"cast({c} {s} {h} as double)")
    box = lambda x, y, h: G.rectangle(side(x, h, "-"), side(y, h, "-"), side(x, h, "+"), side(y, h, "+"))
    pid = F.col("c_custkey").cast("string").alias("pid")
    return src.select(pid, box(_AX, _AY, _AH).alias("geometry")), src.select(pid, box(_BX, _BY, _BH).alias("geometry"))


@query("overlay_difference", f"""WITH a AS (SELECT c_custkey AS pid, {_AX} - {_AH} AS x0, {_AX} + {_AH} AS x1, {_AY} - {_AH} AS y0, {_AY} + {_AH} AS y1 FROM customer),
b AS (SELECT c_custkey AS q, {_BX} - {_BH} AS u0, {_BX} + {_BH} AS u1, {_BY} - {_BH} AS v0, {_BY} + {_BH} AS v1 FROM customer),
p AS (SELECT * FROM a JOIN b ON x0 < u1 AND u0 < x1 AND y0 < v1 AND v0 < y1),
gone AS (SELECT DISTINCT pid FROM p WHERE x0 >= u0 AND x1 <= u1 AND y0 >= v0 AND y1 <= v1),
held AS (SELECT DISTINCT q FROM p WHERE pid NOT IN (SELECT pid FROM gone) AND u0 >= x0 AND u1 <= x1 AND v0 >= y0 AND v1 <= y1),
cut AS (SELECT pid, sum((least(x1, u1) - greatest(x0, u0)) * (least(y1, v1) - greatest(y0, v0))) AS s FROM p
        WHERE q NOT IN (SELECT q FROM held) GROUP BY 1)
SELECT CAST(a.pid AS VARCHAR) AS pid, round(CAST((x1 - x0) * (y1 - y0) - coalesce(s, 0) AS DOUBLE), 6) AS area FROM a
LEFT JOIN cut ON a.pid = cut.pid WHERE a.pid NOT IN (SELECT pid FROM gone)""")
def overlay_difference(spark, sf):
    out = OV.harmonise(*overlay_layers(spark, sf))
    return out.groupBy("pid").agg(F.round(F.sum(G.area(F.col("geometry"))), 6).alias("area"))


_NEURON_COPIES = "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS pid FROM customer UNION ALL SELECT c_custkey, c_custkey || '-copy' FROM customer WHERE c_custkey % 3 = 0"


@query("overlay_shared_outlines", f"""WITH k AS ({_NEURON_COPIES}), a AS (SELECT pid, {_CX} - 5 AS x0, {_CX} + 5 AS x1, {_CY} - 5 AS y0, {_CY} + 5 AS y1 FROM k),
b AS (SELECT {_CX} - 1.5 AS u0, {_CX} + 1.5 AS u1, {_CY} - 6.5 AS v0, {_CY} - 3.5 AS v1 FROM customer),
c AS (SELECT pid, sum((least(x1, u1) - greatest(x0, u0)) * (least(y1, v1) - greatest(y0, v0))) AS s FROM a JOIN b ON x0 < u1 AND u0 < x1 AND y0 < v1 AND v0 < y1 GROUP BY 1)
SELECT pid, CAST(count(*) AS BIGINT) AS parts, round(CAST(100 - coalesce(any_value(s), 0) AS DOUBLE), 6) AS area FROM a LEFT JOIN c USING (pid) GROUP BY 1""")
def overlay_shared_outlines(spark, sf):
    """Neurons that tile the plane, some of them twice, less a square on each edge that two rows share."""
    src = table(spark, sf, "customer").select("c_custkey")
    ids = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit(""), F.lit("-copy"))).otherwise(F.array(F.lit("")))
    side = lambda c, d: F.expr(f"cast({c} + {d} as double)")
    neurons = src.withColumn("tag", F.explode(ids)).select(F.concat(F.col("c_custkey").cast("string"), "tag").alias("pid"), G.rectangle(side(_CX, -5), side(_CY, -5), side(_CX, 5), side(_CY, 5)).alias("geometry"))
    others = src.select(F.col("c_custkey").cast("string").alias("pid"), G.rectangle(side(_CX, -1.5), side(_CY, -6.5), side(_CX, 1.5), side(_CY, -3.5)).alias("geometry"))
    out = OV.harmonise(neurons, others)
    return out.groupBy("pid").agg(F.count(F.lit(1)).alias("parts"), F.round(F.sum(G.area(F.col("geometry"))), 6).alias("area"))


@query("polygons_within", f"""SELECT CAST(a.c_custkey AS VARCHAR) AS pid, CAST(b.c_custkey AS VARCHAR) AS pid2
FROM (SELECT c_custkey, {_AX} - {_AH} AS x0, {_AX} + {_AH} AS x1, {_AY} - {_AH} AS y0, {_AY} + {_AH} AS y1 FROM customer) a
JOIN (SELECT c_custkey, {_BX} - {_BH} AS u0, {_BX} + {_BH} AS u1, {_BY} - {_BH} AS v0, {_BY} + {_BH} AS v1 FROM customer) b
ON x0 >= u0 AND x1 <= u1 AND y0 >= v0 AND y1 <= v1""")
def polygons_within(spark, sf):
    return OV.polygons_within(*overlay_layers(spark, sf))


@query("polygons_contain", f"""SELECT CAST(a.c_custkey AS VARCHAR) AS pid2, CAST(b.c_custkey AS VARCHAR) AS pid
FROM (SELECT c_custkey, {_AX} - {_AH} AS x0, {_AX} + {_AH} AS x1, {_AY} - {_AH} AS y0, {_AY} + {_AH} AS y1 FROM customer) a
JOIN (SELECT c_custkey, {_BX} - {_BH} AS u0, {_BX} + {_BH} AS u1, {_BY} - {_BH} AS v0, {_BY} + {_BH} AS v1 FROM customer) b
ON u0 >= x0 AND u1 <= x1 AND v0 >= y0 AND v1 <= y1""")
def polygons_contain(spark, sf):
    neurons, others = overlay_layers(spark, sf)
    return OV.polygons_within(others, neurons)


@query("overlay_of_cells")
def overlay_of_cells(spark, sf):
    """Overlapping quadrilaterals: even customers less odd ones, as parts with their area."""
    cells = polygons(spark, sf).select(F.col("cell_id").cast("string").alias("pid"), "cell_id", "geometry")
    even, odd = cells.filter("cell_id % 2 = 0").drop("cell_id"), cells.filter("cell_id % 2 = 1").drop("cell_id")
    return OV.harmonise(even, odd).select("pid", "part", F.round(G.area(F.col("geometry")), 6).alias("area"))


@query("valid_polygons", """SELECT CAST(c_custkey AS VARCHAR) AS pid FROM customer WHERE c_custkey % 10 IN (0, 1, 3, 6)""")
def valid_polygons(spark, sf):
    """Outlines of ten kinds, six of them at fault and four valid."""
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    shell = box(-4, -4, 4, 4)
    kinds = [
        [[shell]], [[shell, box(-2, -2, 2, 2)]],
        [[[(0, 0), (4, 4), (4, 0), (0, 3)]]],  # edges cross
        [[shell, box(-2, -2, 2, 2)], [box(-1, -1, 1, 1)]],  # a part in a hole
        [[box(-4, -4, 0, 0), box(1, 1, 2, 2)]],  # a hole outside its shell
        [[shell, box(-3, -3, 3, 3), box(-1, -1, 1, 1)]],  # a hole in a hole
        [[shell, [(4, 0), (2, 1), (2, -1)]]],  # a hole that touches its shell in one place
        [[shell], [box(-1, -1, 1, 1)]],  # a part in a part
        [[shell, [(4, 0), (0, 2), (-4, 0), (0, -2)]]],  # a hole that cuts the inside in two
        [[box(-4, -4, 1, 1)], [box(-1, -1, 4, 4)]],  # parts that overlap
    ]
    outlines = F.lit([[[[float(c) for at in (*ring, ring[0]) for c in at] for ring in part] for part in parts] for parts in kinds])
    here = table(spark, sf, "customer").select("c_custkey", F.expr(f"cast({_CX} as double)").alias("cx"), F.expr(f"cast({_CY} as double)").alias("cy"),
                                               F.element_at(outlines, (F.col("c_custkey") % 10 + 1).cast("int")).alias("parts"))
    corner = lambda ring, i: G.vertex(F.col("cx") + F.get(ring, 2 * i), F.col("cy") + F.get(ring, 2 * i + 1))
    ring = lambda r: F.transform(F.sequence(F.lit(0), (F.size(r) / 2 - 1).cast("int")), lambda i: corner(r, i))
    shapes = here.select(F.col("c_custkey").cast("string").alias("pid"), G.geometry(F.transform("parts", lambda part: F.transform(part, ring))).alias("geometry"))
    return OV.valid_only(materialize(shapes)).select("pid")


# ------------------------------------------------------------------------------ files and back

@query("geo_files_round_trip", f"""WITH {SQL_EDGES},
m AS (SELECT cell_id, sum(x1 * y2 - x2 * y1) / 2 AS a FROM edge GROUP BY 1)
SELECT CAST(cell_id AS VARCHAR) AS id, c_name AS name, c_acctbal AS balance, round(a, 6) AS polygon_area FROM m JOIN customer ON cell_id = c_custkey""")
def geo_files_round_trip(spark, sf):
    """Outlines with properties as GeoParquet, from there as one GeoJSON document, and back."""
    folder = step_path(spark)
    about = table(spark, sf, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    FE.write_geoparquet(polygons(spark, sf).join(about, "cell_id").select(F.col("cell_id").cast("string").alias("id"), "name", "balance", "geometry"), f"{folder}/cells.parquet")
    FE.write_geojson(FE.read_features(spark, f"{folder}/cells.parquet"), f"{folder}/cells.geojson", ["id"], "id", one_file=True)
    back = FE.read_features(spark, f"{folder}/cells.geojson", properties="name string, balance double")
    return back.select("id", "name", "balance", F.round(G.area(F.col("geometry")), 6).alias("polygon_area"))


@query("text_tables_round_trip", """SELECT e.event_id, e.event_type, e.value, e.user_id FROM events e
WHERE e.user_id % 3 = 0 AND e.event_type IS NOT NULL""")
def text_tables_round_trip(spark, sf):
    """Events as a gzipped table, a folder per type with id lists, and edges; rows chosen by the id list that was written."""
    folder = step_path(spark)
    events = table(spark, sf, "events").select("event_id", "event_type", "value", "user_id")
    TA.write_table(events, f"{folder}/events.tsv.gz")
    TA.write_groups(events.withColumn("chosen", F.when(F.col("user_id") % 3 == 0, "yes").otherwise("no")), "chosen", f"{folder}/groups", "event_id")
    ids = TA.read_id_list(spark, f"{folder}/groups/ids/_group=yes")
    back = TA.read_table(spark, f"{folder}/events.tsv.gz", schema="event_id bigint, event_type string, value double, user_id bigint")
    return M.subset_by_ids(back.filter("event_type is not null"), ids, ["event_id"])


@query("edges_and_chains_round_trip", f"WITH RECURSIVE {SQL_CHAINS} SELECT chain, array_to_string(members, ',') AS members, l.n AS n_links FROM chn, (SELECT count(*) AS n FROM links) l")
def edges_and_chains_round_trip(spark, sf):
    """Links as edge text, chains as lists of positions, both read again."""
    folder, links = step_path(spark), materialize(mbn(spark, sf)).select("a", "b", "dist", "ct")
    TA.write_edges(links, f"{folder}/edges.tsv.gz")
    edges = materialize(TA.read_edges(spark, f"{folder}/edges.tsv.gz"))
    TA.write_chains(CH.chains(CH.choose_links(CH.threads(edges), 30.0, 3)), f"{folder}/chains.txt.gz")
    count = F.lit(edges.count()).cast("long")
    return TA.read_chains(spark, f"{folder}/chains.txt.gz").select("chain", F.array_join("members", ",").alias("members"), count.alias("n_links"))
