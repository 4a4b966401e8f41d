"""Queries over detector boxes: routing, ports, overlaps, designators."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions import dims, geom
from netloom.operators import detect
from netloom.plans import sqlgeo as g
from netloom.plans.fixtures import sql_list
from netloom.plans.registry import query

BOX = ["image_id", "idx", "cls", "conf", "x1", "y1", "x2", "y2"]


@query("P01_route_boxes", ("boxes",), """SELECT image_id, idx, CASE WHEN cls IN ('junction','terminal') AND conf>=0.1
 THEN 'junction' WHEN cls='text' AND conf>=0.4 THEN 'text' WHEN cls NOT IN ('crossover','probe.current','probe.voltage')
 AND conf>=0.4 THEN 'component' END AS route FROM boxes""")
def _(t):
    return detect.route_boxes(t.boxes).select("image_id", "idx", "route")


@query("P02_annotation_filter", ("boxes",), """SELECT * FROM boxes WHERE conf>=0.4 AND cls NOT IN
 ('junction','crossover','text','probe.current','probe.voltage','explanatory')""")
def _(t):
    return detect.profile_filter(t.boxes, "annotation").select(*BOX)


@query("P03_reading_filter", ("boxes",), """SELECT * FROM boxes WHERE conf>=0.45 AND cls NOT IN
 ('text','junction','crossover','terminal')""")
def _(t):
    return detect.profile_filter(t.boxes, "reading").select(*BOX)


@query("P04_box_centre", ("boxes",), "SELECT image_id, idx, (x1+x2)//2 AS cx, (y1+y2)//2 AS cy FROM boxes")
def _(t):
    return detect.with_centre(t.boxes).select("image_id", "idx", "cx", "cy")


for _profile in ("wiring", "annotation", "reading"):
    @query(f"P05_J02_place_ports_{_profile}", (f"ports_{_profile}",),
           f"SELECT image_id, ci, name, pi, px, py FROM ports_{_profile}")
    def _(t, profile=_profile):
        return t.ports(profile).select("image_id", "ci", "name", "pi", "px", "py")


@query("P06_orientation_by_shape", ("comps_wiring", "templates_wiring"), """SELECT image_id, idx,
 (t.port_key IS NOT NULL AND cls NOT IN ('gnd','vss') AND name<>'GND' AND
  CASE WHEN cls='diode.light_emitting' THEN r<0.55 WHEN cls='capacitor.polarized' THEN r<0.75
  WHEN t.flat THEN r>1.5 ELSE r<0.6 END) IS TRUE AS turned
 FROM (SELECT *, CAST(y2-y1 AS DOUBLE)/greatest(x2-x1,1) AS r FROM comps_wiring) c
 LEFT JOIN (SELECT * FROM templates_wiring WHERE pi=0 AND n_ports=2) t USING (port_key)""")
def _(t):
    two = dims.templates(t.spark, "wiring").where("pi = 0 and n_ports = 2")
    turned = detect.turned(geom.box(""), F.col("cls"), F.col("name"), F.col("n_ports"), F.col("flat"))
    return t.comps("wiring").join(two, "port_key", "left").select(
        "image_id", "idx", F.coalesce(turned, F.lit(False)).alias("turned"))


@query("P07_orientation_by_side", ("comps_reading", "templates_reading"), """SELECT image_id, idx, t.pi,
 CAST(trunc(x1+(CASE WHEN y2-y1>x2-x1 THEN 1-ry ELSE rx END)*(x2-x1)) AS BIGINT) AS px,
 CAST(trunc(y1+(CASE WHEN y2-y1>x2-x1 THEN rx ELSE ry END)*(y2-y1)) AS BIGINT) AS py
 FROM comps_reading c JOIN templates_reading t ON c.name=t.port_key
 UNION ALL SELECT image_id, idx, p AS pi, CASE WHEN p=0 THEN x1 ELSE x2 END, (y1+y2)//2 FROM comps_reading, (VALUES (0),(1)) v(p)
 WHERE name NOT IN (SELECT port_key FROM templates_reading)""")
def _(t):
    comps = t.comps("reading").withColumn("port_key", F.col("name"))
    cols = ["image_id", "idx", "pi", "px", "py"]
    return detect.place_ports(comps, "segments").select(*cols).unionByName(detect.side_ports(comps).select(*cols))


@query("P08_scaled_limits", ("limits",), "SELECT image_id, pjr, pjf, jj_align, jj_max, p2p_max, p2p_line, agg_p2p, "
       "skel_search, skel_gap, grid_snap, uf_merge FROM limits")
def _(t):
    return detect.thresholds(t.images).select("image_id", *dims.SCALED)


@query("P10_texts_outside_components", ("comps_reading", "texts"), f"""SELECT image_id, text_ord, text FROM texts t WHERE NOT EXISTS
 (SELECT 1 FROM comps_reading c WHERE c.image_id=t.image_id AND {g.inter('t', 'c')} > {g.area('t')}*0.5)""")
def _(t):
    return detect.outside(t.texts, t.comps("reading")).select("image_id", "text_ord", "text")


@query("P11_texts_outside_grounds", ("comps_wiring", "texts"), f"""SELECT image_id, text_ord, text FROM texts t WHERE NOT EXISTS
 (SELECT 1 FROM comps_wiring c WHERE c.image_id=t.image_id AND c.name='GND' AND {g.inter('t', 'c')} > {g.area('t')}*0.5)""")
def _(t):
    return detect.outside(t.texts, t.comps("wiring").where("name = 'GND'")).select("image_id", "text_ord", "text")


@query("P14_part_classes", ("boxes",), """SELECT image_id, idx, cls NOT IN ('junction','crossover','text','probe.current',
 'probe.voltage') AS is_part, cls='terminal' AS is_terminal FROM boxes""")
def _(t):
    c = F.col("cls")
    return t.boxes.select("image_id", "idx", detect.is_part_class(c).alias("is_part"), (c == "terminal").alias("is_terminal"))


@query("P15_clamped_boxes", ("boxes", "images"), """SELECT image_id, idx, nx1, ny1, greatest(nx1+2, least(x2, width//3)) AS nx2,
 greatest(ny1+2, least(y2, height//4)) AS ny2 FROM (SELECT *, greatest(0, least(x1, width//3-1)) AS nx1,
 greatest(0, least(y1, height//4-1)) AS ny1 FROM boxes JOIN images USING (image_id))""")
def _(t):
    w, h = F.floor(F.col("width") / 3), F.floor(F.col("height") / 4)
    out = geom.clamped(geom.box(""), w, h)
    return t.boxes.join(t.images, "image_id").select(
        "image_id", "idx", *[c.alias(n) for c, n in zip(out, ("nx1", "ny1", "nx2", "ny2"))])


@query("P17_same_position", ("boxes",), """SELECT a.image_id, a.idx AS a, b.idx AS b FROM boxes a JOIN boxes b
 ON a.image_id=b.image_id AND a.idx<b.idx AND abs(a.x1-b.x1)<30 AND abs(a.y1-b.y1)<30 AND abs(a.x2-b.x2)<30 AND abs(a.y2-b.y2)<30""")
def _(t):
    return detect.duplicates(t.boxes, tol=30)


@query("J01_names_and_display", ("comps_wiring",), "SELECT image_id, idx, name, display, port_key FROM comps_wiring")
def _(t):
    return t.comps("wiring").select("image_id", "idx", "name", "display", "port_key")


@query("J03_port_labels", ("ports_annotation", "labels_annotation"), """SELECT image_id, ci, pi, coalesce(label,'?') AS label
 FROM ports_annotation LEFT JOIN labels_annotation USING (name, pi)""")
def _(t):
    return detect.with_labels(t.ports("annotation"), "annotation").select("image_id", "ci", "pi", "label")


@query("J03_port_labels_by_index", ("ports_annotation", "labels_annotation"), """SELECT image_id, ci, pi, coalesce(label,CAST(pi AS VARCHAR)) AS label
 FROM ports_annotation LEFT JOIN labels_annotation USING (name, pi)""")
def _(t):
    return detect.with_labels(t.ports("annotation"), "annotation", by_index=True).select("image_id", "ci", "pi", "label")


@query("W01_designators_annotation", ("comps_annotation",), f"""SELECT image_id, idx, prefix||row_number() OVER
 (PARTITION BY image_id, prefix ORDER BY idx) AS designator FROM (SELECT *, coalesce(MAP {{{','.join(
    f"'{n}':'{p}'" for n, p in dims.PREFIXES['annotation'].items())}}}[name], left(name,1)) AS prefix FROM comps_annotation)""")
def _(t):
    return detect.designators(t.comps("annotation"), "annotation", t.image_guard).select("image_id", "idx", "designator")


@query("W01_designators_wiring", ("comps_wiring",), f"""SELECT image_id, idx, CASE WHEN name='GND' THEN 'GND' ELSE prefix||row_number() OVER
 (PARTITION BY image_id, prefix ORDER BY idx) END AS designator FROM (SELECT *, coalesce(MAP {{{','.join(
    f"'{n}':'{p}'" for n, p in dims.PREFIXES['wiring'].items())}}}[name], 'X') AS prefix FROM comps_wiring)""")
def _(t):
    return detect.designators(t.comps("wiring"), "wiring", t.image_guard).select("image_id", "idx", "designator")


@query("W02_dense_reindex", ("comps_annotation",), """SELECT image_id, idx, row_number() OVER (PARTITION BY image_id ORDER BY idx)-1
 AS new_idx FROM comps_annotation""")
def _(t):
    return detect.reindex(t.comps("annotation"), t.image_guard).select("image_id", "idx", "new_idx")


@query("A15_source_correction", ("comps_wiring",), f"""SELECT image_id, idx, CASE WHEN dc THEN 'V-DC' WHEN ac THEN 'V-AC' ELSE name END AS name,
 CASE WHEN dc THEN 'voltage.dc' WHEN ac THEN 'voltage.ac' ELSE cls END AS cls FROM (SELECT *,
  name='V-AC' AND bool_or(name='GND') OVER w AND bool_or(name IN {tuple(dims.RESISTIVE_LOADS)}) OVER w AS dc,
  name='V-DC' AND NOT bool_or(name='GND') OVER w AND conf<0.5 AS ac FROM comps_wiring WINDOW w AS (PARTITION BY image_id))""")
def _(t):
    return detect.fix_sources(t.comps("wiring")).select("image_id", "idx", "name", "cls")


@query("F18_overlap_ratio", ("boxes",), f"""SELECT a.image_id, a.idx AS a, b.idx AS b, round({g.iou('a', 'b')},9) AS iou
 FROM boxes a JOIN boxes b ON a.image_id=b.image_id AND a.idx<b.idx AND {g.overlaps('a', 'b')}""")
def _(t):
    p = detect.overlap_pairs(t.boxes, t.boxes, same=True)
    return p.select("image_id", F.col("l_idx").alias("a"), F.col("r_idx").alias("b"),
                    F.round(geom.iou(geom.box("l_"), geom.box("r_")), 9).alias("iou"))


_SPEC = "coalesce(MAP {" + ",".join(f"'{c}':{v}" for c, v in dims.SPECIFICITY.items()) + "}[%s], 0)"
_FAM = "MAP {" + ",".join(f"'{c}':{i}" for i, f in enumerate(dims.FAMILIES['annotation']) for c in f) + "}[%s]"


def _walk(pairs: str, prefix: str = "") -> str:
    """SQL: walk the ordered pairs of each picture one by one, keeping the list of removed boxes."""
    return f"""{prefix} pairs AS ({pairs}),
 steps AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY a, b) AS n FROM pairs),
 walk(image_id, n, gone) AS (SELECT DISTINCT image_id, 0::BIGINT, []::BIGINT[] FROM steps UNION ALL
  SELECT w.image_id, s.n, CASE WHEN list_contains(gone, s.a) OR list_contains(gone, s.b) THEN gone ELSE list_append(gone, s.loser) END
  FROM walk w JOIN steps s ON s.image_id=w.image_id AND s.n=w.n+1),
 gone AS (SELECT image_id, unnest(arg_max(gone, n)) AS idx FROM walk GROUP BY image_id)"""


@query("J26_same_family_overlaps", ("comps_annotation",), _walk(
    f"""SELECT a.image_id, a.idx AS a, b.idx AS b, CASE WHEN {_SPEC % 'a.cls'}>={_SPEC % 'b.cls'} THEN b.idx ELSE a.idx END AS loser
 FROM comps_annotation a JOIN comps_annotation b ON a.image_id=b.image_id AND a.idx<b.idx AND {_FAM % 'a.cls'}={_FAM % 'b.cls'}
 AND {g.overlaps('a', 'b')} AND {g.iou('a', 'b')}>0.35""", ",")
    + " SELECT image_id, idx, cls FROM comps_annotation ANTI JOIN gone USING (image_id, idx)", recursive=True)
def _(t):
    c = t.comps("annotation")
    return detect.suppress(c, detect.family_conflicts(c, "annotation")).select("image_id", "idx", "cls")


_FAMW = "(CASE " + " ".join(f"WHEN %s IN ({','.join(repr(c) for c in f)}) THEN {i}" for i, f in enumerate(dims.FAMILIES["wiring"])) + " END)"


@query("J26_wiring_family_overlaps", ("comps_wiring",), _walk(
    f"""SELECT a.image_id, a.idx AS a, b.idx AS b, CASE WHEN {_SPEC % 'a.cls'}>={_SPEC % 'b.cls'} THEN b.idx ELSE a.idx END AS loser
 FROM comps_wiring a JOIN comps_wiring b ON a.image_id=b.image_id AND a.idx<b.idx AND {_FAMW.replace('%s', 'a.cls')}={_FAMW.replace('%s', 'b.cls')}
 AND {g.overlaps('a', 'b')} AND {g.iou('a', 'b')}>0.35""", ",")
    + " SELECT image_id, idx, cls FROM comps_wiring ANTI JOIN gone USING (image_id, idx)", recursive=True)
def _(t):
    c = t.comps("wiring")
    return detect.suppress(c, detect.family_conflicts(c, "wiring")).select("image_id", "idx", "cls")


def _any_sql(limit):
    return _walk(f"""SELECT a.image_id, a.idx AS a, b.idx AS b, CASE WHEN a.conf>=b.conf THEN b.idx ELSE a.idx END AS loser
 FROM boxes a JOIN boxes b ON a.image_id=b.image_id AND a.idx<b.idx AND {g.overlaps('a', 'b')} AND {g.iou('a', 'b')}>{limit}""", ",") + " SELECT image_id, idx, cls FROM boxes ANTI JOIN gone USING (image_id, idx)"


@query("J27_any_family_overlaps", ("boxes",), _any_sql(0.3), recursive=True)
def _(t):
    return detect.suppress(t.boxes, detect.any_conflicts(t.boxes, 0.3)).select("image_id", "idx", "cls")


@query("J27_default_limit", ("boxes",), _any_sql(0.7), recursive=True)
def _(t):
    return detect.suppress(t.boxes, detect.any_conflicts(t.boxes)).select("image_id", "idx", "cls")


_MATCH = f""", pairs AS (SELECT a.image_id, a.idx AS p, b.idx AS d, {g.iou('a', 'b')} AS s FROM boxes a JOIN refs b
  ON a.image_id=b.image_id AND {g.overlaps('a', 'b')} AND {g.iou('a', 'b')}>0.3),
 steps AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY p, s DESC, d) AS n FROM pairs),
 walk(image_id, n, ps, ds) AS (SELECT DISTINCT image_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM steps UNION ALL
  SELECT w.image_id, s.n, CASE WHEN list_contains(ps, s.p) OR list_contains(ds, s.d) THEN ps ELSE list_append(ps, s.p) END,
  CASE WHEN list_contains(ps, s.p) OR list_contains(ds, s.d) THEN ds ELSE list_append(ds, s.d) END
  FROM walk w JOIN steps s ON s.image_id=w.image_id AND s.n=w.n+1),
 matched AS (SELECT image_id, unnest(arg_max(ps, n)) AS pred_idx, unnest(arg_max(ds, n)) AS ref_idx FROM walk GROUP BY image_id)"""


@query("J04_match_boxes", ("boxes", "refs"), _MATCH + " SELECT * FROM matched", recursive=True)
def _(t):
    return detect.match_boxes(t.boxes, t.refs)


@query("F22_relative_boxes", ("boxes", "images"), """SELECT image_id, idx, round((CAST(x1 AS DOUBLE)+x2)/2/width,9) AS cx,
 round((CAST(y1 AS DOUBLE)+y2)/2/height,9) AS cy, round((CAST(x2 AS DOUBLE)-x1)/width,9) AS bw, round((CAST(y2 AS DOUBLE)-y1)/height,9) AS bh FROM boxes JOIN images USING (image_id)""")
def _(t):
    rel = geom.to_relative(geom.box(""), F.col("width"), F.col("height"))
    return t.boxes.join(t.images, "image_id").select(
        "image_id", "idx", *[F.round(c, 9).alias(n) for c, n in zip(rel, ("cx", "cy", "bw", "bh"))])


@query("F22_pixel_boxes", ("boxes",), """SELECT image_id, idx, CAST(trunc((cx-bw/2)*640) AS BIGINT) AS px1, CAST(trunc((cy-bh/2)*480) AS BIGINT) AS py1,
 CAST(trunc((cx+bw/2)*640) AS BIGINT) AS px2, CAST(trunc((cy+bh/2)*480) AS BIGINT) AS py2 FROM (SELECT image_id, idx,
 CAST(x1 AS DOUBLE)/600 AS cx, CAST(y1 AS DOUBLE)/500 AS cy, CAST(x2-x1 AS DOUBLE)/700 AS bw, CAST(y2-y1 AS DOUBLE)/700 AS bh FROM boxes)""")
def _(t):
    d = lambda c: F.col(c).cast("double")
    px = geom.to_pixels(d("x1") / 600, d("y1") / 500, (F.col("x2") - F.col("x1")).cast("double") / 700,
                        (F.col("y2") - F.col("y1")).cast("double") / 700, 640, 480)
    return t.boxes.select("image_id", "idx", *[c.alias(n) for c, n in zip(px, ("px1", "py1", "px2", "py2"))])


@query("F23_class_ids", ("boxes",), f"""SELECT image_id, idx, list_position({sql_list(dims.CLASSES_V13)}, cls)-1 AS cid FROM boxes
 WHERE list_contains({sql_list(dims.CLASSES_V13)}, cls)""")
def _(t):
    classes = F.array(*[F.lit(c) for c in dims.CLASSES_V13])
    cid = (F.array_position(classes, F.col("cls")) - 1).cast("int")
    return t.boxes.select("image_id", "idx", cid.alias("cid")).where("cid >= 0")
