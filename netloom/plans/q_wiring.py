"""Queries over wiring stages and the whole wiring run."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from netloom import session
from netloom.functions import dims, geom
from netloom.lineage import cut
from netloom.operators import circuit, detect, experiments, ranks, spatial, wiring
from netloom.plans import sqlgeo as g
from netloom.plans.registry import query

_J = """, j AS (SELECT image_id, jx, jy, row_number() OVER (PARTITION BY image_id ORDER BY jy, jx) AS jord FROM junctions)"""
_P2J0 = _J + f""", p2j0 AS (SELECT image_id, ci, pi, n_ports, px, py, b.jx AS jx, b.jy AS jy, b.d AS d FROM (SELECT p.image_id, p.ci, p.pi, p.n_ports, p.px, p.py,
  min(row(d, jord, jx, jy)::STRUCT(d DOUBLE, jord BIGINT, jx BIGINT, jy BIGINT)) AS b FROM (SELECT p.*, j.jx, j.jy, j.jord, {g.dist('px', 'py', 'jx', 'jy')} AS d FROM ports_wiring p JOIN j USING (image_id)) p
  JOIN limits l USING (image_id) WHERE d < l.pjr AND NOT {g.crosses(('p.px', 'p.py'), ('p.jx', 'p.jy'), 'p.ci', 'comps_wiring', 'p.image_id')} GROUP BY ALL)),
 p2j AS (SELECT image_id, ci, pi, jx, jy FROM (SELECT *, count(*) OVER w AS k, row_number() OVER (PARTITION BY image_id, ci, jx, jy ORDER BY d, pi) AS r FROM p2j0 WINDOW w AS (PARTITION BY image_id, ci, jx, jy))
  WHERE NOT ((n_ports=2 AND r>1) OR (n_ports>=3 AND k=n_ports AND r>2)))"""
_NEED = ("ports_wiring", "comps_wiring", "junctions", "limits")


class Inputs:
    """Inputs of the wiring stages over the derived tables, with the links after the first clean-up."""

    def __init__(self, t):
        self.comps = cut(t.comps("wiring"), "comps")
        self.ports = cut(detect.place_ports(self.comps, "wiring").withColumnRenamed("idx", "ci").select(
            "image_id", "ci", "pi", "px", "py", "n_ports", "name"), "ports")
        self.junctions = cut(wiring.base_junctions(t.junctions), "junctions")
        self.limits = detect.thresholds(t.images)

    def links0(self, carried=()):
        return wiring.nearest_junctions(self.ports, self.junctions, self.comps, self.limits, carried)

    @cached_property
    def _links(self):
        return cut(wiring.drop_own_shorts(self.links0(wiring.PORT), self.ports), "links")

    def links(self):
        return self._links

    @cached_property
    def jj(self):
        return cut(wiring.nearest_by_direction(self.junctions, self.links(), self.comps, self.limits), "jj")

    @cached_property
    def groups(self):
        return cut(wiring.port_groups(self.ports, self.links(), self.jj), "groups")


_inputs: dict[tuple[str, str], Inputs] = {}


def Stage(t) -> Inputs:
    """The written inputs of one folder, made once per session and shared by the stage queries."""
    key = (t.spark.sparkContext.applicationId, t.folder, t.version)
    if key not in _inputs:
        _inputs[key] = Inputs(t)
    made = _inputs[key]
    session.by_image(t.spark, spatial.crowded(made.comps, made.ports, made.junctions) is None)
    return made


LINK = ["image_id", "ci", "pi", "jx", "jy"]


@query("W04_snap_points", ("boxes",), """, j AS (SELECT image_id, idx, (x1+x2)//2 AS x, (y1+y2)//2 AS y FROM boxes),
 sx AS (SELECT image_id, x, CAST(trunc(median(x) OVER (PARTITION BY image_id, run)) AS BIGINT) AS nx FROM (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY x) AS run FROM
  (SELECT *, CASE WHEN x-lag(x) OVER (PARTITION BY image_id ORDER BY x)>15 THEN 1 ELSE 0 END AS n FROM (SELECT DISTINCT image_id, x FROM j)))),
 sy AS (SELECT image_id, y, CAST(trunc(median(y) OVER (PARTITION BY image_id, run)) AS BIGINT) AS ny FROM (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY y) AS run FROM
  (SELECT *, CASE WHEN y-lag(y) OVER (PARTITION BY image_id ORDER BY y)>15 THEN 1 ELSE 0 END AS n FROM (SELECT DISTINCT image_id, y FROM j))))
 SELECT image_id, idx, nx AS x, ny AS y FROM j JOIN sx USING (image_id, x) JOIN sy USING (image_id, y)""")
def _(t):
    pts = detect.with_centre(t.boxes).select("image_id", "idx", F.col("cx").alias("x"), F.col("cy").alias("y"))
    return wiring.snap(pts, "x", "y", F.lit(15)).select("image_id", "idx", "x", "y")


def _closure(edge_cond: str) -> str:
    return f""", nodes AS (SELECT image_id, idx AS node, (x1+x2)//2 AS x, (y1+y2)//2 AS y FROM boxes),
 e AS (SELECT a.image_id, a.node AS a, b.node AS b FROM nodes a JOIN nodes b ON a.image_id=b.image_id AND {edge_cond}),
 reach(image_id, node, to_) AS (SELECT image_id, node, node FROM nodes UNION SELECT r.image_id, r.node, e.b FROM reach r JOIN e ON e.image_id=r.image_id AND e.a=r.to_),
 comp AS (SELECT image_id, node, min(to_) AS comp FROM reach GROUP BY ALL),
 mean AS (SELECT image_id, comp, CAST(trunc(sum(x)/count(*)) AS BIGINT) AS mx, CAST(trunc(sum(y)/count(*)) AS BIGINT) AS my FROM comp JOIN nodes USING (image_id, node) GROUP BY ALL)
 SELECT image_id, node AS idx, mx, my FROM comp JOIN mean USING (image_id, comp)"""


@query("G02_A17_merge_points", ("boxes",), _closure(f"{g.dist('a.x', 'a.y', 'b.x', 'b.y')}<=60"), recursive=True)
def _(t):
    pts = detect.with_centre(t.boxes).select("image_id", "idx", "cx", "cy")
    return wiring.merge_points(pts, "cx", "cy", F.lit(60)).select("image_id", "idx", "mx", "my")


@query("G03_merge_ports", ("boxes",), _closure("abs(a.x-b.x)<=50 AND abs(a.y-b.y)<=50"), recursive=True)
def _(t):
    pts = detect.with_centre(t.boxes).select("image_id", "idx", "cx", "cy")
    return wiring.merge_points(pts, "cx", "cy", F.lit(50), round_metric=False).select("image_id", "idx", "mx", "my")


@query("W07_junction_numbers", ("junctions",), "SELECT image_id, jx, jy, 'J'||row_number() OVER (PARTITION BY image_id ORDER BY jy, jx) AS jid FROM junctions")
def _(t):
    return ranks.row_number(t.junctions, ["image_id"], ["jy", "jx"], "n", guard=t.image_guard).select(
        "image_id", "jx", "jy", F.concat(F.lit("J"), F.col("n").cast("string")).alias("jid"))


_REF_SEG = (("a.cx", "a.cy"), ("b.cx", "b.cy"))


@query("J13_F20_F21_crossings", ("comps_wiring",), f""", c AS (SELECT *, (x1+x2)//2 AS cx, (y1+y2)//2 AS cy FROM comps_wiring)
 SELECT a.image_id, a.idx AS ia, b.idx AS ib FROM c a JOIN c b ON a.image_id=b.image_id AND b.idx=a.idx+1 WHERE {g.crosses(*_REF_SEG, 'a.idx', 'comps_wiring', 'a.image_id')}""")
def _(t):
    c = detect.with_centre(t.comps("wiring"))
    a = c.select("image_id", F.col("idx").alias("ia"), F.col("idx").alias("own"), F.col("cx").alias("sx1"), F.col("cy").alias("sy1"), (F.col("idx") + 1).alias("ib"))
    b = c.select("image_id", F.col("idx").alias("ib"), F.col("cx").alias("sx2"), F.col("cy").alias("sy2"))
    return wiring.crossing(a.join(b, ["image_id", "ib"]), t.comps("wiring"), ["ia", "ib"])


@query("J14_O04_nearest_junction", _NEED, _P2J0 + " SELECT image_id, ci, pi, jx, jy FROM p2j0")
def _(t):
    return Stage(t).links0().select(*LINK)


@query("W06_drop_own_shorts", _NEED, _P2J0 + " SELECT * FROM p2j")
def _(t):
    return Stage(t).links().select(*LINK)


_CHOICE = f""", openp AS (SELECT * FROM ports_wiring ANTI JOIN p2j USING (image_id, ci, pi)),
 cand AS (SELECT p.image_id, p.ci, p.pi, q.ci AS cj, q.pi AS pj, {g.dist('p.px', 'p.py', 'q.px', 'q.py')} AS d, (p.px+q.px)//2 AS mx, (p.py+q.py)//2 AS my
  FROM openp p JOIN ports_wiring q ON p.image_id=q.image_id AND p.ci<>q.ci JOIN limits l ON l.image_id=p.image_id
  WHERE {g.dist('p.px', 'p.py', 'q.px', 'q.py')} < l.%s AND (abs(p.px-q.px)<15 OR abs(p.py-q.py)<15 OR NOT {g.crosses(('p.px', 'p.py'), ('q.px', 'q.py'), 'p.ci', 'comps_wiring', 'p.image_id')})),
 pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, ci, pi ORDER BY d, cj, pj) AS r FROM cand) WHERE r=1),
 steps AS (SELECT *, ci*4294967296+pi AS p, cj*4294967296+pj AS t, row_number() OVER (PARTITION BY image_id ORDER BY ci, pi) AS n FROM pick),
 walk(image_id, n, busy, acted) AS (SELECT DISTINCT image_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM steps UNION ALL
  SELECT w.image_id, s.n, CASE WHEN list_contains(busy, s.p) THEN busy ELSE list_append(list_append(busy, s.p), s.t) END, CASE WHEN list_contains(busy, s.p) THEN acted ELSE list_append(acted, s.p) END
  FROM walk w JOIN steps s ON s.image_id=w.image_id AND s.n=w.n+1),
 acted AS (SELECT image_id, unnest(arg_max(acted, n)) AS p FROM walk GROUP BY image_id)
 SELECT image_id, ci, pi, mx AS jx, my AS jy FROM steps JOIN acted USING (image_id, p) UNION ALL SELECT image_id, cj, pj, mx, my FROM steps JOIN acted USING (image_id, p)"""


@query("J15_port_fallback", _NEED, _P2J0 + _CHOICE % "p2p_max", recursive=True)
def _(t):
    s = Stage(t)
    return wiring.port_fallback(s.ports, s.comps, s.limits, s.links(), "p2p_max", 1).select(*LINK)


@query("J17_close_port_fallback", _NEED, _P2J0 + _CHOICE % "agg_p2p", recursive=True)
def _(t):
    s = Stage(t)
    return wiring.port_fallback(s.ports, s.comps, s.limits, s.links(), "agg_p2p", 3).select(*LINK)


_SECOND = f""", openp AS (SELECT * FROM ports_wiring ANTI JOIN p2j USING (image_id, ci, pi)),
 cand AS (SELECT p.image_id, p.ci, p.pi, p.n_ports, j.jx, j.jy, j.jord, {g.dist('p.px', 'p.py', 'j.jx', 'j.jy')} AS d FROM openp p JOIN j USING (image_id) JOIN limits l USING (image_id)
  WHERE {g.dist('p.px', 'p.py', 'j.jx', 'j.jy')} < l.pjf AND NOT {g.crosses(('p.px', 'p.py'), ('j.jx', 'j.jy'), 'p.ci', 'comps_wiring', 'p.image_id')}),
 s1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, ci, pi ORDER BY d, jord) AS r FROM cand c WHERE n_ports<>2 OR (pi=0 AND NOT EXISTS (SELECT 1 FROM p2j o WHERE o.image_id=c.image_id AND o.ci=c.ci AND o.pi=1 AND o.jx=c.jx AND o.jy=c.jy))) WHERE r=1),
 s2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, ci, pi ORDER BY d, jord) AS r FROM cand c WHERE n_ports=2 AND pi=1 AND NOT EXISTS (SELECT 1 FROM
   (SELECT image_id, ci, pi, jx, jy FROM p2j UNION ALL SELECT image_id, ci, pi, jx, jy FROM s1) o WHERE o.image_id=c.image_id AND o.ci=c.ci AND o.pi=0 AND o.jx=c.jx AND o.jy=c.jy)) WHERE r=1)
 SELECT image_id, ci, pi, jx, jy FROM s1 UNION ALL SELECT image_id, ci, pi, jx, jy FROM s2"""


@query("J16_second_junction", _NEED, _P2J0 + _SECOND)
def _(t):
    s = Stage(t)
    return wiring.second_junctions(s.ports, s.junctions, s.comps, s.limits, s.links()).select(*LINK)


_JJ = f""", at_ AS (SELECT p.image_id, jx, jy, ci, name, list_sort(list(DISTINCT pi)) AS pins FROM p2j p JOIN comps_wiring c ON c.image_id=p.image_id AND c.idx=p.ci GROUP BY ALL),
 js AS (SELECT j.*, coalesce(cs, []) AS cs, coalesce(live, 0) AS live FROM j LEFT JOIN (SELECT image_id, jx, jy, list_sort(list(ci)) AS cs, count(*) FILTER (name<>'GND') AS live FROM at_ GROUP BY ALL) USING (image_id, jx, jy)),
 jj AS (SELECT a.image_id, a.jx AS ax, a.jy AS ay, b.jx AS bx, b.jy AS by, a.jord AS oa, b.jord AS ob, {g.dist('a.jx', 'a.jy', 'b.jx', 'b.jy')} AS d, l.jj_align FROM js a JOIN js b ON a.image_id=b.image_id AND a.jord<b.jord JOIN limits l ON l.image_id=a.image_id
  WHERE NOT (len(a.cs)>0 AND a.cs=b.cs) AND (a.live>0 OR b.live>0) AND NOT EXISTS (SELECT 1 FROM at_ x JOIN at_ y ON x.image_id=y.image_id AND x.ci=y.ci AND x.pins<>y.pins
    WHERE x.image_id=a.image_id AND x.jx=a.jx AND x.jy=a.jy AND y.jx=b.jx AND y.jy=b.jy)
  AND ({g.dist('a.jx', 'a.jy', 'b.jx', 'b.jy')}<12 OR (((abs(a.jy-b.jy)<l.jj_align AND abs(a.jx-b.jx)>10) OR (abs(a.jx-b.jx)<l.jj_align AND abs(a.jy-b.jy)>10)) AND {g.dist('a.jx', 'a.jy', 'b.jx', 'b.jy')}<l.jj_max)))"""


@query("J18_junction_pairs", _NEED, _P2J0 + _JJ + " SELECT image_id, ax, ay, bx, by, round(d,6) AS d FROM jj")
def _(t):
    s = Stage(t)
    return wiring.junction_pairs(s.junctions, s.links(), s.comps, s.limits).select("image_id", "ax", "ay", "bx", "by", F.round("d", 6).alias("d"))


_NN = """, both_ AS (SELECT image_id, ax, ay, bx, by, d, oa, ob, jj_align FROM jj UNION ALL SELECT image_id, bx, by, ax, ay, d, oa, ob, jj_align FROM jj),
 ways AS (SELECT *, unnest([CASE WHEN abs(by-ay)<jj_align AND bx<ax THEN 0 END, CASE WHEN abs(by-ay)<jj_align AND bx>ax THEN 1 END, CASE WHEN abs(bx-ax)<jj_align AND by<ay THEN 2 END, CASE WHEN abs(bx-ax)<jj_align AND by>ay THEN 3 END]) AS way FROM both_),
 nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, ax, ay, way ORDER BY d, oa, ob) AS r FROM ways WHERE way IS NOT NULL) WHERE r=1)"""


@query("W05_nearest_by_direction", _NEED, _P2J0 + _JJ + _NN + " SELECT image_id, ax, ay, bx, by, way FROM nn")
def _(t):
    s = Stage(t)
    return wiring.nearest_by_direction(s.junctions, s.links(), s.comps, s.limits)


@query("W14_degree_cap_of_candidates", _NEED, _P2J0 + _JJ + """, steps AS MATERIALIZED (SELECT image_id, ax, ay, bx, by, ax*4294967296+ay AS ea, bx*4294967296+by AS eb, row_number() OVER (PARTITION BY image_id ORDER BY oa, ob) AS n FROM jj),
 walk(image_id, n, ends, kept) AS (SELECT DISTINCT image_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM steps UNION ALL
  SELECT image_id, n, CASE WHEN full_ THEN ends ELSE list_concat(ends, [ea, eb]) END, CASE WHEN full_ THEN kept ELSE list_append(kept, n) END FROM (
   SELECT w.image_id, s.n, w.ends, w.kept, ea, eb, len(list_filter(w.ends, lambda e: e=ea))>=10 OR len(list_filter(w.ends, lambda e: e=eb))>=10 AS full_
   FROM walk w JOIN steps s ON s.image_id=w.image_id AND s.n=w.n+1)),
 kept AS (SELECT image_id, unnest(arg_max(kept, n)) AS n FROM walk GROUP BY image_id)
 SELECT image_id, ax, ay, bx, by FROM steps JOIN kept USING (image_id, n)""", recursive=True)
def _(t):
    s = Stage(t)
    pairs = wiring.junction_pairs(s.junctions, s.links(), s.comps, s.limits).withColumn("ord", F.struct("oa", "ob"))
    return wiring.degree_cap(pairs).select("image_id", "ax", "ay", "bx", "by")


@query("W14_degree_cap", ("boxes",), """, c AS (SELECT image_id, idx, (x1+x2)//2 AS x, (y1+y2)//2 AS y FROM boxes),
 steps AS (SELECT a.image_id, a.idx AS a, b.idx AS b, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by, row_number() OVER (PARTITION BY a.image_id ORDER BY a.idx, b.idx) AS n FROM c a JOIN c b ON a.image_id=b.image_id AND a.idx<b.idx AND b.idx<a.idx+4),
 walk(image_id, n, ends, kept) AS (SELECT DISTINCT image_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM steps UNION ALL
  SELECT image_id, n, CASE WHEN full_ THEN ends ELSE list_concat(ends, [ea, eb]) END, CASE WHEN full_ THEN kept ELSE list_append(kept, n) END FROM (
   SELECT w.image_id, s.n, w.ends, w.kept, s.ax*1048576+s.ay AS ea, s.bx*1048576+s.by AS eb, len(list_filter(w.ends, lambda e: e=s.ax*1048576+s.ay))>=2 OR len(list_filter(w.ends, lambda e: e=s.bx*1048576+s.by))>=2 AS full_
   FROM walk w JOIN steps s ON s.image_id=w.image_id AND s.n=w.n+1)),
 kept AS (SELECT image_id, unnest(arg_max(kept, n)) AS n FROM walk GROUP BY image_id)
 SELECT image_id, a, b FROM steps JOIN kept USING (image_id, n)""", recursive=True)
def _(t):
    c = cut(detect.with_centre(t.boxes).select("image_id", "idx", "cx", "cy"), "centres")
    crowd = spatial.crowded(c)
    session.by_image(t.spark, crowd is None)
    at = spatial.laid(c, crowd)
    a = at.select("image_id", F.col("idx").alias("ia"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.explode(F.array(*[F.col("idx") + k for k in (1, 2, 3)])).alias("ib"))
    b = at.select("image_id", F.col("idx").alias("ib"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    # three pairs a box at most, so that pictures of few boxes have few pairs
    jj = spatial.settled(a.join(b, ["image_id", "ib"]).withColumn("ord", F.struct("ia", "ib")), c)
    return wiring.degree_cap(jj, 2).select("image_id", F.col("ia").alias("a"), F.col("ib").alias("b"))


_LOS = """, on_ AS (SELECT DISTINCT image_id, ci, pi FROM p2j),
 lp AS (SELECT p.*, o.ci IS NOT NULL AS ison FROM ports_wiring p LEFT JOIN on_ o USING (image_id, ci, pi)),
 los AS (SELECT a.image_id, a.ci AS ia, a.pi AS pa, b.ci AS ib, b.pi AS pb, a.px AS ax, a.py AS ay, b.px AS bx, b.py AS by, abs(a.py-b.py)<25 AND abs(a.px-b.px)>5 AS h
  FROM lp a JOIN lp b ON a.image_id=b.image_id AND a.ci<b.ci WHERE NOT (a.name='GND' AND b.name='GND') AND NOT (a.ison AND b.ison)
  AND ((abs(a.py-b.py)<25 AND abs(a.px-b.px)>5) OR (abs(a.px-b.px)<25 AND abs(a.py-b.py)>5))),
 seen AS (SELECT *, sqrt(CAST((ax-bx)*(ax-bx)+(ay-by)*(ay-by) AS DOUBLE)) AS d FROM los l WHERE NOT EXISTS (SELECT 1 FROM comps_wiring k WHERE k.image_id=l.image_id AND k.idx<>ia AND k.idx<>ib AND
  CASE WHEN h THEN k.x2>least(ax,bx)+5 AND k.x1<greatest(ax,bx)-5 AND k.y1<ay+25 AND k.y2>ay-25 ELSE k.y2>least(ay,by)+5 AND k.y1<greatest(ay,by)-5 AND k.x1<ax+25 AND k.x2>ax-25 END)),
 bestp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, ia, ib ORDER BY d, pa, pb) AS r FROM seen) WHERE r=1)"""


@query("J19_sight_lines", _NEED, _P2J0 + _LOS + " SELECT image_id, ia AS ci, pa AS pi, (ax+bx)//2 AS jx, (ay+by)//2 AS jy FROM bestp UNION ALL SELECT image_id, ib, pb, (ax+bx)//2, (ay+by)//2 FROM bestp")
def _(t):
    s = Stage(t)
    return wiring.sight_lines(s.ports, s.comps, s.links()).select(*LINK)


@query("J20_force_last_port", _NEED, _P2J0 + f""", openp AS (SELECT *, count(*) OVER (PARTITION BY image_id, ci) AS k FROM ports_wiring ANTI JOIN p2j USING (image_id, ci, pi))
 SELECT image_id, ci, pi, jx, jy FROM (SELECT p.image_id, p.ci, p.pi, j.jx, j.jy, row_number() OVER (PARTITION BY p.image_id, p.ci, p.pi ORDER BY {g.dist('p.px', 'p.py', 'j.jx', 'j.jy')}, j.jord) AS r
  FROM openp p JOIN j USING (image_id) WHERE k=1 AND {g.dist('p.px', 'p.py', 'j.jx', 'j.jy')}<500 AND NOT EXISTS (SELECT 1 FROM p2j o WHERE o.image_id=p.image_id AND o.ci=p.ci AND o.jx=j.jx AND o.jy=j.jy)
  AND NOT {g.crosses(('p.px', 'p.py'), ('j.jx', 'j.jy'), 'p.ci', 'comps_wiring', 'p.image_id')}) WHERE r=1""")
def _(t):
    s = Stage(t)
    return wiring.force_last(s.ports, s.junctions, s.comps, s.links()).select(*LINK)


@query("J21_close_ports", _NEED, _P2J0 + f""", openp AS (SELECT * FROM ports_wiring ANTI JOIN p2j USING (image_id, ci, pi)),
 steps AS (SELECT a.image_id, a.ci*4294967296+a.pi AS a, b.ci*4294967296+b.pi AS b, (a.px+b.px)//2 AS jx, (a.py+b.py)//2 AS jy, row_number() OVER (PARTITION BY a.image_id ORDER BY a.ci, a.pi, b.ci, b.pi) AS n
  FROM openp a JOIN openp b ON a.image_id=b.image_id AND a.ci<b.ci WHERE {g.dist('a.px', 'a.py', 'b.px', 'b.py')}<50 AND NOT (a.name='GND' AND b.name='GND')),
 walk(image_id, n, busy, kept) AS (SELECT DISTINCT image_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM steps UNION ALL
  SELECT w.image_id, s.n, CASE WHEN list_contains(busy, s.a) OR list_contains(busy, s.b) THEN busy ELSE list_concat(busy, [s.a, s.b]) END, CASE WHEN list_contains(busy, s.a) OR list_contains(busy, s.b) THEN kept ELSE list_append(kept, s.n) END
  FROM walk w JOIN steps s ON s.image_id=w.image_id AND s.n=w.n+1),
 kept AS (SELECT image_id, unnest(arg_max(kept, n)) AS n FROM walk GROUP BY image_id)
 SELECT image_id, a//4294967296 AS ci, a%4294967296 AS pi, jx, jy FROM steps JOIN kept USING (image_id, n) UNION ALL SELECT image_id, b//4294967296, b%4294967296, jx, jy FROM steps JOIN kept USING (image_id, n)""", recursive=True)
def _(t):
    s = Stage(t)
    return wiring.close_ports(s.ports, s.links()).select(*LINK)


_REV = """, rp AS (SELECT image_id, ci, pi, px, py FROM ports_wiring), rl AS (SELECT r.image_id, r.ci, r.pi, q.px AS jx, q.py AS jy FROM rp r JOIN rp q ON q.image_id=r.image_id AND q.pi=r.pi AND q.ci-r.ci IN (-1, 1, 2)),
 here AS (SELECT image_id, px, py, max(ci*4294967296+pi) AS b FROM rp GROUP BY ALL)
 SELECT DISTINCT l.image_id, l.ci*4294967296+l.pi AS a, h.b FROM rl l JOIN here h ON h.image_id=l.image_id AND h.px=l.jx AND h.py=l.jy JOIN rp a ON a.image_id=l.image_id AND a.ci=l.ci AND a.pi=l.pi
 WHERE EXISTS (SELECT 1 FROM rl k WHERE k.image_id=l.image_id AND k.ci*4294967296+k.pi=h.b AND k.jx=a.px AND k.jy=a.py)"""


@query("J30_reverse_pairs", ("ports_wiring",), _REV)
def _(t):
    p = cut(t.ports("wiring").select("image_id", "ci", "pi", "px", "py"), "ports")
    q = p.select("image_id", F.col("ci").alias("cj"), "pi", F.col("px").alias("jx"), F.col("py").alias("jy"))
    # both ways between neighbours, one way to the component after
    step = F.explode(F.array(*[F.col("ci") + k for k in (-1, 1, 2)]))
    links = p.withColumn("cj", step).join(q, ["image_id", "cj", "pi"]).select(*LINK)
    return wiring.reverse_pairs(links, p)


@query("J31_same_wire", ("junctions", "segments"), """SELECT j.image_id, seg AS wire, jx, jy FROM junctions j JOIN (SELECT *, least(x1,x2)*5 AS wx1, least(y1,y2)*5 AS wy1, greatest(x1,x2)*5 AS wx2, greatest(y1,y2)*5 AS wy2 FROM segments) s
 ON s.image_id=j.image_id AND jx BETWEEN wx1-5 AND wx2+5 AND jy BETWEEN wy1-5 AND wy2+5""")
def _(t):
    w = t.segments.select("image_id", F.col("seg").alias("wire"), (F.least("x1", "x2") * 5).alias("x1"), (F.least("y1", "y2") * 5).alias("y1"),
                          (F.greatest("x1", "x2") * 5).alias("x2"), (F.greatest("y1", "y2") * 5).alias("y2"))
    return wiring.same_wire(t.junctions, w)


_GROUPS = """, lead AS (SELECT image_id, jx, jy, min(ci*4294967296+pi) AS lead FROM p2j GROUP BY ALL),
 ed0 AS (SELECT image_id, lead AS a, ci*4294967296+pi AS b FROM p2j JOIN lead USING (image_id, jx, jy) UNION ALL
  SELECT n.image_id, x.lead, y.lead FROM nn n JOIN lead x ON x.image_id=n.image_id AND x.jx=n.ax AND x.jy=n.ay JOIN lead y ON y.image_id=n.image_id AND y.jx=n.bx AND y.jy=n.by UNION ALL
  SELECT l.image_id, l.ci*4294967296+l.pi, h.b FROM p2j l JOIN (SELECT image_id, px, py, max(ci*4294967296+pi) AS b FROM ports_wiring GROUP BY ALL) h ON h.image_id=l.image_id AND h.px=l.jx AND h.py=l.jy JOIN ports_wiring a ON a.image_id=l.image_id AND a.ci=l.ci AND a.pi=l.pi
  WHERE EXISTS (SELECT 1 FROM p2j k WHERE k.image_id=l.image_id AND k.ci*4294967296+k.pi=h.b AND k.jx=a.px AND k.jy=a.py)),
 ed AS (SELECT image_id, a, b FROM ed0 WHERE a<>b UNION SELECT image_id, b, a FROM ed0 WHERE a<>b),
 reach(image_id, node, to_) AS (SELECT image_id, ci*4294967296+pi, ci*4294967296+pi FROM ports_wiring UNION SELECT r.image_id, r.node, e.b FROM reach r JOIN ed e ON e.image_id=r.image_id AND e.a=r.to_),
 grp AS (SELECT image_id, node//4294967296 AS ci, node%4294967296 AS pi, min(to_) AS g FROM reach GROUP BY image_id, node)"""
_UNSHORT = f""", sh AS (SELECT a.image_id, a.ci, CASE WHEN {g.dist('a.px', 'a.py', 'a.jx', 'a.jy')} > {g.dist('b.px', 'b.py', 'b.jx', 'b.jy')} THEN 0 ELSE 1 END AS pi FROM (SELECT l.*, px, py, n_ports FROM p2j l JOIN ports_wiring USING (image_id, ci, pi)) a
  JOIN (SELECT l.*, px, py FROM p2j l JOIN ports_wiring USING (image_id, ci, pi)) b ON a.image_id=b.image_id AND a.ci=b.ci AND a.pi=0 AND b.pi=1 AND a.n_ports=2
  JOIN grp ga ON ga.image_id=a.image_id AND ga.ci=a.ci AND ga.pi=0 JOIN grp gb ON gb.image_id=a.image_id AND gb.ci=a.ci AND gb.pi=1 WHERE ga.g=gb.g),
 kept AS (SELECT * FROM p2j ANTI JOIN sh USING (image_id, ci, pi))"""


@query("G05_port_groups", _NEED, _P2J0 + _JJ + _NN + _GROUPS + " SELECT * FROM grp", recursive=True)
def _(t):
    return Stage(t).groups


@query("G06_unshort", _NEED, _P2J0 + _JJ + _NN + _GROUPS + _UNSHORT + " SELECT * FROM kept", recursive=True)
def _(t):
    s = Stage(t)
    return wiring.unshort(s.ports, s.links(), s.groups).select(*LINK)


@query("G06_final_groups", _NEED, _P2J0 + _JJ + _NN + _GROUPS + _UNSHORT + """, lead2 AS (SELECT image_id, jx, jy, min(ci*4294967296+pi) AS lead FROM kept GROUP BY ALL),
 fe0 AS (SELECT image_id, lead AS a, ci*4294967296+pi AS b FROM kept JOIN lead2 USING (image_id, jx, jy) WHERE lead//4294967296<>ci UNION ALL
  SELECT n.image_id, x.lead, y.lead FROM nn n JOIN lead2 x ON x.image_id=n.image_id AND x.jx=n.ax AND x.jy=n.ay JOIN lead2 y ON y.image_id=n.image_id AND y.jx=n.bx AND y.jy=n.by),
 fe AS (SELECT image_id, a, b FROM fe0 WHERE a<>b UNION SELECT image_id, b, a FROM fe0 WHERE a<>b),
 freach(image_id, node, to_) AS (SELECT image_id, ci*4294967296+pi, ci*4294967296+pi FROM ports_wiring UNION SELECT r.image_id, r.node, e.b FROM freach r JOIN fe e ON e.image_id=r.image_id AND e.a=r.to_),
 fgrp AS (SELECT image_id, node//4294967296 AS ci, node%4294967296 AS pi, min(to_) AS g FROM freach GROUP BY image_id, node)
 SELECT * FROM fgrp WHERE (image_id, g) IN (SELECT (image_id, g) FROM fgrp GROUP BY image_id, g HAVING count(DISTINCT ci)>=2)""", recursive=True)
def _(t):
    s = Stage(t)
    kept = cut(wiring.unshort(s.ports, s.links(), s.groups), "links")
    return wiring.eligible(wiring.port_groups(s.ports, kept, s.jj, final=True))


_BENDS = """[(qx,py),(px,qy),(qx+20,py),(qx-20,py),(qx+40,py),(qx-40,py),(qx+60,py),(qx-60,py),(px,qy+20),(px,qy-20),(px,qy+40),(px,qy-40),(px,qy+60),(px,qy-60),
 (hx+20,hy),(hx-20,hy),(hx,hy+20),(hx,hy-20),(hx+40,hy),(hx-40,hy),(hx,hy+40),(hx,hy-40)]"""


@query("G10_routes", _NEED, _P2J0 + f""", ln AS (SELECT p.image_id, p.ci*4294967296+p.pi AS line, p.ci AS own, px, py, l.jx AS qx, l.jy AS qy, (px+l.jx)//2 AS hx, (py+l.jy)//2 AS hy FROM p2j l JOIN ports_wiring p USING (image_id, ci, pi)),
 bd AS (SELECT *, unnest(range(22)) AS n, CAST(unnest(list_transform({_BENDS}, lambda r: r[1])) AS BIGINT) AS mx, CAST(unnest(list_transform({_BENDS}, lambda r: r[2])) AS BIGINT) AS my FROM ln),
 fit AS (SELECT image_id, line, n, mx, my FROM bd b WHERE NOT {g.crosses(('b.px', 'b.py'), ('b.mx', 'b.my'), 'b.own', 'comps_wiring', 'b.image_id')} AND NOT {g.crosses(('b.mx', 'b.my'), ('b.qx', 'b.qy'), 'b.own', 'comps_wiring', 'b.image_id')}),
 best AS (SELECT image_id, line, min(n) AS n, arg_min(mx, n) AS mx, arg_min(my, n) AS my FROM fit GROUP BY ALL)
 SELECT * FROM best UNION ALL SELECT image_id, line, -1, NULL, NULL FROM ln b ANTI JOIN best USING (image_id, line) WHERE EXISTS (SELECT 1 FROM ports_wiring p WHERE p.image_id=b.image_id AND p.px=b.qx AND p.py=b.qy)
 OR NOT {g.crosses(('b.px', 'b.py'), ('b.qx', 'b.qy'), 'b.own', 'comps_wiring', 'b.image_id')}""")
def _(t):
    s = Stage(t)
    lines = s.links().join(s.ports, ["image_id", "ci", "pi"]).select(
        "image_id", wiring.port_id().alias("line"), F.col("ci").alias("own"), "px", "py", F.col("jx").alias("qx"), F.col("jy").alias("qy"), F.lit(True).alias("port_link"))
    return wiring.routes(lines, s.comps, s.ports)


@query("G10_junction_routes", _NEED, _P2J0 + _JJ + _NN + f""", ln AS (SELECT image_id, ax, ay, bx, by, way, ax AS px, ay AS py, bx AS qx, by AS qy, (ax+bx)//2 AS hx, (ay+by)//2 AS hy FROM nn),
 bd AS (SELECT *, unnest(range(22)) AS n, CAST(unnest(list_transform({_BENDS}, lambda r: r[1])) AS BIGINT) AS mx, CAST(unnest(list_transform({_BENDS}, lambda r: r[2])) AS BIGINT) AS my FROM ln),
 fit AS (SELECT * FROM bd b WHERE NOT {g.crosses(('b.px', 'b.py'), ('b.mx', 'b.my'), '-1', 'comps_wiring', 'b.image_id')} AND NOT {g.crosses(('b.mx', 'b.my'), ('b.qx', 'b.qy'), '-1', 'comps_wiring', 'b.image_id')})
 SELECT image_id, ax, ay, bx, by, way, min(n) AS n, arg_min(mx, n) AS mx, arg_min(my, n) AS my FROM fit GROUP BY ALL""")
def _(t):
    s = Stage(t)
    found = wiring.routes(wiring.lines_of(s.links().limit(0), s.jj, s.ports), s.comps, s.ports)
    x, y = (lambda c: F.shiftright(c, 32)), (lambda c: wiring.place_of(c).cast("bigint"))
    return found.select("image_id", *[f(F.col(f"line.{c}")).alias(n) for c, names in (("from", ("ax", "ay")), ("to", ("bx", "by"))) for f, n in zip((x, y), names)], "line.way", "n", "mx", "my")


_prepared: dict[tuple[str, str], dict] = {}


def prepared(t):
    """Components and what the wiring run needs of them, worked out once per folder and session."""
    key = (t.spark.sparkContext.applicationId, t.folder, t.version)
    if key not in _prepared:
        comps = cut(t.comps("wiring"), "comps")
        session.by_image(t.spark, spatial.crowded(comps) is None)
        comps = detect.reindex(detect.suppress(comps, detect.family_conflicts(comps, "wiring")), t.image_guard)
        comps = cut(detect.fix_sources(comps.drop("idx").withColumnRenamed("new_idx", "idx")), "comps")
        ports = detect.place_ports(comps, "wiring").withColumnRenamed("idx", "ci").select("image_id", "ci", "pi", "px", "py", "n_ports", "name")
        raw = cut(detect.with_centre(detect.route_boxes(t.boxes).where("route = 'junction'")).select("image_id", F.col("cx").alias("jx"), F.col("cy").alias("jy")), "raw")
        session.by_image(t.spark, spatial.crowded(comps, ports, raw) is None)
        _prepared[key] = wiring.prepare(comps, ports, raw, detect.thresholds(t.images)) | {"comps": comps}
    made = _prepared[key]
    session.by_image(t.spark, spatial.crowded(made["comps"], made["ports"], made["junctions"]) is None)
    return made


def wired(t, switches):
    """Groups under one setting."""
    return wiring.wire(prepared(t), switches)


def whole_run(t) -> dict:
    """All results of the run under the settings of the published one, made once per folder and session."""
    ready = prepared(t)
    if "run" not in ready:
        ready["run"] = circuit.run(ready, ready["comps"], t.texts, dims.ABLATIONS["Ours"], guard=t.image_guard)
    return ready["run"]


@query("S16_whole_run_report")
def _(t):
    return whole_run(t)["report"]


@query("G10_whole_run_routes")
def _(t):
    return whole_run(t)["routes"].select("image_id", "line.*", "n", "mx", "my")


def ablation_inputs(t) -> tuple:
    """References with designators, their ports, and true groups: ports of the references by the junction they hang on."""
    named = cut(detect.designators(t.comps("annotation"), "annotation", t.image_guard), "named")
    ports = cut(detect.with_labels(detect.place_ports(named, "annotation"), "annotation").withColumnRenamed("idx", "ci"), "ports")
    truth = Stage(t).links().join(ports.select("image_id", "ci", "pi", "designator", "label"), ["image_id", "ci", "pi"]).select(
        "image_id", wiring.point_id(F.col("jx"), F.col("jy")).alias("g"), "designator", "label")
    return named, ports, truth


@query("A10_ablation_run")
def _(t):
    ready = prepared(t)
    named, ports, truth = ablation_inputs(t)
    return experiments.run(ready, ready["comps"], named, ports, t.images, truth)


@query("G05_G06_whole_wiring")
def _(t):
    return wired(t, dims.ABLATIONS["Ours"])["groups"]


@query("J29_baseline_wiring")
def _(t):
    return wired(t, dims.ABLATIONS["Baseline"])["groups"]


@query("F19_distances", ("boxes",), f"""SELECT image_id, idx, round({g.dist('x1', 'y1', 'x2', 'y2')},6) AS euclid, {g.manhattan('x1', 'y1', 'x2', 'y2')} AS manhattan, greatest(abs(x1-x2),abs(y1-y2)) AS chebyshev FROM boxes""")
def _(t):
    b = geom.box("")
    return t.boxes.select("image_id", "idx", F.round(geom.dist(*b), 6).alias("euclid"), geom.manhattan(*b).alias("manhattan"), geom.chebyshev(*b).alias("chebyshev"))


