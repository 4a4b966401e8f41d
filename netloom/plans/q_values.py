"""Queries over read values, rendered texts and wire segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom import session
from netloom.functions import dims, geom
from netloom.lineage import cut
from netloom.operators import detect, lines, segments, spatial, values, wiring
from netloom.plans import sqlgeo as g
from netloom.plans.q_metrics import _VARIANTS, _fits_sql
from netloom.plans.registry import query

_C = ", c AS (SELECT *, (x1+x2)//2 AS cx, (y1+y2)//2 AS cy FROM comps_%s)"
_MAN = g.manhattan("t.cx", "t.cy", "c.cx", "c.cy")


def _comps(t, profile):
    return detect.with_centre(t.comps(profile))


def _reading_ok(v, name):
    pats, anti = dims.VALUE_PATTERNS["reading"], dims.ANTI_PATTERNS_READING
    unit = f"coalesce(MAP {{{','.join(chr(39) + n + chr(39) + ':' + chr(39) + u + chr(39) for n, (_, u) in pats.items())}}}[{name}],'')"
    bad = " ".join(f"WHEN '{n}' THEN " + " OR ".join(f"regexp_matches({v},'{p}')" for p in ps) for n, ps in anti.items())
    tested = f"(CASE WHEN regexp_matches({v},'[ΩFHVAmHμ]$') THEN {v} ELSE {v}||{unit} END)"
    ok = " ".join(f"WHEN '{n}' THEN regexp_matches({tested},'{p}')" for n, (p, _) in pats.items())
    stored = f"(CASE WHEN regexp_matches({v},'[ΩFHVAmH]$') THEN {v} ELSE {v}||{unit} END)"
    return f"(CASE WHEN {name}<>'GND' AND NOT (CASE {name} {bad} ELSE FALSE END) AND (CASE {name} {ok} ELSE TRUE END) THEN {stored} END)"


_SIMPLE = _C % "reading" + f""", val AS (SELECT c.image_id, c.idx, arg_min({_reading_ok('t.text', 'c.name')}, row({_MAN}, text_ord)) AS value FROM c JOIN texts t USING (image_id)
  WHERE {_MAN}<=250 AND {_reading_ok('t.text', 'c.name')} IS NOT NULL GROUP BY ALL), valued AS (SELECT c.*, coalesce(value,'') AS value FROM c LEFT JOIN val USING (image_id, idx))"""


@query("J06_nearest_value", ("comps_reading", "texts"), _SIMPLE + " SELECT image_id, idx, value FROM valued")
def _(t):
    return values.match_nearest(_comps(t, "reading"), t.texts)


_PROX = _C % "wiring" + ", ud AS (SELECT DISTINCT text FROM texts)" + _VARIANTS + f""", cand AS (SELECT t.image_id, t.text_ord, c.idx, o, {_fits_sql('v.v', 'c.name')} AS value, {_MAN}-CASE WHEN v.v=t.text THEN 40 ELSE 0 END AS score, v.v=t.text AS exact, {_MAN} AS d
  FROM c JOIN texts t USING (image_id) JOIN vs v ON v.text=t.text WHERE {_MAN}<=250),
 fold AS (SELECT image_id, text_ord, list_reduce(list(struct_pack(idx:=idx, value:=value, score:=score, exact:=exact) ORDER BY idx, o), lambda a, x: CASE WHEN x.score < a.score-(CASE WHEN a.exact THEN 20 ELSE 0 END) THEN x ELSE a END) AS w FROM cand WHERE value IS NOT NULL GROUP BY ALL),
 chosen AS (SELECT image_id, text_ord, w.idx AS idx, w.value AS value, w.score AS score FROM fold)"""


@query("J07_text_choices", ("comps_wiring", "texts"), _PROX + " SELECT * FROM chosen")
def _(t):
    return values.text_choices(_comps(t, "wiring"), t.texts)


_PROX_ALL = _PROX + """, first AS (SELECT image_id, idx, arg_min(text_ord, row(score, text_ord)) AS text_ord, arg_min(value, row(score, text_ord)) AS value FROM chosen GROUP BY ALL),
 rest AS (SELECT image_id, idx, text_ord, d, arg_min(value, o) AS value FROM cand WHERE value IS NOT NULL AND (image_id, idx) NOT IN (SELECT (image_id, idx) FROM first) AND (image_id, text_ord) NOT IN (SELECT (image_id, text_ord) FROM first) GROUP BY ALL),
 steps AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY idx, d, text_ord) AS n FROM rest),
 walk(image_id, n, cs, ts, kept) AS (SELECT DISTINCT image_id, 0::BIGINT, []::BIGINT[], []::BIGINT[], []::BIGINT[] FROM steps UNION ALL
  SELECT image_id, n, CASE WHEN no THEN cs ELSE list_append(cs, idx) END, CASE WHEN no THEN ts ELSE list_append(ts, text_ord) END, CASE WHEN no THEN kept ELSE list_append(kept, n) END FROM (
   SELECT w.image_id, s.n, w.cs, w.ts, w.kept, s.idx, s.text_ord, list_contains(w.cs, s.idx) OR list_contains(w.ts, s.text_ord) AS no FROM walk w JOIN steps s ON s.image_id=w.image_id AND s.n=w.n+1)),
 second AS (SELECT image_id, idx, value FROM steps JOIN (SELECT image_id, unnest(arg_max(kept, n)) AS n FROM walk GROUP BY image_id) USING (image_id, n)),
 valued AS (SELECT c.*, coalesce(f.value, s.value, '') AS value FROM c LEFT JOIN first f USING (image_id, idx) LEFT JOIN second s USING (image_id, idx))"""


@query("J07_match_by_proximity", ("comps_wiring", "texts"), _PROX_ALL + " SELECT image_id, idx, value FROM valued", recursive=True)
def _(t):
    return values.match_by_proximity(_comps(t, "wiring"), t.texts)


_NEAR = f""", nt AS (SELECT * FROM (SELECT c.image_id, c.idx, text_ord, text, {_MAN} AS d, row_number() OVER (PARTITION BY c.image_id, c.idx ORDER BY {_MAN}, text_ord) AS r FROM c JOIN texts t USING (image_id)) WHERE r=1)"""


@query("J08_nearest_text", ("comps_wiring", "texts"), _C % "wiring" + _NEAR + " SELECT image_id, idx, text_ord, text, d FROM nt")
def _(t):
    return values.nearest_texts(_comps(t, "wiring"), t.texts)


@query("J09_texts_about", ("comps_wiring", "texts"), _C % "wiring" + _NEAR + """, ins AS (SELECT c.image_id, c.idx, text_ord FROM c JOIN texts t USING (image_id) WHERE t.cx BETWEEN c.x1-20 AND c.x2+20 AND t.cy BETWEEN c.y1-20 AND c.y2+20)
 SELECT * FROM ins UNION ALL SELECT image_id, idx, text_ord FROM nt WHERE (image_id, idx) NOT IN (SELECT (image_id, idx) FROM ins)""")
def _(t):
    return values.texts_about(_comps(t, "wiring"), t.texts)


_UNITS = dims.VALID_UNITS
_VALID = " ".join(f"WHEN '{n}' THEN " + " OR ".join(f"suffix(value,'{u}')" for u in us) for n, us in _UNITS.items())
_FIRSTU = " ".join(f"WHEN '{n}' THEN '{us[0]}'" for n, us in _UNITS.items())


@query("F06_unit_repair", ("comps_wiring", "texts"), _C % "wiring" + _NEAR + f""", q AS (SELECT c.*, CASE WHEN idx%3=0 THEN '7H' WHEN idx%3=1 THEN '12' ELSE '3kΩ' END AS value FROM c)
 SELECT q.image_id, q.idx, CASE WHEN conf>=0.6 AND NOT (CASE name {_VALID} ELSE TRUE END) AND regexp_matches(n.text,'^[0-9.]') THEN regexp_extract(n.text,'^([0-9.]+)',1)||(CASE name {_FIRSTU} END) ELSE value END AS value
 FROM q LEFT JOIN nt n USING (image_id, idx)""")
def _(t):
    c = _comps(t, "wiring").withColumn("value", F.when(F.col("idx") % 3 == 0, "7H").when(F.col("idx") % 3 == 1, "12").otherwise("3kΩ"))
    return values.repair_units(c, t.texts).select("image_id", "idx", "value")


_INF = """, has AS (SELECT image_id, bool_or(name LIKE 'V-%') AS v, bool_or(name LIKE 'I-%') AS i FROM c GROUP BY 1),
 inf AS (SELECT image_id, kind, arg_min(text_ord, text_ord) AS text_ord, arg_min(text, text_ord) AS text FROM (SELECT t.*, CASE WHEN regexp_matches(text,'[0-9.][Vv]$') AND NOT coalesce(v,FALSE) THEN 'V' WHEN regexp_matches(text,'[0-9.][Aa]$') AND NOT coalesce(i,FALSE) THEN 'I' END AS kind
  FROM (SELECT image_id, text_ord, replace(text,'5','A') AS text FROM texts) t LEFT JOIN has USING (image_id)) WHERE kind IS NOT NULL GROUP BY ALL)"""


def _amp(t):
    return t.texts.withColumn("text", F.replace("text", F.lit("5"), F.lit("A")))


@query("P18_inferred_sources", ("comps_reading", "texts"), _C % "reading" + _INF + " SELECT * FROM inf")
def _(t):
    return values.inferred_sources(t.comps("reading"), _amp(t))


@query("A06_description_lines", ("comps_reading", "texts"), _SIMPLE + _INF + f""", per AS (SELECT image_id, count(*) AS n, bool_or(name='Diode') AND bool_or(name='Resistor') AS led FROM c GROUP BY 1)
 SELECT * FROM (SELECT image_id, 0 AS section, unnest([0,1]) AS ord, unnest(['{values.OPENING}', '（共检测到'||n||'个元器件）']) AS line FROM per
 UNION ALL SELECT image_id, 1, -text_ord, CASE kind WHEN 'V' THEN '- 推测电压源：数值='||text||'（检测到电压标注但元件漏检）' ELSE '- 推测电流源：数值='||text||'（检测到电流标注但元件漏检）' END FROM inf
 UNION ALL SELECT image_id, 2, 0, '' FROM per
 UNION ALL SELECT image_id, 3, row_number() OVER (PARTITION BY image_id ORDER BY name, idx), '- '||display||row_number() OVER (PARTITION BY image_id, name ORDER BY idx)||CASE WHEN value<>'' THEN '：数值='||value ELSE '：数值未识别' END FROM valued
 UNION ALL SELECT image_id, 4, unnest([0,1,2,3,4,5]), unnest([{','.join("'" + q + "'" for q in values.QUESTIONS)}, CASE WHEN led THEN '{values.LED_HINT}' END]) FROM per) WHERE line IS NOT NULL AND image_id IN (SELECT image_id FROM c)""")
def _(t):
    c = _comps(t, "reading")
    valued = c.join(values.match_nearest(c, t.texts), ["image_id", "idx"])
    seen = _amp(t).join(c.select("image_id").distinct(), "image_id", "left_semi")
    return values.description_lines(valued, seen, t.image_guard)


_ZH = "coalesce(MAP {" + ",".join(f"'{k}':'{v}'" for k, v in dims.CHINESE.items()) + "}[name], name)"
_PI = "MAP {" + ",".join(f"'{k}':'{','.join(v)}'" for k, v in dims.LABELS["wiring"].items() if v) + "}[name]"


@query("S16_report_lines", ("comps_wiring", "texts", "junctions", "predicted"), _C % "wiring" + f""", im AS (SELECT DISTINCT image_id FROM c), li AS (SELECT image_id, g, string_agg(designator||'.'||label, ', ' ORDER BY designator||'.'||label) AS listing FROM predicted WHERE image_id IN (SELECT image_id FROM im) GROUP BY ALL),
 np AS (SELECT c.*, coalesce((SELECT n FROM (VALUES {','.join(f"('{n}',{len(p)})" for n, p in dims.TEMPLATES['wiring'].items())}) v(k,n) WHERE k=port_key),0) AS n_ports FROM c)
 SELECT * FROM (SELECT image_id, 0 AS section, 0 AS ord, '[检测元件] '||count(*)||'个' AS line FROM c GROUP BY 1
 UNION ALL SELECT image_id, 0, idx+1, '  '||rpad('X'||idx, CAST(greatest(6, length('X'||idx)) AS INT), ' ')||' '||rpad({_ZH}, CAST(greatest(10, length({_ZH})) AS INT), ' ')||' 值未识别'||CASE WHEN {_PI} IS NOT NULL AND n_ports=len(string_split({_PI},',')) THEN ' 端口:'||{_PI} ELSE '' END FROM np
 UNION ALL SELECT image_id, 1, 0, '[OCR文字] '||(SELECT count(*) FROM texts t WHERE t.image_id=im.image_id)||'个' FROM im
 UNION ALL SELECT image_id, 1, text_ord+1, '  "'||text||'"' FROM texts WHERE image_id IN (SELECT image_id FROM im)
 UNION ALL SELECT image_id, 2, 0, '[节点] '||(SELECT count(*) FROM junctions t WHERE t.image_id=im.image_id)||'个' FROM im
 UNION ALL SELECT image_id, 2, row_number() OVER (PARTITION BY image_id ORDER BY jy, jx), '  J'||row_number() OVER (PARTITION BY image_id ORDER BY jy, jx)||': ('||jx||','||jy||')' FROM junctions WHERE image_id IN (SELECT image_id FROM im)
 UNION ALL SELECT image_id, 3, 0, '[连接关系]' FROM im
 UNION ALL SELECT image_id, 3, row_number() OVER (PARTITION BY image_id ORDER BY g), '  连通组'||row_number() OVER (PARTITION BY image_id ORDER BY g)||': '||listing FROM li
 UNION ALL SELECT image_id, 3, 1, '  (未检测到连接)' FROM im WHERE image_id NOT IN (SELECT image_id FROM li))""")
def _(t):
    n = F.create_map(*[F.lit(x) for k, p in dims.TEMPLATES["wiring"].items() for x in (k, len(p))])
    c = _comps(t, "wiring").withColumn("value", F.lit("")).withColumn("designator", F.concat(F.lit("X"), F.col("idx").cast("string"))).withColumn(
        "n_ports", F.coalesce(F.try_element_at(n, F.col("port_key")), F.lit(0)))
    seen = c.select("image_id").distinct()
    e = t.predicted.withColumn("e", F.concat("designator", F.lit("."), "label"))
    listing = lines.joined(e, ["image_id", "g"], ["e"], "e", ", ", "listing")
    return values.report_lines(c, t.texts.join(seen, "image_id", "left_semi"), t.junctions.join(seen, "image_id", "left_semi"),
                               listing.join(seen, "image_id", "left_semi"), t.image_guard)


@query("S16_confidence_lines", ("comps_wiring", "texts"), _C % "wiring" + """, im AS (SELECT DISTINCT image_id FROM c), w AS (SELECT *, (text_ord*7)%101/100.0 AS conf FROM texts WHERE image_id IN (SELECT image_id FROM im))
 SELECT image_id, 0 AS section, 0 AS ord, '[元件检测] 共 '||count(*)||' 个' AS line FROM c GROUP BY 1
 UNION ALL SELECT image_id, 0, idx+1, '  ['||CAST(round_even(conf*100, 0) AS BIGINT)||'%] '||rpad(name, CAST(greatest(15, length(name)) AS INT), ' ')||' '||CASE WHEN idx%3=0 THEN '(未识别)' ELSE '= '||idx||'k' END FROM c
 UNION ALL SELECT image_id, 1, 0, '[OCR文字] 共 '||(SELECT count(*) FROM w WHERE w.image_id=im.image_id)||' 个' FROM im
 UNION ALL SELECT image_id, 1, text_ord+1, '  ['||CAST(round_even(conf*100, 0) AS BIGINT)||'%] "'||text||'"' FROM w""")
def _(t):
    c = _comps(t, "wiring").withColumn("value", F.when(F.col("idx") % 3 == 0, "").otherwise(F.concat(F.col("idx").cast("string"), F.lit("k"))))
    return values.confidence_lines(c, t.texts.withColumn("conf", (F.col("text_ord") * 7) % 101 / 100.0))


# ---- segments -----------------------------------------------------------------------------------------
def _d(p, q, a="a", b="b"):
    return g.dist(f"{a}.x{p}", f"{a}.y{p}", f"{b}.x{q}", f"{b}.y{q}")


@query("J10_drop_repeated_segments", ("segments",), f"""SELECT image_id, seg FROM segments a WHERE NOT EXISTS (SELECT 1 FROM segments b WHERE b.image_id=a.image_id AND b.seg<a.seg
 AND least({_d(1, 1)}+{_d(2, 2)}, {_d(1, 2)}+{_d(2, 1)})<40)""")
def _(t):
    return segments.drop_repeats(t.segments, 40).select("image_id", "seg")


_ADJ = f"least({_d(1, 1)},{_d(1, 2)},{_d(2, 1)},{_d(2, 2)})<=12"


@query("J11_adjacent_segments", ("segments",), f"SELECT a.image_id, a.seg AS a, b.seg AS b FROM segments a JOIN segments b ON a.image_id=b.image_id AND a.seg<b.seg AND {_ADJ}")
def _(t):
    return segments.adjacent(t.segments)


_WG = f""", e AS (SELECT a.image_id, a.seg AS a, b.seg AS b FROM segments a JOIN segments b ON a.image_id=b.image_id AND {_ADJ}),
 reach(image_id, node, to_) AS (SELECT image_id, seg, seg FROM segments UNION SELECT r.image_id, r.node, e.b FROM reach r JOIN e ON e.image_id=r.image_id AND e.a=r.to_),
 grouped AS (SELECT s.*, g FROM segments s JOIN (SELECT image_id, node AS seg, min(to_) AS g FROM reach GROUP BY ALL) USING (image_id, seg)),
 ends AS (SELECT image_id, g, x1 AS ex, y1 AS ey FROM grouped UNION ALL SELECT image_id, g, x2, y2 FROM grouped),
 leaves AS (SELECT image_id, g, ex, ey FROM (SELECT *, count(*) OVER (PARTITION BY image_id, g, round_even(ex/3.0::DOUBLE,0), round_even(ey/3.0::DOUBLE,0)) AS n FROM ends) WHERE n=1)"""


@query("G01_wire_groups", ("segments",), _WG + " SELECT image_id, seg, g FROM grouped", recursive=True)
def _(t):
    return segments.wire_groups(t.segments).select("image_id", "seg", "g")


@query("A16_leaf_ends", ("segments",), _WG + " SELECT * FROM leaves", recursive=True)
def _(t):
    return segments.leaf_ends(segments.wire_groups(t.segments))


_SP = """, sp AS (SELECT image_id, ci, pi, px%90 AS px, py%90 AS py, n_ports, name FROM ports_wiring),
 onw AS (SELECT DISTINCT p.image_id, ci, pi, g FROM sp p JOIN leaves l ON l.image_id=p.image_id AND """ + g.dist("px", "py", "ex", "ey") + "<25)"


def _sp(t):
    ports = t.ports("wiring").select("image_id", "ci", "pi", (F.col("px") % 90).alias("px"), (F.col("py") % 90).alias("py"), "n_ports", "name")
    return ports if spatial.crowded(ports) is None else cut(ports, "sp")


def _on(t, ports):
    session.by_image(t.spark, spatial.crowded(ports, t.segments) is None)
    return segments.ports_on_wires(ports, segments.leaf_ends(segments.wire_groups(t.segments)))


@query("J12_ports_on_wires", ("segments", "ports_wiring"), _WG + _SP + " SELECT image_id, ci, pi, g FROM onw", recursive=True)
def _(t):
    return _on(t, _sp(t))


_MW = """, own AS (SELECT image_id, ci, pi, max(g) AS own FROM onw GROUP BY ALL),
 me0 AS (SELECT image_id, min(own) OVER (PARTITION BY image_id, ci) AS a, own AS b FROM own), me AS (SELECT image_id, a, b FROM me0 UNION SELECT image_id, b, a FROM me0),
 mreach(image_id, node, to_) AS (SELECT DISTINCT image_id, g, g FROM onw UNION SELECT r.image_id, r.node, e.b FROM mreach r JOIN me e ON e.image_id=r.image_id AND e.a=r.to_),
 merged AS (SELECT image_id, ci, pi, m, min(g) AS first FROM onw JOIN (SELECT image_id, node AS g, min(to_) AS m FROM mreach GROUP BY ALL) USING (image_id, g) GROUP BY ALL)"""


@query("G04_merged_wires", ("segments", "ports_wiring"), _WG + _SP + _MW + " SELECT * FROM merged", recursive=True)
def _(t):
    return segments.merge_wires(_on(t, _sp(t)))


_CONN = f""", mp AS (SELECT m.*, px, py, ci*4294967296+pi AS p FROM merged m JOIN sp USING (image_id, ci, pi)),
 conn AS (SELECT a.image_id, a.p, b.p AS q, row({g.dist('a.px', 'a.py', 'b.px', 'b.py')}, 0, a.m, a.first, a.p, b.first, b.p) AS o FROM mp a JOIN mp b ON a.image_id=b.image_id AND a.m=b.m AND a.ci<>b.ci AND row(a.first, a.p)<row(b.first, b.p))"""


@query("G08_first_connections", ("segments", "ports_wiring"), _WG + _SP + _MW + _CONN + """ SELECT image_id, p // 4294967296 AS ci, p % 4294967296 AS pi, q // 4294967296 AS cj, q % 4294967296 AS pj FROM (SELECT image_id, p, arg_min(q, o) AS q FROM (SELECT image_id, p, q, o FROM conn UNION ALL SELECT image_id, q, p, o FROM conn) GROUP BY ALL)""", recursive=True)
def _(t):
    ports = _sp(t)
    best = segments.nearest_on_wire(ports, segments.merge_wires(_on(t, ports)))
    first = best.groupBy("image_id", "p").agg(F.min_by("q", "ord").alias("q"))
    return first.select("image_id", *[f(F.col(c)).alias(n) for c, names in (("p", ("ci", "pi")), ("q", ("cj", "pj"))) for f, n in zip((wiring.component_of, wiring.place_of), names)])


@query("J22_close_connections", ("ports_wiring",), f""", pw AS MATERIALIZED (SELECT image_id, ci, pi, px, py, CAST(floor(px/35.0) AS BIGINT) AS u, CAST(floor(py/35.0) AS BIGINT) AS v FROM ports_wiring),
 about AS MATERIALIZED (SELECT image_id, ci AS cj, pi AS pj, px AS qx, py AS qy, u+du AS u, v+dv AS v FROM pw, (VALUES (-1), (0), (1)) h(du), (VALUES (-1), (0), (1)) k(dv))
 SELECT image_id, ci, pi, cj, pj, round({g.dist('px', 'py', 'qx', 'qy')}, 6) AS d FROM pw JOIN about USING (image_id, u, v) WHERE ci<cj AND {g.dist('px', 'py', 'qx', 'qy')}<35""")
def _(t):
    return segments.proximity(t.ports("wiring")).withColumn("d", F.round("d", 6))


@query("O03_ordered_connections", ("ports_wiring",), f"""SELECT image_id, ci, pi, cj, pj, row_number() OVER (PARTITION BY image_id ORDER BY d, ci, pi, cj, pj) AS place FROM (SELECT a.image_id, a.ci, a.pi, b.ci AS cj, b.pi AS pj, {g.dist('a.px', 'a.py', 'b.px', 'b.py')} AS d
 FROM ports_wiring a JOIN ports_wiring b ON a.image_id=b.image_id AND a.ci<b.ci WHERE {g.dist('a.px', 'a.py', 'b.px', 'b.py')}<35)""")
def _(t):
    from netloom.operators import ranks
    conn = cut(segments.proximity(t.ports("wiring")), "conn")
    return ranks.row_number(conn, ["image_id"], ["d", "ci", "pi", "cj", "pj"], "place").select("image_id", "ci", "pi", "cj", "pj", "place")


_NODES = f""", pairs AS (SELECT image_id, p, q, o FROM conn UNION ALL
  SELECT a.image_id, a.ci*4294967296+a.pi, b.ci*4294967296+b.pi, row({g.dist('a.px', 'a.py', 'b.px', 'b.py')}, 1, 0, 0, a.ci*4294967296+a.pi, 0, b.ci*4294967296+b.pi)
  FROM sp a JOIN sp b ON a.image_id=b.image_id AND a.ci<b.ci WHERE {g.dist('a.px', 'a.py', 'b.px', 'b.py')}<35),
 steps AS MATERIALIZED (SELECT image_id, p, q, row_number() OVER (PARTITION BY image_id ORDER BY o) AS n FROM pairs),
 spm AS MATERIALIZED (SELECT image_id, ci, pi, n_ports, name, ci*4294967296+pi AS p FROM sp),
 walk(image_id, n, ps, ns, nxt) AS (SELECT image_id, 0::BIGINT, coalesce(list(p) FILTER (name='GND'), []::BIGINT[]), coalesce(list(0::BIGINT) FILTER (name='GND'), []::BIGINT[]), 1::BIGINT FROM spm GROUP BY image_id
  UNION ALL SELECT image_id, n, CASE WHEN ia IS NULL AND ib IS NULL THEN list_concat(ps, [p, q]) WHEN ib IS NULL THEN list_append(ps, q) WHEN ia IS NULL THEN list_append(ps, p) ELSE ps END,
   CASE WHEN ia IS NULL AND ib IS NULL THEN list_concat(ns, [nxt, nxt]) WHEN ib IS NULL THEN list_append(ns, ns[ia]) WHEN ia IS NULL THEN list_append(ns, ns[ib]) ELSE ns END,
   CASE WHEN ia IS NULL AND ib IS NULL THEN nxt+1 ELSE nxt END
   FROM (SELECT w.image_id, s.n, s.p, s.q, ps, ns, nxt, nullif(list_position(ps, s.p), 0) AS ia, nullif(list_position(ps, s.q), 0) AS ib FROM walk w JOIN steps s ON s.image_id=w.image_id AND s.n=w.n+1)),
 last AS MATERIALIZED (SELECT image_id, arg_max(ps, n) AS ps, arg_max(ns, n) AS ns, arg_max(nxt, n) AS nxt FROM walk GROUP BY image_id),
 got AS MATERIALIZED (SELECT image_id, unnest(ps) AS p, unnest(ns) AS node FROM last),
 fresh AS MATERIALIZED (SELECT image_id, ci, row_number() OVER (PARTITION BY image_id ORDER BY ci) - 1 AS k FROM (
  SELECT image_id, ci FROM spm JOIN got USING (image_id, p) WHERE n_ports=2 GROUP BY image_id, ci HAVING count(*)=2 AND min(node)=max(node))),
 more AS (SELECT image_id, count(*) AS m FROM fresh GROUP BY image_id),
 solo AS (SELECT image_id, p, row_number() OVER (PARTITION BY image_id ORDER BY p) - 1 AS k FROM spm ANTI JOIN got USING (image_id, p))
 SELECT s.image_id, s.ci, s.pi, CASE WHEN f.k IS NOT NULL AND s.pi=1 THEN nxt+f.k WHEN o.k IS NOT NULL THEN nxt+coalesce(m,0)+o.k ELSE t.node END AS node
 FROM spm s JOIN last l USING (image_id) LEFT JOIN got t USING (image_id, p) LEFT JOIN fresh f USING (image_id, ci) LEFT JOIN more USING (image_id) LEFT JOIN solo o USING (image_id, p)"""


@query("G09_assign_nodes", ("segments", "ports_wiring"), _WG + _SP + _MW + _CONN + _NODES, recursive=True)
def _(t):
    ports = _sp(t)
    return segments.assign_nodes(ports, segments.merge_wires(_on(t, ports)), t.image_guard)


@query("F26_extended_segments", ("segments",), """SELECT image_id, seg, CAST(trunc(x1-ux*3) AS BIGINT) AS x1, CAST(trunc(y1-uy*3) AS BIGINT) AS y1, CAST(trunc(x2+ux*3) AS BIGINT) AS x2, CAST(trunc(y2+uy*3) AS BIGINT) AS y2 FROM
 (SELECT *, dx/l AS ux, dy/l AS uy FROM (SELECT *, CASE WHEN dx=0 AND dy=0 THEN 1.0::DOUBLE ELSE sqrt(dx*dx+dy*dy) END AS l FROM (SELECT *, CAST(x2-x1 AS DOUBLE) AS dx, CAST(y2-y1 AS DOUBLE) AS dy FROM segments)))""")
def _(t):
    s = geom.extended(geom.box(""))
    return t.segments.select("image_id", "seg", *[c.alias(n) for c, n in zip(s, ("x1", "y1", "x2", "y2"))])
