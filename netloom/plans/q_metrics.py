"""Queries over groups, experiments, selections, splits and label data."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions import dims, text
from netloom.lineage import cut
from netloom.operators import dataset, detect, lines, metrics
from netloom.plans import sqlgeo as g
from netloom.plans.fixtures import _values, sql_list
from netloom.plans.registry import query

_GROUPS = """, tg AS (SELECT DISTINCT image_id, g, designator||'.'||label AS id, designator FROM truth WHERE (image_id, g) IN
  (SELECT (image_id, g) FROM truth GROUP BY image_id, g HAVING count(*)>=2)),
 pg AS (SELECT DISTINCT image_id, g, designator||'.'||label AS id, designator FROM predicted WHERE (image_id, g) IN
  (SELECT (image_id, g) FROM predicted GROUP BY image_id, g HAVING count(DISTINCT designator||'.'||label)>=2)),
 te AS (SELECT DISTINCT a.image_id, a.id AS a, b.id AS b FROM tg a JOIN tg b ON a.image_id=b.image_id AND a.g=b.g AND a.id<b.id),
 pe AS (SELECT DISTINCT a.image_id, a.id AS a, b.id AS b FROM pg a JOIN pg b ON a.image_id=b.image_id AND a.g=b.g AND a.id<b.id),
 ts AS (SELECT image_id, g, string_agg(id, '|' ORDER BY id) AS s FROM tg GROUP BY ALL),
 ps AS (SELECT image_id, g, string_agg(id, '|' ORDER BY id) AS s FROM pg GROUP BY ALL),
 td AS (SELECT DISTINCT image_id, g, designator FROM tg),
 pd AS (SELECT DISTINCT image_id, g, designator FROM pg WHERE (image_id, g) IN (SELECT (image_id, g) FROM pg GROUP BY image_id, g HAVING count(DISTINCT designator)>=2)),
 tn AS (SELECT image_id, designator, (SELECT coalesce(string_agg(designator,'|' ORDER BY designator),'') FROM td x WHERE x.image_id=l.image_id AND x.g=l.g AND x.designator<>l.designator) AS s
   FROM (SELECT image_id, designator, max(g) AS g FROM td GROUP BY ALL) l),
 pn AS (SELECT image_id, designator, (SELECT coalesce(string_agg(designator,'|' ORDER BY designator),'') FROM pd x WHERE x.image_id=l.image_id AND x.g=l.g AND x.designator<>l.designator) AS s
   FROM (SELECT image_id, designator, max(g) AS g FROM pd GROUP BY ALL) l),
 edges AS (SELECT image_id, count(t) AS n_true, count(p) AS n_pred, count(*) FILTER (t IS NOT NULL AND p IS NOT NULL) AS tp FROM (
   SELECT image_id, a, b, max(t) AS t, max(p) AS p FROM (SELECT *, 1 AS t, NULL AS p FROM te UNION ALL SELECT *, NULL, 1 FROM pe) GROUP BY ALL) GROUP BY image_id),
 matched AS (SELECT image_id, CAST(sum(least(a,b)) AS BIGINT) AS n_matched FROM (SELECT image_id, s, count(*) AS a FROM ts GROUP BY ALL) x
   JOIN (SELECT image_id, s, count(*) AS b FROM ps GROUP BY ALL) y USING (image_id, s) GROUP BY image_id),
 neigh AS (SELECT image_id, count(*) AS n_comps, count(*) FILTER (coalesce(t.s,'')=coalesce(p.s,'')) AS n_right FROM tn t FULL JOIN pn p USING (image_id, designator) GROUP BY image_id)"""


def _tp(t):
    return cut(metrics.true_groups(t.truth), "truth"), cut(metrics.predicted_groups(t.predicted), "pred")


@query("A07_A08_A09_wiring_metrics", ("truth", "predicted"), _GROUPS + """ SELECT o_orderkey AS image_id, coalesce(gt,0) AS n_gt_groups, coalesce(pr,0) AS n_pred_groups,
 round(coalesce(tp/CAST(nullif(n_true,0) AS DOUBLE),0),9) AS port_correct_rate, round(coalesce((n_pred-tp)/CAST(nullif(n_pred,0) AS DOUBLE),0),9) AS fp_rate,
 round(coalesce((n_true-tp)/CAST(nullif(n_true,0) AS DOUBLE),0),9) AS fn_rate, round(coalesce(n_matched/CAST(gt AS DOUBLE),0),9) AS group_accuracy,
 round(coalesce(n_right/CAST(n_comps AS DOUBLE),0),9) AS comp_neighbor_accuracy FROM orders LEFT JOIN edges e ON e.image_id=o_orderkey
 LEFT JOIN (SELECT image_id, count(*) AS gt FROM ts GROUP BY 1) t ON t.image_id=o_orderkey LEFT JOIN (SELECT image_id, count(*) AS pr FROM ps GROUP BY 1) p ON p.image_id=o_orderkey
 LEFT JOIN matched m ON m.image_id=o_orderkey LEFT JOIN neigh n ON n.image_id=o_orderkey""")
def _(t):
    out = metrics.evaluate(t.images, t.truth, t.predicted)
    return out.select("image_id", "n_gt_groups", "n_pred_groups", *[F.round(m, 9).alias(m) for m in metrics.RATES])


@query("G07_U01_pair_counts", ("truth", "predicted"), _GROUPS + """ SELECT image_id, n_true, n_pred, tp, n_pred-tp AS fp, n_true-tp AS fn FROM edges""")
def _(t):
    return metrics.edge_counts(*_tp(t)).where("n_true + n_pred > 0")


@query("J23_equal_groups", ("truth", "predicted"), _GROUPS + """ SELECT a.image_id, a.g, b.g AS p FROM (SELECT *, row_number() OVER (PARTITION BY image_id, s ORDER BY g) AS k FROM ts) a
 JOIN (SELECT *, row_number() OVER (PARTITION BY image_id, s ORDER BY g) AS k FROM ps) b USING (image_id, s, k)""")
def _(t):
    return metrics.matched_groups(*_tp(t))


@query("G11_U02_neighbours", ("truth", "predicted"), _GROUPS + """ SELECT image_id, designator, CASE WHEN t.s IS NULL THEN NULL WHEN t.s='' THEN 0 ELSE len(string_split(t.s,'|')) END AS nt,
 CASE WHEN p.s IS NULL THEN NULL WHEN p.s='' THEN 0 ELSE len(string_split(p.s,'|')) END AS np FROM tn t FULL JOIN pn p USING (image_id, designator)""")
def _(t):
    a, b = _tp(t)
    ta = metrics.neighbour_counts(metrics.designator_groups(a)).select("image_id", "designator", F.col("n_neighbours").alias("nt"))
    pb = metrics.neighbour_counts(metrics.designator_groups(b, 2)).select("image_id", "designator", F.col("n_neighbours").alias("np"))
    return ta.join(pb, ["image_id", "designator"], "full")


@query("P16_group_eligibility", ("predicted",), """SELECT image_id, g, count(DISTINCT designator) AS comps, count(DISTINCT designator||'.'||label) AS ids FROM predicted GROUP BY ALL HAVING count(DISTINCT designator)>=2""")
def _(t):
    return t.predicted.groupBy("image_id", "g").agg(
        F.count_distinct("designator").alias("comps"), F.count_distinct(F.concat("designator", F.lit("."), "label")).alias("ids")).where("comps >= 2")


@query("S04_group_filter", ("truth",), _GROUPS.split(",\n pg AS")[0] + " SELECT image_id, g, id FROM tg")
def _(t):
    return metrics.true_groups(t.truth).select("image_id", "g", "id")


@query("A18_group_listing", ("predicted",), """SELECT image_id, g, string_agg(e, ', ' ORDER BY e) AS listing FROM (SELECT image_id, g, CASE WHEN designator='R0' THEN 'GND' ELSE designator||'.'||label END AS e FROM predicted) GROUP BY ALL""")
def _(t):
    e = F.when(F.col("designator") == "R0", "GND").otherwise(F.concat("designator", F.lit("."), "label"))
    return lines.joined(t.predicted.withColumn("e", e), ["image_id", "g"], ["e"], "e", ", ", "listing")


@query("A19_group_designators", ("predicted",), """SELECT image_id, g, string_agg(designator, '-' ORDER BY designator) AS listing FROM (SELECT DISTINCT image_id, g, designator FROM predicted) GROUP BY ALL""")
def _(t):
    return lines.joined(metrics.designator_groups(t.predicted), ["image_id", "g"], ["designator"], "designator", "-", "listing")


@query("W12_group_numbers", ("predicted",), """SELECT image_id, g, row_number() OVER (PARTITION BY image_id ORDER BY m) AS no FROM (SELECT image_id, g, min(member_ord) AS m FROM predicted GROUP BY ALL)""")
def _(t):
    from netloom.operators import ranks
    firsts = t.predicted.groupBy("image_id", "g").agg(F.min("member_ord").alias("m"))
    return ranks.row_number(firsts, ["image_id"], ["m"], "no", guard=t.image_guard).select("image_id", "g", "no")


@query("J05_port_identity", ("ports_wiring", "ports_annotation", "labels_annotation", "comps_annotation", "refs"), f""", des AS (SELECT image_id, idx AS ci, prefix||row_number() OVER (PARTITION BY image_id, prefix ORDER BY idx) AS designator
  FROM (SELECT *, coalesce(MAP {{{','.join(f"'{n}':'{p}'" for n, p in dims.PREFIXES['annotation'].items())}}}[name], left(name,1)) AS prefix FROM comps_annotation)),
 rp AS (SELECT p.image_id, p.ci, pi, px, py, n_ports, designator||'.'||coalesce(label,'?') AS port_id FROM ports_annotation p JOIN des USING (image_id, ci) LEFT JOIN labels_annotation USING (name, pi))
 SELECT w.image_id, w.ci, w.pi, arg_min(port_id, row({g.dist('w.px', 'w.py', 'r.px', 'r.py')}, r.pi)) AS port_id FROM ports_wiring w
 JOIN refs m ON m.image_id=w.image_id AND m.idx=w.ci JOIN rp r ON r.image_id=w.image_id AND r.ci=w.ci
 WHERE (w.n_ports=r.n_ports AND w.pi=r.pi) OR (w.n_ports<>r.n_ports AND {g.dist('w.px', 'w.py', 'r.px', 'r.py')}<60) GROUP BY ALL""")
def _(t):
    named = detect.designators(t.comps("annotation"), "annotation", t.image_guard)
    rp = detect.with_labels(detect.place_ports(named, "annotation"), "annotation").withColumnRenamed("idx", "ci")
    match = t.refs.select("image_id", F.col("idx").alias("pred_idx"), F.col("idx").alias("ref_idx"))
    return metrics.port_identity(match, t.ports("wiring"), rp)


@query("F27_port_ids", ("predicted",), """SELECT image_id, member_ord, id, regexp_extract(id, '^(.*)[.]([^.]*)$', 1) AS designator, regexp_extract(id, '^(.*)[.]([^.]*)$', 2) AS label, split_part(id, '.', 1) AS first_part
 FROM (SELECT *, designator||'.x.'||label AS id FROM (SELECT image_id, member_ord, designator, label FROM predicted))""".replace("SELECT *, designator||'.x.'||label AS id FROM (SELECT image_id, member_ord, designator, label FROM predicted)", "SELECT image_id, member_ord, designator||'.x.'||label AS id FROM predicted"))
def _(t):
    i = F.col("id")
    return t.predicted.select("image_id", "member_ord", F.concat("designator", F.lit(".x."), "label").alias("id")).select(
        "image_id", "member_ord", "id", F.regexp_extract(i, r"^(.*)\.([^.]*)$", 1).alias("designator"),
        F.regexp_extract(i, r"^(.*)\.([^.]*)$", 2).alias("label"), F.split_part(i, F.lit("."), F.lit(1)).alias("first_part"))


# ---- experiments ------------------------------------------------------------------------------------
_MEANS = ", means AS (SELECT config, " + ", ".join(f"avg({m}) AS {m}" for m in metrics.RATES) + ", count(*) AS n FROM experiments WHERE port_correct_rate IS NOT NULL GROUP BY config)"


@query("A10_config_means", ("experiments",), _MEANS + " SELECT config, n, " + ", ".join(f"round({m},9) AS {m}" for m in metrics.RATES) + " FROM means")
def _(t):
    return metrics.config_means(t.experiments).select("config", "n", *[F.round(m, 9).alias(m) for m in metrics.RATES])


@query("A11_ablation_deltas", ("experiments",), _MEANS + """ SELECT a.config, m.metric, round(CASE m.metric WHEN 'comp_neighbor_accuracy' THEN a.comp_neighbor_accuracy-f.comp_neighbor_accuracy
 WHEN 'group_accuracy' THEN a.group_accuracy-f.group_accuracy ELSE a.port_correct_rate-f.port_correct_rate END, 9) AS delta FROM means a, means f, (VALUES ('comp_neighbor_accuracy'),('group_accuracy'),('port_correct_rate')) m(metric)
 WHERE f.config='Ours' AND a.config NOT IN ('Ours','Baseline','CCL')""")
def _(t):
    return metrics.deltas(metrics.config_means(t.experiments)).select("config", "metric", F.round("delta", 9).alias("delta"))


@query("A12_summary_table", ("experiments",), _MEANS + """ SELECT config, round(comp_neighbor_accuracy,6) AS cna, round(group_accuracy,6) AS ga, round(port_correct_rate,6) AS pc, round(fp_rate,6) AS fp, round(fn_rate,6) AS fn, n FROM means""")
def _(t):
    s = metrics.summary_table(metrics.config_means(t.experiments))
    return s.select("config", *[F.round(c, 6).alias(c) for c in ("cna", "ga", "pc", "fp", "fn")], "n")


_FLAGS = list(dims.DEFAULT_SWITCHES)


@query("J29_config_grid", ("images",), "SELECT image_id, config, " + ", ".join(_FLAGS) + " FROM images, (" + _values(
    [(n, *[({**dims.DEFAULT_SWITCHES, **c})[f] for f in _FLAGS]) for n, c in dims.ABLATIONS.items()], ",".join(["config", *_FLAGS])) + ")")
def _(t):
    from netloom.operators import wiring
    return wiring.config_grid(t.images).select("image_id", "config", *[F.col("flags")[f].alias(f) for f in _FLAGS])


# ---- selection --------------------------------------------------------------------------------------
@query("A01_image_counts", ("boxes",), """SELECT image_id, count(*) FILTER (cls NOT IN ('junction','crossover','text','probe.current','probe.voltage')) AS comp_n, count(*) FILTER (cls='terminal') AS term_n FROM boxes GROUP BY image_id""")
def _(t):
    return dataset.image_counts(t.boxes)


_TOP = ", top AS (SELECT drafter, count(*) AS n, min(ord) AS first FROM pictures WHERE terminals>0 GROUP BY drafter ORDER BY n DESC, first LIMIT 10)"
_MED = """, picks AS (SELECT drafter, ord, count FROM (SELECT *, row_number() OVER (PARTITION BY drafter ORDER BY count, ord)-1 AS pos, count(*) OVER (PARTITION BY drafter) AS n FROM pictures
 WHERE terminals>0 AND drafter IN (SELECT drafter FROM top)) WHERE pos=n//2)"""


def _bins() -> str:
    out, prev = "", "sel0"
    out += ", sel0 AS (SELECT drafter, ord, count, 'terminal' AS bin FROM picks)"
    for i, (label, lo, hi, target) in enumerate(dims.BINS, 1):
        out += f""", sel{i} AS (SELECT * FROM {prev} UNION ALL (SELECT drafter, ord, count, '{label}' FROM pictures LEFT JOIN (SELECT drafter, count(*) AS used FROM {prev} GROUP BY 1) USING (drafter)
   WHERE count BETWEEN {lo} AND {hi} AND ord NOT IN (SELECT ord FROM {prev}) ORDER BY coalesce(used,0), ord LIMIT {target}))"""
        prev = f"sel{i}"
    return out


@query("O01_top_drafters", ("pictures",), _TOP + " SELECT drafter, n, first FROM top")
def _(t):
    return dataset.top_drafters(t.pictures)


@query("W08_median_picks", ("pictures",), _TOP + _MED + " SELECT * FROM picks")
def _(t):
    return dataset.terminal_picks(t.pictures).select("drafter", "ord", "count")


@query("W09_O02_U04_stratified_selection", ("pictures",), _TOP + _MED + _bins() + " SELECT * FROM sel4")
def _(t):
    return dataset.stratified(t.pictures, dataset.terminal_picks(t.pictures))


@query("A23_selection_coverage", ("pictures",), _TOP + _MED + _bins() + " SELECT bin, count(*) AS n, count(DISTINCT drafter) AS drafters FROM sel4 GROUP BY ROLLUP (bin)")
def _(t):
    return dataset.coverage_of(dataset.stratified(t.pictures, dataset.terminal_picks(t.pictures)))


# ---- splits and labels ------------------------------------------------------------------------------
_SPLIT = ", split AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(CAST(image_id AS VARCHAR))) <= CAST(floor((SELECT count(*) FROM images)*0.85) AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM images)"


@query("W11_exact_split", ("images",), _SPLIT + " SELECT image_id, split FROM split")
def _(t):
    return dataset.split(t.images, F.col("image_id"), 0.85).select("image_id", "split")


@query("A22_split_totals", ("images", "boxes"), _SPLIT + " SELECT split, count(DISTINCT image_id) AS images, count(*) AS labels FROM boxes JOIN split USING (image_id) GROUP BY ROLLUP (split)")
def _(t):
    s = dataset.split(t.images, F.col("image_id"), 0.85).select("image_id", "split")
    return dataset.split_totals(t.boxes.select("image_id").join(s, "image_id"))


_WORD = """, words AS (SELECT text FROM texts UNION ALL SELECT unnest(string_split(text,' ')) FROM documents)"""


def _words(t):
    return t.texts.select("text").unionByName(t.read("documents").select(F.explode(F.split("text", " ")).alias("text")))


@query("P09_permitted_labels", ("texts",), _WORD + """ SELECT text, coalesce(regexp_full_match(text,'[0-9.kKmMΩμunpFV AHz+/-]+'),FALSE) AS ok, count(*) AS n FROM words GROUP BY ALL""")
def _(t):
    return _words(t).groupBy("text").agg(F.count(F.lit(1)).alias("n")).withColumn("ok", dataset.permitted(F.col("text")))


@query("A13_character_coverage", ("texts",), _WORD + f""", seen AS (SELECT DISTINCT unnest(string_split(text,'')) AS ch FROM words), alpha AS (SELECT unnest(string_split('{dims.LABEL_ALPHABET}','')) AS ch)
 SELECT ch, a.ch IS NOT NULL AS in_alphabet, s.ch IS NOT NULL AS covered FROM (SELECT ch FROM seen WHERE ch<>'' UNION SELECT ch FROM alpha) LEFT JOIN alpha a USING (ch) LEFT JOIN seen s USING (ch)""")
def _(t):
    return dataset.character_coverage(_words(t))


@query("A14_text_counters", ("texts",), _WORD + r""", w AS (SELECT text, regexp_replace(text,'^\s+|\s+$','','g') AS s FROM words) SELECT count(*) AS total, count(*) FILTER (text<>'' AND regexp_full_match(s,'[0-9.kKmMΩμunpFV AHz+/-]+')) AS valid,
 count(*) FILTER (text='') AS empty, count(*) FILTER (text<>'' AND NOT regexp_full_match(s,'[0-9.kKmMΩμunpFV AHz+/-]+')) AS invalid FROM w""")
def _(t):
    return dataset.text_counters(_words(t))


@query("A24_recognition_accuracy", ("texts",), "SELECT count(*) FILTER (text=replace(text,'k','K')) AS correct, count(*) AS total FROM texts")
def _(t):
    return dataset.recognition_accuracy(t.texts.select(F.replace("text", F.lit("k"), F.lit("K")).alias("pred"), F.col("text").alias("label")))


@query("J28_annotation_pictures", (), """, x AS (SELECT 1)""".replace(", x", "WITH x") + f""", pics AS (SELECT source AS drafter, doc_id//2 AS stem, 'C'||(doc_id//2)||{sql_list(dataset.EXTENSIONS + ('.gif',))}[1+(doc_id*7)%7] AS name, (doc_id*7)%7 AS rk FROM documents)
 SELECT drafter, stem, arg_min(name, rk) AS name FROM (SELECT DISTINCT source AS drafter, 'C'||doc_id AS stem FROM documents) a JOIN (SELECT drafter, 'C'||stem AS stem, name, rk FROM pics WHERE rk<6) p USING (drafter, stem) GROUP BY ALL""")
def _(t):
    docs = t.read("documents")
    half = F.floor(F.col("doc_id") / 2).cast("string")
    ext = F.element_at(F.array(*[F.lit(e) for e in (*dataset.EXTENSIONS, ".gif")]), ((F.col("doc_id") * 7) % 7 + 1).cast("int"))
    pics = docs.select(F.col("source").alias("drafter"), F.concat(F.lit("C"), half, ext).alias("name"))
    return dataset.pair_pictures(docs.select(F.col("source").alias("drafter"), F.concat(F.lit("C"), F.col("doc_id").cast("string")).alias("stem")), pics)


@query("S03_U05_override_sources", (), """SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'q'||quality ELSE source END AS payload, CASE WHEN l.doc_id IS NOT NULL THEN 0 ELSE 1 END AS source FROM documents LEFT JOIN labels l USING (doc_id)""")
def _(t):
    fixed = t.read("labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("payload"))
    return dataset.first_source([fixed, t.read("documents").select("doc_id", F.col("source").alias("payload"))], "doc_id")


@query("S05_work_list", ("truth", "images", "refs"), "SELECT DISTINCT image_id FROM truth WHERE image_id IN (SELECT image_id FROM images) AND image_id IN (SELECT image_id FROM refs)")
def _(t):
    return dataset.work_list(t.truth, t.images, t.refs, t.refs)


@query("U03_distinct_points", ("boxes",), "SELECT DISTINCT image_id, (x1+x2)//2 AS cx, (y1+y2)//2 AS cy FROM boxes")
def _(t):
    return detect.with_centre(t.boxes).select("image_id", "cx", "cy").distinct()


@query("W13_last_write", (), "SELECT user_id, arg_max(props, row(ts, event_id)) AS props FROM events GROUP BY user_id")
def _(t):
    return dataset.latest(t.read("events"), "user_id", F.struct("ts", "event_id"), "props")


_POSTS = "posts AS (SELECT event_id AS seq, CAST(user_id%40 AS VARCHAR)||'k' AS pattern, event_type||'k' AS replacement FROM events), mem AS (SELECT pattern, arg_max(replacement, seq) AS replacement, min(seq) AS first FROM posts GROUP BY pattern)"


def _posts(t):
    return t.read("events").select(F.col("event_id").alias("seq"), F.concat((F.col("user_id") % 40).cast("string"), F.lit("k")).alias("pattern"),
                                   F.concat("event_type", F.lit("k")).alias("replacement"))


@query("S18_correction_memory", (), f"WITH {_POSTS} SELECT * FROM mem")
def _(t):
    return dataset.correction_memory(_posts(t))


_CORR = f""", {_POSTS}, hit AS (SELECT text, arg_min(pattern, first) AS pattern, arg_min(replacement, first) AS replacement FROM (SELECT DISTINCT text FROM texts) JOIN mem ON contains(text, pattern) GROUP BY text)
 SELECT image_id, text_ord, CASE WHEN h.pattern IS NULL THEN text ELSE replace(text, h.pattern, h.replacement) END AS text FROM texts LEFT JOIN hit h USING (text)"""


@query("F05_apply_corrections", ("texts",), _CORR)
def _(t):
    return dataset.apply_corrections(t.texts.select("image_id", "text_ord", "text"), dataset.correction_memory(_posts(t)))


# ---- scalar text rules ------------------------------------------------------------------------------
_DISTINCT = ", u AS (SELECT DISTINCT text FROM words)"
_COMPACT = r"(CASE WHEN length(regexp_replace(s,'[^\p{L}\p{N}. +\-]','','g')) < length(s)*0.5 THEN '' ELSE s END)"
_SQUEEZE = r"(SELECT text, regexp_replace(regexp_replace(text,'^\s+|\s+$','','g'),'[ \n]','','g') AS s FROM u)"
_SHORT = r"""(CASE WHEN regexp_matches(c,'^[0-9]+[Rr][0-9]+.*$') THEN regexp_replace(c,'^([0-9]+)[Rr]([0-9]+).*$','\1.\2Ω')
 WHEN regexp_matches(c,'^[0-9]+[kKmM][0-9]+Ω?$') THEN regexp_replace(c,'^([0-9]+)([kKmM])([0-9]+)Ω?$','\1.\3\2Ω')
 WHEN regexp_matches(c,'^[0-9]+[Vv][0-9]+$') THEN regexp_replace(c,'^([0-9]+)[Vv]([0-9]+)$','\1.\2V')
 WHEN regexp_matches(c,'^[0-9]+[Aa][0-9]+$') THEN regexp_replace(c,'^([0-9]+)[Aa]([0-9]+)$','\1.\2A')
 WHEN regexp_matches(c,'^[0-9]{2}[Vv]$') AND CAST(left(c,2) AS INT)<=50 THEN c[1]||'.'||c[2]||'V' ELSE c END)"""


@query("F01_compact_readings", ("texts",), _WORD + _DISTINCT + f" SELECT text, {_COMPACT} AS compact FROM {_SQUEEZE}")
def _(t):
    return _words(t).distinct().select("text", text.compact(F.col("text")).alias("compact"))


@query("F01_compact_documents", (), f"WITH u AS (SELECT doc_id, text FROM documents) SELECT doc_id, {_COMPACT} AS compact FROM " + _SQUEEZE.replace("SELECT text,", "SELECT doc_id,"))
def _(t):
    return t.read("documents").select("doc_id", text.compact(F.col("text")).alias("compact"))


@query("F02_expand_shorthand", ("base",), ", v AS (SELECT DISTINCT CAST(l_quantity AS INT)||['R','k','V','A','M','V','r'][1+l_partkey%7]||CASE WHEN l_partkey%7=5 THEN '' ELSE CAST(l_suppkey%10 AS VARCHAR) END||CASE WHEN l_partkey%3=0 AND l_partkey%7 IN (1,4) THEN 'Ω' ELSE '' END AS c FROM base) SELECT c AS text, "
       + _SHORT + " AS expanded FROM v")
def _(t):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    unit = F.element_at(F.array(*[F.lit(x) for x in "RkVAMVr"]), (p % 7 + 1).cast("int"))
    c = F.concat(F.col("l_quantity").cast("int").cast("string"), unit, F.when(p % 7 == 5, "").otherwise((s % 10).cast("string")),
                 F.when((p % 3 == 0) & (p % 7).isin(1, 4), "Ω").otherwise(""))
    return t.base.select(c.alias("text")).distinct().select("text", text.expand_shorthand(F.col("text")).alias("expanded"))


@query("F03_single_dots", ("texts",), _WORD + " SELECT text, replace(replace(text,'.','..'),'..','.') AS mended FROM (SELECT DISTINCT text FROM words)")
def _(t):
    return _words(t).distinct().select("text", text.single_dots(F.replace("text", F.lit("."), F.lit(".."))).alias("mended"))


_VARIANTS = r""", vs AS (SELECT text, o, v FROM (SELECT text, unnest([0,1,2,3,4,5,6,7,8]) AS o, unnest([text,
 CASE WHEN regexp_matches(text,'^[0-9.]+[Hz]$') THEN n||'kΩ' END, CASE WHEN regexp_matches(text,'^[0-9.]+[Hz]$') THEN n||'MΩ' END, CASE WHEN regexp_matches(text,'^[0-9.]+[Hz]$') THEN n||'Ω' END,
 CASE WHEN regexp_matches(text,'^[0-9.]+V$') THEN n||'Ω' END, CASE WHEN regexp_matches(text,'^[0-9.]+V$') THEN n||'μF' END, CASE WHEN regexp_matches(text,'^[0-9.]+V$') THEN n||'F' END,
 CASE WHEN regexp_matches(text,'^[0-9]{2}[kKmMμ]') THEN text[1]||'.'||text[2]||text[3] END, CASE WHEN regexp_matches(text,'[kKmM]$') THEN text||'Ω' END]) AS v
 FROM (SELECT text, regexp_extract(text,'^([0-9.]+)',1) AS n FROM ud)) WHERE v IS NOT NULL)"""


@query("F04_reading_variants", ("texts",), ", ud AS (SELECT DISTINCT text FROM texts)" + _VARIANTS + " SELECT text, string_agg(v,'|' ORDER BY o) AS variants FROM vs GROUP BY text")
def _(t):
    v = F.transform(text.variants(F.col("text")), lambda x: x["value"])
    return t.texts.select("text").distinct().select("text", F.array_join(v, "|").alias("variants"))


def _fits_sql(v: str, name: str) -> str:
    pats = dims.VALUE_PATTERNS["wiring"]
    unit = f"coalesce(MAP {{{','.join(chr(39) + n + chr(39) + ':' + chr(39) + u + chr(39) for n, (_, u) in pats.items())}}}[{name}],'')"
    full = f"(CASE WHEN regexp_matches({v},'[ΩFHVAmHμ]$') THEN {v} ELSE {v}||{unit} END)"
    m = " ".join(f"WHEN '{n}' THEN regexp_matches({full},'{p}')" for n, (p, _) in pats.items())
    return (f"(CASE WHEN {name}='GND' THEN NULL WHEN {name} NOT IN {tuple(pats)} THEN {v} WHEN {name} IN ('V-DC','V-AC') AND regexp_matches({v},'^[1-4][0-9]$|^50$') "
            f"THEN {v}[1]||'.'||{v}[2]||'V' WHEN (CASE {name} {m} ELSE FALSE END) THEN {full} END)")


@query("F29_pattern_test", ("texts", "names_wiring"), f", ud AS (SELECT DISTINCT text FROM texts UNION SELECT DISTINCT CAST(CAST(l_quantity AS INT) AS VARCHAR) FROM lineitem) SELECT text, name, {_fits_sql('text', 'name')} AS fitted FROM ud, (SELECT DISTINCT name FROM names_wiring)")
def _(t):
    bare = t.read("lineitem").select(F.col("l_quantity").cast("int").cast("string").alias("text"))
    names = F.broadcast(dims.mapping(t.spark, dims.NAMES["wiring"], "cls", "name").select("name").distinct())  # fixed, 54 rows
    return t.texts.select("text").unionByName(bare).distinct().crossJoin(names).select(
        "text", "name", text.fits(F.col("text"), F.col("name")).alias("fitted"))


@query("F24_encode_labels", ("texts",), _WORD + _DISTINCT + f", ids AS (SELECT text, list_filter(list_transform(string_split(text,''), lambda c: position(c IN '{dims.READABLE}')), lambda i: i>0) AS l FROM u WHERE text<>'') SELECT text, CASE WHEN len(l)=0 THEN '0' ELSE array_to_string(l,' ') END AS ids FROM ids UNION ALL SELECT text, '0' FROM u WHERE text=''")
def _(t):
    return _words(t).distinct().select("text", F.array_join(F.transform(text.encode(F.col("text")), lambda i: i.cast("string")), " ").alias("ids"))


@query("F25_decode_sequences", ("texts",), _WORD + _DISTINCT + f""", numbered AS MATERIALIZED (SELECT row_number() OVER () AS n, text FROM u),
 ids AS MATERIALIZED (SELECT n, i, position(text[i] IN '{dims.READABLE}') AS v FROM (SELECT n, text, unnest(range(1, length(text)+1)) AS i FROM numbered)),
 seen AS MATERIALIZED (SELECT n, i, v, lag(v) OVER (PARTITION BY n ORDER BY i) AS p FROM ids),
 read AS MATERIALIZED (SELECT n, string_agg('{dims.READABLE}'[v],'' ORDER BY i) AS decoded FROM seen WHERE v<>0 AND (p IS NULL OR p<>v) GROUP BY n)
 SELECT text, coalesce(decoded,'') AS decoded FROM numbered LEFT JOIN read USING (n)""")
def _(t):
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    ids = F.transform(chars, lambda c: F.position(c, F.lit(dims.READABLE)))
    return _words(t).distinct().withColumn("ids", ids).select("text", text.decode(F.col("ids")).alias("decoded"))
