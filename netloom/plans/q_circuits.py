"""Queries over circuits, netlists and review replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions import dims, text
from netloom.operators import netlist, ranks, replies, rules
from netloom.plans.fixtures import sql_list
from netloom.plans.registry import query


def _circuits(t):
    return t.read("orders").select(F.col("o_orderkey").alias("circuit_id"),
                                   F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"),
                                   F.col("o_orderpriority").alias("expected_function"))


def _guard(t):
    return t.guard.renamed("circuit_id")


_ROLES = """, roles AS (SELECT circuit_id, nodes[1] AS node, 'p' AS role FROM parts WHERE type='voltage_source' UNION ALL
 SELECT circuit_id, nodes[2], 'm' FROM parts WHERE type='voltage_source' UNION ALL SELECT circuit_id, nodes[1], 'g' FROM parts WHERE type='ground')"""
_SHORTS = """ SELECT circuit_id, 0 AS rule, idx AS ord, 'short_circuit' AS type, from_node||','||to_node AS refs,
 '电源到地直接短接：'||from_node||' ↔ '||to_node AS description, 1 AS times FROM links l WHERE via IS NULL AND (
 (EXISTS (FROM roles r WHERE r.circuit_id=l.circuit_id AND r.node=from_node AND role='p') AND EXISTS (FROM roles r WHERE r.circuit_id=l.circuit_id AND r.node=to_node AND role IN ('m','g')))
 OR (EXISTS (FROM roles r WHERE r.circuit_id=l.circuit_id AND r.node=to_node AND role='p') AND EXISTS (FROM roles r WHERE r.circuit_id=l.circuit_id AND r.node=from_node AND role IN ('m','g'))))"""
_REVERSED = """ SELECT p.circuit_id, 1 AS rule, p.idx*2+v.side AS ord, 'reverse_polarity' AS type, p.nodes[1]||','||p.nodes[2] AS refs,
 p.id||'('||p.type||')极性接反：'||CASE v.side WHEN 0 THEN '阴极连接到电源正极' ELSE '阳极连接到地' END AS description, count(*) AS times
 FROM parts p JOIN parts s USING (circuit_id) JOIN (VALUES (0),(1)) v(side) ON s.nodes[1+v.side]=p.nodes[2-v.side]
 WHERE p.type IN ('led','diode','capacitor') AND len(p.nodes)=2 AND s.type='voltage_source' GROUP BY ALL"""
_DEGREES = """, degrees AS (SELECT circuit_id, node, count(*) AS degree FROM (SELECT circuit_id, unnest(nodes) AS node FROM parts UNION ALL
 SELECT circuit_id, from_node FROM links UNION ALL SELECT circuit_id, to_node FROM links) GROUP BY ALL)"""
_OPEN = """ SELECT circuit_id, 2 AS rule, 0 AS ord, 'open_circuit' AS type, node AS refs, '悬空节点 '||node||'：只连接到一个元件，可能断路' AS description,
 1 AS times FROM degrees WHERE degree=1"""


def _flat(issues):
    return issues.withColumn("refs", F.array_join("refs", ",")).drop("severity")


@query("J24_short_circuits", ("parts", "links"), _ROLES + _SHORTS)
def _(t):
    return _flat(rules.short_circuits(t.parts, t.links))


@query("J25_reverse_polarity", ("parts",), _REVERSED)
def _(t):
    return _flat(rules.reverse_polarity(t.parts))


@query("A02_open_circuits", ("parts", "links"), _DEGREES + _OPEN)
def _(t):
    return _flat(rules.open_circuits(t.parts, t.links))


@query("A05_all_safety_rules", ("parts", "links"), _ROLES + _DEGREES + f"{_SHORTS} UNION ALL {_REVERSED} UNION ALL {_OPEN}")
def _(t):
    return _flat(rules.safety(t.parts, t.links))


_TALLY = """, tally AS (SELECT o_orderkey AS circuit_id, coalesce(critical,0) AS critical, coalesce(major,0) AS major, coalesce(minor,0) AS minor,
 coalesce(quality,0) AS quality, coalesce(correctness,0) AS correctness FROM orders LEFT JOIN (SELECT circuit_id,
 count(*) FILTER (family='safety' AND severity='critical') AS critical, count(*) FILTER (family='correctness' AND severity='major') AS major,
 count(*) FILTER (family='correctness' AND severity='minor') AS minor, count(*) FILTER (family='quality') AS quality,
 count(*) FILTER (family='correctness') AS correctness FROM issues GROUP BY 1) i ON i.circuit_id=o_orderkey),
 report AS (SELECT *, CAST(greatest(0, least(100, 100-30*critical-15*major-5*minor-3*quality)) AS INT) AS overall_score FROM tally)"""


@query("A03_review_score", ("issues",), _TALLY + " SELECT circuit_id, overall_score FROM report")
def _(t):
    return rules.reports(_circuits(t), t.issues).select("circuit_id", "overall_score")


@query("A04_review_summary", ("issues",), _TALLY + """ SELECT circuit_id, CASE WHEN critical>0 AND major>0 THEN '发现'||critical||'处致命错误；发现'||major||'处功能问题'
 WHEN critical>0 THEN '发现'||critical||'处致命错误' WHEN major>0 THEN '发现'||major||'处功能问题' WHEN correctness+quality>0
 THEN '电路基本正确，有'||(correctness+quality)||'处优化建议' ELSE '电路设计正确，质量良好' END AS summary FROM report""")
def _(t):
    return rules.reports(_circuits(t), t.issues).select("circuit_id", "summary")


@query("A21_issue_counts", ("issues",), """SELECT circuit_id, family, type, count(*) AS n FROM issues
 GROUP BY GROUPING SETS ((circuit_id), (circuit_id, family), (circuit_id, family, type))""")
def _(t):
    return rules.type_counts(t.issues)


@query("P12_score_bands", ("issues",), _TALLY + """ SELECT circuit_id, CASE WHEN overall_score>=70 THEN 'ok' WHEN overall_score>=30 THEN 'warn' ELSE 'fail' END AS band,
 overall_score<80 AS detailed FROM report""")
def _(t):
    return rules.reports(_circuits(t), t.issues).select(
        "circuit_id", rules.band(F.col("overall_score")).alias("band"), (F.col("overall_score") < 80).alias("detailed"))


@query("O05_problem_listing", ("issues",), _TALLY + " SELECT circuit_id, overall_score FROM report WHERE overall_score<80 ORDER BY circuit_id")
def _(t):
    return rules.problems(rules.reports(_circuits(t), t.issues)).select("circuit_id", "overall_score")


@query("P13_listing_truncation", (), "SELECT doc_id, " + ", ".join(f"left(text,{n}) AS t{n}" for n in (50, 60, 80, 100, 2000, 3000)) + " FROM documents")
def _(t):
    return t.read("documents").select("doc_id", *[replies.shortened(F.col("text"), n).alias(f"t{n}") for n in (50, 60, 80, 100, 2000, 3000)])


_SEEN = """, seen AS (SELECT circuit_id, node, min(idx*10+pos) AS first FROM (SELECT circuit_id, idx, unnest(nodes) AS node,
  generate_subscripts(nodes,1) AS pos FROM parts) GROUP BY ALL),
 nums AS (SELECT circuit_id, node, first, CASE WHEN upper(node) IN ('GND','GROUND','0') THEN 0 ELSE row_number() OVER (PARTITION BY circuit_id,
  upper(node) IN ('GND','GROUND','0') ORDER BY first) END AS num FROM seen)"""
_VALUE = r"""CASE WHEN value IS NULL OR value='' THEN '1' WHEN regexp_matches(v, '^[0-9.]+') THEN regexp_extract(v,'^([0-9.]+)\s*([kMmunp]?)',1)||
 CASE regexp_extract(v,'^([0-9.]+)\s*([kMmunp]?)',2) WHEN 'M' THEN 'Meg' ELSE regexp_extract(v,'^([0-9.]+)\s*([kMmunp]?)',2) END ELSE v END"""
_LINES = _SEEN + f""", wide AS (SELECT p.*, replace(replace(trim(value),'Ω',''),'μ','u') AS v,
  list_transform(nodes, lambda x: x) AS ns FROM parts p),
 nn AS (SELECT circuit_id, idx, {','.join(f"max(num) FILTER (pos={i + 1}) AS n{i}" for i in range(5))} FROM (SELECT circuit_id, idx, unnest(nodes) AS node,
  generate_subscripts(nodes,1) AS pos FROM parts) JOIN nums USING (circuit_id, node) GROUP BY ALL),
 plines AS (SELECT circuit_id, idx, CASE WHEN type IN ('resistor','capacitor','inductor') THEN id||' '||n0||' '||n1||' '||{_VALUE}
  WHEN type IN ('voltage_source','current_source') THEN id||' '||n0||' '||n1||' DC '||{_VALUE}
  WHEN type='diode' THEN id||' '||n0||' '||n1||' D_'||id||chr(10)||'.MODEL D_'||id||' D (IS=1e-14 N=1.0)'
  WHEN type='led' THEN id||' '||n0||' '||n1||' LED_'||id||chr(10)||'.MODEL LED_'||id||' D (IS='||CASE WHEN value LIKE '%vf=2.1%' THEN '6e-16' ELSE '1e-15' END||' N=2.0 RS=5)'
  WHEN type='transistor_npn' THEN id||' '||n0||' '||n1||' '||n2||' QNPN'||chr(10)||'.MODEL QNPN NPN (BF=200 IS=1e-14 VAF=100)'
  WHEN type='transistor_pnp' THEN id||' '||n0||' '||n1||' '||n2||' QPNP'||chr(10)||'.MODEL QPNP PNP (BF=100 IS=1e-14 VAF=80)'
  WHEN type='opamp' THEN '* '||id||': Simplified opamp model (VCVS, gain=1e5)'||chr(10)||'E_'||id||' '||(CASE WHEN len(nodes)>3 THEN n4 ELSE n2 END)||' 0 '||n0||' '||n1||' 1e5'||chr(10)||'Rin_'||id||' '||n0||' '||n1||' 1e6'
  WHEN type='switch' THEN 'S_'||id||' '||n0||' '||n1||' 99 0 SMOD'||chr(10)||'.MODEL SMOD SW (RON=0.01 ROFF=1e6 VTH=0.5)'
  WHEN type NOT IN ('ground','wire') THEN '* '||id||': '||type||' not implemented in SPICE converter' END AS line FROM wide JOIN nn USING (circuit_id, idx))"""


@query("W03_node_numbers", ("parts",), _SEEN + " SELECT circuit_id, node, num FROM nums")
def _(t):
    return netlist.node_numbers(t.parts, _guard(t)).select("circuit_id", "node", "num")


@query("F07_netlist_values", ("parts",), f"SELECT circuit_id, idx, {_VALUE} AS parsed FROM (SELECT *, replace(replace(trim(value),'Ω',''),'μ','u') AS v FROM parts)")
def _(t):
    return t.parts.select("circuit_id", "idx", text.netlist_value(F.col("value")).alias("parsed"))


@query("F08_netlist_entries", ("parts",), _LINES + " SELECT circuit_id, idx, line FROM plines WHERE line IS NOT NULL")
def _(t):
    return netlist.part_lines(t.parts, netlist.node_numbers(t.parts, _guard(t)))


@query("F09_led_saturation", (), """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE CAST(l_quantity AS INT)%4 WHEN 0 THEN '1e-14' WHEN 1 THEN '1e-15' WHEN 2 THEN '1e-16' ELSE '1e-17' END AS sat
 FROM lineitem""")
def _(t):
    k = F.col("l_quantity").cast("int") % 4
    v = F.concat(F.lit("red, Vf = "), F.element_at(F.array(*[F.lit(x) for x in ("1.5", "2.0", "2.5", "3.0V")]), k + 1))
    return t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.led_saturation(v).alias("sat"))


for _kind in ("op", "dc", "tran"):
    _foot = {"op": "'.OP'", "tran": "'.TRAN 1u 10m'",
             "dc": "'.DC '||(SELECT arg_min(id, idx) FROM parts p WHERE p.circuit_id=o_orderkey AND type='voltage_source')||' 0 5 0.1'"}[_kind]

    @query(f"F10_netlist_text_{_kind}", ("parts",), _LINES + f""" SELECT * FROM (
     SELECT o_orderkey AS circuit_id, 0 AS section, unnest([0,1,2,3]) AS ord, unnest(['* order '||o_orderkey, '* Generated netlist for SPICE simulation', '', '* Node mapping:']) AS line FROM orders
     UNION ALL SELECT circuit_id, 1, row_number() OVER (PARTITION BY circuit_id ORDER BY num, first), '*   '||node||' -> N'||lpad(CAST(num AS VARCHAR),3,'0') FROM nums WHERE node<>'0'
     UNION ALL SELECT o_orderkey, 2, 0, '' FROM orders
     UNION ALL SELECT circuit_id, 3, idx, line FROM plines
     UNION ALL SELECT o_orderkey, 4, unnest([0,1,2]), unnest(['', {_foot}, '.END']) FROM orders) WHERE line IS NOT NULL""")
    def _(t, kind=_kind):
        return netlist.netlist_lines(_circuits(t), t.parts, kind, _guard(t))


_NET_TEXT = """, net AS (SELECT doc_id AS circuit_id, '* doc '||doc_id||chr(10)||replace(replace(text, '. ', chr(10)), ', ', chr(10)||'V')||chr(10)||
 CASE doc_id%5 WHEN 0 THEN '.OPTIONS x' WHEN 1 THEN '.DC V1 0 5' WHEN 2 THEN '.tran 1u' ELSE 'Q1 2 3 0 NPN' END||chr(10)||'D1 1 2 DX'||chr(10)||'V1 1 0 DC 5'||chr(10)||'.ends'||chr(10)||'R9 1 2 3' AS text FROM documents),
 lines AS (SELECT circuit_id, generate_subscripts(ls,1)-1 AS line_no, regexp_replace(unnest(ls), '^\\s+|\\s+$', '', 'g') AS line FROM (SELECT circuit_id, string_split(text, chr(10)) AS ls FROM net)),
 live AS (SELECT * FROM lines l LEFT JOIN (SELECT circuit_id, min(line_no) AS e FROM lines WHERE upper(line) LIKE '.END%' GROUP BY 1) USING (circuit_id) WHERE line_no < coalesce(e, 1e9))""".replace("\\\\", "\\")


def _net_texts(t):
    k = F.col("doc_id")
    body = F.replace(F.replace("text", F.lit(". "), F.lit("\n")), F.lit(", "), F.lit("\nV"))
    extra = F.when(k % 5 == 0, ".OPTIONS x").when(k % 5 == 1, ".DC V1 0 5").when(k % 5 == 2, ".tran 1u").otherwise("Q1 2 3 0 NPN")
    return t.read("documents").select(k.alias("circuit_id"), F.concat(
        F.lit("* doc "), k.cast("string"), F.lit("\n"), body, F.lit("\n"), extra, F.lit("\nD1 1 2 DX\nV1 1 0 DC 5\n.ends\nR9 1 2 3")).alias("text"))


@query("F11_netlist_headers", (), "WITH x AS (SELECT 1)" + _NET_TEXT + """ SELECT circuit_id, trim(substr(arg_min(line, line_no) FILTER (line LIKE '* %'), 3)) AS title,
 coalesce(arg_max(CASE WHEN upper(line) LIKE '.OP%' THEN 'op' WHEN upper(line) LIKE '.DC%' THEN 'dc' WHEN upper(line) LIKE '.TRAN%' THEN 'tran' END, line_no)
 FILTER (regexp_matches(upper(line), '^[.](OP|DC|TRAN)')), 'op') AS analysis FROM live GROUP BY circuit_id""")
def _(t):
    return netlist.netlist_headers(_net_texts(t))


_PARSED = _NET_TEXT + f""", words AS (SELECT circuit_id, line_no, string_split_regex(line, '\\s+') AS w, coalesce(MAP {{{','.join(f"'{a}':'{b}'" for a, b in dims.LETTER_TYPES.items())}}}[upper(left(line,1))],'unknown') AS type
 FROM live WHERE line<>'' AND line NOT LIKE '*%' AND line NOT LIKE '.%'),
 nparts AS (SELECT circuit_id, line_no, w[1] AS id, type, CASE WHEN type IN ('transistor','mosfet') THEN w[2:4] ELSE w[2:3] END AS nodes,
 CASE WHEN type IN ('voltage_source','current_source') THEN (CASE WHEN upper(w[4])='DC' AND len(w)>4 THEN w[5] WHEN upper(w[4])='AC' THEN coalesce(w[5],'AC') ELSE w[4] END)
  WHEN type IN ('transistor','mosfet','diode') THEN NULL ELSE w[4] END AS value,
 CASE WHEN type IN ('transistor','mosfet') THEN w[5] WHEN type='diode' THEN w[4] END AS model FROM words
 WHERE len(w) >= CASE WHEN type IN ('transistor','mosfet','voltage_source','current_source') THEN 4 ELSE 3 END)"""


@query("F12_netlist_parts", (), "WITH x AS (SELECT 1)" + _PARSED + " SELECT circuit_id, line_no, id, type, array_to_string(nodes, ' ') AS nodes, value, model FROM nparts")
def _(t):
    return netlist.netlist_parts(_net_texts(t)).withColumn("nodes", F.array_join("nodes", " "))


@query("A20_part_listing", (), "WITH x AS (SELECT 1)" + _PARSED + """ SELECT circuit_id, line_no, '  '||id||': '||type||', nodes=['''||array_to_string(nodes, ''', ''')||''']'||
 CASE WHEN coalesce(value,'')<>'' THEN ', value='||value ELSE '' END||CASE WHEN coalesce(model,'')<>'' THEN ', model='||model ELSE '' END AS line FROM nparts""")
def _(t):
    return netlist.listing(netlist.netlist_parts(_net_texts(t)))


_BODY = r"""CASE WHEN response LIKE '```%' THEN trim(regexp_replace(regexp_replace(response, '^```[^\n]*\n', ''), '\n```$', ''), chr(10)||' ') ELSE response END"""


@query("F13_strip_fences", ("replies",), f"SELECT circuit_id, {_BODY} AS body FROM replies")
def _(t):
    return t.replies.select("circuit_id", text.strip_fences(F.col("response")).alias("body"))


_FIRST = f""", b AS (SELECT circuit_id, {_BODY} AS body FROM replies),
 ch AS (SELECT circuit_id, generate_subscripts(cs,1) AS i, unnest(cs) AS c FROM (SELECT circuit_id, string_split(body,'') AS cs FROM b WHERE body LIKE '{{%')),
 ends AS (SELECT circuit_id, min(i) AS e FROM (SELECT *, sum(CASE c WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY circuit_id ORDER BY i) AS depth FROM ch) WHERE depth=0 AND c='}}' GROUP BY 1),
 js AS (SELECT circuit_id, CASE WHEN body LIKE '{{%' THEN left(body, coalesce(e,0)) ELSE body END AS json FROM b LEFT JOIN ends USING (circuit_id))"""


@query("F14_first_json", ("replies",), _FIRST + " SELECT * FROM js")
def _(t):
    return replies.with_json(t.replies).select("circuit_id", "json")


@query("F15_F17_typed_issues", ("replies",), _FIRST + """, fam AS (SELECT circuit_id, f, key, CAST(json_extract(json, key) AS JSON[]) AS items FROM js,
  (VALUES ('safety','$.fatal_errors'),('correctness','$.correctness_issues'),('quality','$.quality_issues')) v(f,key) WHERE json_valid(json))
 SELECT circuit_id, f AS family, ord, type, CASE WHEN f='correctness' AND severity NOT IN ('major','minor') THEN 'minor' WHEN f='quality' AND severity NOT IN ('minor','suggestion') THEN 'minor' ELSE severity END AS severity,
 description, suggestion FROM (SELECT circuit_id, f, generate_subscripts(items,1)-1 AS ord, json_extract_string(unnest(items),'$.type') AS type, json_extract_string(unnest(items),'$.severity') AS severity,
 json_extract_string(unnest(items),'$.description') AS description, json_extract_string(unnest(items),'$.suggestion') AS suggestion FROM fam)""")
def _(t):
    return replies.reply_issues(replies.parse_replies(t.replies))


@query("F15_reply_status", ("replies",), _FIRST + """ SELECT circuit_id, coalesce(json<>'' AND json_valid(json), FALSE) AS ok, CASE WHEN json<>'' AND json_valid(json) THEN CAST(json_extract(json,'$.overall_score') AS INT) END AS overall_score,
 CASE WHEN json<>'' AND json_valid(json) THEN json_extract_string(json,'$.summary') END AS summary FROM js""")
def _(t):
    return replies.parse_replies(t.replies).select("circuit_id", "ok", "reply.overall_score", "reply.summary")


@query("F16_part_validation", ("parts",), f"""SELECT circuit_id, idx, CASE WHEN (CASE WHEN idx%6=5 THEN 'tube' ELSE type END) NOT IN {dims.PART_TYPES} THEN 'type' WHEN idx%9=8 THEN 'nodes' END AS reject FROM parts""")
def _(t):
    p = t.parts.withColumn("type", F.when(F.col("idx") % 6 == 5, "tube").otherwise(F.col("type"))).withColumn(
        "nodes", F.when(F.col("idx") % 9 != 8, F.col("nodes")))
    return rules.part_rejects(p).select("circuit_id", "idx", "reject")


@query("F16_issue_validation", ("issues",), f"""SELECT circuit_id, idx, CASE WHEN NOT ((family='safety' AND type IN {dims.SAFETY_TYPES}) OR (family='correctness' AND type IN {dims.CORRECTNESS_TYPES}) OR (family='quality' AND type IN {dims.QUALITY_TYPES})) THEN 'type'
 WHEN NOT ((family='safety' AND severity='critical') OR (family='correctness' AND severity IN ('major','minor')) OR (family='quality' AND severity IN ('minor','suggestion'))) THEN 'severity' END AS reject FROM issues""")
def _(t):
    return rules.issue_rejects(t.issues).select("circuit_id", "idx", "reject")


_HEAD, _MID, _TAIL = ["电路名称: {name}", "预期功能: {expected_function}", "", "元件列表:"], ["", "连接关系:"], ["", "JSON"]


@query("F28_prompt_lines", ("parts", "links"), f""" SELECT * FROM (SELECT o_orderkey AS circuit_id, 0 AS section, unnest([0,1,2,3]) AS ord, unnest(['电路名称: order '||o_orderkey, '预期功能: '||o_orderpriority, '', '元件列表:']) AS line FROM orders
 UNION ALL SELECT circuit_id, 1, idx, '- '||id||': '||type||', value='||coalesce(value,'None')||', nodes=['''||array_to_string(nodes, ''', ''')||''']' FROM parts
 UNION ALL SELECT o_orderkey, 2, unnest([0,1]), unnest({sql_list(_MID)}) FROM orders
 UNION ALL SELECT circuit_id, 3, idx, '- '||from_node||' → '||to_node||coalesce(' via '||via,'') FROM links
 UNION ALL SELECT o_orderkey, 4, unnest([0,1]), unnest({sql_list(_TAIL)}) FROM orders)""")
def _(t):
    return replies.prompt_lines(_circuits(t), t.parts, t.links, _HEAD, _MID, _TAIL)


def _array_replies(t):
    item = F.struct("idx", "type", "severity", F.concat(F.lit("about "), "type").alias("description"), F.when(F.col("idx") % 3 != 0, "fix").alias("suggestion"),
                    F.when(F.col("idx") % 4 != 0, F.array(F.concat(F.lit("P"), F.col("idx").cast("string")), F.lit("P0"))).alias("components"))
    return t.issues.where("family = 'correctness'").groupBy("circuit_id").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("j")).select(
        "circuit_id", F.concat(F.lit("```json\n"), "j", F.lit("\n```")).alias("response"))


_ARRAYS = """ SELECT circuit_id, row_number() OVER (PARTITION BY circuit_id ORDER BY idx) - 1 AS ord, type, CASE WHEN severity IN ('major','minor') THEN severity ELSE 'minor' END AS severity,
 'about '||type AS description, CASE WHEN idx%3<>0 THEN 'fix' END AS suggestion, CASE WHEN idx%4<>0 THEN 'P'||idx||',P0' END AS components FROM issues WHERE family='correctness'"""


@query("F15_array_replies", ("issues",), _ARRAYS)
def _(t):
    return replies.array_issues(_array_replies(t), F.lit("correctness")).select(
        "circuit_id", "ord", "type", "severity", "description", "suggestion", F.when(F.col("components").isNotNull(), F.array_join("components", ",")).alias("components"))


@query("F16_required_fields", ("issues",), "SELECT circuit_id, ord, CASE WHEN components IS NULL THEN 'components' WHEN suggestion IS NULL THEN 'suggestion' END AS reject FROM (" + _ARRAYS + ")")
def _(t):
    return rules.field_rejects(replies.array_issues(_array_replies(t), F.lit("correctness"))).select("circuit_id", "ord", "reject")


@query("F16_report_validation", ("replies",), _FIRST + """ SELECT circuit_id, CASE WHEN NOT (json<>'' AND json_valid(json)) OR CAST(json_extract(json,'$.overall_score') AS INT) > 60 THEN 'overall_score' END AS reject FROM js""")
def _(t):
    read = replies.parse_replies(t.replies).select("circuit_id", "reply.overall_score", "reply.summary")
    # scores above 60 are moved out of the range
    return rules.report_rejects(read.withColumn("overall_score", F.when(F.col("overall_score") > 60, F.col("overall_score") + 41).otherwise(F.col("overall_score")))).select("circuit_id", "reject")


def _circuit_replies(t):
    parts = t.parts.groupBy("circuit_id").agg(F.sort_array(F.collect_list(F.struct("idx", "id", "type", "value", "nodes"))).alias("components"))
    links = t.links.groupBy("circuit_id").agg(F.sort_array(F.collect_list(F.struct("idx", "from_node", "to_node", "via"))).alias("connections"))
    doc = F.to_json(F.struct("name", F.when(F.col("circuit_id") % 5 != 0, F.col("expected_function")).alias("expected_function"), "components", "connections"))
    return _circuits(t).join(parts, "circuit_id").join(links, "circuit_id").select("circuit_id", F.concat(F.lit("```json\n"), doc, F.lit("\n```")).alias("response"))


@query("F15_circuit_parts", ("parts",), "SELECT circuit_id, row_number() OVER (PARTITION BY circuit_id ORDER BY idx) - 1 AS idx, id, type, value, array_to_string(nodes, ',') AS nodes FROM parts WHERE circuit_id%5<>0")
def _(t):
    return replies.circuit_parts(replies.circuit_replies(_circuit_replies(t))).withColumn("nodes", F.array_join("nodes", ","))


@query("F15_circuit_links", ("links",), "SELECT circuit_id, row_number() OVER (PARTITION BY circuit_id ORDER BY idx) - 1 AS idx, from_node, to_node, via FROM links WHERE circuit_id%5<>0")
def _(t):
    return replies.circuit_links(replies.circuit_replies(_circuit_replies(t)))


@query("F15_circuit_status", ("parts",), "SELECT circuit_id, CASE WHEN circuit_id%5=0 THEN 'expected_function' END AS reject FROM (SELECT DISTINCT circuit_id FROM parts)")
def _(t):
    return replies.circuit_replies(_circuit_replies(t)).select("circuit_id", "reject")


_SHAPES = (("description", "Draw: {description}."), ("netlist_request", "As a netlist: {description}"), ("netlist_review", "{name}:\n{netlist}\nIs it right?"),
           ("simulation", "{name} gave {result}"), ("wired_review", "{name}\n{components}\n{groups}"))


@query("F28_prompt_shapes", (), """SELECT doc_id AS circuit_id, shape, CASE shape WHEN 'description' THEN 'Draw: '||text||'.' WHEN 'netlist_request' THEN 'As a netlist: '||text
 WHEN 'netlist_review' THEN source||':'||chr(10)||left(text, 2000)||chr(10)||'Is it right?' WHEN 'simulation' THEN source||' gave '||lang
 ELSE source||chr(10)||text||chr(10)||lang END AS prompt FROM (SELECT doc_id, coalesce(text,'None') AS text, coalesce(source,'None') AS source, coalesce(lang,'None') AS lang FROM documents),
 (SELECT unnest(['description','netlist_request','netlist_review','simulation','wired_review']) AS shape)""")
def _(t):
    d = t.read("documents").select(F.col("doc_id").alias("circuit_id"), F.col("text").alias("description"), F.col("source").alias("name"), F.col("lang").alias("result"),
                                   F.col("text").alias("netlist"), F.col("text").alias("components"), F.col("lang").alias("groups"))
    out = None
    for shape, wording in _SHAPES:
        own = replies.prompts(d, shape, wording).withColumn("shape", F.lit(shape))
        out = own if out is None else out.unionByName(own)
    return out
