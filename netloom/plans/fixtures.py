"""Circuit-shaped tables derived from the given tables, as DataFrames and as the same SQL.

Nothing is read but the given tables; every derived table grows with them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from netloom import session
from netloom.functions import dims
from netloom.operators import detect, ranks

CLASSES = ("resistor", "capacitor.polarized", "capacitor.unpolarized", "diode", "diode.light_emitting", "gnd",
           "junction", "terminal", "text", "voltage.dc", "transistor.bjt", "crossover", "junction", "resistor",
           "voltage.ac", "integrated_circuit", "integrated_circuit.ne555", "junction", "operational_amplifier",
           "inductor", "text", "transformer", "diode.zener", "explanatory")
SUFFIXES = ("k", "V", "R7", "H", "Ω", "uF", "A5", "")
VALUES = ("Ω", "kΩ", "MΩ", "μF", "V", "", "k", "vf=2.1")

_guards: dict[tuple, ranks.SkewGuard] = {}
_lines: dict[tuple, int] = {}


def _pick(values: tuple, index) -> "F.Column":
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def sql_list(values) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


class Tables:
    """Derived tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        session.settle(spark)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def version(self) -> tuple:
        """Names, sizes and times of what the folder holds: results kept for it are kept for these files."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))

    @property
    def guard(self) -> ranks.SkewGuard:
        """Orders with very many lines, counted once per folder and session."""
        key = (self.spark.sparkContext.applicationId, self.folder, self.version)
        if key not in _guards:
            _guards[key] = ranks.SkewGuard(self.read("lineitem").select("l_orderkey"), ["l_orderkey"])
        return _guards[key]

    @property
    def image_guard(self) -> ranks.SkewGuard:
        return self.guard.renamed("image_id")

    @property
    def lines(self) -> int:
        """Rows of lineitem, counted once per folder and session."""
        key = (self.spark.sparkContext.applicationId, self.folder, self.version)
        if key not in _lines:
            _lines[key] = self.read("lineitem").count()
        return _lines[key]

    @cached_property
    def base(self) -> DataFrame:
        session.deal(self.spark, self.lines)
        return ranks.row_number(self.read("lineitem"), ["l_orderkey"],
                                ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "idx",
                                start=0, guard=self.guard)

    @cached_property
    def boxes(self) -> DataFrame:
        p, s, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("int")
        return self.base.select(
            F.col("l_orderkey").alias("image_id"), "idx", _pick(CLASSES, 1 + p % 24).alias("cls"),
            ((1 + (p * 7) % 99).cast("double") / 100).alias("conf"),
            ((p * 37) % 400).alias("x1"), ((s * 53) % 400).alias("y1"),
            ((p * 37) % 400 + 20 + q * 3).alias("x2"), ((s * 53) % 400 + 20 + (p % 60) * 2).alias("y2"))

    def comps(self, profile: str) -> DataFrame:
        return detect.with_names(detect.profile_filter(self.boxes, profile), profile)

    def ports(self, profile: str) -> DataFrame:
        return detect.place_ports(self.comps(profile), profile).withColumnRenamed("idx", "ci")

    @cached_property
    def refs(self) -> DataFrame:
        """Reference boxes: the boxes moved a little, some of them missing."""
        return self.boxes.where("(x1 + y1) % 10 <> 0").select(
            "image_id", "idx", "cls", (F.col("x1") + F.col("idx") % 7).alias("x1"),
            (F.col("y1") - F.col("idx") % 5).alias("y1"), (F.col("x2") + F.col("idx") % 7).alias("x2"),
            (F.col("y2") + F.col("idx") % 5).alias("y2"))

    @cached_property
    def junctions(self) -> DataFrame:
        return detect.with_centre(detect.route_boxes(self.boxes).where("route = 'junction'")).select(
            "image_id", F.col("cx").alias("jx"), F.col("cy").alias("jy")).distinct()

    @cached_property
    def texts(self) -> DataFrame:
        p, s = F.col("l_partkey"), F.col("l_suppkey")
        x, y = (s * 31) % 500, (p * 17) % 500
        return self.base.select(
            F.col("l_orderkey").alias("image_id"), F.col("idx").alias("text_ord"),
            F.concat(F.col("l_quantity").cast("int").cast("string"), _pick(SUFFIXES, 1 + s % 8)).alias("text"),
            x.alias("x1"), y.alias("y1"), (x + 30).alias("x2"), (y + 14).alias("y2"),
            (x + 15).alias("cx"), (y + 7).alias("cy"))

    @cached_property
    def segments(self) -> DataFrame:
        p, s = (F.col("l_partkey") * 37) % 90, (F.col("l_suppkey") * 53) % 90
        return self.base.select(
            F.col("l_orderkey").alias("image_id"), F.col("idx").alias("seg"), p.alias("x1"), s.alias("y1"),
            (p + (F.col("l_quantity").cast("int") % 7) * 10).alias("x2"),
            (s + (F.col("l_linenumber") % 4) * 10).alias("y2"))

    @cached_property
    def images(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderkey").alias("image_id"), (1000 + (F.col("o_orderkey") % 7) * 300).alias("width"),
            (800 + (F.col("o_orderkey") % 5) * 250).alias("height"))

    @cached_property
    def parts(self) -> DataFrame:
        def node(k):
            return F.when(k % 5 == 0, "GND").otherwise(F.concat(F.lit("N"), (k % 5).cast("string")))
        p, s = F.col("l_partkey"), F.col("l_suppkey")
        t = _pick(dims.PART_TYPES, 1 + p % 15)
        five = F.array(node(s), node(p), node(p + s), node(p + 1), node(s + 1))
        n = F.when(t.isin("transistor_npn", "transistor_pnp", "mosfet_n", "mosfet_p"), 3).when(
            t == "opamp", F.when(s % 2 == 0, 3).otherwise(5)).when(t == "ground", 1).otherwise(2)
        return self.base.select(
            F.col("l_orderkey").alias("circuit_id"), "idx", F.concat(F.lit("P"), F.col("idx").cast("string")).alias("id"),
            t.alias("type"),
            F.when(s % 11 != 0, F.concat(F.col("l_quantity").cast("int").cast("string"),
                                         _pick(VALUES, 1 + s % 8))).alias("value"),
            F.slice(five, F.lit(1), n).alias("nodes"))

    @cached_property
    def links(self) -> DataFrame:
        def node(k):
            return F.when(k % 5 == 0, "GND").otherwise(F.concat(F.lit("N"), (k % 5).cast("string")))
        return self.base.select(
            F.col("l_orderkey").alias("circuit_id"), "idx", node(F.col("l_suppkey")).alias("from_node"),
            node(F.col("l_partkey")).alias("to_node"),
            F.when(F.col("l_returnflag") != "N", F.concat(F.lit("P"), F.col("idx").cast("string"))).alias("via"))

    def _members(self, group) -> DataFrame:
        return self.base.select(
            F.col("l_orderkey").alias("image_id"), (group % 4).cast("bigint").alias("g"), F.col("idx").alias("member_ord"),
            F.concat(F.lit("R"), F.floor(F.col("idx") / 2).cast("string")).alias("designator"),
            (F.col("l_linenumber") % 2 + 1).cast("string").alias("label"))

    @cached_property
    def truth(self) -> DataFrame:
        return self._members(F.col("l_suppkey"))

    @cached_property
    def predicted(self) -> DataFrame:
        return self._members(F.when(F.col("l_linenumber") % 3 == 0, F.col("l_partkey")).otherwise(F.col("l_suppkey")))

    @cached_property
    def pictures(self) -> DataFrame:
        """Annotated pictures: one per document."""
        return self.read("documents").select(
            F.col("source").alias("drafter"), F.col("doc_id").alias("ord"), (F.col("n_chars") % 30).alias("count"),
            (F.col("n_chars") % 3).alias("terminals"))

    @cached_property
    def replies(self) -> DataFrame:
        """Review replies: fenced, broken or plain JSON text, one per order."""
        k = F.col("o_orderkey")
        body = F.concat(
            F.lit('{"overall_score": '), (k % 101).cast("string"), F.lit(', "fatal_errors": ['),
            F.when(k % 3 == 0, F.lit('{"type": "short_circuit", "severity": "critical", "description": "A} {B"}')).otherwise(""),
            F.lit('], "correctness_issues": ['),
            F.when(k % 4 == 1, F.concat(F.lit('{"type": "wrong_value", "severity": "'),
                                        _pick(("major", "minor", "fatal"), 1 + k % 3),
                                        F.lit('", "description": "value of R1", "suggestion": "change"}'))).otherwise(""),
            F.lit('], "quality_issues": [], "summary": "order '), k.cast("string"), F.lit('"}'))
        return self.read("orders").select(
            k.alias("circuit_id"),
            F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .when((F.col("o_orderstatus") == "P") & (k % 2 == 0), F.substring(body, F.lit(1), F.length(body) - 1))
            .when(F.col("o_orderstatus") == "P", F.concat(body, F.lit(" and some talk }")))
            .otherwise(body).alias("response"))

    @cached_property
    def issues(self) -> DataFrame:
        """Review issues in long form, one per line."""
        fam = _pick(("safety", "correctness", "quality"), 1 + F.col("l_suppkey") % 3)
        return self.base.select(
            F.col("l_orderkey").alias("circuit_id"), fam.alias("family"),
            _pick(("short_circuit", "wrong_value", "cost", "thermal"), 1 + F.col("l_partkey") % 4).alias("type"),
            _pick(("critical", "major", "minor", "suggestion"), 1 + F.col("l_linenumber") % 4).alias("severity"), "idx")

    @cached_property
    def experiments(self) -> DataFrame:
        """Results per picture and setting, some of them failed."""
        k = F.col("o_orderkey")
        names = F.array(*[F.struct(F.lit(n).alias("config"), F.lit(i).alias("c")) for i, n in enumerate(dims.ABLATIONS)])
        def rate(a):
            return F.when((k + F.col("c")) % 17 != 0, ((k * a + F.col("c") * 13) % 101).cast("double") / 100)
        return self.read("orders").select("o_orderkey", F.inline(names)).select(
            k.alias("image_id"), "config", (k % 26).alias("n_components"), (k % 9).alias("n_gt_groups"),
            (k % 8).alias("n_pred_groups"), rate(7).alias("port_correct_rate"), rate(11).alias("fp_rate"),
            rate(17).alias("fn_rate"), rate(19).alias("group_accuracy"), rate(23).alias("comp_neighbor_accuracy"))


# ---- the same tables in SQL ------------------------------------------------------------------------
def _values(rows, cols: str) -> str:
    def lit(v):
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return f"SELECT * FROM (VALUES {','.join('(' + ','.join(map(lit, r)) + ')' for r in rows)}) t({cols})"


def _node(k):
    return f"CASE WHEN ({k})%5=0 THEN 'GND' ELSE 'N'||(({k})%5) END"


def _skip(profile):
    return ",".join(f"'{c}'" for c in dims.SKIP[profile])


def _named(profile):
    disp = "coalesce(d.display, b.cls)" if profile in dims.DISPLAY else "coalesce(n.name, b.cls)"
    pk = "coalesce(k.port_key, b.cls)" if profile in dims.PORT_KEYS else "coalesce(n.name, b.cls)"
    j = f"LEFT JOIN names_{profile} n USING (cls)"
    if profile in dims.DISPLAY:
        j += f" LEFT JOIN display_{profile} d USING (cls)"
    if profile in dims.PORT_KEYS:
        j += f" LEFT JOIN keys_{profile} k USING (cls)"
    return f"coalesce(n.name, b.cls) AS name, {disp} AS display, {pk} AS port_key", j


def _comps(profile):
    cols, j = _named(profile)
    where = {"wiring": f"conf>=0.4 AND cls NOT IN ({_skip('wiring')},'junction','terminal','text')"}.get(
        profile, f"conf>={dims.CONF.get(profile)} AND cls NOT IN ({_skip(profile) if profile in dims.SKIP else ''})")
    return f"SELECT b.*, {cols} FROM boxes b {j} WHERE {where}"


def _turned(flat):
    return ("CASE WHEN x2<=x1 OR y2<=y1 THEN FALSE WHEN cls LIKE '%light_emitting%' THEN r<0.55 "
            f"WHEN cls LIKE '%capacitor.polarized%' THEN r<0.75 WHEN {flat} THEN r>1.5 ELSE r<0.6 END")


def _ports(profile):
    middle = profile == "annotation"
    known = ",".join(f"'{n}'" for n in dims.TEMPLATES[profile])
    extra = f"WHERE t.pi IS NOT NULL OR c.port_key NOT IN ({known})" if middle else ""
    return f"""SELECT image_id, idx AS ci, cls, conf, x1,y1,x2,y2, name, display, port_key, pi, n_ports,
  CAST(trunc(x1+(CASE WHEN turn THEN 1-ry ELSE rx END)*(x2-x1)) AS BIGINT) AS px,
  CAST(trunc(y1+(CASE WHEN turn THEN rx ELSE ry END)*(y2-y1)) AS BIGINT) AS py
  FROM (SELECT *, n_ports=2 AND cls NOT IN ('gnd','vss','GND') AND name<>'GND' AND ({_turned('flat')}) AS turn
   FROM (SELECT c.*, coalesce(t.pi,0) AS pi, coalesce(t.n_ports,1) AS n_ports, coalesce(t.flat,FALSE) AS flat,
     coalesce(t.rx,0.5::DOUBLE) AS rx, coalesce(t.ry,0.5::DOUBLE) AS ry,
     CAST(y2-y1 AS DOUBLE)/greatest(x2-x1,1) AS r
    FROM comps_{profile} c {'LEFT' if middle else ''} JOIN templates_{profile} t USING (port_key) {extra}))"""


def _members(group):
    return f"""SELECT l_orderkey AS image_id, ({group})%4 AS g, idx AS member_ord, 'R'||(idx//2) AS designator,
  CAST(l_linenumber%2+1 AS VARCHAR) AS label FROM base"""


_REPLY = """'{"overall_score": '||(o_orderkey%101)||', "fatal_errors": ['||CASE WHEN o_orderkey%3=0 THEN
 '{"type": "short_circuit", "severity": "critical", "description": "A} {B"}' ELSE '' END||'], "correctness_issues": ['||
 CASE WHEN o_orderkey%4=1 THEN '{"type": "wrong_value", "severity": "'||['major','minor','fatal'][1+o_orderkey%3]||
 '", "description": "value of R1", "suggestion": "change"}' ELSE '' END||'], "quality_issues": [], "summary": "order '||
 o_orderkey||'"}'"""

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "base": ((), """SELECT *, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice)-1 AS idx FROM lineitem"""),
    "boxes": (("base",), f"""SELECT l_orderkey AS image_id, idx, {sql_list(CLASSES)}[CAST(1+l_partkey%24 AS INT)] AS cls,
      CAST(1+(l_partkey*7)%99 AS DOUBLE)/100 AS conf, (l_partkey*37)%400 AS x1, (l_suppkey*53)%400 AS y1,
      (l_partkey*37)%400+20+CAST(l_quantity AS INT)*3 AS x2, (l_suppkey*53)%400+20+(l_partkey%60)*2 AS y2 FROM base"""),
    "refs": (("boxes",), """SELECT image_id, idx, cls, x1+idx%7 AS x1, y1-idx%5 AS y1, x2+idx%7 AS x2, y2+idx%5 AS y2
      FROM boxes WHERE (x1+y1)%10<>0"""),
    "junctions": (("boxes",), """SELECT DISTINCT image_id, (x1+x2)//2 AS jx, (y1+y2)//2 AS jy FROM boxes
      WHERE cls IN ('junction','terminal') AND conf>=0.1"""),
    "texts": (("base",), f"""SELECT *, x1+30 AS x2, y1+14 AS y2, x1+15 AS cx, y1+7 AS cy FROM (
      SELECT l_orderkey AS image_id, idx AS text_ord, CAST(l_quantity AS INT)||{sql_list(SUFFIXES)}[CAST(1+l_suppkey%8 AS INT)] AS text,
      (l_suppkey*31)%500 AS x1, (l_partkey*17)%500 AS y1 FROM base)"""),
    "segments": (("base",), """SELECT l_orderkey AS image_id, idx AS seg, (l_partkey*37)%90 AS x1, (l_suppkey*53)%90 AS y1,
      (l_partkey*37)%90+(CAST(l_quantity AS INT)%7)*10 AS x2, (l_suppkey*53)%90+(l_linenumber%4)*10 AS y2 FROM base"""),
    "images": ((), "SELECT o_orderkey AS image_id, 1000+(o_orderkey%7)*300 AS width, 800+(o_orderkey%5)*250 AS height FROM orders"),
    "limits": (("images",), "SELECT *, " + ", ".join(
        (f"CAST(trunc({v}*scale) AS INT) AS {n}" if fl is None else f"greatest({fl}, CAST(trunc({v}*scale) AS INT)) AS {n}")
        for n, (v, fl) in dims.SCALED.items())
        + " FROM (SELECT *, sqrt(CAST(height AS DOUBLE)*height+CAST(width AS DOUBLE)*width)/2000 AS scale FROM images)"),
    "parts": (("base",), f"""SELECT circuit_id, idx, id, type, value, list_slice(five, 1, CASE WHEN type IN
      ('transistor_npn','transistor_pnp','mosfet_n','mosfet_p') THEN 3 WHEN type='opamp' THEN (CASE WHEN s%2=0 THEN 3 ELSE 5 END)
      WHEN type='ground' THEN 1 ELSE 2 END) AS nodes FROM (
      SELECT l_orderkey AS circuit_id, idx, 'P'||idx AS id, {sql_list(dims.PART_TYPES)}[CAST(1+l_partkey%15 AS INT)] AS type,
      CASE WHEN l_suppkey%11<>0 THEN CAST(l_quantity AS INT)||{sql_list(VALUES)}[CAST(1+l_suppkey%8 AS INT)] END AS value,
      l_suppkey AS s, [{_node('l_suppkey')},{_node('l_partkey')},{_node('l_partkey+l_suppkey')},{_node('l_partkey+1')},
      {_node('l_suppkey+1')}] AS five FROM base)"""),
    "links": (("base",), f"""SELECT l_orderkey AS circuit_id, idx, {_node('l_suppkey')} AS from_node, {_node('l_partkey')} AS to_node,
      CASE WHEN l_returnflag<>'N' THEN 'P'||idx END AS via FROM base"""),
    "truth": (("base",), _members("l_suppkey")),
    "predicted": (("base",), _members("CASE WHEN l_linenumber%3=0 THEN l_partkey ELSE l_suppkey END")),
    "pictures": ((), """SELECT source AS drafter, doc_id AS ord, n_chars%30 AS count, n_chars%3 AS terminals FROM documents"""),
    "replies": ((), f"""SELECT circuit_id, CASE WHEN st='F' THEN '```json'||chr(10)||body||chr(10)||'```'
      WHEN st='P' AND circuit_id%2=0 THEN left(body, length(body)-1) WHEN st='P' THEN body||' and some talk }}'
      ELSE body END AS response FROM (SELECT o_orderkey AS circuit_id, o_orderstatus AS st, {_REPLY} AS body FROM orders)"""),
    "issues": (("base",), """SELECT l_orderkey AS circuit_id, ['safety','correctness','quality'][CAST(1+l_suppkey%3 AS INT)] AS family,
      ['short_circuit','wrong_value','cost','thermal'][CAST(1+l_partkey%4 AS INT)] AS type,
      ['critical','major','minor','suggestion'][CAST(1+l_linenumber%4 AS INT)] AS severity, idx FROM base"""),
    "experiments": ((), """SELECT o_orderkey AS image_id, config, o_orderkey%26 AS n_components, o_orderkey%9 AS n_gt_groups,
      o_orderkey%8 AS n_pred_groups, """ + ", ".join(
        f"CASE WHEN (o_orderkey+c)%17<>0 THEN CAST((o_orderkey*{a}+c*13)%101 AS DOUBLE)/100 END AS {n}" for a, n in
        ((7, "port_correct_rate"), (11, "fp_rate"), (17, "fn_rate"), (19, "group_accuracy"), (23, "comp_neighbor_accuracy")))
        + " FROM orders, (" + _values([(n, i) for i, n in enumerate(dims.ABLATIONS)], "config,c") + ")"),
}
for _p in dims.NAMES:
    CTES[f"names_{_p}"] = ((), _values(list(dims.NAMES[_p].items()), "cls,name"))
for _p in dims.DISPLAY:
    CTES[f"display_{_p}"] = ((), _values(list(dims.DISPLAY[_p].items()), "cls,display"))
    CTES[f"keys_{_p}"] = ((), _values(list(dims.PORT_KEYS[_p].items()), "cls,port_key"))
for _p in ("wiring", "annotation", "reading"):
    CTES[f"comps_{_p}"] = (("boxes", f"names_{_p}", *((f"display_{_p}", f"keys_{_p}") if _p in dims.DISPLAY else ())), _comps(_p))
    CTES[f"templates_{_p}"] = ((), _values(dims.template_rows(_p), "port_key,pi,rx,ry,n_ports,flat"))
    CTES[f"ports_{_p}"] = ((f"comps_{_p}", f"templates_{_p}"), _ports(_p))
for _p in dims.LABELS:
    CTES[f"labels_{_p}"] = ((), _values(dims.label_rows(_p), "name,pi,label"))


def with_sql(needs: tuple[str, ...], body: str, recursive: bool = False) -> str:
    """`body` preceded by the derived tables it needs, dependencies first. A body may go on with
    further tables by starting with a comma."""
    done: list[str] = []

    def visit(name: str):
        if name not in done:
            for dep in CTES[name][0]:
                visit(dep)
            done.append(name)
    for n in needs:
        visit(n)
    head = ", ".join(f"{n} AS ({CTES[n][1]})" for n in done)
    if not head:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}{head} {body}"
