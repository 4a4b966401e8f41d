"""Queries that write derived tables in the file formats and read them back, and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions import dims
from netloom.lineage import cut, scratch_path
from netloom.operators import detect, ranks
from netloom.plans.fixtures import sql_list
from netloom.plans.q_metrics import _CORR, _posts
from netloom.plans.registry import query
from netloom.sources import files, readers, sinks
from netloom.streaming import jobs


def _write_suppliers(t, line, path: str) -> None:
    """A file for each supplier, all in one folder: a folder for each would be made, renamed and listed by the driver alone."""
    files.write_named(t.read("supplier").select(F.format_string("s_suppkey=%d.txt", "s_suppkey").alias("name"), line.alias("line")), [], path)


@query("S01_descriptions", (), "SELECT s_suppkey AS circuit, '电路描述：'||s_name||chr(10) AS description FROM supplier")
def _(t):
    path = scratch_path(t.spark, "descriptions")
    _write_suppliers(t, F.concat(F.lit("电路描述："), "s_name"), path)
    out = readers.descriptions(t.spark, path)
    return out.select(F.regexp_extract("path", r"s_suppkey=(\d+)", 1).cast("bigint").alias("circuit"), "description")


def _docs(t):
    named = detect.designators(t.comps("annotation"), "annotation", t.image_guard)
    comps = cut(named, "named")
    img = F.concat(F.lit("C"), F.col("image_id").cast("string"), F.lit(".jpg"))
    ports = detect.with_labels(detect.place_ports(comps, "annotation"), "annotation").select(
        img.alias("image"), F.col("idx").alias("ci"), "pi", "px", "py", "label")
    c = comps.join(t.images, "image_id").withColumn("image", img).withColumn("raw_name", F.col("cls"))
    path = scratch_path(t.spark, "detections")
    sinks.write_detections(c, ports, path)
    return readers.detections(t.spark, path, whole_files=False)


_DES = f""", des AS (SELECT image_id, idx AS ci, prefix||row_number() OVER (PARTITION BY image_id, prefix ORDER BY idx) AS designator
  FROM (SELECT *, coalesce(MAP {{{','.join(f"'{n}':'{p}'" for n, p in dims.PREFIXES['annotation'].items())}}}[name], left(name,1)) AS prefix FROM comps_annotation))"""


@query("S02_detection_components", ("comps_annotation", "images"), _DES + """ SELECT 'C'||image_id||'.jpg' AS image, width, height, idx, name, cls AS raw_name, designator, conf, x1, y1, x2, y2
 FROM comps_annotation c JOIN images USING (image_id) JOIN des d ON d.image_id=c.image_id AND d.ci=c.idx""".replace("c JOIN images USING (image_id) JOIN des d ON d.image_id=c.image_id AND d.ci=c.idx", "c JOIN images USING (image_id) JOIN (SELECT image_id, ci AS idx, designator FROM des) d USING (image_id, idx)"))
def _(t):
    return readers.detection_components(_docs(t)).drop("n_ports")


@query("S02_S12_detection_ports", ("comps_annotation", "ports_annotation", "labels_annotation"), _DES + """ SELECT 'C'||image_id||'.jpg' AS image, ci, pi, name, designator, px, py, coalesce(label,'?') AS label
 FROM ports_annotation JOIN des USING (image_id, ci) LEFT JOIN labels_annotation USING (name, pi)""")
def _(t):
    return readers.detection_ports(_docs(t))


@query("S06_annotated_objects", ("boxes",), """SELECT 'C'||image_id||'.jpg' AS filename, cls AS name, CASE WHEN cls='text' THEN '10k' END AS text, x1, y1, x2, y2 FROM boxes""")
def _(t):
    b = t.boxes
    o = F.struct(F.col("cls").alias("name"), F.when(F.col("cls") == "text", "10k").alias("text"), F.struct(
        F.concat(F.col("x1").cast("string"), F.lit(".7")).alias("xmin"), F.col("y1").cast("string").alias("ymin"), F.col("x2").cast("string").alias("xmax"), F.col("y2").cast("string").alias("ymax")).alias("bndbox"))
    docs = b.withColumn("o", o).groupBy("image_id").agg(F.collect_list("o").alias("object")).select(
        F.concat(F.lit("C"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("filename"), "object")
    path = scratch_path(t.spark, "voc")
    docs.write.format("xml").option("rowTag", "annotation").option("rootTag", "set").save(path)
    return readers.voc_objects(t.spark, path).drop("file")


@query("S07_manifest", ("pictures",), "SELECT 'img_'||lpad(CAST(ord AS VARCHAR), 6, '0')||'.jpg' AS file, drafter, count, 'C'||ord AS name FROM pictures")
def _(t):
    path = scratch_path(t.spark, "manifest")
    sinks.write_manifest(t.pictures.select(F.format_string("img_%06d.jpg", "ord").alias("file"), "drafter", "count", F.concat(F.lit("C"), F.col("ord").cast("string")).alias("name")), path)
    return readers.manifest(t.spark, path)


@query("S07_manifest_or_listing", ("pictures",), "SELECT 'm' AS kind, 'img_'||lpad(CAST(ord AS VARCHAR), 6, '0')||'.jpg' AS file FROM pictures UNION ALL SELECT 'l', CAST(s_suppkey AS VARCHAR)||'.PNG' FROM supplier")
def _(t):
    path = scratch_path(t.spark, "pictures")
    one = t.pictures.select(F.format_string("img_%06d.jpg", "ord").alias("file"), "drafter", "count", F.concat(F.lit("C"), F.col("ord").cast("string")).alias("name"))
    sinks.write_manifest(one, f"{path}/with/manifest.txt")
    names = t.read("supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".PNG")).alias("name"), F.lit("x").alias("line"))
    files.write_named(names, [], f"{path}/without")
    with_, without = (readers.picture_names(t.spark, f"{path}/{k}") for k in ("with", "without"))
    return with_.select(F.lit("m").alias("kind"), "file").unionByName(without.select(F.lit("l").alias("kind"), "file"))


@query("S07_listing", (), "SELECT s_suppkey AS k FROM supplier")
def _(t):
    path = scratch_path(t.spark, "listing")
    _write_suppliers(t, F.col("s_name"), path)
    out = readers.listing(t.spark, path, "*.txt")
    return out.select(F.regexp_extract("path", r"s_suppkey=(\d+)", 1).cast("bigint").alias("k"))


def _sample_lines(t):
    sep = F.when(F.col("text_ord") % 5 == 4, " ").otherwise("\t")
    return t.texts.select(F.concat(F.lit("data/crops/"), F.col("image_id").cast("string"), F.lit("_"), F.col("text_ord").cast("string"), F.lit(".png"), sep, "text").alias("value"))


@query("S08_label_samples", ("texts", "refs"), """SELECT 'data/crops/'||image_id||'_'||text_ord||'.png' AS path, text FROM texts WHERE text_ord%5<>4 AND (image_id, text_ord) IN (SELECT (image_id, idx) FROM refs)""")
def _(t):
    path = scratch_path(t.spark, "samples")
    _sample_lines(t).write.text(path)
    files = t.refs.select(F.concat(F.lit("data/crops/"), F.col("image_id").cast("string"), F.lit("_"), F.col("idx").cast("string"), F.lit(".png")).alias("path"))
    return readers.label_samples(t.spark.read.text(path), files)


@query("S08_label_samples_by_name", ("texts", "refs"), """SELECT image_id||'_'||text_ord||'.png' AS path, replace(replace(replace(text,'R',''),'H','H'),'A','A') AS text FROM texts WHERE text_ord%5<>4 AND (image_id, text_ord) IN (SELECT (image_id, idx) FROM refs)""")
def _(t):
    files = t.refs.select(F.concat(F.col("image_id").cast("string"), F.lit("_"), F.col("idx").cast("string"), F.lit(".png")).alias("path"))
    return readers.label_samples(_sample_lines(t), files, by_basename=True, alphabet=dims.READABLE)


_YOLO = """SELECT CASE WHEN l_suppkey%7=0 THEN 'val' ELSE 'train' END AS split, l_suppkey AS image_id, l_partkey%61 AS cid, CAST((l_partkey*37)%400 AS DOUBLE)/400 AS cx, CAST((l_suppkey*53)%400 AS DOUBLE)/400 AS cy,
 CAST(l_quantity AS DOUBLE)/64 AS bw, CAST(l_partkey%60 AS DOUBLE)/64 AS bh FROM lineitem"""


@query("S09_S10_label_files", (), f"SELECT split, image_id, cid, round(cx,6) AS cx, round(cy,6) AS cy, round(bw,6) AS bw, round(bh,6) AS bh FROM ({_YOLO})")
def _(t):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    labels = t.read("lineitem").select(
        F.when(s % 7 == 0, "val").otherwise("train").alias("split"), s.alias("image_id"), (p % 61).cast("int").alias("cid"), (((p * 37) % 400).cast("double") / 400).alias("cx"),
        (((s * 53) % 400).cast("double") / 400).alias("cy"), (F.col("l_quantity") / 64).alias("bw"), ((p % 60).cast("double") / 64).alias("bh"))
    path = scratch_path(t.spark, "yolo")
    sinks.write_yolo(labels, path)
    place = F.regexp_extract_all("name", F.lit(r"[^/.]+"), F.lit(0))
    back = readers.yolo_labels(files.read_named(t.spark, path).select(place[0].alias("split"), place[1].cast("bigint").alias("image_id"), "value"))
    return back.select("split", "image_id", "cid", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "bw", "bh")])


@query("S11_descriptor", ("boxes",), """, cl AS (SELECT cls, row_number() OVER (ORDER BY cls)-1 AS cid FROM (SELECT DISTINCT cls FROM boxes)) SELECT unnest([0,1,2,3,4]) AS ord, unnest(['path: out','train: images/train','val: images/val','nc: '||(SELECT count(*) FROM cl),'names:']) AS line
 UNION ALL SELECT cid+5, '  '||cid||': '||cls FROM cl""")
def _(t):
    # the classes of the detector are few whatever the number of boxes
    classes = ranks.global_number(t.boxes.select("cls").distinct(), ["cls"], "cid", start=0).withColumn("cid", F.col("cid").cast("int"))
    return sinks.descriptor_lines(classes, "out")


@query("S13_result_files", ("experiments",), "SELECT 'C'||image_id AS image, config, CAST(n_components AS VARCHAR) AS n_components, coalesce(CAST(CAST(round(port_correct_rate*100) AS INT) AS VARCHAR),'None') AS pc FROM experiments")
def _(t):
    path = scratch_path(t.spark, "results")
    sinks.write_results(t.experiments.withColumn("image", F.concat(F.lit("C"), F.col("image_id").cast("string"))), path)
    back = t.spark.read.option("header", True).csv(path)
    pc = F.when(F.col("port_correct_rate") == "None", "None").otherwise(F.round(F.col("port_correct_rate").try_cast("double") * 100).cast("int").cast("string"))
    return back.select("image", "config", "n_components", pc.alias("pc"))


@query("S14_truth_lines", ("truth",), """SELECT image_id, no, 'G'||no||': '||m AS line FROM (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY g) AS no, string_agg(designator||'.'||label, ', ' ORDER BY member_ord) AS m FROM truth GROUP BY image_id, g)""")
def _(t):
    return sinks.truth_lines(t.truth, t.image_guard)


@query("S04_S14_truth_files", (), """SELECT l_suppkey AS image_id, l_partkey%4 AS g, 'R'||l_partkey||'.x' AS designator, CAST(l_linenumber AS VARCHAR) AS label FROM lineitem""".replace("l_partkey%4 AS g", "dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_partkey%4)-1 AS g"))
def _(t):
    e = t.read("lineitem").select(F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") % 4).alias("g"), F.col("l_orderkey").alias("member_ord"),
                                  F.concat(F.lit("R"), F.col("l_partkey").cast("string"), F.lit(".x")).alias("designator"), F.col("l_linenumber").cast("string").alias("label"))
    path = scratch_path(t.spark, "truth")
    sinks.write_lines(sinks.truth_lines(e), "image_id", ["no"], path)
    texts = t.spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.txt$", 1).alias("image_id"), F.col("value").alias("text"))
    return readers.true_group_entries(texts).select(F.col("image_id").cast("bigint").alias("image_id"), "g", "designator", "label")


@query("S15_split_labels", ("texts",), """SELECT CASE WHEN image_id%10=0 THEN 'val' ELSE 'train' END AS split, 'c'||image_id||'_'||text_ord AS path, text FROM texts""")
def _(t):
    path = scratch_path(t.spark, "split")
    sinks.write_split_labels(t.texts.select(F.when(F.col("image_id") % 10 == 0, "val").otherwise("train").alias("split"),
                                            F.concat(F.lit("c"), F.col("image_id").cast("string"), F.lit("_"), F.col("text_ord").cast("string")).alias("path"), "text"), path)
    return t.spark.read.option("sep", "\t").schema("path string, text string, split string").csv(path).select("split", "path", "text")


@query("W10_running_numbers", (), "SELECT event_id, row_number() OVER (ORDER BY ts, event_id)-1 AS seq FROM events")
def _(t):
    return ranks.global_number(t.read("events").select("event_id", "ts"), ["ts", "event_id"], "seq", start=0).select("event_id", "seq")


@query("S17_appended_labels", (), """SELECT printf('machine_%04d.png', CAST(row_number() OVER (ORDER BY part, k)-1 AS INT)) AS path, text FROM (SELECT 0 AS part, c_custkey AS k, c_name AS text FROM customer UNION ALL SELECT 1, p_partkey, p_brand FROM part)""")
def _(t):
    path = scratch_path(t.spark, "labels")
    first = t.read("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("text"))
    sinks.append_labels(0, first, ["k"], path)
    have = t.spark.read.text(path).count()
    sinks.append_labels(have, t.read("part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("text")), ["k"], path)
    return t.spark.read.option("sep", "\t").schema("path string, text string").csv(path)


@query("S19_raw_boxes", ("boxes",), "SELECT image_id, idx, cls, conf, x1, y1, x2, y2 FROM boxes")
def _(t):
    path = scratch_path(t.spark, "raw")
    t.boxes.write.json(path)
    return readers.raw_boxes(t.spark, path, "json")


# ---- streams ------------------------------------------------------------------------------------------
def _stream(t, table):
    return t.spark.readStream.schema(t.read(table).schema).option("pathGlobFilter", f"{table}.parquet").parquet(t.folder)


@query("T01_latest_documents", (), "SELECT user_id, arg_max(props, event_id) AS props FROM events GROUP BY user_id")
def _(t):
    base = scratch_path(t.spark, "t01")
    jobs.keep_latest(_stream(t, "events"), "user_id", "event_id", "props", f"{base}/checkpoint")
    return jobs.latest_state(t.spark, "user_id", "props", f"{base}/checkpoint")


@query("T02_corrected_stream", ("texts",), _CORR.replace("SELECT image_id, text_ord, CASE", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE").replace(
    "FROM texts LEFT JOIN hit h USING (text)", f"FROM (SELECT *, CAST(l_quantity AS INT)||{sql_list(('k', 'V'))}[CAST(1+l_suppkey%2 AS INT)] AS text FROM lineitem) x LEFT JOIN hit h USING (text)").replace("(SELECT DISTINCT text FROM texts)", "(SELECT DISTINCT CAST(l_quantity AS INT)||u AS text FROM lineitem, (VALUES ('k'),('V')) v(u))"))
def _(t):
    base = scratch_path(t.spark, "t02")
    posts = _posts(type("S", (), {"read": staticmethod(lambda n: _stream(t, n))}))
    jobs.keep_corrections(posts, f"{base}/c1")
    texts = _stream(t, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(
        F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_suppkey") % 2 == 0, "k").otherwise("V")).alias("text"))
    jobs.correct_stream(texts, f"{base}/c1", f"{base}/out", f"{base}/c2")
    return t.spark.read.parquet(f"{base}/out").drop("batch")


@query("T03_ingested_crops", (), """SELECT row_number() OVER (ORDER BY path)-1 AS seq, path FROM (SELECT DISTINCT 'crop_'||user_id||'_'||event_type||'.png' AS path FROM events)""")
def _(t):
    base = scratch_path(t.spark, "t03")
    path = F.concat(F.lit("crop_"), F.col("user_id").cast("string"), F.lit("_"), "event_type", F.lit(".png"))
    jobs.ingest_crops(_stream(t, "events").select(path.alias("path"), F.col("event_type").alias("text")), f"{base}/out", f"{base}/checkpoint")
    return t.spark.read.parquet(f"{base}/out").select("seq", "path")


