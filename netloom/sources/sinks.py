"""Writers of the file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netloom.operators import lines, ranks
from netloom.sources import files


def detection_documents(comps: DataFrame, ports: DataFrame) -> DataFrame:
    """One nested document per picture from comps(image, width, height, idx, name, raw_name, designator, conf, x1..y2)
    and ports(image, ci, pi, px, py, label). The tables themselves are the form for anything but this format."""
    p = ports.groupBy("image", F.col("ci").alias("idx")).agg(F.sort_array(F.collect_list(F.struct("pi", "px", "py", "label"))).alias("ps"))
    part = comps.join(p, ["image", "idx"], "left").withColumn("ps", F.coalesce("ps", F.expr("array()").cast("array<struct<pi int, px bigint, py bigint, label string>>")))
    c = F.struct("idx", "name", "raw_name", "designator", F.array("x1", "y1", "x2", "y2").alias("xyxy"),
                 F.transform("ps", lambda x: F.array(x["px"], x["py"])).alias("ports"), F.transform("ps", lambda x: x["label"]).alias("labels"), "conf")
    return part.withColumn("c", c).groupBy("image", "width", "height").agg(F.sort_array(F.collect_list("c")).alias("components"))


def write_detections(comps: DataFrame, ports: DataFrame, path: str) -> None:
    detection_documents(comps, ports).write.mode("overwrite").json(path)


def yolo_lines(labels: DataFrame) -> DataFrame:
    """Adds `value`, the label text with six decimals."""
    return labels.withColumn("value", F.format_string("%d %.6f %.6f %.6f %.6f", "cid", "cx", "cy", "bw", "bh"))


def write_yolo(labels: DataFrame, path: str) -> None:
    """A text file per picture in the folder of its split."""
    name = F.concat(F.col("split").cast("string"), F.lit("/"), F.col("image_id").cast("string"), F.lit(".txt"))
    files.write_named(yolo_lines(labels).select(name.alias("name"), F.col("value").alias("line")), [], path)


def write_yolo_table(labels: DataFrame, path: str, buckets: int) -> None:
    """The same labels as a table, in `buckets` files a split by the hash of the picture; for anything but the text form."""
    labels.repartition(buckets, "image_id").sortWithinPartitions("split", "image_id").write.mode("overwrite").partitionBy("split").parquet(path)


def descriptor_lines(classes: DataFrame, root: str) -> DataFrame:
    """(ord, line) of the data set descriptor from classes(cid, cls)."""
    head = classes.agg(F.count(F.lit(1)).alias("n")).select(F.posexplode(F.array(
        F.lit(f"path: {root}"), F.lit("train: images/train"), F.lit("val: images/val"),
        F.concat(F.lit("nc: "), F.col("n").cast("string")), F.lit("names:"))).alias("ord", "line"))
    return head.unionByName(classes.select((F.col("cid") + 5).alias("ord"), F.concat(F.lit("  "), F.col("cid").cast("string"), F.lit(": "), "cls").alias("line")))


RESULT_COLUMNS = ["image", "config", "n_components", "n_gt_groups", "n_pred_groups", "port_correct_rate", "fp_rate", "fn_rate",
                  "group_accuracy", "comp_neighbor_accuracy"]


def write_results(results: DataFrame, path: str) -> None:
    """Results as CSV in fixed column order; missing rates are written as None."""
    results.select(*RESULT_COLUMNS).write.mode("overwrite").option("header", True).option("nullValue", "None").csv(path)


def truth_lines(entries: DataFrame, guard: ranks.SkewGuard | None = None) -> DataFrame:
    """(image_id, no, line): one line `G<no>: a.b, c.d` per group of entries(image_id, g, member_ord, designator, label)."""
    e = entries.withColumn("e", F.concat("designator", F.lit("."), "label"))
    text = lines.joined(e, ["image_id", "g"], ["member_ord", "e"], "e", ", ", "members")
    return ranks.row_number(text, ["image_id"], ["g"], "no", guard=guard).select(
        "image_id", "no", F.concat(F.lit("G"), F.col("no").cast("string"), F.lit(": "), "members").alias("line"))


def write_lines(rows: DataFrame, key: str, order: list[str], path: str) -> None:
    """Line tables as one text file per key, `<key>.txt`, lines in order."""
    files.write_named(rows.select(F.concat(F.col(key).cast("string"), F.lit(".txt")).alias("name"), "line", *order), order, path)


def write_split_labels(samples: DataFrame, path: str) -> None:
    """samples(split, path, text) as tab-separated files per split."""
    samples.select("split", "path", "text").write.mode("overwrite").partitionBy("split").option("sep", "\t").option("quote", "").csv(path)


def append_labels(existing: int, new: DataFrame, order: list[str], path: str) -> None:
    """Append new(text, ..) with running numbers going on from `existing`."""
    numbered = ranks.global_number(new, order, "seq", start=existing)
    numbered.select(F.format_string("machine_%04d.png", "seq").alias("path"), "text").write.mode("append").option("sep", "\t").option("quote", "").csv(path)


def write_manifest(selection: DataFrame, path: str) -> None:
    """selection(file, drafter, count, name) as a tab-separated manifest."""
    selection.select("file", "drafter", "count", "name").write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)
