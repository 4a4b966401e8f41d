"""Readers of the file formats: descriptions, detections, true groups, annotations, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netloom.functions import dims

DETECTIONS = ("image string, width bigint, height bigint, components array<struct<idx bigint, name string, raw_name string, "
              "designator string, xyxy array<bigint>, ports array<array<bigint>>, labels array<string>, conf double, manual boolean>>")
VOC = ("filename string, object array<struct<name string, text string, bndbox struct<xmin string, ymin string, xmax string, ymax string>>>")
RAW_BOXES = "image_id bigint, idx bigint, cls string, conf double, x1 bigint, y1 bigint, x2 bigint, y2 bigint"


def descriptions(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(file, path, description): one row per text file."""
    return (spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
            .select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("description"), "*").drop("value"))


def detections(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Detection documents; `whole_files` for one document per file, else one per line."""
    return spark.read.schema(DETECTIONS).option("multiLine", whole_files).json(path)


def detection_components(docs: DataFrame) -> DataFrame:
    box = F.col("c.xyxy")
    return docs.select("image", "width", "height", F.explode("components").alias("c")).select(
        "image", "width", "height", "c.idx", "c.name", "c.raw_name", "c.designator", "c.conf",
        *[F.get(box, F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))], F.size("c.ports").alias("n_ports"))


def detection_ports(docs: DataFrame) -> DataFrame:
    """(image, ci, pi, px, py, label): ports with the label at the same place, `?` where there is none."""
    c = docs.select("image", F.explode("components").alias("c")).select(
        "image", F.col("c.idx").alias("ci"), "c.name", "c.designator", F.col("c.labels").alias("labels"), F.posexplode("c.ports").alias("pi", "p"))
    return c.select("image", "ci", "pi", "name", "designator", F.get("p", F.lit(0)).alias("px"), F.get("p", F.lit(1)).alias("py"),
                    F.coalesce(F.get("labels", F.col("pi")), F.lit("?")).alias("label"))


def true_group_entries(texts: DataFrame) -> DataFrame:
    """texts(image_id, text) of lines `G<n>: R1.1, R2.2` -> (image_id, g, member_ord, designator, label).

    g is the place of the line in its file. Lines without colon or right side and entries without dot
    are left out; an entry is split at its last dot.
    """
    lines = texts.select("image_id", F.posexplode(F.split("text", "\n")).alias("g", "line"))
    right = lines.where(F.col("line").contains(":")).withColumn("right", F.trim(F.regexp_replace("line", r"^[^:]*:", "")))
    entries = right.where("right <> ''").select("image_id", "g", F.posexplode(F.split("right", ",")).alias("member_ord", "e")).withColumn("e", F.trim("e"))
    dotted = r"(?s)^(.*)\.([^.]*)$"
    return entries.where(F.col("e").contains(".")).select(
        "image_id", "g", "member_ord", F.regexp_extract("e", dotted, 1).alias("designator"), F.regexp_extract("e", dotted, 2).alias("label"))


def voc_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, filename, name, text, x1, y1, x2, y2) of annotated objects; broken documents are left out.

    A picture without objects gives one row with NULL name.
    """
    docs = (spark.read.format("xml").option("rowTag", "annotation").option("mode", "DROPMALFORMED").schema(VOC).load(path)
            .select("*", F.col("_metadata.file_name").alias("file")))
    rows = docs.select("file", F.coalesce("filename", F.regexp_replace("file", r"\.xml$", ".jpg")).alias("filename"), F.explode_outer("object").alias("o"))

    def whole(c: str) -> Column:
        return F.coalesce(F.col(f"o.bndbox.{c}"), F.lit("0")).try_cast("double").cast("bigint")
    return rows.select("file", "filename", "o.name", "o.text", whole("xmin").alias("x1"), whole("ymin").alias("y1"),
                       whole("xmax").alias("x2"), whole("ymax").alias("y2"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, drafter, count, name) from a tab-separated manifest."""
    return spark.read.option("sep", "\t").schema("file string, drafter string, count bigint, name string").csv(path).where("file <> ''")


def listing(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """File names below a folder, without reading contents."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
            .select(F.col("path"), F.element_at(F.split("path", "/"), -1).alias("file")))


def picture_names(spark: SparkSession, folder: str, manifest_name: str = "manifest.txt") -> DataFrame:
    """(file) of the pictures to read: the first column of the manifest of the folder if it has one, else the pictures
    that lie in the folder itself, by their ending in any case."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{manifest_name}")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return manifest(spark, path.toString()).select(F.trim("file").alias("file")).where("file <> ''")
    found = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return found.where(F.lower("file").rlike(r"\.(jpg|jpeg|png)$"))


def label_samples(lines: DataFrame, files: DataFrame | None = None, by_basename: bool = False, alphabet: str | None = None) -> DataFrame:
    """lines(value) `path<TAB>text` -> (path, text), only with a tab and, given files(path), only existing ones.

    By base name also files(path) are compared by base name; with an alphabet other characters are
    dropped and empty texts left out.
    """
    v = F.regexp_replace("value", r"^\s+|\s+$", "")
    s = lines.where(v.contains("\t")).select(F.regexp_extract(v, r"(?s)^([^\t]*)\t(.*)$", 1).alias("path"), F.regexp_extract(v, r"(?s)^([^\t]*)\t(.*)$", 2).alias("text"))
    if by_basename:
        s = s.withColumn("path", F.element_at(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), -1))
    if alphabet is not None:
        known = F.array(*[F.lit(c) for c in alphabet])
        s = s.withColumn("text", F.array_join(F.filter(F.split("text", ""), lambda c: F.array_contains(known, c)), "")).where("text <> ''")
    return s if files is None else s.join(files.select("path").distinct(), "path", "left_semi")


def yolo_labels(lines: DataFrame) -> DataFrame:
    """lines(.., value) -> (.., cid, cx, cy, bw, bh); lines with under five fields are skipped."""
    w = F.split(F.trim("value"), r"\s+")
    rows = lines.withColumn("w", w).where(F.size("w") >= 5)
    return rows.select(*[c for c in lines.columns if c != "value"], F.get("w", F.lit(0)).cast("int").alias("cid"),
                       *[F.get("w", F.lit(i)).cast("double").alias(n) for i, n in enumerate(("cx", "cy", "bw", "bh"), 1)])


def raw_boxes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Detector output as a table."""
    return spark.read.format(fmt).schema(RAW_BOXES).load(path)


def class_rows(spark: SparkSession, classes: tuple = dims.CLASSES_V16) -> DataFrame:
    return spark.createDataFrame(list(enumerate(classes)), "cid int, cls string")
