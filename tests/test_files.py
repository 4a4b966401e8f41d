import os

import pytest
from pyspark.sql import functions as F

from netloom.plans import catalog, q_sources
from netloom.sources import files, readers, sinks


def tree(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def test_a_file_for_each_name_in_few_folders(spark, tmp_path):
    path = str(tmp_path / "labels")
    rows = spark.range(3000).select(F.when(F.col("id") % 7 == 0, "val").otherwise("train").alias("split"), F.floor(F.col("id") / 3).alias("image_id"), F.lit(3).alias("cid"),
                                    *[F.lit(0.5).alias(c) for c in ("cx", "cy", "bw", "bh")])
    sinks.write_yolo(rows, path)
    found = tree(path)
    assert found.pop(0) == "_SUCCESS" and {os.path.dirname(f) for f in found} == {"train", "val"} and len(found) == len(set(found)) == 1429
    back = files.read_named(spark, path)
    assert back.count() == 3000 and back.where("name = 'train/5.txt'").count() == 3
    sinks.write_yolo(rows.limit(1), path)  # overwriting leaves nothing of the last run
    assert len(tree(path)) == 2


def test_lines_in_order_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "texts")
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "é"), (1, 3, None), (2, 1, "x")], "image_id int, no int, line string")
    sinks.write_lines(rows, "image_id", ["no"], path)
    assert (tmp_path / "texts" / "1.txt").read_text() == "é\nb\n\n" and (tmp_path / "texts" / "2.txt").read_text() == "x\n"
    sinks.write_lines(rows.limit(0), "image_id", ["no"], path)
    assert tree(path) == ["_SUCCESS"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "texts")
    rows = spark.range(200).select(F.concat(F.lit("f"), (F.col("id") % 20).cast("string")).alias("name"), F.col("id"),
                                   F.when(F.col("id") == 137, F.raise_error(F.lit("broken"))).otherwise("x").alias("line"))
    with pytest.raises(Exception, match="broken"):
        files.write_named(rows, ["id"], path)
    assert tree(path) == []


def test_manifest_or_listing(spark, tmp_path):
    for name in ("b.JPG", "a.png", "c.txt", "d.jpeg"):
        (tmp_path / name).write_text("x")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "e.png").write_text("x")
    assert sorted(r.file for r in readers.picture_names(spark, str(tmp_path)).collect()) == ["a.png", "b.JPG", "d.jpeg"]
    (tmp_path / "manifest.txt").write_text("z.png\td1\t3\tZ\n\n y.png \td2\t4\tY\n")
    assert sorted(r.file for r in readers.picture_names(spark, str(tmp_path)).collect()) == ["y.png", "z.png"]


@pytest.mark.parametrize("name", ["S01_descriptions", "S07_listing"])
def test_supplier_files_share_one_folder(spark, monkeypatch, tmp_path, name):
    """No folder is made for each file, which the driver would rename and list one by one."""
    monkeypatch.setattr(q_sources, "scratch_path", lambda spark, label: f"{tmp_path}/{label}")
    n = catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert n > 1 and [p for p in tmp_path.glob("*/*") if p.is_dir()] == [] and len(list(tmp_path.glob("*/s_suppkey=*.txt"))) == n
