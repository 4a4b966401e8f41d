from pyspark.sql import functions as F

from netloom.operators import dataset
from netloom.sources import readers, sinks


def test_true_groups(spark):
    text = "G1: R1.1, C1.+, x\nnothing here\nG2:\nG3: U1.a.b, V1.~, V1.~\n"
    df = spark.createDataFrame([(7, text)], "image_id long, text string")
    got = [(r.g, r.designator, r.label) for r in readers.true_group_entries(df).orderBy("g", "member_ord").collect()]
    assert got == [(0, "R1", "1"), (0, "C1", "+"), (3, "U1.a", "b"), (3, "V1", "~"), (3, "V1", "~")]


def test_annotations(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<annotation><object><name>text</name><text>10k</text><bndbox><xmin>1.9</xmin><ymin>2</ymin><xmax>x</xmax><ymax>8</ymax></bndbox></object></annotation>")
    (tmp_path / "b.xml").write_text("<annotation><filename>p.png</filename></annotation>")
    (tmp_path / "c.xml").write_text("<annotation><object><name>")
    got = {(r.filename, r.name, r.x1, r.x2) for r in readers.voc_objects(spark, str(tmp_path)).collect()}
    assert got == {("a.jpg", "text", 1, None), ("p.png", None, 0, 0)}


def test_one_document_for_a_large_picture(spark):
    comps = spark.createDataFrame([("i", 10, 10, k, "Resistor", "resistor", f"R{k}", 0.5, 1, 2, 3, 4) for k in range(60_000)],
                                  "image string, width long, height long, idx long, name string, raw_name string, designator string, conf double, x1 long, y1 long, x2 long, y2 long")
    ports = spark.createDataFrame([("i", k, p, 1, 2, str(p)) for k in range(8) for p in (0, 1)], "image string, ci long, pi int, px long, py long, label string")
    docs = sinks.detection_documents(comps, ports)
    assert docs.count() == 1
    assert readers.detection_components(docs).count() == 60_000


def test_corrections(spark):
    memory = spark.createDataFrame([("l", "1", 2), ("O", "0", 1), ("10k", "x", 3), ("", "y", 0)], "pattern string, replacement string, first long")
    texts = spark.createDataFrame([("1Ol",), ("lll",), ("10k",), ("zz",), ("",), (None,)], "text string")
    got = [r[0] for r in dataset.apply_corrections(texts, memory).select("text").collect()]
    assert sorted(got, key=str) == sorted(["10l", "111", "x", "zz", "", None], key=str)
    assert dataset.apply_corrections(texts, memory.limit(0)).count() == 6


def test_a_picture_over_several_tasks_keeps_its_groups(spark, tmp_path):
    rows = [(k % 3, k // 3, f"G{k // 3 + 1}: R{k}.1, R{k}.2") for k in range(3000)]
    lines = spark.createDataFrame(rows, "image_id long, no long, line string").repartition(8)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1k")
    try:
        sinks.write_lines(lines, "image_id", ["no"], str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    texts = spark.read.text(str(tmp_path / "t"), wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.txt$", 1).alias("image_id"), F.col("value").alias("text"))
    assert readers.true_group_entries(texts).select("image_id", "g").distinct().count() == 3000


def test_corrections_in_slices_equal_a_plain_search(spark):
    """Patterns of one character, patterns in patterns, and several automata."""
    import random
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abΩ.") for _ in range(rng.randrange(n)))
    patterns = list(dict.fromkeys(["a", "", "Ω", *(word(5) for _ in range(60))]))
    order = list(range(len(patterns)))
    rng.shuffle(order)
    rows = [(p, f"<{i}>", i) for i, p in zip(order, patterns)]
    texts = [None, "", "a", *(word(12) for _ in range(200))]
    memory = spark.createDataFrame(rows + [(None, "x", -1)], "pattern string, replacement string, first bigint")
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")

    def plain(t):
        hit = min(((f, p, r) for p, r, f in rows if p and t and p in t), default=None)
        return t.replace(hit[1], hit[2]) if hit else t

    for chars in (10 ** 6, 300):
        got = {r.i: r.text for r in dataset.apply_corrections(frame, memory, slice_chars=chars).collect()}
        assert got == {i: plain(t) for i, t in enumerate(texts)}
