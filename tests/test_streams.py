import os

from netloom.streaming import jobs


def pusher(spark, folder, schema):
    def push(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return push, lambda: spark.readStream.schema(schema).parquet(folder)


def test_latest_by_state_with_late_posts_and_restarts(spark, tmp_path):
    check = str(tmp_path / "c")
    push, stream = pusher(spark, str(tmp_path / "in"), "k string, seq long, v string")

    def run():
        jobs.keep_latest(stream(), "k", "seq", "v", check)
        return {r.k: r.v for r in jobs.latest_state(spark, "k", "v", check).collect()}

    push([("a", 1, "x"), ("a", 3, "z"), ("b", 2, "y"), (None, 1, "n")])
    assert run() == {"a": "z", "b": "y", None: "n"}
    push([("a", 2, "late"), ("b", 5, "new")])
    assert run() == {"a": "z", "b": "new", None: "n"}
    push([("a", 9, None)])
    assert run() == {"a": None, "b": "new", None: "n"}
    assert {r.k: r.v for r in jobs.latest_state(spark, "k", "v", check, batch=0).collect()} == {"a": "z", "b": "y", None: "n"}


def test_corrections_keep_first_place(spark, tmp_path):
    check = str(tmp_path / "c")
    push, stream = pusher(spark, str(tmp_path / "in"), "seq long, pattern string, replacement string")
    assert jobs.corrections_state(spark, check).collect() == []
    for rows in ([(1, "O", "0"), (2, "l", "1")], [(3, "O", "Ω")]):
        push(rows)
        jobs.keep_corrections(stream(), check)
    assert {(r.pattern, r.replacement, r.first) for r in jobs.corrections_state(spark, check).collect()} == {("O", "Ω", 1), ("l", "1", 2)}


def test_texts_are_corrected_with_the_version_of_their_batch(spark, tmp_path):
    memory, out = str(tmp_path / "m"), str(tmp_path / "out")
    push_c, corrections = pusher(spark, str(tmp_path / "corrections"), "seq long, pattern string, replacement string")
    push_t, texts = pusher(spark, str(tmp_path / "texts"), "id long, text string")

    def run():
        jobs.correct_stream(texts(), memory, out, str(tmp_path / "c"))
        return {r.id: r.text for r in spark.read.parquet(out).collect()}

    push_t([(1, "1O")])
    assert run() == {1: "1O"}
    push_c([(1, "O", "0")])
    jobs.keep_corrections(corrections(), memory)
    push_t([(2, "2O")])
    assert run() == {1: "1O", 2: "20"}
    push_c([(2, "O", "Ω")])
    jobs.keep_corrections(corrections(), memory)
    assert jobs._version(spark, memory, f"{out}_versions/batch=1") == 0  # a repeated batch goes on with its version
    push_t([(3, "3O")])
    assert run() == {1: "1O", 2: "20", 3: "3Ω"}


def test_crops_go_on_numbering(spark, tmp_path):
    out = str(tmp_path / "out")
    push, stream = pusher(spark, str(tmp_path / "in"), "path string, text string")
    for rows in ([("p2", "b"), ("p1", "a"), ("p1", "a")], [("p2", "b"), ("p3", "c")], [("p1", "a")], [("p4", "d")]):
        push(rows)
        jobs.ingest_crops(stream(), out, str(tmp_path / "c"))
    assert {(r.path, r.seq) for r in spark.read.parquet(out).collect()} == {("p1", 0), ("p2", 1), ("p3", 2), ("p4", 3)}
    # a batch that failed before its commit runs again with the same numbers
    newest = max(int(n) for n in os.listdir(tmp_path / "c" / "commits") if n.isdigit())
    for folder in (tmp_path / "c" / "commits",):
        for name in (str(newest), f".{newest}.crc"):
            if (folder / name).exists():
                os.unlink(folder / name)
    jobs.ingest_crops(stream(), out, str(tmp_path / "c"))
    assert {(r.path, r.seq) for r in spark.read.parquet(out).collect()} == {("p1", 0), ("p2", 1), ("p3", 2), ("p4", 3)}
