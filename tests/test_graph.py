import random

from pyspark.sql import functions as F

from netloom.operators import graph, wiring


def _edges(seed, images=6, n=14, m=16):
    rnd = random.Random(seed)
    return [(i, *sorted(rnd.sample(range(n), 2))) for i in range(images) for _ in range(m)]


def test_components(spark):
    edges = _edges(1, m=9) + [(9, k, k + 1) for k in range(60)]  # a long chain as well
    nodes = [(i, k) for i in range(6) for k in range(14)] + [(9, k) for k in range(61)]
    parent = {x: x for x in nodes}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a, b in edges:
        ra, rb = find((i, a)), find((i, b))
        parent[max(ra, rb)] = min(ra, rb)
    got = graph.connected_components(spark.createDataFrame(nodes, "image_id long, node long"),
                                     spark.createDataFrame(edges, "image_id long, a long, b long").repartition(7))
    assert {(r.image_id, r.node): r.comp for r in got.collect()} == {x: find(x)[1] for x in nodes}


def _pairs(spark, seed):
    rows = sorted({(i, a, b) for i, a, b in _edges(seed)})
    return rows, spark.createDataFrame(rows, "image_id long, a long, b long").repartition(5).withColumn("ord", F.struct("a", "b"))


def test_matching_equals_walk(spark):
    for seed in (2, 3):
        rows, df = _pairs(spark, seed)
        busy, want = set(), set()
        for i, a, b in rows:
            if (i, a) not in busy and (i, b) not in busy:
                busy |= {(i, a), (i, b)}
                want.add((i, a, b))
        assert {(r.image_id, r.a, r.b) for r in graph.greedy_matching(df).collect()} == want


def test_suppression_equals_walk(spark):
    rows, df = _pairs(spark, 4)
    gone = set()
    for i, a, b in rows:
        if (i, a) not in gone and (i, b) not in gone:
            gone.add((i, b if (a + b) % 3 else a))
    loser = F.when((F.col("a") + F.col("b")) % 3 != 0, F.col("b")).otherwise(F.col("a"))
    got = graph.resolve_pairs(df.withColumn("loser", loser), F.array("loser"))
    assert {(r.image_id, r.loser) for r in got.collect()} == gone


def test_capped_equals_walk(spark):
    rows, df = _pairs(spark, 5)
    deg, want = {}, set()
    for i, a, b in rows:
        if deg.get((i, a), 0) < 2 and deg.get((i, b), 0) < 2:
            want.add((i, a, b))
            for x in (a, b):
                deg[(i, x)] = deg.get((i, x), 0) + 1
    assert {(r.image_id, r.a, r.b) for r in graph.capped_pairs(df, 2).collect()} == want


def test_choices_equal_walk(spark):
    rnd = random.Random(6)
    rows = [(i, p, rnd.choice([x for x in range(20) if x != p])) for i in range(8) for p in range(20)]
    busy, want = set(), set()
    for i, p, t in rows:
        if (i, p) not in busy:
            busy |= {(i, p), (i, t)}
            want.add((i, p))
    df = spark.createDataFrame(rows, "image_id long, p long, t long").repartition(5)
    assert {(r.image_id, r.p) for r in wiring.settle_choices(df).collect()} == want


def test_the_three_ways_agree(spark, monkeypatch):
    """One pass per key, one pass per component, and rounds."""
    for seed in (7, 8):
        _, df = _pairs(spark, seed)
        df = df.withColumn("loser", F.when((F.col("a") + F.col("b")) % 3 != 0, F.col("b")).otherwise(F.col("a")))
        choices = df.groupBy("image_id", F.col("a").alias("p")).agg(F.min("b").alias("t"))
        runs = []
        for rows in (10 ** 6, 8, 2):
            monkeypatch.setattr(graph, "FOLD_ROWS", rows)
            runs.append([sorted(map(tuple, x.collect())) for x in (
                graph.greedy_matching(df).select("image_id", "a", "b"), graph.resolve_pairs(df, F.array("loser")).select("image_id", "a", "b"),
                graph.capped_pairs(df, 2).select("image_id", "a", "b"), wiring.settle_choices(choices).select("image_id", "p", "t"))])
        assert runs[0] == runs[1] == runs[2]


def test_a_row_of_ports_takes_no_more_jobs(spark):
    def jobs(n):
        df = spark.range(n).select(F.lit(1).cast("long").alias("image_id"), F.col("id").alias("a"), (F.col("id") + 1).alias("b")).withColumn("ord", F.struct("a", "b"))
        group = f"row-{n}"
        spark.sparkContext.setJobGroup(group, group)
        got = sorted(r.a for r in graph.greedy_matching(df).collect())
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert got == list(range(0, n, 2))
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    assert jobs(500) <= jobs(8) + 1


def test_ids_do_not_collide(spark):
    rows = [(1, 0, 1000), (1, 1, 0), (1, 0, 70_000), (1, 3_000_000, 5)]
    df = spark.createDataFrame(rows, "image_id long, ci long, pi int").withColumn("p", wiring.port_id())
    back = df.select(wiring.component_of(F.col("p")), wiring.place_of(F.col("p"))).collect()
    assert [tuple(r) for r in back] == [r[1:] for r in rows]
    points = spark.createDataFrame([(1, 1 << 20), (2, 0), (0, 1 << 21)], "x long, y long").select(wiring.point_id(F.col("x"), F.col("y")))
    assert points.distinct().count() == 3
