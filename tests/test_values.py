import random

from pyspark.sql import functions as F

from netloom.functions import text
from netloom.operators import values


def test_settled_components_equal_a_walk_over_all_candidates(spark):
    """A crowded place: every component about a text is walked, by index and variant."""
    rng = random.Random(4)
    comps = spark.createDataFrame([(i % 2, i, rng.choice(["Resistor", "Capacitor-Unpolarized", "Inductor"]), rng.randrange(300), rng.randrange(300)) for i in range(900)],
                                  "image_id bigint, idx bigint, name string, cx bigint, cy bigint")
    texts = spark.createDataFrame([(i % 2, i, rng.choice(["10k", "4.7k", "1OO", "100n", "10u", "2m", "5"]), rng.randrange(300), rng.randrange(300)) for i in range(30)],
                                  "image_id bigint, text_ord bigint, text string, cx bigint, cy bigint")
    pairs = comps.join(texts.withColumnsRenamed({"cx": "tx", "cy": "ty"}), "image_id").select(
        "image_id", "text_ord", "idx", "text", (F.abs(F.col("cx") - F.col("tx")) + F.abs(F.col("cy") - F.col("ty"))).alias("d"), "name",
        F.posexplode(text.variants(F.col("text"))).alias("k", "v")).where("d <= 250")
    rows = pairs.select("image_id", "text_ord", "idx", "k", "d", "text", F.col("v.value").alias("variant"), text.fits(F.col("v.value"), F.col("name")).alias("fit")).where("fit is not null").collect()
    assert max(sum(r.text_ord == t for r in rows) for t in range(30)) > 291
    best = {}
    for r in sorted(rows, key=lambda r: (r.image_id, r.text_ord, r.idx, r.k)):
        exact = r.variant == r.text
        score, key = int(r.d - (40 if exact else 0)), (r.image_id, r.text_ord)
        if key not in best or score < best[key][2] - (20 if best[key][3] else 0):
            best[key] = (r.idx, r.fit or r.variant, score, exact)
    got = {(r.image_id, r.text_ord): (r.idx, r.value, r.score) for r in values.text_choices(comps, texts).collect()}
    assert got == {k: v[:3] for k, v in best.items()}
