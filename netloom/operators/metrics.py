"""Wiring quality against true groups, without ever listing the pairs of a group.

Groups are long tables (image_id, g, id, designator): g orders the groups of a picture. Pairs are
counted in closed form; sets are compared by sizes and sizes of intersections.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from netloom.lineage import cut

RATES = ["port_correct_rate", "fp_rate", "fn_rate", "group_accuracy", "comp_neighbor_accuracy"]


def true_groups(entries: DataFrame) -> DataFrame:
    """Entries (image_id, g, designator, label) of groups with two or more entries, repeats counting."""
    big = entries.groupBy("image_id", "g").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("image_id", "g")
    return entries.join(big, ["image_id", "g"]).select(
        "image_id", "g", F.concat("designator", F.lit("."), "label").alias("id"), "designator").distinct()


def predicted_groups(entries: DataFrame) -> DataFrame:
    """Distinct ids of groups with two or more different ids; designator up to the first dot."""
    ids = entries.select("image_id", "g", F.concat("designator", F.lit("."), "label").alias("id")).distinct()
    big = ids.groupBy("image_id", "g").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("image_id", "g")
    return ids.join(big, ["image_id", "g"]).withColumn("designator", F.split_part("id", F.lit("."), F.lit(1)))


def _twos(n: Column) -> Column:
    return n * (n - 1) / 2


def _digest(value: Column) -> list[Column]:
    """Aggregates that tell sets apart without holding them: number, sum and exclusive or of hashes."""
    return [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(value) % (1 << 40)).alias("h1"), F.bit_xor(F.xxhash64(value, F.lit(1))).alias("h2")]


HEAVY = 1000      # classes of ids from which a group is heavy
PRODUCT = 10_000  # true times predicted groups of one class up to which they are listed


def _met(classes: DataFrame, keys: list, at: DataFrame, name: str, heavy: DataFrame) -> DataFrame:
    """Pairs c < c2 of classes in one light group. at(*keys, c, name); heavy(*keys, name)."""
    light = at.join(heavy, [*keys, name], "left_anti")
    return light.join(light.withColumnRenamed("c", "c2"), [*keys, name]).where("c < c2").select(*keys, "c", "c2").distinct()


def _heavy(at: DataFrame, keys: list, name: str, limit: int) -> DataFrame:
    return cut(at.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select(*keys, name), "heavy")


def _signed(classes: DataFrame, keys: list, at: DataFrame, name: str, heavy: DataFrame) -> DataFrame:
    """Classes with the heavy groups they lie in, as an array s_<name>; a picture has few heavy groups."""
    own = at.join(heavy, [*keys, name]).groupBy(*keys, "c").agg(F.sort_array(F.collect_set(name)).alias("s"))
    none = F.array().cast(own.schema["s"].dataType)
    return classes.join(own, [*keys, "c"], "left").withColumn("s", F.coalesce("s", none)).withColumnRenamed("s", f"s_{name}")


def _weight_of_heavy(signed: DataFrame, keys: list, marks: list[str]) -> DataFrame:
    """(*keys, pairs): pairs of ids of different classes that share a heavy group on every side of `marks`, counted by
    classes of equal heavy sets."""
    kinds = signed.where(" and ".join(f"size({m}) > 0" for m in marks)).groupBy(*keys, *marks).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("ww"))
    kinds = cut(kinds.withColumn("kind", F.struct(*marks)), "kinds")
    within = kinds.select(*keys, ((F.col("w") * F.col("w") - F.col("ww")) / 2).cast("bigint").alias("pairs"))
    one = kinds.select(*keys, "kind", "w", F.explode(marks[0]).alias("at"))
    other = one.select(*keys, F.col("kind").alias("k2"), F.col("w").alias("w2"), "at")
    both = one.join(other, [*keys, "at"]).where("kind < k2").select(*keys, "kind", "k2", "w", "w2").distinct()
    for m in marks[1:]:
        both = both.where(F.arrays_overlap(F.col("kind")[m], F.col("k2")[m]))
    return within.unionByName(both.select(*keys, (F.col("w") * F.col("w2")).cast("bigint").alias("pairs")))


def _weights(pairs: DataFrame, signed: DataFrame, keys: list, marks: list[str]) -> DataFrame:
    """(*keys, pairs) of listed pairs of classes that do not share a heavy group on every side."""
    a = signed.select(*keys, "c", F.col("w").alias("wa"), *(F.col(m).alias(f"a_{m}") for m in marks))
    b = signed.select(*keys, F.col("c").alias("c2"), F.col("w").alias("wb"), *(F.col(m).alias(f"b_{m}") for m in marks))
    both = pairs.join(a, [*keys, "c"]).join(b, [*keys, "c2"])
    if marks:
        both = both.where(~functools.reduce(lambda x, y: x & y, [F.arrays_overlap(f"a_{m}", f"b_{m}") for m in marks]))
    return both.select(*keys, (F.col("wa") * F.col("wb")).cast("bigint").alias("pairs"))


def pair_counts(members: DataFrame, keys: tuple = ("image_id",), heavy: int = HEAVY) -> DataFrame:
    """Distinct unordered pairs of ids that share a group, per key: (*keys, pairs).

    members(*keys, g, id) without repeats; g may be any type. Pairs with an id of one group only are counted by numbers.
    Ids in several groups fall into classes of equal sets of groups (compared by digest). Classes meet in light
    groups; those that share a heavy group, of more than `heavy` classes, are counted by their sets of heavy groups.
    """
    keys = list(keys)
    ids = cut(members.groupBy(*keys, "id").agg(*_digest(F.col("g")), F.min("g").alias("g")), "ids")
    single = ids.where("n = 1").groupBy(*keys, "g").agg(F.count(F.lit(1)).alias("s"))
    every = members.groupBy(*keys, "g").agg(F.count(F.lit(1)).alias("k"))
    simple = single.join(every, [*keys, "g"]).select(*keys, (_twos(F.col("s")) + F.col("s") * (F.col("k") - F.col("s"))).cast("bigint").alias("pairs"))
    classes = cut(ids.where("n > 1").groupBy(*keys, F.struct("n", "h1", "h2").alias("c")).agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("id")), "classes")
    inner = classes.select(*keys, _twos(F.col("w")).cast("bigint").alias("pairs"))
    at = cut(classes.join(members, [*keys, "id"]).select(*keys, "c", "g"), "at")  # the groups of one id of each class
    hot = _heavy(at, keys, "g", heavy)
    met, parts = _met(classes, keys, at, "g", hot), simple.unionByName(inner)
    if hot.isEmpty():
        parts = parts.unionByName(_weights(met, classes, keys, []))
    else:
        signed = cut(_signed(classes.drop("id"), keys, at, "g", hot), "signed")
        parts = parts.unionByName(_weights(met, signed, keys, ["s_g"])).unionByName(_weight_of_heavy(signed, keys, ["s_g"]))
    # groups without any pair still give their key a row
    return parts.unionByName(every.select(*keys, F.lit(0).cast("bigint").alias("pairs"))).groupBy(*keys).agg(F.sum("pairs").alias("pairs"))


def shared_pairs(truth: DataFrame, pred: DataFrame, heavy: int = HEAVY, product: int = PRODUCT) -> DataFrame:
    """(image_id, pairs): distinct pairs of ids that share a true group and a predicted group.

    Ids in one group on either side are counted by their pair of groups; they meet the other ids through the pairs of
    groups of a class, or, where these are too many, through one side and then the other. Classes of ids in several
    groups meet in light groups of one side and are tested on the other; classes that share heavy groups on both sides
    are counted by their sets of heavy groups.
    """
    keys = ["image_id"]
    ids = (truth.groupBy("image_id", "id").agg(*[c.alias("t_" + n) for c, n in zip(_digest(F.col("g")), ("n", "h1", "h2"))], F.min("g").alias("g"))
           .join(pred.groupBy("image_id", "id").agg(*[c.alias("p_" + n) for c, n in zip(_digest(F.col("g")), ("n", "h1", "h2"))], F.min("g").alias("p")), ["image_id", "id"]))
    ids = cut(ids, "ids")
    simple = cut(ids.where("t_n = 1 and p_n = 1").groupBy("image_id", "g", "p").agg(F.count(F.lit(1)).alias("k")), "simple")
    many = ids.where("t_n > 1 or p_n > 1")
    classes = cut(many.groupBy("image_id", F.struct("t_n", "t_h1", "t_h2", "p_n", "p_h1", "p_h2").alias("c")).agg(
        F.count(F.lit(1)).alias("w"), F.min("id").alias("id")), "classes")
    side = lambda df, name: cut(classes.join(df, ["image_id", "id"]).select("image_id", "c", F.col("g").alias(name)), "side")
    in_t, in_p = side(truth, "g"), side(pred, "p")
    few = F.col("c.t_n") * F.col("c.p_n") <= product
    listed = in_t.where(few).join(in_p, ["image_id", "c"]).join(simple, ["image_id", "g", "p"]).select("image_id", "c", "k")
    through = (simple.join(in_t.where(~few), ["image_id", "g"]).groupBy("image_id", "c", "p").agg(F.sum("k").alias("k"))
               .join(in_p.where(~few), ["image_id", "c", "p"]).select("image_id", "c", "k"))
    with_simple = listed.unionByName(through).join(classes, ["image_id", "c"]).select("image_id", (F.col("w") * F.col("k")).alias("pairs"))
    hot_t, hot_p = _heavy(in_t, keys, "g", heavy), _heavy(in_p, keys, "p", heavy)

    def tested(pairs, at, name):
        """Those of the pairs that share a group of the other side."""
        mine = pairs.join(at, ["image_id", "c"])
        return mine.join(at.withColumnRenamed("c", "c2"), ["image_id", "c2", name]).select("image_id", "c", "c2").distinct()
    met = tested(_met(classes, keys, in_t, "g", hot_t), in_p, "p")
    if hot_t.isEmpty():
        among = _weights(met, classes, keys, [])
    else:  # pairs may share heavy true groups only
        met = met.unionByName(tested(_met(classes, keys, in_p, "p", hot_p), in_t, "g")).distinct()
        signed = cut(_signed(_signed(classes.drop("id"), keys, in_t, "g", hot_t), keys, in_p, "p", hot_p), "signed")
        among = _weights(met, signed, keys, ["s_g", "s_p"]).unionByName(_weight_of_heavy(signed, keys, ["s_g", "s_p"]))
    parts = [simple.select("image_id", _twos(F.col("k")).alias("pairs")), classes.select("image_id", _twos(F.col("w")).alias("pairs")), with_simple, among]
    out = parts[0].select("image_id", F.col("pairs").cast("bigint"))
    for p in parts[1:]:
        out = out.unionByName(p.select("image_id", F.col("pairs").cast("bigint")))
    return out.groupBy("image_id").agg(F.sum("pairs").alias("pairs"))


def edge_counts(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """(image_id, tp, fp, fn, n_true, n_pred) over unordered pairs of ids sharing a group."""
    def tagged(df, what):
        return df.select("image_id", F.lit(what).alias("what"), F.col("g").cast("bigint").alias("g"), "id")
    # either count is a long plan of its own, so they are written one after the other
    rows = cut(pair_counts(tagged(truth, "n_true").unionByName(tagged(pred, "n_pred")), ("image_id", "what")), "counts")
    rows = rows.unionByName(cut(shared_pairs(truth, pred), "shared").select("image_id", F.lit("tp").alias("what"), "pairs"))

    def total(n):
        return F.coalesce(F.sum(F.when(F.col("what") == n, F.col("pairs"))), F.lit(0)).cast("bigint").alias(n)
    out = rows.groupBy("image_id").agg(total("n_true"), total("n_pred"), total("tp"))
    return out.withColumn("fp", F.col("n_pred") - F.col("tp")).withColumn("fn", F.col("n_true") - F.col("tp"))


def _group_digests(df: DataFrame, name: str, on: str = "id") -> DataFrame:
    """(image_id, name, d): one digest for each group."""
    return df.groupBy("image_id", F.col("g").alias(name)).agg(*_digest(F.col(on))).select("image_id", name, F.struct("n", "h1", "h2").alias("d"))


def _verified(found: DataFrame, truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Pairs of groups (image_id, g, p, n) of equal digests whose n members are the same."""
    mine = found.join(truth.select("image_id", "g", "id"), ["image_id", "g"])
    same = mine.join(pred.select("image_id", F.col("g").alias("p"), "id"), ["image_id", "p", "id"])
    return same.groupBy("image_id", "g", "p", "n").agg(F.count(F.lit(1)).alias("k")).where("k = n").select("image_id", "g", "p")


def equal_groups(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """(image_id, g, p) of true and predicted groups that hold the same ids."""
    found = _group_digests(truth, "g").join(_group_digests(pred, "p"), ["image_id", "d"]).select("image_id", "g", "p", "d.n")
    return _verified(found, truth, pred)


def matched_groups(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """One-to-one matches (image_id, g, p): equal groups paired in order inside their class."""
    gs, ps = _group_digests(truth, "g"), _group_digests(pred, "p")
    # classes of equal sets are as small as the number of repeated nets in a picture
    gs = gs.withColumn("k", F.row_number().over(W.partitionBy("image_id", "d").orderBy("g")))
    ps = ps.withColumn("k", F.row_number().over(W.partitionBy("image_id", "d").orderBy("p")))
    return _verified(gs.join(ps, ["image_id", "d", "k"]).select("image_id", "g", "p", "d.n"), truth, pred)


def last_groups(groups: DataFrame) -> DataFrame:
    """(image_id, designator, g): the last group a component is in, whose others are its neighbours."""
    return groups.groupBy("image_id", "designator").agg(F.max("g").alias("g"))


def designator_groups(groups: DataFrame, at_least: int = 1) -> DataFrame:
    d = groups.select("image_id", "g", "designator").distinct()
    if at_least < 2:
        return d
    big = d.groupBy("image_id", "g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least).select("image_id", "g")
    return d.join(big, ["image_id", "g"])


def neighbour_counts(groups: DataFrame) -> DataFrame:
    """(image_id, designator, g, n_neighbours) from the last group of each component."""
    d = designator_groups(groups)
    n = d.groupBy("image_id", "g").agg((F.count(F.lit(1)) - 1).alias("n_neighbours"))
    return last_groups(d).join(n, ["image_id", "g"])


def neighbour_accuracy(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """(image_id, n_right, n_comps): components whose neighbour sets agree; a missing one is empty."""
    t, p = designator_groups(truth), designator_groups(pred, 2)
    def last(d, name):
        own = last_groups(d).withColumnRenamed("g", name)
        return own.join(_group_digests(d, name, "designator"), ["image_id", name]).select("image_id", "designator", F.col("d").alias("d_" + name))
    comps = last(t, "g").join(last(p, "p"), ["image_id", "designator"], "full")
    # a component is in both its groups, so its neighbours agree where the groups do
    right = F.when(F.col("d_g").isNull(), F.col("d_p.n") == 1).when(F.col("d_p").isNull(), F.col("d_g.n") == 1).otherwise(F.col("d_g") == F.col("d_p"))
    return comps.groupBy("image_id").agg(F.sum(right.cast("bigint")).alias("n_right"), F.count(F.lit(1)).alias("n_comps"))


def _rate(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def evaluate(images: DataFrame, true_entries: DataFrame, pred_entries: DataFrame) -> DataFrame:
    """All rates of each picture in images(image_id)."""
    truth, pred = cut(true_groups(true_entries), "truth"), cut(predicted_groups(pred_entries), "pred")
    names = ["n_true", "n_pred", "tp", "fp", "fn", "n_gt_groups", "n_pred_groups", "n_matched", "n_right", "n_comps"]

    def tagged(df):
        return df.select("image_id", *[(F.col(n) if n in df.columns else F.lit(0)).cast("bigint").alias(n) for n in names])
    count = lambda df, g, n: df.groupBy("image_id").agg(F.count_distinct(g).alias(n))
    found = tagged(images).withColumn("asked", F.lit(True))
    matched = matched_groups(truth, pred).groupBy("image_id").agg(F.count(F.lit(1)).alias("n_matched"))
    for d in (edge_counts(truth, pred), count(truth, "g", "n_gt_groups"), count(pred, "g", "n_pred_groups"),
              cut(matched, "matched"), cut(neighbour_accuracy(truth, pred), "right")):
        found = found.unionByName(tagged(d).where("image_id is not null").withColumn("asked", F.lit(False)))
    out = found.groupBy("image_id").agg(*[F.sum(n).alias(n) for n in names], F.bool_or("asked").alias("asked")).where("asked")
    return out.select(
        "image_id", "n_gt_groups", "n_pred_groups", _rate(F.col("tp"), F.col("n_true")).alias("port_correct_rate"),
        _rate(F.col("fp"), F.col("n_pred")).alias("fp_rate"), _rate(F.col("fn"), F.col("n_true")).alias("fn_rate"),
        _rate(F.col("n_matched"), F.col("n_gt_groups")).alias("group_accuracy"),
        _rate(F.col("n_right"), F.col("n_comps")).alias("comp_neighbor_accuracy"))


# ---- summaries of experiments ---------------------------------------------------------------------
def config_means(results: DataFrame) -> DataFrame:
    """Mean rates and number of pictures per setting, failed rows left out."""
    return results.where("port_correct_rate is not null").groupBy("config").agg(
        *[F.avg(m).alias(m) for m in RATES], F.count(F.lit(1)).alias("n"))


def deltas(means: DataFrame, base: str = "Ours", leave_out=("Ours", "Baseline", "CCL")) -> DataFrame:
    """(config, metric, delta) of each ablation against the full setting; 0 where it has no results."""
    metrics = ["comp_neighbor_accuracy", "group_accuracy", "port_correct_rate"]
    def long(df, name):
        return df.unpivot(["config"], metrics, "metric", name)
    ref = long(means.where(F.col("config") == base), "full").drop("config")
    from netloom.functions.dims import ABLATIONS
    names = means.sparkSession.createDataFrame([(c,) for c in ABLATIONS if c not in leave_out], "config string")
    # the table of settings is fixed and the means hold one row per setting
    return (F.broadcast(names).crossJoin(ref).join(long(means, "value"), ["config", "metric"], "left")
            .select("config", "metric", F.coalesce(F.col("value") - F.col("full"), F.lit(0.0)).alias("delta")))


def summary_table(means: DataFrame) -> DataFrame:
    return means.select("config", F.col("comp_neighbor_accuracy").alias("cna"), F.col("group_accuracy").alias("ga"),
                        F.col("port_correct_rate").alias("pc"), F.col("fp_rate").alias("fp"), F.col("fn_rate").alias("fn"), "n")


def port_identity(match: DataFrame, pred_ports: DataFrame, ref_ports: DataFrame, reach: int = 60) -> DataFrame:
    """(image_id, ci, pi, port_id): by index when both sides have as many ports, else the nearest within reach.

    match(image_id, pred_idx, ref_idx), pred_ports(image_id, ci, pi, px, py, n_ports),
    ref_ports(image_id, ci, pi, px, py, n_ports, designator, label).
    """
    r = ref_ports.select("image_id", F.col("ci").alias("ref_idx"), F.col("pi").alias("rpi"), F.col("px").alias("rx"),
                         F.col("py").alias("ry"), F.col("n_ports").alias("rn"), F.concat("designator", F.lit("."), "label").alias("port_id"))
    both = (pred_ports.join(match.withColumnRenamed("pred_idx", "ci"), ["image_id", "ci"]).join(r, ["image_id", "ref_idx"])
            .withColumn("d", F.sqrt(((F.col("px") - F.col("rx")) * (F.col("px") - F.col("rx"))
                                     + (F.col("py") - F.col("ry")) * (F.col("py") - F.col("ry"))).cast("double"))))
    same = F.col("n_ports") == F.col("rn")
    kept = both.where((same & (F.col("pi") == F.col("rpi"))) | (~same & (F.col("d") < reach)))
    return kept.groupBy("image_id", "ci", "pi").agg(F.min_by("port_id", F.struct("d", "rpi")).alias("port_id"))
