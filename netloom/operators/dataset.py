"""Benchmark selection, splits, label data and their counters."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from netloom.functions import dims
from netloom.lineage import cut
from netloom.operators import ranks


# ---- selection ------------------------------------------------------------------------------------
def image_counts(objects: DataFrame) -> DataFrame:
    """(image_id, comp_n, term_n) from annotated objects(image_id, cls)."""
    c = F.col("cls")
    return objects.groupBy("image_id").agg(F.count_if(~c.isin(*dims.NOT_COMPONENTS)).alias("comp_n"),
                                           F.count_if(c == "terminal").alias("term_n"))


def top_drafters(pictures: DataFrame, k: int = 10) -> DataFrame:
    """Drafters with most terminal pictures; ties by first appearance."""
    return (pictures.where("terminals > 0").groupBy("drafter").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
            .orderBy(F.desc("n"), "first").limit(k))


def median_picks(pictures: DataFrame, guard: ranks.SkewGuard | None = None) -> DataFrame:
    """Per drafter the terminal picture in the middle of the order by count."""
    pool = pictures.where("terminals > 0")
    n = pool.groupBy("drafter").agg(F.count(F.lit(1)).alias("n"))
    placed = ranks.row_number(pool, ["drafter"], ["count", "ord"], "pos", start=0, guard=guard)
    return placed.join(n, "drafter").where(F.col("pos") == F.floor(F.col("n") / 2)).drop("n", "pos")


def terminal_picks(pictures: DataFrame, k: int = 10) -> DataFrame:
    return median_picks(pictures.join(F.broadcast(top_drafters(pictures, k).select("drafter")), "drafter", "left_semi"))


def stratified(pictures: DataFrame, picks: DataFrame) -> DataFrame:
    """Selection (drafter, ord, count, bin): the picks, then each bin up to its target.

    Drafters used least come first, counting what earlier bins took. A selection never exceeds the
    targets plus the picks (80 rows), so it may be broadcast.
    """
    cols = ["drafter", "ord", "count"]
    chosen = picks.select(*cols, F.lit("terminal").alias("bin"))
    for label, low, high, target in dims.BINS:
        used = F.broadcast(chosen.groupBy("drafter").agg(F.count(F.lit(1)).alias("used")))
        pool = pictures.where(F.col("count").between(low, high)).join(F.broadcast(chosen.select("ord")), "ord", "left_anti")
        best = (pool.join(used, "drafter", "left").orderBy(F.coalesce("used", F.lit(0)), "ord").limit(target)
                .select(*cols, F.lit(label).alias("bin")))
        chosen = chosen.unionByName(best)
        chosen = chosen.sparkSession.createDataFrame(chosen.collect(), chosen.schema)  # at most 80 rows
    return chosen


def coverage_of(selection: DataFrame) -> DataFrame:
    """Selected pictures and different drafters per bin and in all."""
    return selection.rollup("bin").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("drafter").alias("drafters"))


# ---- splits ---------------------------------------------------------------------------------------
def split(rows: DataFrame, key: Column, train: float) -> DataFrame:
    """Adds `split`: exactly floor(n * train) rows are train, in the order of the key's digest.

    `key` names a row uniquely. Only one limit digest is looked up; rows are labelled where they lie.
    """
    digest = F.md5(key.cast("string"))
    k = int(rows.count() * train)
    limit = ranks.cutoff_value(rows, digest, k)
    return rows.withColumn("split", F.when(digest <= F.lit(limit), "train").otherwise("val") if limit else F.lit("val"))


def split_totals(labels: DataFrame) -> DataFrame:
    """Images and labels per split, and in all (split NULL)."""
    per = labels.groupBy("split", "image_id").agg(F.count(F.lit(1)).alias("k"))
    return per.rollup("split").agg(F.count(F.lit(1)).alias("images"), F.sum("k").cast("bigint").alias("labels"))


# ---- annotated texts ------------------------------------------------------------------------------
def permitted(c: Column) -> Column:
    """Non-empty and made of label characters only."""
    return F.coalesce(c.rlike(f"^[{re.escape(dims.LABEL_ALPHABET)}]+$"), F.lit(False))


def text_counters(objects: DataFrame) -> DataFrame:
    """Counters over text objects(text): total, valid, empty, invalid characters."""
    t = F.regexp_replace("text", r"^\s+|\s+$", "")
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    return objects.agg(F.count(F.lit(1)).alias("total"), F.count_if(~empty & permitted(t)).alias("valid"),
                       F.count_if(empty).alias("empty"), F.count_if(~empty & ~permitted(t)).alias("invalid"))


def character_coverage(samples: DataFrame, alphabet: str = dims.LABEL_ALPHABET) -> DataFrame:
    """(ch, in_alphabet, covered) over all characters of samples(text) and of the alphabet."""
    seen = samples.select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch <> ''").distinct()
    known = F.broadcast(samples.sparkSession.createDataFrame([(c,) for c in alphabet], "ch string"))
    return (known.withColumn("in_alphabet", F.lit(True)).join(seen.withColumn("covered", F.lit(True)), "ch", "full")
            .select("ch", F.coalesce("in_alphabet", F.lit(False)).alias("in_alphabet"), F.coalesce("covered", F.lit(False)).alias("covered")))


def recognition_accuracy(pairs: DataFrame) -> DataFrame:
    """Exact matches of pairs(pred, label)."""
    return pairs.agg(F.count_if(F.col("pred") == F.col("label")).alias("correct"), F.count(F.lit(1)).alias("total"))


# ---- files ----------------------------------------------------------------------------------------
EXTENSIONS = (".png", ".jpg", ".jpeg", ".PNG", ".JPG", ".JPEG")


def pair_pictures(annotations: DataFrame, pictures: DataFrame) -> DataFrame:
    """Annotation with the picture of the same folder and stem; extensions by priority.

    annotations(drafter, stem), pictures(drafter, name).
    """
    stem = F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)
    ext = F.regexp_extract("name", r"(\.[^.]*)$", 1)
    rank = F.array_position(F.array(*[F.lit(e) for e in EXTENSIONS]), ext)
    cand = pictures.select("drafter", "name", stem.alias("stem"), rank.alias("rank")).where("rank > 0")
    best = cand.groupBy("drafter", "stem").agg(F.min_by("name", "rank").alias("name"))
    return annotations.join(best, ["drafter", "stem"])


def first_source(tables: list[DataFrame], key: str) -> DataFrame:
    """One row per key from the first table that has it; columns (key, payload, source)."""
    out = None
    for i, d in enumerate(tables):
        one = d.select(key, "payload", F.lit(i).alias("source"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key).agg(F.min_by("payload", "source").alias("payload"), F.min("source").alias("source"))


def work_list(truth: DataFrame, pictures: DataFrame, *detections: DataFrame) -> DataFrame:
    """Images with truth, picture and detections from any source."""
    found = detections[0].select("image_id")
    for d in detections[1:]:
        found = found.unionByName(d.select("image_id"))
    return truth.select("image_id").distinct().join(pictures, "image_id", "left_semi").join(found, "image_id", "left_semi")


# ---- corrections ----------------------------------------------------------------------------------
def latest(events: DataFrame, key: str, seq, payload: str) -> DataFrame:
    """Last payload per key, combined before the shuffle."""
    return events.groupBy(key).agg(F.max_by(payload, seq).alias(payload))


def correction_memory(posts: DataFrame) -> DataFrame:
    """posts(seq, pattern, replacement) -> (pattern, replacement, first): last write, first place."""
    return posts.groupBy("pattern").agg(F.max_by("replacement", "seq").alias("replacement"), F.min("seq").alias("first"))


SLICE_CHARS = 4_000_000  # characters of the patterns of one automaton


def apply_corrections(texts: DataFrame, memory: DataFrame, col: str = "text", slice_chars: int = SLICE_CHARS) -> DataFrame:
    """Text with the first pattern it contains replaced everywhere.

    Patterns go into automata (a trie with failure links), one for each slice of at most about `slice_chars` characters,
    and every distinct text runs once through each. Null and empty patterns never match, null texts stay.
    """
    ordered = cut(memory.where("pattern <> ''").select("pattern", "replacement", "first"), "memory")
    chars = ordered.agg(F.sum(F.length("pattern") + F.length(F.coalesce("replacement", F.lit(""))) + 16)).first()[0]
    if not chars:
        return texts
    distinct, slices = texts.select(F.col(col).alias("_t")).where("_t <> ''").distinct(), -(-chars // slice_chars)
    if slices > 1:
        distinct = cut(distinct, "texts")
    hits = None
    for k in range(slices):
        own = ordered if slices == 1 else ordered.where(F.pmod(F.xxhash64("pattern"), F.lit(slices)) == k)
        found = distinct.mapInArrow(_finder(own), "_t string, first bigint, pattern string, replacement string")
        hits = found if hits is None else hits.unionByName(found)
    best = hits.groupBy("_t").agg(F.min(F.struct("first", "pattern", "replacement")).alias("_h"))
    return (texts.join(best, F.col(col) == F.col("_t"), "left").withColumn(
        col, F.when(F.col("_h").isNotNull(), F.replace(F.col(col), F.col("_h.pattern"), F.col("_h.replacement"))).otherwise(F.col(col)))
        .drop("_t", "_h"))


def _finder(patterns: DataFrame):
    """A function that gives each text with its first pattern; the automaton of the slice is sent to every task."""
    import ahocorasick
    rows = patterns.collect()  # one slice, of bounded size
    held = patterns.sparkSession.sparkContext.broadcast(rows)

    def run(batches):
        machine = ahocorasick.Automaton()
        for r in held.value:
            machine.add_word(r["pattern"], (r["first"], r["pattern"], r["replacement"]))
        if len(machine):
            machine.make_automaton()
        for b in batches:
            found = []
            for t in b.column(0).to_pylist():
                if len(machine) and (hit := min((x for _, x in machine.iter(t)), key=lambda x: x[:2], default=None)):
                    found.append((t, *hit))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.string(), pa.int64(), pa.string(), pa.string()))],
                                                 ["_t", "first", "pattern", "replacement"])

    return run
