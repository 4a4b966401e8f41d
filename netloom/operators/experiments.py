"""The ablation run: wiring under each setting, scored against true groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netloom.functions import dims
from netloom.lineage import cut
from netloom.operators import detect, metrics, wiring


def honoured(settings: dict[str, dict] | None = None) -> dict[str, dict]:
    """The settings that ask for no work on pixels."""
    return {n: s for n, s in (settings or dims.ABLATIONS).items() if not any(s.get(k) for k in dims.RASTER_SWITCHES)}


def predicted_entries(groups: DataFrame, port_ids: DataFrame) -> DataFrame:
    """Group entries (image_id, g, designator, label) of wired ports that have an id; its last dot parts the two."""
    dotted = r"(?s)^(.*)\.([^.]*)$"
    return groups.join(port_ids, ["image_id", "ci", "pi"]).select(
        "image_id", "g", F.regexp_extract("port_id", dotted, 1).alias("designator"), F.regexp_extract("port_id", dotted, 2).alias("label"))


def run(prepared: dict[str, DataFrame], comps: DataFrame, references: DataFrame, reference_ports: DataFrame, images: DataFrame,
        truth: DataFrame, settings: dict[str, dict] | None = None) -> DataFrame:
    """Rates of every picture under every honoured setting: (config, image_id, counts and rates).

    comps are matched to references (image_id, idx, box); a port takes the id of its counterpart among
    reference_ports (as for `metrics.port_identity`). truth has true group entries.
    """
    ids = cut(metrics.port_identity(detect.match_boxes(comps, references), prepared["ports"], reference_ports), "ids")
    settings, entries = honoured(settings), None
    # pictures of all settings are scored at once, under the key (config, image_id)
    both = lambda config: F.struct(config.alias("config"), "image_id").alias("image_id")
    alike = {}  # settings that differ in nothing the vector path reads are wired and scored once, under the first name
    for name, switches in settings.items():
        alike.setdefault(wiring.in_effect(switches), []).append(name)
    for group in alike.values():
        own = cut(predicted_entries(wiring.wire(prepared, settings[group[0]])["groups"], ids), "own")
        one = own.select(both(F.lit(group[0])), "g", "designator", "label")
        entries = one if entries is None else entries.unionByName(one)
    firsts = F.explode(F.array(*[F.lit(g[0]) for g in alike.values()]))
    every = images.select(F.col("image_id"), firsts.alias("config")).select(both(F.col("config")))
    true = truth.select("*", firsts.alias("config")).select(both(F.col("config")), "g", "designator", "label")
    names = F.create_map(*[c for g in alike.values() for c in (F.lit(g[0]), F.array(*[F.lit(n) for n in g]))])
    return metrics.evaluate(every, true, entries).select(
        F.explode(names[F.col("image_id.config")]).alias("config"), "image_id.image_id", "n_gt_groups", "n_pred_groups", *metrics.RATES)
