"""The grid experiment: every model, text variant and clustering, scored, judged and ranked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice import settings as cfg
from coppice.functions.text import config_label
from coppice.operators import scores, sweep
from coppice.operators.tag_metrics import tag_columns
from coppice.session import cut
from coppice.sources.sinks import write_tables

ALL_COLUMNS = [
    "config_id", "model", "variant", "cluster_algo", "wos_jaccard", "concept_coherence", "domain_overlap", "oecd_coherence",
    "silhouette", "calinski_harabasz", "davies_bouldin", "n_clusters", "max_cluster_pct", "stage1_score",
]


@dataclass
class GridTables:
    results: DataFrame
    finalists: DataFrame
    winner: DataFrame
    assignments: DataFrame
    attempted: int
    failed: list

    def write(self, path: str, fmt: str = "parquet") -> dict[str, str]:
        return write_tables({"all_results": self.results, "finalists": self.finalists, "winner_details": self.winner}, path, fmt)


def winner_details(items: DataFrame, assignments: DataFrame, config_id: str) -> DataFrame:
    """The winner's items with their cluster, in cluster order."""
    chosen = assignments.filter(F.col("config_id") == config_id).select("item_id", "cluster")
    return items.select("item_id", "technology_name", "Web_of_Science_Category").join(chosen, "item_id").orderBy("cluster", "item_id")


def grid_experiment(items: DataFrame, vectors: DataFrame, judge: sweep.Judge | None = None, configs: list[tuple] | None = None,
                    top: int = cfg.SHORTLIST_GRID, **kw) -> GridTables:
    """Score every configuration on every ``(model, variant)`` of ``vectors(item_id, model, variant, features)``.

    Each vector set is a scope of its own, so one sweep clusters all sets. The labels of every
    configuration are kept: finalists and the winner are read back, not fitted again.
    """
    configs = configs or scores.grid_rows()
    tagged = tag_columns(items, ["item_id", "technology_name", "Technology_Description"])
    sets = [tuple(r) for r in vectors.select("model", "variant").distinct().orderBy("model", "variant").collect()]
    results, labels, failed = [], [], []
    for scope, (model, variant) in enumerate(sets):
        mine = vectors.filter((F.col("model") == model) & (F.col("variant") == variant)).select("item_id", "features")
        ready = cut(tagged.join(mine, "item_id"))
        assigned, broken = sweep.candidate_sweep(ready, configs, spectral_max=None, **kw)
        assigned = cut(assigned)
        failed += [(model, variant, *b) for b in broken]
        label = config_label(F.col("algo"), F.col("method"), F.col("size"))
        config = F.concat_ws("_", F.lit(model), F.lit(variant), "cluster_algo")
        scored = sweep.score_candidates(ready, assigned, full=True).withColumn("cluster_algo", label).withColumn("config_id", config)
        # The order of generation over the whole grid decides ties.
        placed = scored.withColumn("ord", F.lit(scope * len(configs)) + F.col("ord"))
        results.append(cut(placed.withColumn("model", F.lit(model)).withColumn("variant", F.lit(variant)).drop("scope")))
        labels.append(assigned.withColumn("cluster_algo", label).withColumn("config_id", config).select(
            "config_id", (F.lit(scope * len(configs)) + F.col("ord")).alias("ord"), "item_id", "cluster"))
    scored, assignments = results[0], labels[0]
    for r, a in zip(results[1:], labels[1:]):
        scored, assignments = scored.unionByName(r), assignments.unionByName(a)
    assignments = cut(assignments)
    short = sweep.judged_shortlist(
        items, assignments.withColumn("scope", F.lit(0)), scored.withColumn("scope", F.lit(0)), top, judge).drop("scope")
    winner = short.filter("final_rank = 1").select("config_id").first()["config_id"]
    return GridTables(
        scored.select(*ALL_COLUMNS), short.select(*ALL_COLUMNS, "judge_coherence", "final_score", "stage1_rank", "final_rank", "moved_up"),
        winner_details(items, assignments, winner), assignments, len(configs) * len(sets), failed)
