"""Whole revisions of plans, and their repetition.  A plan is a user's week of events; the choices depend on each other, so there is no SQL: tests compare with plain loops."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions import exprs as X
from chronoloom.operators import audit, revision
from chronoloom.operators.shelf import Shelf, shelved
from chronoloom.plans import audits
from chronoloom.plans.profiles import PROFILES
from chronoloom.plans.registry import registrar

REGISTRY, query = registrar()
KEYS = ["user_id", "week"]
RULES = revision.Rules(beat=7, max_reuse=PROFILES[0].max_reuse)


@dataclass(frozen=True)
class Weeks:
    """Users' weeks as plans, and what audits and revisions of them need."""

    plans: DataFrame
    energy: DataFrame
    drops: DataFrame
    strong: DataFrame
    library: DataFrame
    shelf: Shelf

    def audit(self, plans: DataFrame) -> DataFrame:
        """Findings on plans as they are now: a slot's energy is that of the hour in which it begins."""
        hour = F.floor(F.col("track_start") / audits.HOUR).cast("int")
        heard = plans.withColumn("h", hour).join(self.energy.select("track", "h", "e", "q_hi", "rel"), ["track", "h"])
        return audit.issues(heard, self.drops, self.strong, KEYS)

    def revise(self, plans: DataFrame, found: DataFrame) -> DataFrame:
        return revision.revised(plans, found, self.library, self.shelf, KEYS, RULES)


def weeks(spark: SparkSession, sf_dir: str) -> Weeks:
    a = audits.audited(spark, sf_dir)
    library = a.features.withColumn("start", F.col("id") * 2.0)
    rows = a.plan.withColumn("week", F.floor(F.col("track_start") / (7 * 24 * audits.HOUR)).cast("int"))
    rows = rows.withColumn("pos", (F.row_number().over(Window.partitionBy(*KEYS).orderBy("pos")) - 1).cast("int"))
    rows = rows.withColumns({"level": X.level(F.col("e"), F.col("q_lo"), F.col("q_hi")), "fitted": F.lit(None).cast("int"), "cut_in": F.lit(False)})
    return Weeks(rows.select(*KEYS, *revision.NAMES), a.energy, a.drops, audits.strong(a.features), library, shelved(library.filter("usable")))


@query()
def revise_plan(spark, sf_dir):
    """Every plan after one revision: all five actions, worst findings first, eight changes in all."""
    w = weeks(spark, sf_dir)
    p = PROFILES[0]
    later = revision.fitted(w.revise(w.plans, w.audit(w.plans)), w.library, p.kenburns, p.shake, p.flash)
    return later.select(*KEYS, F.format_string("c%03d", "pos").alias("clip_no"), "clip_id", "track_start", "duration", "intensity", "impact", "source_start", "speed", "effects", "cut_in", "applied")


@query()
def iterate_plans(spark, sf_dir):
    """Every version's score of every plan, revised until its own stop (four versions at most), and whether it is the plan's best."""
    w = weeks(spark, sf_dir)
    history, best = revision.converged(w.plans, w.audit, w.revise, KEYS)
    chosen = best.select(*KEYS, F.col("version")).distinct().withColumn("best", F.lit(True))
    return history.join(chosen, [*KEYS, "version"], "left").select(*KEYS, "version", "score", "n_issues", "stopped", F.coalesce("best", F.lit(False)).alias("best"))


@query()
def final_plans(spark, sf_dir):
    """The slots of every plan's best version."""
    w = weeks(spark, sf_dir)
    best = revision.converged(w.plans, w.audit, w.revise, KEYS)[1]
    return best.select(*KEYS, "version", "score", F.format_string("c%03d", "pos").alias("clip_no"), "clip_id", "track_start", "duration", "intensity", "impact")
