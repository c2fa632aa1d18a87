"""How far a misused tool can reach: blast scores and attack paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolguard import rules
from toolguard.functions import capabilities as caps
from toolguard.functions import regex
from toolguard.functions.risk import searchable
from toolguard.functions.constants import constant, constant_map, let
from toolguard.scale import hottest, salted_join


def _points(capabilities: Column, table: dict[str, int]) -> Column:
    points = constant_map(table)
    return F.aggregate(
        capabilities, F.lit(0), lambda total, c: total + F.coalesce(F.try_element_at(points, c), F.lit(0))
    )


def capability_points(capabilities: Column) -> Column:
    return _points(capabilities, rules.CAPABILITY_POINTS)


def downstream_points(capabilities: Column) -> Column:
    """Each distinct target counts the sensitivity of its category, up to 30 in all."""
    per_category = {c: level * len(set(targets)) for c, (level, _, targets) in rules.DOWNSTREAM.items()}
    return F.least(_points(capabilities, per_category), F.lit(rules.DOWNSTREAM_CAP))


def open_chains(capabilities: Column) -> Column:
    """The chains whose required capabilities are all there, in list order."""
    chains = [
        {"name": name, "description": text, "reaches": targets, "requires": need}
        for name, need, targets, text in rules.CHAINS
    ]
    return F.filter(constant(chains), lambda p: F.size(F.array_except(p["requires"], capabilities)) == 0)


def chain_points(capabilities: Column) -> Column:
    return F.least(F.size(open_chains(capabilities)) * rules.CHAIN_POINTS, F.lit(rules.CHAIN_CAP))


def risk_points(text: Column, risk_level: Column) -> Column:
    """Points for the risk level, plus those of the highest tier of words in the text."""
    # The text has no underscores, so words with one can be left out of the search.
    tiers = [(points, [w for w in tier if "_" not in w]) for points, tier in rules.IMPACT_WORDS]
    words = F.when(~text.rlike(regex.whole_word([w for _, tier in tiers for w in tier])), 0)
    for points, tier in tiers:
        words = words.when(text.rlike(regex.whole_word(tier)), points)
    return caps.lookup(risk_level, rules.RISK_BASE_POINTS, 2) + words.otherwise(0)


def label(score: Column) -> Column:
    case = None
    for least, name in rules.BLAST_LABELS:
        case = (F if case is None else case).when(score >= least, name)
    return case.otherwise("NONE")


def attack_paths(capabilities: Column) -> Column:
    """Open chains in list order, then one direct path per capability."""
    direct = constant_map(
        {
            c: {"name": f"Direct {c}", "description": f"Tool can {text}", "reaches": targets, "requires": [c]}
            for c, (_, text, targets) in rules.DOWNSTREAM.items()
        }
    )
    each = F.transform(capabilities, lambda c: F.try_element_at(direct, c))
    return F.concat(open_chains(capabilities), F.array_compact(each))


def blast_radius(text: Column, capabilities: Column, risk_level: Column) -> Column:
    """Score, label, score components and attack paths as one struct.

    ``text`` is the ``searchable`` form of the tool's name and description.
    """
    parts = F.struct(
        capability_points(capabilities).alias("capability_amplification"),
        downstream_points(capabilities).alias("downstream_targets"),
        chain_points(capabilities).alias("combination_paths"),
        risk_points(text, risk_level).alias("risk_amplification"),
    )

    def scored(p: Column) -> Column:
        total = (
            p["capability_amplification"] + p["downstream_targets"] + p["combination_paths"] + p["risk_amplification"]
        )
        return F.struct(F.least(total, F.lit(rules.BLAST_CAP)).alias("score"), p.alias("components"))

    return let(
        let(parts, scored),
        lambda s: F.struct(
            s["score"].alias("score"),
            label(s["score"]).alias("label"),
            s["components"].alias("components"),
            attack_paths(capabilities).alias("attack_paths"),
        ),
    )


def by_name(analyses: DataFrame) -> DataFrame:
    """Blast radius per name, from its permission analysis (severity as risk level)."""
    radius = blast_radius(searchable(F.col("name"), F.lit("")), F.col("actual"), F.col("severity"))
    return analyses.withColumn("blast", radius).select(
        "repo_id", "name", "blast.score", "blast.label", "blast.components", "blast.attack_paths"
    )


def repo_summary(radii: DataFrame) -> DataFrame:
    """Per repo: the worst score and its label, tools, and tools scoring 50 or more."""
    return (
        radii.groupBy("repo_id")
        .agg(
            F.max("score").alias("max_score"),
            F.count(F.lit(1)).alias("total_tools"),
            F.count_if(F.col("score") >= 50).alias("high_risk_tools"),
        )
        .withColumn("max_label", label(F.col("max_score")))
    )


def ranked(radii: DataFrame) -> DataFrame:
    """Tools with their place by score within the repo (equal scores share a place).

    A place is one more than the number of tools with a higher score.  Scores
    lie in 0..100, so the running count goes over at most 101 rows per repo;
    no task ever sorts the tools of a large repo.
    """
    per_score = radii.groupBy("repo_id", "score").agg(F.count(F.lit(1)).alias("n"))
    higher = Window.partitionBy("repo_id").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    places = per_score.select(
        "repo_id", "score", (F.coalesce(F.sum("n").over(higher), F.lit(0)) + 1).alias("place")
    )
    return salted_join(
        radii.select("repo_id", "name", "score", "label"), places, ["repo_id", "score"], "inner",
        spread=["name"], hot=hottest(per_score.select("repo_id", "score", "n"), "n"),
    ).select("repo_id", "name", "score", "label", "place")


def repo_summaries(repos: DataFrame, radii: DataFrame) -> DataFrame:
    """``repo_summary`` for every repo, also those without any tool."""
    return repos.join(repo_summary(radii), "repo_id", "left").select(
        "repo_id",
        F.coalesce("max_score", F.lit(0)).alias("max_score"),
        F.coalesce("max_label", F.lit("NONE")).alias("max_label"),
        F.coalesce("total_tools", F.lit(0)).alias("total_tools"),
        F.coalesce("high_risk_tools", F.lit(0)).alias("high_risk_tools"),
    )
