"""Checking the JSON answers of scoring models before they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHILD = "struct<id:string,score:double,confidence:double,evidence_slides:array<int>,explanation:string,missing_evidence:array<string>>"
SCORE = f"struct<score:double,confidence:double,evidence_slides:array<int>,explanation:string,missing_evidence:array<string>,subcriteria:array<{CHILD}>>"


def checked(responses: DataFrame, slides: DataFrame, components: list[str], key: str = "deck_id", json: str = "response") -> DataFrame:
    """(key, errors ARRAY<STRING>, scores MAP): each answer with all that is wrong with it; usable answers have no errors.

    An answer must score exactly the ``components``; a score is null or 0..100, a
    confidence 0..1, a cited slide one of the deck's, and a score above 0 must
    cite a slide itself or in one of its parts. Text that isn't JSON has the one
    error 'not_json'.
    """
    known = slides.groupBy(key).agg(F.collect_set("slide_number").alias("__known"))
    d = responses.select(key, F.from_json(F.get_json_object(json, "$.scores"), f"map<string,{SCORE}>").alias("s"), F.json_object_keys(F.col(json)).alias("keys")).join(known, key, "left")
    entries, have = F.map_values("s"), F.map_keys("s")
    want = F.array(*[F.lit(c) for c in components])
    cites = lambda e: F.coalesce(e["evidence_slides"], F.array().cast("array<int>"))
    every = lambda e: F.flatten(F.concat(F.array(cites(e)), F.transform(F.coalesce(e["subcriteria"], F.array().cast(f"array<{CHILD}>")), cites)))
    outside = lambda c, lo, hi: F.coalesce(F.isnan(c) | (c < lo) | (c > hi), F.lit(False))
    parts = lambda test: F.exists(entries, lambda e: test(e) | F.exists(F.coalesce(e["subcriteria"], F.array().cast(f"array<{CHILD}>")), test))
    errors = F.array_compact(F.array(
        F.when(F.size(F.array_except(want, have)) > 0, "missing_component"), F.when(F.size(F.array_except(have, want)) > 0, "unknown_component"),
        F.when(parts(lambda e: outside(e["score"], 0, 100)), "score_range"), F.when(parts(lambda e: outside(e["confidence"], 0, 1)), "confidence_range"),
        F.when(F.exists(entries, lambda e: F.size(F.array_except(every(e), F.coalesce(F.col("__known"), F.array().cast("array<int>")))) > 0), "unknown_slide"),
        F.when(F.exists(entries, lambda e: F.coalesce(e["score"] > 0, F.lit(False)) & (F.size(every(e)) == 0)), "uncited_score"),
    ))
    return d.select(key, F.when(F.col("s").isNull() | F.col("keys").isNull(), F.array(F.lit("not_json"))).otherwise(errors).alias("errors"), F.col("s").alias("scores"))


#: Parts of the components and their weights.
SUBCRITERIA = {
    "solution_clarity": {"mechanism": 0.40, "user_workflow": 0.30, "inputs_outputs": 0.20, "scope": 0.10},
    "technical_feasibility": {"architecture": 0.35, "implementation_plan": 0.25, "resources_dependencies": 0.25, "risks_mitigations": 0.15},
    "innovation": {"differentiation": 0.40, "problem_specific_value": 0.40, "justification": 0.20},
    "text_visual_balance": {"purpose_fit": 0.40, "complementarity": 0.35, "information_load": 0.25},
    "content_structure": {"clear_concise_writing": 0.50, "organization": 0.30, "precision": 0.20},
    "readability": {"legibility": 0.40, "contrast": 0.25, "hierarchy": 0.20, "unobstructed_content": 0.15},
    "narrative_flow": {"logical_progression": 0.40, "connections": 0.35, "pacing": 0.25},
    "visual_relevance_coherence": {"relevance": 0.50, "semantic_coherence": 0.30, "consistent_labels": 0.20},
    "layout_space_usage": {"alignment_grouping": 0.40, "purposeful_space": 0.35, "consistency": 0.25},
}


def component_records(answers: DataFrame, requirements: DataFrame | None = None, key: str = "deck_id", alignment: str = "problem_statement_alignment") -> DataFrame:
    """(key, scores MAP<name, STRUCT<score, confidence, n_missing>>) of usable answers (``checked``), for ``metrics.evaluated``.

    A component's score is recomputed from its parts where these are exactly those
    with weights (``SUBCRITERIA``; for the alignment the deck's requirements: key,
    weights MAP<id, weight>), null if a part has none; else its own score stands.
    Without requirements the alignment has no score. Missing evidence of a
    component and of its parts counts, each text once.
    """
    a = answers.where(F.size("errors") == 0).select(key, "scores")
    a = a.join(requirements.select(key, F.col("weights").alias("__w")), key, "left") if requirements is not None else a.withColumn("__w", F.lit(None).cast("map<string,double>"))
    known = F.create_map(*[x for k, ws in SUBCRITERIA.items() for x in (F.lit(k), F.create_map(*[y for i, w in ws.items() for y in (F.lit(i), F.lit(w))]))])
    none = F.array().cast("array<string>")

    def record(name, r):
        weights = F.when(name == alignment, F.col("__w")).otherwise(F.try_element_at(known, name))
        parts = F.coalesce(r["subcriteria"], F.array().cast(f"array<{CHILD}>"))
        ids = F.transform(parts, lambda p: p["id"])
        own = (F.size(ids) > 0) & weights.isNotNull() & (F.size(F.array_except(ids, F.map_keys(weights))) == 0) & (F.size(F.array_except(F.map_keys(weights), ids)) == 0)
        total = F.aggregate(F.map_values(weights), F.lit(0.0), lambda s, w: s + w)
        mean = lambda f: F.aggregate(parts, F.lit(0.0), lambda s, p: s + p[f] * F.try_element_at(weights, p["id"])) / total
        lacks = F.size(F.array_distinct(F.flatten(F.concat(F.array(F.coalesce(r["missing_evidence"], none)), F.when(F.coalesce(own, F.lit(False)), F.transform(parts, lambda p: F.coalesce(p["missing_evidence"], none))).otherwise(F.array().cast("array<array<string>>"))))))
        absent = (name == alignment) & F.col("__w").isNull()
        score = F.when(absent, F.lit(None).cast("double")).when(F.coalesce(own, F.lit(False)), mean("score")).otherwise(r["score"])
        sure = F.when(score.isNotNull(), F.when(F.coalesce(own, F.lit(False)), mean("confidence")).otherwise(r["confidence"]))
        return F.struct(F.round(score, 6).alias("score"), F.round(sure, 6).alias("confidence"), lacks.cast("int").alias("n_missing"))

    return a.select(key, F.transform_values("scores", record).alias("scores"))


def reaggregated(children: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score): weighted mean of the children's scores where their ids are exactly those that have weights, else null."""
    j = children.join(weights.withColumnRenamed("weight", "__w"), [*keys, "id"], "full")
    g = j.groupBy(*keys).agg(F.bool_and(F.col("__w").isNotNull() & F.col("score").isNotNull()).alias("ok"), (F.sum(F.col("score") * F.col("__w")) / F.nullif(F.sum("__w"), F.lit(0.0))).alias("s"))
    return g.select(*keys, F.when(F.col("ok"), F.round("s", 6)).alias("score"))


def findings(scores: DataFrame, key: str, name: str, score: str, weak: float = 60.0, strong: float = 85.0) -> DataFrame:
    """(key, name, kind): 'ambiguous' without a score, 'weakness' below ``weak``, 'strength' from ``strong`` on; others give none."""
    s: Column = F.col(score)
    kind = F.when(s.isNull(), "ambiguous").when(s < weak, "weakness").when(s >= strong, "strength")
    return scores.select(key, name, kind.alias("kind")).where("kind is not null")
