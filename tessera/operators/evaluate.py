"""Retriever evaluation and test-run summaries over parsed outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.parse import judge_scores, with_eval_fields
from tessera.functions.text import contains_ci


def parse_judgements(answers: DataFrame, query_id: str = "query_id",
                     answer: str = "answer") -> DataFrame:
    """One row per (query, model) with the judged score; a later line for
    the same model replaces an earlier one (C10)."""
    rows = answers.select(query_id, F.explode(judge_scores(answer)).alias("s")) \
        .select(query_id, "s.model", "s.score", "s.pos")
    return rows.groupBy(query_id, "model").agg(F.max_by("score", "pos").alias("score"))


def model_stats(scores: DataFrame, tested_models: DataFrame) -> DataFrame:
    """Mean, median and count per tested model; judged models that were not
    tested are ignored (B6); tested models without scores get n = 0 (H1).
    The model list is the small side of a left join: each model's scores
    reduce map-side before the shuffle, so a hot model is not a hot task."""
    kept = scores.join(tested_models.select("model"), "model", "left_semi")
    agg = kept.groupBy("model").agg(F.avg("score").alias("mean"), F.median("score").alias("median"),
                                    F.count("score").alias("n"))
    return (tested_models.select("model").distinct().join(agg, "model", "left")
            .select("model", "mean", "median", F.coalesce("n", F.lit(0)).alias("n")))


def score_results(results: DataFrame, threshold: int = 70) -> DataFrame:
    """Per test: score and success. Simple tests: the expected text is
    contained in the output (case-insensitive) -> 100, else 0. Full tests:
    parsed SCORE, success = ran and score >= threshold and (plan passed or
    plan not required) (C13, C14, H6)."""
    simple = F.col("test_type") == "simple"
    staged = with_eval_fields(results.withColumn("_matched", contains_ci("stdout", "expected_response")),
                              "raw", "_parsed", "_expl")
    matched, parsed = F.col("_matched"), F.col("_parsed")
    score = F.when(simple, F.when(matched, F.lit(100)).otherwise(F.lit(0))).otherwise(parsed)
    success = F.when(simple, matched).otherwise(
        F.col("ran") & (parsed >= threshold) & (F.col("plan_passed") | ~F.col("plan_should_pass")))
    return staged.select("test_name", "test_type", score.alias("score"),
                         F.when(simple, F.lit("")).otherwise(F.col("_expl")).alias("explanation"),
                         success.alias("success"), *[c for c in ("skip",) if c in results.columns])


def run_summary(scored: DataFrame) -> DataFrame:
    """Total and per type: count, passed, failed, success rate in % (null
    when there are no tests) (H2). ``test_type`` is null on the total row."""
    agg = scored.rollup("test_type").agg(F.count(F.lit(1)).alias("total"),
                                         F.count_if("success").alias("passed"))
    return agg.select("test_type", "total", "passed", (F.col("total") - F.col("passed")).alias("failed"),
                      F.when(F.col("total") > 0, F.round(F.col("passed") * 100.0 / F.col("total"), 1))
                      .alias("success_rate"))


def failures(scored: DataFrame) -> DataFrame:
    """The failed tests (H2); a test whose success is unknown has failed."""
    return scored.filter(~F.coalesce("success", F.lit(False))).select("test_name", "test_type", "score", "explanation")


def all_passed(scored: DataFrame) -> DataFrame:
    """(test_type, all_passed), and a row of null type for the whole run,
    which has passed if there are no tests (H2)."""
    ok = F.coalesce("success", F.lit(False))
    by_type = scored.groupBy("test_type").agg(F.bool_and(ok).alias("all_passed"))
    total = scored.agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("all_passed"))
    return by_type.unionByName(total.select(F.lit(None).cast("string").alias("test_type"), "all_passed"))


def case_violations(cases: DataFrame) -> DataFrame:
    """Test cases that are not valid (B7): no prompt, or neither an expected
    response nor an expected repository. Columns: name, has_prompt,
    expected_response, has_expected_repo, skip."""
    has_expected = F.coalesce(F.length("expected_response"), F.lit(0)) > 0
    problem = (F.when(~F.col("has_prompt"), F.lit("missing prompt"))
               .when(~has_expected & ~F.col("has_expected_repo"), F.lit("missing expected repo")))
    return cases.filter(~F.col("skip")).select("name", problem.alias("problem")).filter(F.col("problem").isNotNull())


def runnable_cases(cases: DataFrame) -> DataFrame:
    """Cases to run: skipped ones out; any invalid case is an error."""
    bad = case_violations(cases)
    first = bad.first()
    if first is not None:
        raise ValueError(f"Invalid test case {first['name']}: {first['problem']}")
    return cases.filter(~F.col("skip")).withColumn(
        "test_type", F.when(F.coalesce(F.length("expected_response"), F.lit(0)) > 0, F.lit("simple"))
        .when(F.col("has_expected_repo"), F.lit("integration")).otherwise(F.lit("simple")))
