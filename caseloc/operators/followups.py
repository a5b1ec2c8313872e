"""Rounds of tool requests: what the observations of one round ask for in the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import kept

# Fixed values: (tool that was run, what its observation must show, tool to run, priority, reason).
RULES = (
    ("playground_decoder", "requires_browser", "browser_reproduction_reader", "high", "second_round_browser_read_after_playground_decoder_identified_live_reproduction"),
    ("web_snapshot_fetcher", "doc_kind = 'api_or_docs'", "web_doc_reader", "medium", "second_round_docs_reader_after_snapshot_identified_api_or_docs_page"),
    ("browser_reproduction_reader", "NOT success", "web_snapshot_fetcher", "medium", "second_round_fallback_snapshot_after_browser_reader_failed"),
    ("vlm_image_inspector", "NOT success", "vlm_image_inspector", "low", "second_round_retry_failed_image_observation"),
)


def followup_requests(observations: DataFrame, history: DataFrame) -> DataFrame:
    """(instance_id, tool, source, priority, reason): requests that observations
    (instance_id, tool, source, success, requires_browser, doc_kind) ask for, without
    those of the history (instance_id, tool, source); each once, by the first rule."""
    asked = F.array_compact(
        F.array(*[F.when((F.col("tool") == ran) & F.expr(f"coalesce({test}, false)"), F.struct(F.lit(n).alias("n"), F.lit(tool).alias("next"), F.lit(priority).alias("priority"), F.lit(reason).alias("reason"))) for n, (ran, test, tool, priority, reason) in enumerate(RULES)])
    )
    each = observations.select("instance_id", "source", F.inline(asked)).withColumnRenamed("next", "tool")
    once = each.groupBy("instance_id", "tool", "source").agg(F.min_by(F.struct("priority", "reason"), "n").alias("x")).select("instance_id", "tool", "source", "x.*")
    return once.join(history.select("instance_id", "tool", "source").distinct(), ["instance_id", "tool", "source"], "left_anti")


def tool_rounds(planned: DataFrame, outcomes: DataFrame, max_rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(requests, stops) of planned requests (instance_id, tool, source).

    outcomes (instance_id, tool, source, success, requires_browser, doc_kind) say what
    a request observes; one without an outcome fails. A round runs the requests of all
    instances that the round before has asked for; what was ever asked for is the
    history, so each is run once and rounds only see what is new. requests
    (instance_id, round_id, tool, source, success); stops (instance_id, rounds,
    reason, confidence): an instance ends when nothing new is asked for or the rounds
    are over.
    """
    keys = ["instance_id", "tool", "source"]
    now = planned.select(*keys).distinct()
    history, done, stops = None, None, None
    for turn in range(1, max_rounds + 1):
        seen = now.join(outcomes.dropDuplicates(keys), keys, "left").na.fill(False, ["success", "requires_browser"])
        seen = kept(seen.withColumn("round_id", F.lit(turn)), "observations")
        history = seen.select(*keys) if history is None else history.unionByName(seen.select(*keys))
        shown = seen.select("instance_id", "round_id", "tool", "source", "success")
        done = shown if done is None else done.unionByName(shown)
        now = kept(followup_requests(seen, history), "followups")
        goes_on = now.select("instance_id").distinct().withColumn("more", F.lit(True))
        ended = seen.groupBy("instance_id").agg(F.max("success").alias("any")).join(goes_on, "instance_id", "left")
        last = F.lit(turn == max_rounds)
        reason = F.when(last, "max_tool_rounds_reached").when(F.col("any"), "successful_observations_and_no_new_followups").otherwise("no_successful_observations_and_no_fallback_available")
        sure = F.when(last, 0.6).when(F.col("any"), 0.7).otherwise(0.45)
        stop = ended.where(last | F.col("more").isNull()).select("instance_id", F.lit(turn).alias("rounds"), reason.alias("reason"), sure.alias("confidence"))
        stops = stop if stops is None else stops.unionByName(stop)
        now = now.select(*keys)
    return done, stops
