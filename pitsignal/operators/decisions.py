"""Recorded decisions: parsing that fails closed, normalisation, agreement and repeatability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitsignal.functions.text import canonical_json, json_ascii, redact_json, sha256_hex

# fixed values: the decision vocabulary
ACTIONS = ("continuation", "reversion", "abstain")
DRIVERS = ("crypto_cross_market", "company_specific", "macro", "unclear")
KEYS = ("action", "confidence", "driver", "idiosyncratic_news_detected", "reason")
MAX_REASON = 600
_TRUE = ("true", "1", "yes", "on", "t", "y")
_FALSE = ("false", "0", "no", "off", "f", "n")


def parse_decisions(replies: DataFrame, content: str = "content") -> DataFrame:
    """Add the decision columns of a recorded reply and the failure code, null when it is valid.

    Whatever cannot be read abstains with confidence 0: no text, no JSON, another key set, or a
    value outside its range. A detected idiosyncratic event forces abstain / company_specific.
    """
    text = F.col(content)
    doc = F.try_parse_json(text)
    keys = F.array_sort(F.array_distinct(F.json_object_keys(text)))
    field = lambda name: F.try_variant_get(F.col("_doc"), f"$.{name}", "string")
    kind = lambda name: F.schema_of_variant(F.variant_get(F.col("_doc"), f"$.{name}", "variant"))
    parsed = replies.withColumn("_doc", doc).withColumn("_keys", keys)
    shaped = F.col("_keys") == F.array(*[F.lit(k) for k in sorted(KEYS)])
    number = F.coalesce(field("confidence").try_cast("double"), F.when(field("confidence") == "true", 1.0).when(field("confidence") == "false", 0.0))
    flag_text = F.lower(field("idiosyncratic_news_detected"))
    flag = F.when(flag_text.isin(*_TRUE), True).when(flag_text.isin(*_FALSE), False)
    reason = field("reason")
    fits = (
        field("action").isin(*ACTIONS)
        & field("driver").isin(*DRIVERS)
        & number.between(0.0, 1.0)
        & flag.isNotNull()
        & (kind("reason") == "STRING")
        & F.char_length(reason).between(1, MAX_REASON)
    )
    code = (
        F.when(text.isNull(), "non_text_response")
        .when(F.col("_doc").isNull(), "malformed_json")
        .when(~F.coalesce(shaped, F.lit(False)), "invalid_response_shape")
        .when(~F.coalesce(fits, F.lit(False)), "schema_validation")
    )
    ok = F.col("failure_code").isNull()
    read = parsed.withColumn("failure_code", code).withColumns(
        {
            "action": F.when(ok, field("action")).otherwise("abstain"),
            "confidence": F.when(ok, number).otherwise(0.0),
            "idiosyncratic_news_detected": F.when(ok, flag).otherwise(False),
            "driver": F.when(ok, field("driver")).otherwise("unclear"),
            "reason": F.when(ok, reason).otherwise(F.concat(F.lit("fail_closed:"), F.col("failure_code"))),
        }
    )
    return normalize_decisions(read.drop("_doc", "_keys"))


def normalize_decisions(decisions: DataFrame) -> DataFrame:
    news = F.col("idiosyncratic_news_detected")
    return decisions.withColumns(
        {
            "action": F.when(news, "abstain").otherwise(F.col("action")),
            "driver": F.when(news, "company_specific").otherwise(F.col("driver")),
        }
    )


def agreement(observer: DataFrame, authoritative: DataFrame, key: str) -> DataFrame:
    """Observer against authoritative decision per episode; null agreement for an invalid observer."""
    names = ("action", "driver", "idiosyncratic_news_detected")
    theirs = authoritative.select(key, *[F.col(n).alias(f"_a_{n}") for n in names])
    valid = F.col("failure_code").isNull()
    same = lambda n: F.when(valid, F.col(n).eqNullSafe(F.col(f"_a_{n}")))
    return observer.join(theirs, key).select(
        key,
        F.when(valid, "ok").otherwise("invalid").alias("status"),
        same("action").alias("action_agreement"),
        same("driver").alias("driver_agreement"),
        same("idiosyncratic_news_detected").alias("idiosyncratic_news_agreement"),
        F.when(valid, "observed").otherwise(F.col("failure_code")).alias("reason"),
    )


def _counts(column: str, values: Sequence[str]) -> dict[str, Column]:
    return {v: F.count(F.when(F.col(column) == v, 1)) for v in values}


def decision_profile(
    decisions: DataFrame, keys: Sequence[str], *, expected_action: str | None = None, expected_idiosyncratic: bool | None = None
) -> DataFrame:
    """Repeatability of the decisions of each scenario.

    The vocabularies are fixed, so counts are conditional measures of one hash aggregation and a
    scenario with any number of repeats stays one row per task before the shuffle. Distinct
    reasons are exact: copies collapse in their own aggregation.
    """
    keys = list(keys)
    n = F.count(F.lit(1))
    actions, drivers = _counts("action", ACTIONS), _counts("driver", DRIVERS)
    flag = F.col("idiosyncratic_news_detected")
    flags = {"false": F.count(F.when(~flag, 1)), "true": F.count(F.when(flag, 1))}
    failed = F.count(F.when((F.col("action") == "abstain") & F.col("reason").startswith("fail_closed:"), 1))

    def as_map(counts: dict[str, Column], keep_zero: bool) -> Column:
        full = F.map_from_entries(F.array(*[F.struct(F.lit(k), counts[k]) for k in sorted(counts)]))
        return full if keep_zero else F.map_filter(full, lambda _, v: v > 0)

    share = lambda counts: F.greatest(*counts.values()) / n
    expected_action_rate = F.lit(None).cast("double") if expected_action is None else F.count(F.when(F.col("action") == expected_action, 1)) / n
    expected_flag_rate = (
        F.lit(None).cast("double") if expected_idiosyncratic is None else F.count(F.when(flag == expected_idiosyncratic, 1)) / n
    )
    profile = decisions.groupBy(*keys).agg(
        n.alias("count"),
        as_map(actions, False).alias("actions"),
        as_map(drivers, False).alias("drivers"),
        as_map(flags, True).alias("idiosyncratic_news_detected"),
        share(actions).alias("action_consistency"),
        share(drivers).alias("driver_consistency"),
        share(flags).alias("idiosyncratic_consistency"),
        failed.alias("fail_closed_count"),
        (failed / n).alias("fail_closed_rate"),
        F.min("confidence").alias("confidence_min"),
        F.avg("confidence").alias("confidence_mean"),
        F.max("confidence").alias("confidence_max"),
        expected_action_rate.alias("expected_action_rate"),
        expected_flag_rate.alias("expected_idiosyncratic_rate"),
    )
    reasons = decisions.select(*keys, "reason").distinct().groupBy(*keys).agg(F.count("reason").alias("unique_reason_count"))
    return profile.join(reasons, keys)


def tool_evidence(calls: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Audit row per recorded tool call: redacted arguments, success, error code, result digest.

    Expects episode_id, call_no, tool, arguments_json, result_json (null when the call failed).
    """
    permitted = F.col("tool").isin(list(allowed))
    result = canonical_json(F.col("result_json"))
    success = permitted & result.isNotNull()
    return calls.select(
        "episode_id",
        "call_no",
        "tool",
        redact_json(F.col("arguments_json")).alias("arguments_json"),
        success.alias("success"),
        F.when(~permitted, "tool_not_allowed").when(~success, "tool_failure").alias("error_code"),
        F.when(success, sha256_hex(result)).otherwise("").alias("result_sha256"),
    )


def evidence_complete(evidence: DataFrame, episodes: DataFrame) -> DataFrame:
    """Complete only when there is a call and every call succeeded."""
    summary = evidence.groupBy("episode_id").agg(F.bool_and("success").alias("_all"))
    return episodes.select("episode_id").join(summary, "episode_id", "left").select(
        "episode_id", F.coalesce("_all", F.lit(False)).alias("complete")
    )


def context_digest(items: DataFrame, keys: Sequence[str], order: str, content: str, *, limit: int = 1600) -> DataFrame:
    """JSON array of the items in order, cut to `limit` characters.

    An item takes two characters at least (its own and a separator), so items past half the limit
    cannot show; the rank filter is applied before the shuffle and only that many are collected.
    """
    keys = list(keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    as_list = F.to_json(F.array(content))
    quoted = as_list.substr(F.lit(2), F.char_length(as_list) - 2)
    # content that is JSON stays JSON, other text becomes a JSON string; the cut of one item keeps
    # whole what the overall cut can still show
    head = F.substring(json_ascii(F.coalesce(F.to_json(F.try_parse_json(content)), quoted)), 1, limit)
    few = items.withColumn("_rank", rank).where(F.col("_rank") <= limit // 2 + 1).select(*keys, "_rank", head.alias("_text"))
    joined = few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_rank", "_text"))).alias("_items"))
    body = F.concat(F.lit("["), F.array_join(F.transform("_items", lambda e: e["_text"]), ","), F.lit("]"))
    return joined.select(*keys, F.substring(body, 1, limit).alias("digest"))


def tool_digest(calls: DataFrame, tool: str, *, limit: int = 1600) -> DataFrame:
    """Digest of the results of one tool per episode: its successful calls in order, keys sorted.

    Expects episode_id, call_no, tool, result_json; a call without a readable result has failed and is
    left out, and an episode without a successful call has no row.
    """
    found = calls.where(F.col("tool") == tool).withColumn("_result", canonical_json(F.col("result_json"))).where(F.col("_result").isNotNull())
    return context_digest(found, ["episode_id"], "call_no", "_result", limit=limit)
