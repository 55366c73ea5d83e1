"""Per-source policies and the audit log (announced for the original, not in its code)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from maskwright.functions.expr import computed_once, free_for, lit
from maskwright.functions.keyed import hmac_sha256
from maskwright.operators.detect import rule_plan
from maskwright.operators.report import findings
from maskwright.operators.redact import apply_replacements
from maskwright.operators.resolve import resolved_spans
from maskwright.plans.sanitize import Rules, with_candidates
from maskwright.rules import ALWAYS_ON, PROFILES, RuleSet

def sanitize_by_policy(df: DataFrame, text_col: str, source_col: str, policies: DataFrame,
                       rules: Rules = None) -> DataFrame:
    """Mask each row by its source's policy ``(source, profile, min_confidence)``.

    A policy allows the categories of its profile (NULL profile: all) above its threshold; other rules
    do not run on the row. Sources without a policy get every rule. Two policies for one source are an
    error.
    """
    twice = [r[0] for r in policies.groupBy("source").count().where("count > 1").limit(5).collect()]
    if twice:
        raise ValueError(f"more than one policy for {', '.join(map(str, twice))}")
    free_for(df, "spans", "clean_text")
    named = policies.select(F.col("source").alias("_mw_source"), F.lower("profile").alias("_mw_profile"),
                            F.col("min_confidence").alias("_mw_floor"))
    allowed = ", ".join(f"{lit(p)}, array({', '.join(lit(c) for c in (*cs, *ALWAYS_ON))})"
                        for p, cs in PROFILES.items())

    def permits(confidence: str, category: str) -> str:
        return f"""({confidence} >= coalesce(_mw_floor, 0.0D) AND (_mw_profile IS NULL OR array_contains(
            coalesce(element_at(map({allowed}), _mw_profile), array(raise_error(
                concat('Unknown profile: ', _mw_profile)))), {category})))"""

    jvm, *_ = rule_plan(RuleSet.of(rules))
    table = ", ".join(f"named_struct('k', {k}, 'conf', {float(r.confidence)!r}D, 'cat', {lit(r.category)})"
                      for k, (_, r) in enumerate(jvm, 1))
    open_to = f"transform(filter(array({table}), v_r -> {permits('v_r.conf', 'v_r.cat')}), v_r -> v_r.k)" if jvm else None
    if open_to:  # once per policy, not per text
        named = named.withColumn("_mw_allowed", F.expr(open_to))
        open_to = f"coalesce(_mw_allowed, sequence(1, {len(jvm)}))"
    joined = df.join(named, F.col(source_col) == F.col("_mw_source"), "left").drop("_mw_source")
    found = with_candidates(joined, text_col, rules, into="_mw_candidates", allowed=open_to)
    keep = f"filter(_mw_candidates, v_c -> {permits('-v_c.nc', 'v_c.cat')})"
    return (computed_once(found, "spans", resolved_spans(keep))
            .drop("_mw_candidates", "_mw_profile", "_mw_floor", "_mw_allowed")
            .withColumn("clean_text", apply_replacements(text_col)))


def audit_log(df: DataFrame, keys: list[str], spans_col: str = "spans", key: bytes | None = None) -> DataFrame:
    """What was masked where, with a hash instead of the value: fit to append to a log table.

    With a ``key`` the hash is an HMAC (``original_hmac``). Without it it is a plain SHA-256 (``original_sha256``), from which values with
    few possibilities, such as phone numbers, can be found by trying: then the log is as secret as the values.
    """
    if key is None:
        return findings(df, keys, spans_col, hash_original=True)
    return findings(df, keys, spans_col).select(*keys, "start", "end", hmac_sha256(F.col("original"), key).alias("original_hmac"),
                                                "replacement", "category", "label", "confidence")


_DIGITS = 4  # hex digits of a row's hash that name its bucket


def audit_buckets(log: DataFrame, by: list[str]) -> DataFrame:
    """(by..., bucket, n, digest): rows of a log by the first digits of their hashes, each bucket with a digest of its sorted hashes.

    Rows are hashed in place, so 65,536 buckets share the rows of a batch evenly, whatever they hold. Of two logs that should be equal, the buckets that
    differ tell where a row is missing, added or changed.
    """
    columns = sorted(c for c in log.columns if c not in by)
    leaf = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    hashed = log.select(*by, leaf.alias("leaf")).withColumn("bucket", F.substring("leaf", 1, _DIGITS))
    return hashed.groupBy(*by, "bucket").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("leaf")), ""), 256).alias("digest"))


def audit_roots(buckets: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, root): one digest per batch over all its rows, from the digests of its buckets, by way of 256 groups of them."""
    def combined(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        listed = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "bucket", F.col("n").cast("string"), "digest"))), ",")
        return rows.groupBy(*by, *keys).agg(F.sum("n").alias("n"), F.sha2(listed, 256).alias(name))

    groups = combined(buckets.withColumn("group", F.substring("bucket", 1, _DIGITS // 2)), ["group"], "digest")
    return combined(groups.withColumnRenamed("group", "bucket"), [], "root")
