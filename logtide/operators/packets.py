"""Label-free review packets, offline review and its evaluation."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reviews import leaked, parse

SCORES = ("template_burst_score", "template_count_deviation_score", "novelty_score", "rarity_score")


def event_packets(top: DataFrame, dataset: str, method: str) -> DataFrame:
    """One packet a ranked event, without any label."""
    out = top.select(
        F.format_string(f"{dataset}:{method}:%06d:event:%d", F.col("rank"), F.col("event_id")).alias("packet_id"), F.lit("event_packet_v1").alias("schema_version"), F.col("rank").alias("selection_rank"), "event_id", "event_order", "block_id", "template", "message",
        F.struct(*SCORES).alias("scores"),
    )
    return guarded(out)


def template_packets(top: DataFrame, dataset: str, method: str, representatives: int = 4, limit: int = 200) -> DataFrame:
    """One packet a template of the ranked events: counts, score range, members and first and last representatives."""
    up, down = Window.partitionBy("template").orderBy("rank"), Window.partitionBy("template").orderBy(F.desc("rank"))
    x = top.withColumn("_up", F.row_number().over(up)).withColumn("_down", F.row_number().over(down))
    head = representatives // 2
    pick = (F.col("_up") <= head) | (F.col("_down") <= representatives - head)
    packs = x.groupBy("template").agg(
        F.count("*").alias("num_events"), F.countDistinct("block_id").alias("num_blocks"), F.min("rank").alias("best_rank"), F.struct(F.min("template_burst_score").alias("min"), F.avg("template_burst_score").alias("mean"), F.max("template_burst_score").alias("max")).alias("burst"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))), lambda e: e["event_id"]).alias("member_event_ids"),
        F.array_sort(F.collect_list(F.when(pick, F.struct("rank", "event_id", "message")))).alias("representatives"),
    )
    out = packs.orderBy("best_rank", F.desc("num_events"), F.desc("burst.max"), "template").limit(limit)
    return guarded(out.withColumn("packet_id", F.format_string(f"{dataset}:{method}:template:%06d", F.col("best_rank"))))


def guarded(packets: DataFrame) -> DataFrame:
    if bad := leaked(packets.schema):
        raise ValueError(f"label leak: {', '.join(bad)}")
    return packets


def render(packets: DataFrame, template: str) -> DataFrame:
    """``packet_id, prompt, request_sha256``."""
    body = F.to_json(F.struct(*sorted(packets.columns)))
    out = packets.select("packet_id", F.replace(F.lit(template), F.lit("{{PACKET_JSON}}"), body).alias("prompt"))
    return out.withColumn("request_sha256", F.sha2("prompt", 256))


def dry_run(prompt: str) -> str:
    return ""


def offline_reviewer(prompt: str) -> str:
    """A deterministic stand-in for a model: judges by words of failure in the prompt."""
    raw = prompt[prompt.find("{") :]
    packet = json.loads(raw[: raw.rfind("}") + 1])
    bad = any(w in prompt.lower() for w in ("error", "fail", "fatal"))
    answer = {"packet_id": packet["packet_id"], "review_decision": "likely_anomaly" if bad else "likely_normal", "severity": "medium" if bad else "low", "confidence": 0.8, "recommended_action": "inspect_event" if bad else "ignore"}
    answer |= {"reason_codes": ["sequence_context" if bad else "benign_repetition"], "rationale": "judged by words", "suspicious_evidence": [], "benign_evidence": [], "needs_more_context": False}
    return json.dumps(answer)


def review(prompts: DataFrame, reviewer: Callable[[str], str] = dry_run, cache: DataFrame | None = None) -> DataFrame:
    """Ask the reviewer about prompts not in ``cache`` (by request hash), one partition a caller; answers are checked."""
    todo = prompts.join(cache.select("request_sha256"), "request_sha256", "left_anti") if cache is not None else prompts

    def run(it):
        for pdf in it:
            rows = []
            for r in pdf.itertuples():
                answer, wrong = parse(reviewer(r.prompt), r.packet_id)
                answer = answer or {}
                rows.append((r.packet_id, r.request_sha256, not wrong, answer.get("review_decision"), answer.get("recommended_action"), answer.get("confidence"), answer.get("triage_score"), wrong))
            yield pd.DataFrame(rows, columns=["packet_id", "request_sha256", "valid_json", "review_decision", "recommended_action", "confidence", "triage_score", "errors"])

    fresh = todo.mapInPandas(run, "packet_id string, request_sha256 string, valid_json boolean, review_decision string, recommended_action string, confidence double, triage_score double, errors array<string>")
    return fresh.unionByName(cache.select(*fresh.columns)) if cache is not None else fresh


def policy_summary(reviews: DataFrame, labels: DataFrame, total: int, ks: tuple[int, ...] = (10, 50)) -> DataFrame:
    """Three decision policies and the top-k by triage score, against labels joined only here.

    ``reviews(packet_id, event_id, selection_rank, review_decision, recommended_action, triage_score, confidence)``.
    """
    x = reviews.join(labels.select("event_id", "label").dropDuplicates(["event_id"]), "event_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    flags = {"likely_anomaly": F.col("review_decision") == "likely_anomaly", "inspect_action": F.startswith(F.coalesce("recommended_action", F.lit("")), F.lit("inspect")), "uncertain_or_anomaly": F.col("review_decision").isin("likely_anomaly", "uncertain")}
    ranked = x.withColumn("_r", F.row_number().over(Window.orderBy(F.desc_nulls_last("triage_score"), F.desc_nulls_last("confidence"), "selection_rank", "event_id")))
    parts = [ranked.where(c).withColumn("policy", F.lit(n)) for n, c in flags.items()] + [ranked.where(F.col("_r") <= k).withColumn("policy", F.lit(f"triage_score_top{k}")) for k in ks]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    out = both.groupBy("policy").agg(F.count("*").alias("selected"), F.count_if(F.col("label") == 1).alias("positives"))
    return out.withColumn("precision", F.col("positives") / F.col("selected")).withColumn("recall", F.try_divide(F.col("positives"), F.nullif(F.lit(total), F.lit(0))))


def members_of(reviews: DataFrame, packets: DataFrame) -> DataFrame:
    """Cluster reviews spread over their members, with each member's place."""
    return reviews.join(packets.select("packet_id", "member_event_ids"), "packet_id").select("*", F.posexplode("member_event_ids").alias("member_rank", "event_id")).drop("member_event_ids")
