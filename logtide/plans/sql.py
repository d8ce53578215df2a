"""The queries' results as DuckDB SQL."""

from __future__ import annotations

_CONTEXT = (
    "prev_event_novelty_score next_event_novelty_score neighbor_max_novelty_score neighbor_mean_novelty_score local_unseen_count_radius2 local_new_template_count_radius2 local_template_switch_count_radius2 "
    "prev_template_same next_template_same relative_position_in_window distance_to_window_edge_ratio local_sequence_context_score"
).split()
_PARTS: dict[str, tuple[str, str]] = {
    "logs": ("", """SELECT event_id AS event_order, event_id, ts, concat(event_type, ' user ', user_id, ' value ', CAST(value AS DECIMAL(18,2)), ' props ', props) AS message,
      CASE WHEN event_type = 'error' AND value >= 200 THEN 1 ELSE 0 END AS label, concat(event_type, ' k', CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 10, ' v', CAST(floor(value / 20) AS BIGINT)) AS template, event_id // 1000 AS block_id FROM events"""),
    "cut": ("logs", "SELECT count(*) AS total, greatest(1, CAST(floor(count(*) * 0.3) AS BIGINT)) AS cut FROM logs"),
    "history": ("cut", "SELECT logs.* FROM logs, cut WHERE event_order < cut"),
    "raw_stream": ("cut", "SELECT logs.*, event_order - cut AS i, total - cut AS n FROM logs, cut WHERE event_order >= cut"),
    "counts": ("history", "SELECT template, count(*) AS c FROM history GROUP BY template"),
    "firsts": ("logs", "SELECT template, min(event_order) AS f FROM logs GROUP BY template"),
    "stream": ("raw_stream counts firsts", """SELECT s.*, coalesce(c.c, 0) AS historical_count, coalesce(c.c, 0) = 0 AS unseen, coalesce(c.c, 0) <= 2 AS rare, s.event_order = f.f AS is_new, 1.0::DOUBLE / (coalesce(c.c, 0) + 1) AS rarity_score,
      1.0::DOUBLE / (coalesce(c.c, 0) + 1) + (coalesce(c.c, 0) = 0)::INT + 0.75 * (s.event_order = f.f)::INT + 0.25 * (coalesce(c.c, 0) <= 2)::INT AS novelty_score
      FROM raw_stream s LEFT JOIN counts c USING (template) LEFT JOIN firsts f USING (template)"""),
    "starts": ("raw_stream", "SELECT w AS window_id, w * 50 AS lo FROM (SELECT max(n) AS n FROM raw_stream), range(0, 1000000) r(w) WHERE w * 50 + 100 <= n UNION ALL SELECT (n - 100) // 50 + 1, n - 100 FROM (SELECT max(n) AS n FROM raw_stream) WHERE ((n - 100) // 50) * 50 + 100 < n"),
    "members": ("stream starts", "SELECT window_id, s.* FROM stream s JOIN starts ON i >= lo AND i < lo + 100"),
    "per": ("members", "SELECT window_id, template, count(*) AS c FROM members GROUP BY ALL"),
    "clusters": ("per", "SELECT window_id, count(*) AS u, max(c) AS mx, avg(c) AS mean, sum(c) AS n, -sum(c * 1.0 / t * log2(c * 1.0 / t)) AS ent FROM (SELECT *, sum(c) OVER (PARTITION BY window_id) AS t FROM per) GROUP BY window_id"),
    "features": ("members clusters", """SELECT window_id, CAST(any_value(k.n) AS BIGINT) AS num_records, any_value(k.u) AS unique_templates, any_value(k.u) * 1.0::DOUBLE / count(*) AS unique_template_ratio, any_value(k.ent) AS template_entropy, any_value(k.mx) AS max_cluster_size, any_value(k.mean) AS mean_cluster_size, any_value(k.mx) * 1.0::DOUBLE / count(*) AS max_cluster_ratio,
      CAST(count_if(is_new) AS BIGINT) AS new_template_count, count_if(is_new) * 1.0::DOUBLE / count(*) AS new_template_ratio, CAST(count_if(rare) AS BIGINT) AS rare_template_count, count_if(rare) * 1.0::DOUBLE / count(*) AS rare_template_ratio, CAST(count_if(unseen) AS BIGINT) AS unseen_template_count, count_if(unseen) * 1.0::DOUBLE / count(*) AS unseen_template_ratio,
      max(novelty_score) AS max_novelty_score, avg(novelty_score) AS mean_novelty_score, var_pop(novelty_score) AS var_novelty_score, max(rarity_score) AS max_rarity_score, avg(rarity_score) AS mean_rarity_score, var_pop(rarity_score) AS var_rarity_score,
      min(event_order) AS first_order, max(event_order) AS last_order, count(label) AS num_labeled, CAST(count_if(label = 1) AS BIGINT) AS num_anomalous, CAST(max(label) AS BIGINT) AS window_label,
      (any_value(k.mx) + any_value(k.u) + count_if(rare) + count_if(is_new)) * 1.0::DOUBLE / count(*) AS novelty_magnitude_score FROM members JOIN clusters k USING (window_id) GROUP BY window_id"""),
    "long": ("features", "SELECT window_id, statistic, value, window_label, num_anomalous FROM (SELECT window_id, window_label, num_anomalous, CAST(unique_templates AS DOUBLE) AS unique_templates, template_entropy, rare_template_ratio, unseen_template_ratio FROM features) UNPIVOT (value FOR statistic IN (unique_templates, template_entropy, rare_template_ratio, unseen_template_ratio))"),
    "moments": ("long", """SELECT statistic, n, b0 AS l1, 2 * b1 - b0 AS l2, (6 * b2 - 6 * b1 + b0) / (2 * b1 - b0) AS t3 FROM (SELECT statistic, count(*) AS n, avg(value) AS b0, sum((r - 1) * value) / (count(*) * (count(*) - 1.0::DOUBLE)) AS b1, sum((r - 1) * (r - 2) * value) / (count(*) * (count(*) - 1.0::DOUBLE) * (count(*) - 2)) AS b2
      FROM (SELECT *, row_number() OVER (PARTITION BY statistic ORDER BY value) AS r FROM long) GROUP BY statistic)"""),
    "shapes": ("moments", """SELECT *, CASE WHEN t3 > 0 THEN (-1 + (1 - t3) * (1.59921491 + (1 - t3) * (-0.48832213 + 0.01573152 * (1 - t3)))) / (1 + (1 - t3) * (-0.64363929 + 0.08985247 * (1 - t3)))
      ELSE (0.28377530 + t3 * (-1.21096399 + t3 * (-2.50728214 + t3 * (-1.13455566 - 0.07138022 * t3)))) / (1 + t3 * (2.06189696 + t3 * (1.31912239 + 0.25077104 * t3))) END AS k FROM moments"""),
    "fits": ("shapes", "SELECT *, l1 - scale * (1 - gamma(1 + k)) / k + scale / k * (1 - pow(-ln(0.9), k)) AS threshold FROM (SELECT *, l2 * k / (gamma(1 + k) * (1 - pow(2, -k))) AS scale FROM shapes)"),
    "scores": ("long fits", "SELECT window_id, statistic, value, threshold, value > threshold AS is_suspicious, window_label, num_anomalous FROM long JOIN fits USING (statistic)"),
    "flagged": ("scores", "SELECT window_id, bool_or(is_suspicious) AS is_suspicious, CAST(count_if(is_suspicious) AS BIGINT) AS num_triggered, coalesce(string_agg(CASE WHEN is_suspicious THEN statistic END, ',' ORDER BY statistic), '') AS triggered, max(value - threshold) AS max_excess, max(window_label) AS window_label FROM scores GROUP BY window_id"),
    "bursts": ("members", "SELECT * EXCLUDE (o, island), CASE WHEN o = 1 THEN sum(o) OVER (PARTITION BY window_id, island) ELSE 0 END AS burst FROM (SELECT *, sum(1 - o) OVER (PARTITION BY window_id ORDER BY event_order) AS island FROM (SELECT *, (unseen OR is_new)::INT AS o FROM members))"),
    "deviations": ("per", """SELECT window_id, template, c AS cnt, seen_windows, coalesce(m, 0) AS past_mean, coalesce(s, 0) AS past_std, CASE WHEN seen_windows > 0 AND coalesce(s, 0) > 1e-12 THEN (c - m) / s ELSE 0 END AS past_z, CASE WHEN seen_windows > 0 THEN c / (m + 1) ELSE c END AS ratio, CASE WHEN seen_windows > 0 THEN c - m ELSE c END AS excess FROM (SELECT window_id, template, c, count(*) OVER w AS seen_windows, avg(c) OVER w AS m, stddev_pop(c) OVER w AS s FROM per WINDOW w AS (PARTITION BY template ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""),
    "deviated": ("deviations", "SELECT *, CASE WHEN seen_windows > 0 THEN greatest(0, past_z) + ln(1 + greatest(0, ratio)) ELSE ln(1 + cnt) END AS deviation_score FROM deviations"),
    "ctx": ("members", """SELECT *, neighbor_max_novelty_score + local_unseen_count_radius2 + local_new_template_count_radius2 + local_template_switch_count_radius2 + 1 - greatest(prev_template_same, next_template_same) AS local_sequence_context_score
      FROM (SELECT window_id, event_id, event_order, template, coalesce(lag(novelty_score) OVER w, 0) AS prev_event_novelty_score, coalesce(lead(novelty_score) OVER w, 0) AS next_event_novelty_score,
      coalesce(list_max(list_filter([lag(novelty_score, 1) OVER w, lag(novelty_score, 2) OVER w, lead(novelty_score, 1) OVER w, lead(novelty_score, 2) OVER w], lambda x: x IS NOT NULL)), 0) AS neighbor_max_novelty_score,
      CASE WHEN count(*) OVER c > 1 THEN (coalesce(lag(novelty_score, 2) OVER w, 0) + coalesce(lag(novelty_score, 1) OVER w, 0) + coalesce(lead(novelty_score, 1) OVER w, 0) + coalesce(lead(novelty_score, 2) OVER w, 0)) / (count(*) OVER c - 1) ELSE 0 END AS neighbor_mean_novelty_score,
      CAST(count_if(unseen) OVER c AS BIGINT) AS local_unseen_count_radius2, CAST(count_if(is_new) OVER c AS BIGINT) AS local_new_template_count_radius2,
      CAST(sum(sw) OVER (w ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS local_template_switch_count_radius2, CAST(coalesce((lag(template) OVER w = template)::INT, 0) AS BIGINT) AS prev_template_same, CAST(coalesce((lead(template) OVER w = template)::INT, 0) AS BIGINT) AS next_template_same,
      CASE WHEN k > 1 THEN p * 1.0::DOUBLE / (k - 1) ELSE 0 END AS relative_position_in_window, CASE WHEN k > 1 THEN least(p, k - 1 - p) / ((k - 1) / 2.0::DOUBLE) ELSE 0 END AS distance_to_window_edge_ratio
      FROM (SELECT *, CASE WHEN lag(template) OVER (PARTITION BY window_id ORDER BY event_order) <> template THEN 1 ELSE 0 END AS sw, row_number() OVER (PARTITION BY window_id ORDER BY event_order) - 1 AS p, count(*) OVER (PARTITION BY window_id) AS k FROM members)
      WINDOW w AS (PARTITION BY window_id ORDER BY event_order), c AS (PARTITION BY window_id ORDER BY event_order ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""),
    "ctx_flagged": ("ctx flagged features scores", """SELECT c.* EXCLUDE (event_order, template), f.max_excess, g.max_score, t.num_records, t.template_entropy, t.rare_template_ratio, t.unseen_template_ratio, t.new_template_ratio, t.mean_novelty_score
      FROM ctx c JOIN flagged f USING (window_id) JOIN features t USING (window_id) JOIN (SELECT window_id, max(value) AS max_score FROM scores GROUP BY window_id) g USING (window_id) WHERE f.is_suspicious"""),
    "cands": ("ctx_flagged bursts deviated", "SELECT m.event_id, any_value(m.event_order) AS event_order, any_value(m.block_id) AS block_id, CAST(max(m.label) AS BIGINT) AS label, any_value(m.template) AS template, any_value(m.message) AS message, count(*) AS suspicious_window_count, "
      + ", ".join(f"greatest(0, max(CAST({c} AS DOUBLE))) AS {name}" for c, name in {
        "novelty_score": "novelty_score", "rarity_score": "rarity_score", "ln(1 + historical_count)": "historical_count_log", "unseen::INT": "unseen_in_history", "rare::INT": "historically_rare", "is_new::INT": "is_new_template", "burst": "template_burst_score",
        **{f"c.{n}": n for n in _CONTEXT}, "c.max_score": "max_window_gev_score", "c.max_excess": "max_window_gev_excess", "c.template_entropy": "max_window_template_entropy", "c.rare_template_ratio": "max_window_rare_template_ratio", "c.unseen_template_ratio": "max_window_unseen_template_ratio",
        "c.new_template_ratio": "max_window_new_template_ratio", "c.mean_novelty_score": "max_window_mean_event_novelty_score", "cnt": "max_template_count_in_window", "cnt / c.num_records": "max_template_ratio_in_window", "past_mean": "template_count_past_mean", "past_std": "template_count_past_std",
        "past_z": "template_count_past_z", "ratio": "template_count_past_ratio", "excess": "template_count_past_excess", "seen_windows": "template_count_seen_windows", "deviation_score": "template_count_deviation_score"}.items())
      + " FROM bursts m JOIN ctx_flagged c USING (window_id, event_id) JOIN deviated d ON m.window_id = d.window_id AND m.template = d.template GROUP BY m.event_id"),
    "anoms": ("logs", "SELECT * FROM logs WHERE label = 1"),
    "bounds": ("logs", "SELECT block_id, min(event_order) AS block_start, max(event_order) AS block_end FROM logs GROUP BY block_id"),
    "surprises": ("stream", ""),
}


def _markov(order: int) -> str:
    ctx = ", ".join(f"lag(template, {k}) OVER b AS c{k}" for k in range(1, order))
    keys = ", ".join(f"c{k}" for k in range(1, order))
    full = " AND ".join(f"c{k} IS NOT NULL" for k in range(1, order))
    before = "ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""SELECT *, CASE WHEN {full} THEN -ln(greatest((tc + 0.1) / (cc + 0.1 * greatest(1, v)), 1e-12)) ELSE 0 END AS surprise FROM (SELECT *, count(*) OVER (PARTITION BY {keys} {before}) AS cc, count(*) OVER (PARTITION BY {keys}, template {before}) AS tc,
      coalesce(sum(new_here) OVER ({before}), 0) AS v FROM (SELECT *, {ctx}, (row_number() OVER (PARTITION BY template ORDER BY i) = 1)::INT AS new_here FROM stream WINDOW b AS (PARTITION BY block_id ORDER BY i)))"""


_PARTS["surprises"] = ("stream", _markov(2))
_PARTS["surprises3"] = ("stream", _markov(3))
_PARTS["block_runs"] = ("stream", "SELECT event_id, CASE WHEN o = 1 THEN CAST(sum(o) OVER (PARTITION BY block_id, island) AS DOUBLE) ELSE 0 END AS template_burst_score FROM (SELECT *, sum(1 - o) OVER (PARTITION BY block_id ORDER BY event_order) AS island FROM (SELECT *, (unseen OR is_new)::INT AS o FROM stream))")
_PARTS["scored"] = ("surprises block_runs", "SELECT s.*, b.template_burst_score FROM surprises s JOIN block_runs b USING (event_id)")
_PARTS["calib"] = ("scored", "SELECT quantile_cont(template_burst_score, 0.98) AS qb, quantile_cont(novelty_score, 0.98) AS qn, quantile_cont(surprise, 0.98) AS qs FROM scored WHERE i < (SELECT greatest(1, floor(count(*) * 0.2)) FROM scored)")
_PARTS["seeds"] = ("scored calib", "SELECT * FROM (SELECT *, concat_ws(',', CASE WHEN novelty_score >= qn THEN 'dense_novelty' END, CASE WHEN template_burst_score >= qb THEN 'dense_template_burst' END, CASE WHEN surprise >= qs THEN 'diversity_markov_bigram' END) AS trigger_reasons FROM scored, calib) WHERE trigger_reasons <> ''")
_PARTS["incidents"] = ("seeds", """SELECT block_id, start_order, end_order, seed_events, templates, array_to_string(list_sort(list_distinct(string_split(r, ','))), ',') AS trigger_reasons, max_burst, max_novelty, greatest(0, start_order - 10) AS interval_start, end_order + 10 AS interval_end FROM (
  SELECT block_id, min(event_order) AS start_order, max(event_order) AS end_order, count(*) AS seed_events, count(DISTINCT template) AS templates, string_agg(trigger_reasons, ',') AS r, max(template_burst_score) AS max_burst, max(novelty_score) AS max_novelty
  FROM (SELECT *, sum(new) OVER (PARTITION BY block_id ORDER BY event_order) AS run FROM (SELECT *, CASE WHEN event_order - lag(event_order) OVER (PARTITION BY block_id ORDER BY event_order) > 50 THEN 1 ELSE 0 END AS new FROM seeds)) GROUP BY block_id, run)""")  # fmt: skip


def _clusters(gap: int) -> str:
    return f"""SELECT block_id, min(event_order) AS start_order, max(event_order) AS end_order, count(*) AS events, CAST(count_if(label = 1) AS BIGINT) AS anomalies, count(DISTINCT template) AS templates FROM (SELECT *, sum(new) OVER (PARTITION BY block_id ORDER BY event_order) AS run FROM (SELECT *, CASE WHEN event_order - lag(event_order) OVER (PARTITION BY block_id ORDER BY event_order) > {gap} THEN 1 ELSE 0 END AS new FROM anoms)) GROUP BY block_id, run"""


_PARTS["gaps100"] = ("anoms", _clusters(100))
_PARTS["gaps20"] = ("anoms", _clusters(20))


def _intervals(name: str, margin: int) -> str:
    return f"SELECT *, interval_end - interval_start + 1 AS length, anomalies * 1.0::DOUBLE / (interval_end - interval_start + 1) AS density FROM (SELECT c.*, greatest(start_order - {margin}, block_start) AS interval_start, least(end_order + {margin}, block_end) AS interval_end FROM {name} c JOIN bounds USING (block_id))"


def _merged(name: str) -> str:
    return f"SELECT block_id, min(interval_start) AS interval_start, max(interval_end) AS interval_end FROM (SELECT *, sum(new) OVER (PARTITION BY block_id ORDER BY interval_start, interval_end) AS run FROM (SELECT *, CASE WHEN interval_start > max(interval_end) OVER (PARTITION BY block_id ORDER BY interval_start, interval_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM {name})) GROUP BY block_id, run"


_PARTS["ints20"] = ("gaps20 bounds", _intervals("gaps20", 50))
_PARTS["truth"] = ("gaps100 bounds", _intervals("gaps100", 10))
_PARTS["merged"] = ("incidents", _merged("incidents"))


def compose(wanted: str, final: str) -> str:
    done: dict[str, str] = {}

    def need(name: str) -> None:
        if name in done:
            return
        deps, sql = _PARTS[name]
        for dep in deps.split():
            need(dep)
        done[name] = sql

    for name in wanted.split():
        need(name)
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in done.items()) + "\n" + final


def _r(cols: str, digits: int = 6) -> str:
    """Comma-separated names, those with a ~ rounded."""
    return ", ".join(f"round({c[1:]}, {digits}) AS {c[1:]}" if c.startswith("~") else c for c in cols.split())


_FEATURES = "window_id num_records unique_templates ~unique_template_ratio ~template_entropy max_cluster_size ~mean_cluster_size ~max_cluster_ratio new_template_count ~new_template_ratio rare_template_count ~rare_template_ratio unseen_template_count ~unseen_template_ratio ~max_novelty_score ~mean_novelty_score ~var_novelty_score ~max_rarity_score ~mean_rarity_score ~var_rarity_score first_order last_order num_labeled num_anomalous window_label ~novelty_magnitude_score"
_TERMS = {
    "failure_terms": ("fail", "failed", "failure", "fatal", "error", "exception"), "communication_terms": ("socket", "connection", "link", "network", "control stream"),
    "filesystem_terms": ("mount", "read", "write", "filesystem", "file system", "io"), "hardware_terms": ("machine check", "corrected", "uncorrected", "memory", "processor", "hardware"),
}
_RANK = "template_burst_score DESC, template_count_deviation_score DESC, novelty_score DESC, rarity_score DESC, event_order, event_id"
_MASKED = "concat(event_type, ' user <:NUM:> value <:NUM:>.<:NUM:> props {\"k\": <:NUM:>}')"
_ORACLE = {
    "template_counts": ("logs", "SELECT template, count(*) AS n FROM logs GROUP BY template"),
    "mask_messages": ("logs", f"SELECT event_id, {_MASKED} AS masked FROM events"),
    "novelty_annotate": ("stream", f"SELECT {_r('event_id template historical_count unseen rare is_new ~rarity_score ~novelty_score')} FROM stream"),
    "count_windows": ("raw_stream starts", "SELECT window_id, event_id FROM raw_stream JOIN starts ON i >= lo AND i < lo + 100"),
    "time_windows": ("raw_stream", """SELECT dense_rank() OVER (ORDER BY slot) - 1 AS window_id, num_records, first_order, last_order FROM (SELECT slot, count(*) AS num_records, min(event_order) AS first_order, max(event_order) AS last_order FROM (SELECT event_order, unnest(range(greatest(0, CAST(floor((s - 21600) / 10800) AS BIGINT) + 1), CAST(floor(s / 10800) AS BIGINT) + 1)) AS slot FROM (SELECT event_order, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1e6 AS s FROM raw_stream)) GROUP BY slot)"""),
    "group_windows": ("logs", "SELECT block_id, num_records, first_order, last_order, row_number() OVER (ORDER BY first_order) - 1 AS window_id, CAST(sum(num_records) OVER (ORDER BY first_order) AS BIGINT) AS end_index, CAST(sum(num_records) OVER (ORDER BY first_order) - num_records AS BIGINT) AS start_index FROM (SELECT block_id, count(*) AS num_records, min(event_order) AS first_order, max(event_order) AS last_order FROM logs GROUP BY block_id)"),
    "window_features": ("features", f"SELECT {_r(_FEATURES)} FROM features"),
    "window_ground_truth": ("members", "SELECT window_id, count(*) AS num_records, count(label) AS num_labeled, CAST(count_if(label = 1) AS BIGINT) AS num_anomalous, CAST(max(label) AS BIGINT) AS window_label FROM members GROUP BY window_id"),
    "gev_threshold": ("fits", f"SELECT {_r('statistic n ~l1 ~l2 ~t3 ~threshold', 5)} FROM fits"),
    "gev_scored_windows": ("scores", f"SELECT {_r('window_id statistic ~value ~threshold is_suspicious', 5)} FROM scores"),
    "gev_ensemble_or": ("flagged", f"SELECT {_r('window_id is_suspicious num_triggered triggered ~max_excess', 5)} FROM flagged"),
    "post_gev_eval": ("flagged members", """, cells AS (SELECT CAST(count_if(is_suspicious AND window_label = 1) AS BIGINT) AS tp, CAST(count_if(is_suspicious AND window_label = 0) AS BIGINT) AS fp, CAST(count_if(NOT is_suspicious AND window_label = 1) AS BIGINT) AS fn, CAST(count_if(NOT is_suspicious AND window_label = 0) AS BIGINT) AS tn, count(*) AS windows, CAST(count_if(is_suspicious) AS BIGINT) AS suspicious FROM flagged),
ev AS (SELECT count(*) AS events, CAST(count_if(f) AS BIGINT) AS forwarded, CAST(count_if(l = 1) AS BIGINT) AS anomalies, CAST(count_if(f AND l = 1) AS BIGINT) AS found FROM (SELECT event_id, bool_or(is_suspicious) AS f, max(label) AS l FROM members JOIN flagged USING (window_id) GROUP BY event_id))
SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(1 - suspicious / windows, 6) AS window_reduction, round(1 - forwarded / events, 6) AS event_reduction, round(found / nullif(anomalies, 0), 6) AS event_recall FROM cells, ev"""),
    "order_stat_threshold": ("stream", "SELECT round(list_sort(list(novelty_score))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1], 6) AS u, count(*) AS n FROM stream"),
    "exceedances": ("members", "SELECT window_id, CAST(count_if(novelty_score > (SELECT list_sort(list(novelty_score))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1] FROM stream)) AS BIGINT) AS num_exceedances, round(max(novelty_score), 6) AS max_score FROM members GROUP BY window_id"),
    "burst_runs": ("bursts", "SELECT window_id, event_id, CAST(burst AS BIGINT) AS burst FROM bursts"),
    "past_z": ("logs", """SELECT window_id, num_records, round(CASE WHEN n < 3 OR s < 1e-12 THEN 0 ELSE (x - m) / s END, 5) AS past_z FROM (SELECT *, count(*) OVER w AS n, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s FROM (SELECT dense_rank() OVER (ORDER BY slot) - 1 AS window_id, num_records, ln(1 + num_records) AS x FROM (SELECT CAST(floor((epoch_us(ts) - t0) / 1e6 / 21600) AS BIGINT) AS slot, count(*) AS num_records FROM logs, (SELECT min(epoch_us(ts)) AS t0 FROM logs) GROUP BY slot)) WINDOW w AS (ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""),
    "template_deviation": ("deviated", f"SELECT {_r('window_id template cnt seen_windows ~past_mean ~past_std ~past_z ~ratio ~excess ~deviation_score')} FROM deviated"),
    "sequence_context": ("ctx", f"SELECT {_r('window_id event_id ~' + ' ~'.join(_CONTEXT[:4]) + ' ' + ' '.join(_CONTEXT[4:9]) + ' ~' + ' ~'.join(_CONTEXT[9:]))} FROM ctx"),
    "event_candidates": ("cands", "SELECT event_id, event_order, block_id, label, template, suspicious_window_count, round(max_window_gev_score, 5) AS max_window_gev_score, round(max_window_gev_excess, 5) AS max_window_gev_excess, round(COLUMNS(* EXCLUDE (event_id, event_order, block_id, label, template, message, suspicious_window_count, max_window_gev_score, max_window_gev_excess)), 8) FROM cands"),
    "markov_bigram": ("surprises", "SELECT event_id, round(surprise, 6) AS surprise FROM surprises"),
    "markov_trigram": ("surprises3", "SELECT event_id, round(surprise, 6) AS surprise FROM surprises3"),
    "rank_topk_burst": ("cands", f"SELECT row_number() OVER (ORDER BY {_RANK}) AS rank, event_id, template, round(template_burst_score, 6) AS score FROM cands QUALIFY rank <= 100"),
    "rank_budget_metrics": ("cands logs", f"""SELECT k, selected, positives, templates, round(positives / selected, 6) AS precision, round(positives / nullif(total, 0), 6) AS recall, round(selected / events, 6) AS load FROM (SELECT CAST(k AS BIGINT) AS k, count(*) AS selected, CAST(count_if(label = 1) AS BIGINT) AS positives, count(DISTINCT template) AS templates FROM (SELECT *, row_number() OVER (ORDER BY novelty_score DESC, {_RANK}) AS rank FROM cands) JOIN (SELECT unnest([10, 50, 100, 500]) AS k) ON rank <= k GROUP BY k), (SELECT count_if(label = 1) AS total, count(*) AS events FROM logs)"""),
    "template_rollup": ("cands", f"SELECT template, count(*) AS events, CAST(count_if(label = 1) AS BIGINT) AS positives, min(event_id) AS first_event, arg_min(message, rank) AS message, round(count_if(label = 1) / count(*), 6) AS precision FROM (SELECT *, row_number() OVER (ORDER BY template_count_deviation_score DESC, {_RANK}) AS rank FROM cands) WHERE rank <= 200 GROUP BY template"),
    "threshold_sweep": ("cands", "SELECT CAST(t AS DOUBLE) AS threshold, count(*) AS events, CAST(count_if(label = 1) AS BIGINT) AS positives, count(DISTINCT template) AS templates FROM cands JOIN (SELECT unnest([0, 1, 2, 3, 4, 5]) AS t) ON template_burst_score >= t GROUP BY t"),
    "time_split": ("features", "SELECT CASE WHEN window_id < a THEN 'train' WHEN window_id < greatest(a + 1, floor(n * 0.75)) THEN 'validation' ELSE 'test' END AS split, count(*) AS windows, CAST(count_if(window_label = 1) AS BIGINT) AS positives FROM features, (SELECT count(*) AS n, greatest(1, floor(count(*) * 0.5)) AS a FROM features) GROUP BY 1"),
    "block_split": ("logs bounds", "SELECT ['train', 'validation', 'test'][k % 3 + 1] AS split, block_id, count(*) AS events, CAST(count_if(label = 1) AS BIGINT) AS positives FROM logs JOIN (SELECT block_id, row_number() OVER (ORDER BY block_start) - 1 AS k FROM bounds) USING (block_id) GROUP BY ALL"),
    "block_folds": ("logs", """, b AS (SELECT block_id, pos, row_number() OVER (PARTITION BY pos ORDER BY f) - 1 AS k, sum(pos) OVER () AS m FROM (SELECT block_id, min(event_order) AS f, max((label = 1)::INT) AS pos FROM logs GROUP BY block_id))
SELECT f.k AS fold, b.block_id, CASE WHEN b.pos = 1 AND b.k = f.k THEN 'test' WHEN b.pos = 0 AND b.k % b.m = f.k THEN 'test' WHEN b.pos = 1 AND b.k = (f.k + 1) % b.m THEN 'validation' ELSE 'train' END AS split FROM b, (SELECT k FROM b WHERE pos = 1) f WHERE b.m >= 3"""),
    "event_count_vocab": ("members", """, vocab AS (SELECT template, concat('event_count__', lpad(CAST(row_number() OVER (ORDER BY count(*) DESC, template) - 1 AS VARCHAR), 3, '0'), '__', substr(sha1(template), 1, 10)) AS feature FROM members WHERE window_id < (SELECT greatest(1, floor((max(window_id) + 1) * 0.5)) FROM members) GROUP BY template ORDER BY count(*) DESC, template LIMIT 10)
SELECT window_id, feature, count(*) AS count FROM members JOIN vocab USING (template) GROUP BY ALL"""),
    "average_precision": ("stream", """, g AS (SELECT novelty_score AS s, sum(label) AS p, sum(1 - label) AS q FROM stream GROUP BY 1), c AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(q) OVER (ORDER BY s DESC) AS fp FROM g)
SELECT round(sum(p * tp / (tp + fp)) / sum(p), 6) AS average_precision, round(sum(q * (tp - p / 2)) / (sum(p) * sum(q)), 6) AS roc_auc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(q) AS BIGINT) AS negatives FROM c"""),
    "threshold_choice": ("stream", """, g AS (SELECT novelty_score AS s, sum(label) AS p, sum(1 - label) AS q FROM stream GROUP BY 1), c AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(q) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS total FROM g)
SELECT round(s, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / total, 6) AS recall FROM c WHERE tp / total >= 0.1 ORDER BY tp / (tp + fp) DESC, tp / total DESC, s DESC LIMIT 1"""),
    "classifier_metrics": ("stream", ", c AS (SELECT CAST(count_if(novelty_score >= 0.5 AND label = 1) AS BIGINT) AS tp, CAST(count_if(novelty_score >= 0.5 AND label = 0) AS BIGINT) AS fp, CAST(count_if(novelty_score < 0.5 AND label = 1) AS BIGINT) AS fn, CAST(count_if(novelty_score < 0.5 AND label = 0) AS BIGINT) AS tn FROM stream) SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c"),
    "gap_clusters": ("gaps100", "SELECT * FROM gaps100"),
    "cluster_intervals": ("gaps100 bounds", f"SELECT {_r('block_id start_order end_order events anomalies templates interval_start interval_end length ~density')} FROM ({_intervals('gaps100', 50)})"),
    "cluster_grid": ("anoms", "SELECT CAST(g AS BIGINT) AS gap, CAST(count_if(coalesce(event_order - l > g, true)) AS BIGINT) AS clusters, count(*) AS anomalies FROM (SELECT *, lag(event_order) OVER (PARTITION BY block_id ORDER BY event_order) AS l FROM anoms), (SELECT unnest([5, 20, 50, 100, 200]) AS g) GROUP BY g"),
    "merge_intervals": ("ints20", _merged("ints20")),
    "calibrate_thresholds": ("calib", "SELECT round(qb, 5) AS q_template_burst_score, round(qn, 5) AS q_novelty_score, round(qs, 5) AS q_surprise FROM calib"),
    "trigger_channels": ("seeds", "SELECT trigger_reasons, count(*) AS events FROM seeds GROUP BY 1"),
    "incident_buffer": ("incidents", f"SELECT {_r('block_id start_order end_order seed_events templates trigger_reasons ~max_burst ~max_novelty interval_start interval_end')} FROM incidents"),
    "region_eval": ("merged anoms logs", """, z AS (SELECT count(*) AS intervals, CAST(coalesce(sum(interval_end - interval_start + 1), 0) AS BIGINT) AS length FROM merged), h AS (SELECT count(*) AS covered FROM anoms a WHERE EXISTS (SELECT 1 FROM merged m WHERE m.block_id = a.block_id AND a.event_order BETWEEN m.interval_start AND m.interval_end)), t AS (SELECT count(*) AS events, CAST(count_if(label = 1) AS BIGINT) AS anomalies FROM logs)
SELECT intervals, length, covered, anomalies, round(length / events, 6) AS stream_load, round(covered / nullif(anomalies, 0), 6) AS recall, round(covered / nullif(length, 0), 6) AS density, round(covered / nullif(intervals, 0), 6) AS compression FROM z, h, t"""),
    "detection_delay": ("truth incidents", "SELECT t.block_id, t.start_order, min(r.interval_start) - t.start_order AS delay FROM truth t LEFT JOIN incidents r ON t.block_id = r.block_id AND r.interval_start <= t.interval_end AND r.interval_end >= t.interval_start GROUP BY t.block_id, t.start_order"),
    "gap_summary": ("anoms", "SELECT round(avg(g), 6) AS mean_gap, round(CAST(median(g) AS DOUBLE), 6) AS median_gap, max(g) AS max_gap, round(avg((g <= 50)::INT), 6) AS share_50 FROM (SELECT event_order - lag(event_order) OVER (PARTITION BY block_id ORDER BY event_order) AS g FROM anoms) WHERE g IS NOT NULL"),
    "dispersion": ("anoms logs", "SELECT CAST(100 AS BIGINT) AS bins, round(var_pop(c) / nullif(avg(c), 0), 6) AS dispersion, round(avg((c > 0)::INT), 6) AS non_empty, max(c) AS largest FROM (SELECT b, count(event_id) AS c FROM range(100) r(b) LEFT JOIN (SELECT event_id, least(99, event_order // (SELECT greatest(1, count(*) // 100) FROM logs)) AS x FROM anoms) ON b = x GROUP BY b)"),
    "topn_concentration": ("gaps100", "SELECT rank, running, round(running / total, 6) AS share FROM (SELECT row_number() OVER (ORDER BY anomalies DESC, start_order) AS rank, CAST(sum(anomalies) OVER (ORDER BY anomalies DESC, start_order) AS BIGINT) AS running, sum(anomalies) OVER () AS total FROM gaps100) WHERE rank <= 20"),
    "block_scan": ("logs", "SELECT event_order // 500 AS block, count(*) AS rows, CAST(sum(label) AS BIGINT) AS anomalies FROM logs GROUP BY 1"),
    "prefix_sample": ("logs", "SELECT event_id, template, label FROM logs ORDER BY event_order LIMIT 500"),
    "multi_block_sample": ("logs", "SELECT row_number() OVER (ORDER BY event_order) AS row_id, event_id, event_order // 1000 AS range_id FROM logs WHERE event_order // 250 % 4 = 1"),
    "cosine_topk": ("logs", "SELECT query_id, vec_id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id) QUALIFY rank <= 5"),
    "keyword_semantics": ("logs", f"""SELECT event_id, {', '.join(f"array_to_string(list_filter({list(t)}, lambda t: contains(m, t)), ',') AS {n}" for n, t in _TERMS.items())}, contains(m, 'corrected') AND NOT contains(m, 'uncorrected') AS explicitly_corrected,
      len(list_filter(['fail', 'failed', 'failure', 'fatal', 'error', 'exception', 'uncorrected', 'severed'], lambda t: contains(m, t))) > 0 AS failure_like_text FROM (SELECT event_id, lower(template || ' ' || message) AS m FROM logs)"""),
    "cluster_packets": ("cands", f"SELECT template, count(*) AS events, count(DISTINCT block_id) AS blocks, min(rank) AS best_rank, round(max(template_burst_score), 6) AS burst_max, round(avg(template_burst_score), 6) AS burst_mean, array_to_string(list_sort(list(rank))[1:3], ',') AS best_ranks FROM (SELECT *, row_number() OVER (ORDER BY template_count_deviation_score DESC, {_RANK}) AS rank FROM cands) WHERE rank <= 200 GROUP BY template ORDER BY best_rank, events DESC LIMIT 20"),
    "neighbor_examples": ("logs", "SELECT * EXCLUDE (label) FROM (SELECT event_id, label, lag(event_id, 1) OVER w AS before_1, lag(event_id, 2) OVER w AS before_2, lead(event_id, 1) OVER w AS behind_1, lead(event_id, 2) OVER w AS behind_2 FROM logs WINDOW w AS (ORDER BY event_order)) WHERE label = 1"),
    "same_template_examples": ("logs", "SELECT event_id, coalesce(e, '') AS earlier FROM (SELECT event_id, label, string_agg(CAST(event_id AS VARCHAR), ',') OVER (PARTITION BY template ORDER BY event_order ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS e FROM logs) WHERE label = 1"),
    "resource_metrics": ("logs", """, one AS (SELECT user_id AS packet_id, CAST(trunc(value * 10) AS BIGINT) AS latency_ms, event_id % 7 = 0 AS cache_hit FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1), fresh AS (SELECT *, row_number() OVER (ORDER BY latency_ms, packet_id) - 1 AS k, count(*) OVER () AS n FROM one WHERE NOT cache_hit)
SELECT (SELECT count(*) FROM one) AS packets, (SELECT CAST(count_if(cache_hit) AS BIGINT) FROM one) AS cache_hits, (SELECT CAST(sum(latency_ms) AS BIGINT) FROM one) AS total_ms, (SELECT round(avg(latency_ms), 6) FROM fresh) AS mean_latency, (SELECT max(latency_ms) FROM fresh WHERE k = round_even((n - 1) * 0.95::DOUBLE, 0)) AS p95_latency"""),
    "vote_agreement": ("logs", "SELECT region_id, runs, round(s, 6) AS positive_share, s IN (0, 1) AS unanimous, s >= 0.5 AS majority_positive, round(greatest(s, 1 - s), 6) AS majority_share FROM (SELECT user_id AS region_id, count(*) AS runs, avg((value >= 60)::INT) AS s FROM events GROUP BY 1)"),
    "population_summary": ("logs bounds", "SELECT coalesce(split, 'all') AS split, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives, round(sum(label) / count(*), 6) AS rate FROM (SELECT ['train', 'validation', 'test'][k % 3 + 1] AS split, label FROM logs JOIN (SELECT block_id, row_number() OVER (ORDER BY block_start) - 1 AS k FROM bounds) USING (block_id)) GROUP BY ROLLUP (split)"),
    "topn_sweep": ("cands", f"""SELECT CAST(n AS BIGINT) AS n, count(*) AS events, CAST(count_if(label = 1) AS BIGINT) AS positives, round(count_if(label = 1) / count(*), 6) AS precision, count(DISTINCT block_id) AS blocks FROM (SELECT *, row_number() OVER (ORDER BY s DESC, {_RANK}) AS rank FROM (SELECT *, CASE WHEN max(template_burst_score) OVER () > 0 THEN template_burst_score / max(template_burst_score) OVER () ELSE 0 END + CASE WHEN max(novelty_score) OVER () > 0 THEN novelty_score / max(novelty_score) OVER () ELSE 0 END AS s FROM cands))
  JOIN (SELECT unnest([1, 10, 100, 500]) AS n) ON rank <= n GROUP BY n"""),
    "label_free_regions": ("cands bounds", f"""SELECT c.block_id, start_order, end_order, events, anomalies, templates, greatest(start_order - 10, block_start) AS interval_start, least(end_order + 10, block_end) AS interval_end, least(end_order + 10, block_end) - greatest(start_order - 10, block_start) + 1 AS length FROM (
  SELECT block_id, min(event_order) AS start_order, max(event_order) AS end_order, count(*) AS events, CAST(count_if(label = 1) AS BIGINT) AS anomalies, count(DISTINCT template) AS templates FROM (SELECT *, sum(new) OVER (PARTITION BY block_id ORDER BY event_order) AS run FROM (SELECT *, CASE WHEN event_order - lag(event_order) OVER (PARTITION BY block_id ORDER BY event_order) > 50 THEN 1 ELSE 0 END AS new FROM (SELECT * FROM cands ORDER BY novelty_score DESC, {_RANK} LIMIT 200))) GROUP BY block_id, run) c JOIN bounds USING (block_id)"""),
    "score_neighbors": ("cands", f"""SELECT query_id, event_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, event_order) AS rank FROM (SELECT q.event_id AS query_id, c.event_id, c.event_order, round(abs(c.template_burst_score - q.template_burst_score) + abs(c.template_count_deviation_score - q.template_count_deviation_score) + abs(c.novelty_score - q.novelty_score) + abs(c.rarity_score - q.rarity_score), 6) AS distance
  FROM cands c JOIN (SELECT * FROM cands ORDER BY {_RANK} LIMIT 5) q ON c.event_id <> q.event_id) QUALIFY rank <= 3"""),
    "lower_score_contrast": ("cands", f"SELECT query_id, event_id, rank, round(s, 5) AS score FROM (SELECT q.event_id AS query_id, c.event_id, c.template_count_deviation_score AS s, row_number() OVER (PARTITION BY q.event_id ORDER BY c.template_count_deviation_score DESC, c.event_order) AS rank FROM cands c JOIN (SELECT * FROM cands ORDER BY template_count_deviation_score DESC, {_RANK} LIMIT 5) q ON c.template_count_deviation_score < q.template_count_deviation_score) WHERE rank <= 3"),
    "llm_policy_summary": ("cands", f""", r AS (SELECT event_id, label, event_id % 3 AS k, row_number() OVER (ORDER BY event_id % 101 DESC, rank, event_id) AS t FROM (SELECT *, row_number() OVER (ORDER BY {_RANK}) AS rank FROM cands) WHERE rank <= 100),
p AS (SELECT 'likely_anomaly' AS policy, label FROM r WHERE k = 0 UNION ALL SELECT 'inspect_action', label FROM r WHERE k = 0 UNION ALL SELECT 'uncertain_or_anomaly', label FROM r WHERE k < 2 UNION ALL SELECT 'triage_score_top10', label FROM r WHERE t <= 10 UNION ALL SELECT 'triage_score_top50', label FROM r WHERE t <= 50)
SELECT policy, count(*) AS selected, CAST(count_if(label = 1) AS BIGINT) AS positives, round(count_if(label = 1) / count(*), 6) AS precision, round(count_if(label = 1) / 40, 6) AS recall FROM p GROUP BY policy"""),
}

ORACLE = {name: compose(parts, final) for name, (parts, final) in _ORACLE.items()}
