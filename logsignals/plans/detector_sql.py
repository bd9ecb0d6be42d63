"""The detectors' rules once more, as SQL written from what they have to say rather than from the operators' own expressions.

Every text is a common table expression over `ctx`, a row for each batch; (batch_id, agent, score, threat) with the score to three places.
"""

from __future__ import annotations

VOLUME = """vol AS (
  SELECT batch_id, 'volume' AS agent,
    round((CASE WHEN label IN ('warm-up', 'service', 'benign') THEN least(0.3, spike)
      WHEN label = 'slow' THEN greatest(least(1.0, 0.6 + 0.4 * saturation), spike)
      WHEN label = 'cluster' THEN greatest(0.7, least(1.0, 0.65 + 0.4 * top_count / total::DOUBLE), spike)
      WHEN label = 'single' THEN greatest(0.82, spike) ELSE spike END)::DOUBLE, 3) AS score,
    CASE label WHEN 'slow' THEN 'DOS' WHEN 'single' THEN 'DOS' WHEN 'cluster' THEN 'DDOS' WHEN 'open' THEN CASE WHEN spike = 0 THEN 'NONE' WHEN unique_ips > 5 THEN 'DDOS' ELSE 'DOS' END ELSE 'NONE' END AS threat
  FROM (SELECT *, CASE WHEN dominant_ratio >= 0.5 AND spike_z / 6.0 >= 0.55 THEN least(1.0, spike_z / 6.0) ELSE 0.0 END AS spike,
    CASE WHEN batch_no < 15 THEN 'warm-up'
      WHEN saturation >= 0.5 AND pair_count >= 40 AND avg_latency > thr_latency AND pair_port IN (80, 8080, 8000) THEN 'slow'
      WHEN slow_count >= 100 AND slow_saturation >= 0.5 AND slow_cap_ratio >= 0.5 THEN 'slow'
      WHEN pair_port IN (53, 123, 137, 138, 443, 5353, 67, 68) AND top_count <= 0.9 * total THEN 'service'
      WHEN unique_ips >= 2 AND unique_ips <= 50 AND dominant_ratio >= 0.25 AND dominant_ratio < thr_dominant AND top_count >= thr_rate THEN 'cluster'
      WHEN unique_ips > 5 AND dominant_ratio < thr_dominant THEN CASE WHEN top_count >= 25 AND unique_ips <= 50 AND dominant_ratio >= 0.25 THEN 'cluster' ELSE 'benign' END
      WHEN top_count >= thr_rate AND dominant_ratio >= thr_dominant THEN CASE WHEN unique_ips <= 2 AND avg_latency > thr_latency AND dominant_ratio <= 0.9 THEN 'benign' ELSE 'single' END
      ELSE 'open' END AS label FROM ctx))"""

TEMPORAL = """tmp AS (
  SELECT batch_id, 'temporal' AS agent, round(list_max([periodic, tested, dropping, nightly])::DOUBLE, 3) AS score, CASE WHEN speaks THEN 'BOT_ACTIVITY' ELSE 'NONE' END AS threat
  FROM (SELECT batch_id, speaks,
      CASE WHEN NOT speaks OR periodic_ips = 0 THEN 0.0 WHEN periodic_ips >= thr_periodic THEN 0.9 * bot_conf ELSE 0.6 * bot_conf END AS periodic,
      CASE WHEN speaks AND ks_p < 0.05 AND periodic_ips >= thr_periodic THEN 0.7 ELSE 0.0 END AS tested,
      CASE WHEN speaks AND cusum_peak >= 4 AND periodic_ips >= greatest(1, thr_periodic - 1) THEN 0.72 ELSE 0.0 END AS dropping,
      CASE WHEN speaks AND off_hours_ratio > 0.85 THEN 0.6 ELSE 0.0 END AS nightly
    FROM (SELECT *, span_ms >= 200 AND (periodic_ips >= 1 OR off_hours_ratio > 0.85 OR off_hours_ratio > thr_off_hours) AS speaks FROM ctx)))"""

AUTH = """aut AS (
  SELECT batch_id, 'auth' AS agent,
    round(CASE WHEN failures = 0 OR (stuffing_ips = 0 AND top_failures < 10 AND failing_ips = 0) THEN 0.0 ELSE list_max([
      CASE WHEN stuffing_ips > 0 THEN 0.8 ELSE 0.0 END::DOUBLE, CASE WHEN top_failures >= 60 THEN greatest(0.8, least(1.0, top_failures / 75.0)) ELSE 0.0 END::DOUBLE,
      CASE WHEN streak >= 10 THEN least(1.0, streak / 25.0 + 0.4) ELSE 0.0 END::DOUBLE, CASE WHEN failing_ips > 0 THEN 0.6 ELSE 0.0 END::DOUBLE]) END::DOUBLE, 3) AS score,
    CASE WHEN failures = 0 THEN 'NONE' WHEN stuffing_ips > 0 THEN 'CREDENTIAL_STUFFING' WHEN top_failures >= 10 THEN 'BRUTE_FORCE' ELSE 'NONE' END AS threat
  FROM ctx)"""

PAYLOAD = """pay AS (
  SELECT batch_id, 'payload' AS agent,
    round((CASE WHEN hard THEN CASE WHEN scan_signature THEN 0.8 ELSE 0.7 END WHEN adaptive AND scan_signature THEN 0.8 WHEN adaptive AND hits >= 3 THEN greatest(0.6, odd)
      WHEN NOT adaptive AND hits >= 3 THEN greatest(least(0.95, 0.6 + 0.1 * families), odd) WHEN known THEN odd ELSE 0.0 END)::DOUBLE, 3) AS score,
    CASE WHEN hard OR adaptive THEN CASE WHEN any_port THEN 'PORT_SCAN' ELSE 'ENUMERATION' END WHEN hits >= 3 THEN 'WEB_ATTACK' ELSE 'NONE' END AS threat
  FROM (SELECT *, max_entropy >= 6 AND entropy_distinct >= 100 AS hard, known AND max_entropy >= thr_entropy AND entropy_distinct >= 5 AS adaptive, CASE WHEN entropy_z > 2 THEN least(0.55, entropy_z / 5) ELSE 0.0 END AS odd
    FROM (SELECT *, batch_no >= 15 AND entropy_stable AS known FROM ctx)))"""

SEQUENCE = """seq AS (
  SELECT batch_id, 'sequence' AS agent, CASE WHEN abuse THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, CASE WHEN abuse THEN 'SEQUENCE_ABUSE' ELSE 'NONE' END AS threat
  FROM (SELECT batch_id, sequential_ips > 0 AND most_transitions >= 4 AND dispatched >= 30 AS abuse FROM ctx))"""

GEO = """gpl AS (
  SELECT batch_id, 'geo' AS agent, round(list_max([listed, one, many, wide])::DOUBLE, 3) AS score, CASE WHEN list_max([listed, one, many, wide]) > 0 THEN 'GEO_ANOMALY' ELSE 'NONE' END AS threat
  FROM (SELECT batch_id, CASE WHEN tor_listed THEN 0.75 ELSE 0.0 END::DOUBLE AS listed, CASE WHEN seen AND top_foreign_share >= 0.4 THEN 0.8 ELSE 0.0 END::DOUBLE AS one,
      CASE WHEN seen AND home_known AND foreign_share >= 0.2 AND foreign_countries >= 3 THEN round(least(0.85, 0.5 + 0.4 * foreign_share), 2) ELSE 0.0 END::DOUBLE AS many,
      CASE WHEN seen AND keys >= 10 AND countries >= 5 AND diversity >= 0.1 THEN round(least(0.8, 0.55 + 0.6 * diversity), 2) ELSE 0.0 END::DOUBLE AS wide
    FROM (SELECT *, resolved_ips >= 0.1 * unique_ips OR tor_listed AS seen FROM ctx)))"""

#: agent: (name of its expression, its text, score at which it fires).
AGENTS = {"volume": ("vol", VOLUME, 0.55), "temporal": ("tmp", TEMPORAL, 0.60), "auth": ("aut", AUTH, 0.45), "payload": ("pay", PAYLOAD, 0.60), "sequence": ("seq", SEQUENCE, 0.60), "geo": ("gpl", GEO, 0.50)}
EACH = tuple(text for _, text, _ in AGENTS.values())
#: All findings, those of temporal silent where volume's flood explains them (fn) or not (fr).
RAW = "fr AS (" + " UNION ALL ".join(f"SELECT *, score >= {least} AS fired FROM {name}" for name, _, least in AGENTS.values()) + ")"
FINDINGS = "fn AS (SELECT f.batch_id, f.agent, f.score, f.threat, fired AND NOT (f.agent = 'temporal' AND v.score >= 0.55 AND v.threat IN ('DOS', 'DDOS')) AS fired FROM fr f JOIN vol v USING (batch_id))"
