"""Queries of streams: what they give once all rows of `events` have come, against SQL over the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans.registry import query
from lodestone.session import table_path
from lodestone.streaming import running, windows

#: Users of the table come back within hours, not minutes.
GAP = "6 hours"

_JUDGED = """
v AS (
  SELECT user_id AS session, event_id AS "case", ts, date_trunc('milliseconds', ts) AS ms,
    CASE WHEN (props->>'$.k')::INT % 5 <> 0 AND ['O','C','L','N'][((floor(value)::INT % 4) + 4) % 4 + 1] <> ['O','C','L','N'][((props->>'$.k')::INT % 4 + 4) % 4 + 1] THEN 1 ELSE 0 END AS defect
  FROM events
), mark AS (SELECT max(date_trunc('milliseconds', ts)) - INTERVAL 10 MINUTE AS mark FROM v)"""


def _events(t):
    """The events as a stream of files; all of them in one micro-batch, so that none is late."""
    events = t("events")
    landed = table_path(t.spark, "landed-events")
    events.write.parquet(landed)
    return windows.judged(windows.read_events(t.spark, landed, events.schema, per_trigger=1_000_000))


@query("", f"""
WITH {_JUDGED}, gaps AS (
  SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY session ORDER BY ms, "case") > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS opens FROM v, mark WHERE ms <= mark
), parts AS (SELECT *, sum(opens) OVER (PARTITION BY session ORDER BY ms, "case")::INT AS part FROM gaps)
SELECT session, "case", part, row_number() OVER w AS n, sum(defect) OVER w::BIGINT AS defects, round(sum(defect) OVER w / row_number() OVER w, 9)::DOUBLE AS bond_index
FROM parts WINDOW w AS (PARTITION BY session, part ORDER BY ms, "case")""")
def running_index(t):
    """The index of each session so far, at each of its verdicts."""
    name = table_path(t.spark, "running-index")
    out = running.to_table(running.running_index(_events(t), gap=GAP), name, f"{name}-state", with_state=True)
    return out.select("session", "case", "part", "n", "defects", F.round("bond_index", 9).alias("bond_index"))


@query("", f"""
WITH {_JUDGED}, gaps AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session ORDER BY ts) >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS opens FROM v
), parts AS (SELECT *, sum(opens) OVER (PARTITION BY session ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM gaps)
SELECT session, min(ts) AS "start", max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n, sum(defect)::BIGINT AS defects, round(sum(defect) / count(*), 9)::DOUBLE AS bond_index
FROM parts, mark GROUP BY session, part, mark HAVING max(date_trunc('milliseconds', ts + INTERVAL 6 HOUR)) <= mark""")
def session_metrics(t):
    """Size and index of each session that the watermark has closed."""
    name = table_path(t.spark, "sessions")
    out = running.to_table(windows.session_index(_events(t), gap=GAP), name, f"{name}-state")
    return out.select("session", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", "defects", F.round("bond_index", 9).alias("bond_index"))
