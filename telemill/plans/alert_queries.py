"""Registered queries over alert rules, evaluated on raw points every six hours of the month."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from telemill.functions.fields import SERVICE_LABEL
from telemill.functions.timegrid import MICROS
from telemill.operators import alerts as ops
from telemill.operators.metrics import Selector
from telemill.plans import views
from telemill.plans.views import METRICS_SQL
from telemill.schemas import CHANNEL_SCHEMA, RULE_GROUP_SCHEMA, SILENCE_SCHEMA
from telemill.session import config_table

FIRST, LAST = "2024-01-01", "2024-01-30"
TICK_S = 6 * 3600

SELECTORS = {
    "high_purchases": Selector("app_value", [("type", "=", "purchase")]),
    "jumpy_clicks": Selector("app_value", [("type", "=", "click"), ("shard", "=", "1")]),
    "prices_missing": Selector("item_price"),
    "ticks_seen": Selector("app_ticks_total", [("type", "=~", "s.*")]),
    "errors_either_way": Selector("app_value", [("type", "=", "error")]),
}

# (name, duration in seconds, severity, team label, conditions, channels)
_RULES = [
    ("high_purchases", 21600, "critical", "shop", [("threshold", ">", 15.0)], ["pager", "chat"]),
    ("jumpy_clicks", 43200, "warning", "web", [("rate_of_change", ">=", 0.5)], ["chat", "unknown"]),
    ("prices_missing", 86400, "critical", "shop", [("absence", "", 0.0)], ["pager", "chat", "mail"]),
    ("ticks_seen", 0, "info", "web", [], ["mail"]),
    (
        "errors_either_way", 7200, "warning", "ops",
        [("threshold", "<", 3.0), ("rate_of_change", ">", 4.0), ("threshold", "~", 0.0), ("absence", "", 0.0)],
        ["pager", "chat", "mail"],
    ),
]

_CHANNELS = [("pager", 24 * 3600), ("chat", 3600), ("mail", 30 * 3600)]


def rule_groups(spark: SparkSession) -> DataFrame:
    rules = [
        (name, f"selector of {name}", duration, severity, True, {"team": team, "env": "test"}, {"summary": name}, conditions, channels)
        for name, duration, severity, team, conditions, channels in _RULES
    ]
    off = ("switched_off", "x", 60, "info", False, {}, {}, [], [])
    return config_table(spark, [("shop", rules[:2] + [off]), ("rest", rules[2:])], RULE_GROUP_SCHEMA)


def channels(spark: SparkSession) -> DataFrame:
    return config_table(spark, _CHANNELS, CHANNEL_SCHEMA)


def _at(day: int, hour: int = 0) -> datetime:
    return datetime(2024, 1, day, hour, tzinfo=timezone.utc)


def silence_changes(spark: SparkSession) -> DataFrame:
    """Versions of four silences: one replaced, one deleted, one invalid, one with a pattern."""
    team_shop = [("team", "shop", False, True)]
    return config_table(
        spark,
        [
            ("s1", team_shop, _at(1), _at(30), "ann", "", _at(1), False),
            ("s1", team_shop, _at(10), _at(14, 12), "ann", "shorter", _at(2), False),
            ("s2", [("env", "test", False, True)], _at(1), _at(30), "bob", "", _at(1), False),
            ("s2", [("env", "test", False, True)], _at(1), _at(30), "bob", "", _at(3), True),
            ("s3", [], _at(1), _at(30), "eve", "matches nothing: invalid", _at(1), False),
            (
                "s4",
                [("team", "^(w|o)", True, True), ("env", "prod", False, False), ("team", "web", True, False)],
                _at(20), _at(25), "cid", "", _at(1), False,
            ),
        ],
        SILENCE_SCHEMA,
    )


def evaluations(spark, sf_dir, per_series: bool = False) -> DataFrame:
    rules = ops.load_rules(rule_groups(spark))
    points = ops.rule_points(views.metrics(spark, sf_dir), SELECTORS, FIRST, LAST, rules)
    return ops.evaluate_rules(points, rules, FIRST, LAST, TICK_S, per_series)


def states(spark, sf_dir) -> DataFrame:
    return ops.alert_states(evaluations(spark, sf_dir))


# -- reference SQL --------------------------------------------------------------------------------

_US = TICK_S * MICROS


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_RULE_ROWS = ", ".join(
    f"({_text(n)}, {d}, {_text(s)}, {_text(t)}, {(d or 300) * MICROS}::BIGINT, {_text(','.join(ch))})"
    for n, d, s, t, _, ch in _RULES
)

BASE_SQL = f"""
WITH RECURSIVE metrics_v AS ({METRICS_SQL}),
 rules AS (SELECT *, substr(sha256(name || 'env=test,team=' || team || ','), 1, 16) AS fingerprint
           FROM (VALUES {_RULE_ROWS}) r(name, duration_s, severity, team, lookback_us, channels)),
 ticks AS (SELECT unnest(range(epoch_us(TIMESTAMP '{FIRST}') // {_US}, epoch_us(TIMESTAMP '{LAST}') // {_US} + 1)) * {_US} AS tick_us),
 pts AS (
   SELECT 'high_purchases' AS rule_name, * FROM metrics_v WHERE name = 'app_value' AND l_type = 'purchase'
   UNION ALL SELECT 'jumpy_clicks', * FROM metrics_v WHERE name = 'app_value' AND l_type = 'click' AND l_shard = '1'
   UNION ALL SELECT 'prices_missing', * FROM metrics_v WHERE name = 'item_price'
   UNION ALL SELECT 'ticks_seen', * FROM metrics_v WHERE name = 'app_ticks_total' AND starts_with(l_type, 's')
   UNION ALL SELECT 'errors_either_way', * FROM metrics_v WHERE name = 'app_value' AND l_type = 'error'),
 seen AS (
   SELECT p.rule_name, t.tick_us, l_shard, l_type, service_name, p."timestamp" AS ts, p.value,
     dense_rank() OVER (PARTITION BY p.rule_name, t.tick_us ORDER BY l_shard, l_type, service_name) AS series_no
   FROM pts p JOIN rules r ON r.name = p.rule_name
   JOIN ticks t ON epoch_us(p."timestamp") BETWEEN t.tick_us - r.lookback_us AND t.tick_us),
 one AS (
   SELECT rule_name, tick_us, arg_min(value, ts) AS fst, arg_max(value, ts) AS lst, count(*) AS n
   FROM seen WHERE series_no = 1 GROUP BY 1, 2),
 grid AS (
   SELECT r.*, t.tick_us, o.n, o.lst, CASE WHEN o.n >= 2 AND o.fst <> 0 THEN (o.lst - o.fst) / o.fst ELSE 0 END AS chg
   FROM rules r, ticks t LEFT JOIN one o ON o.rule_name = r.name AND o.tick_us = t.tick_us),
 evals AS (
   SELECT name AS rule_name, duration_s, severity, team, channels, fingerprint, tick_us,
     coalesce(CASE name
       WHEN 'high_purchases' THEN lst > 15
       WHEN 'jumpy_clicks' THEN n IS NOT NULL AND abs(chg) >= 0.5
       WHEN 'prices_missing' THEN n IS NULL
       WHEN 'ticks_seen' THEN lst > 0
       ELSE n IS NULL OR lst < 3 OR abs(chg) > 4 END, false) AS firing,
     coalesce(lst, 0) AS value,
     coalesce(CASE
       WHEN name = 'high_purchases' AND lst > 15 THEN printf('value %.4f > threshold 15.0000', lst)
       WHEN name = 'jumpy_clicks' AND n IS NOT NULL AND abs(chg) >= 0.5 THEN printf('rate of change %.4f >= threshold 0.5000', chg)
       WHEN name = 'prices_missing' AND n IS NULL THEN 'no data for 24h0m0s'
       WHEN name = 'errors_either_way' AND n IS NULL THEN 'no data for 2h0m0s'
       WHEN name = 'errors_either_way' AND lst < 3 THEN printf('value %.4f < threshold 3.0000', lst)
       WHEN name = 'errors_either_way' AND abs(chg) > 4 THEN printf('rate of change %.4f > threshold 4.0000', chg)
       END, '') AS message
   FROM grid),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY tick_us) AS k FROM evals),
 walk AS (
   SELECT k, fingerprint, tick_us, CASE WHEN firing THEN 'pending' ELSE '' END AS state, tick_us AS starts_us, '' AS before
   FROM numbered WHERE k = 1
   UNION ALL
   SELECT n.k, n.fingerprint, n.tick_us,
     CASE WHEN n.firing AND w.state IN ('', 'resolved') THEN 'pending'
          WHEN n.firing AND w.state = 'pending' AND n.tick_us - w.starts_us >= n.duration_s::BIGINT * 1000000 THEN 'firing'
          WHEN n.firing THEN w.state
          WHEN w.state IN ('pending', 'firing') THEN 'resolved' ELSE '' END,
     CASE WHEN w.state IN ('pending', 'firing') THEN w.starts_us ELSE n.tick_us END,
     CASE WHEN w.state = 'resolved' THEN '' ELSE w.state END
   FROM walk w JOIN numbered n ON n.fingerprint = w.fingerprint AND n.k = w.k + 1),
 stated AS (SELECT w.state, w.starts_us, w.before, n.* FROM walk w JOIN numbered n USING (fingerprint, k) WHERE w.state <> ''),
 trans AS (SELECT * FROM stated WHERE state <> before),
 loud AS (
   SELECT * FROM trans WHERE state <> 'pending'
     AND NOT (team = 'shop' AND tick_us >= epoch_us(TIMESTAMP '2024-01-10') AND tick_us < epoch_us(TIMESTAMP '2024-01-14 12:00:00'))
     AND NOT (team = 'ops' AND tick_us >= epoch_us(TIMESTAMP '2024-01-20') AND tick_us < epoch_us(TIMESTAMP '2024-01-25'))),
 chan AS (SELECT * FROM (VALUES ('pager', 86400), ('chat', 3600), ('mail', 108000)) c(channel, repeat_s)),
 cand AS (
   SELECT l.*, c.channel, c.repeat_s, row_number() OVER (PARTITION BY fingerprint, state, c.channel ORDER BY tick_us) AS j
   FROM loud l JOIN chan c ON list_contains(string_split(l.channels, ','), c.channel)),
 fold AS (
   SELECT j, fingerprint, state, channel, tick_us, true AS sent, tick_us AS last_sent FROM cand WHERE j = 1
   UNION ALL
   SELECT c.j, c.fingerprint, c.state, c.channel, c.tick_us, c.tick_us - f.last_sent >= c.repeat_s::BIGINT * 1000000,
     CASE WHEN c.tick_us - f.last_sent >= c.repeat_s::BIGINT * 1000000 THEN c.tick_us ELSE f.last_sent END
   FROM fold f JOIN cand c ON c.fingerprint = f.fingerprint AND c.state = f.state AND c.channel = f.channel AND c.j = f.j + 1)
"""


# -- queries ----------------------------------------------------------------------------------------


def alert_rules(spark, sf_dir):
    """Enabled rules with fingerprints, and how many points of the given tables each looks at."""
    points = ops.rule_points(views.metrics(spark, sf_dir), SELECTORS, "1990-01-01", "2030-01-01")
    counts = points.groupBy("rule_name").agg(F.count(F.lit(1)).alias("points"))
    rules = ops.load_rules(rule_groups(spark))
    return rules.join(counts, F.col("name") == F.col("rule_name"), "left").select(
        "name", "severity", ops.fingerprint(F.col("name"), F.col("labels")).alias("fingerprint"),
        F.coalesce("points", F.lit(0)).alias("points"),
    )


def rule_eval(spark, sf_dir):
    return evaluations(spark, sf_dir).select(
        "rule_name", "fingerprint", "tick_us", "firing", F.round("value", 4).alias("value"), "message"
    )


def rule_eval_per_series(spark, sf_dir):
    """Every series on its own, at every tick."""
    evaluated = evaluations(spark, sf_dir, per_series=True)
    label = lambda key: F.coalesce(F.col("labels")[key], F.lit(""))
    return evaluated.select(
        "rule_name", label("type").alias("l_type"), label("shard").alias("l_shard"), label("__service__").alias("l_service"),
        "tick_us", "firing",
    )


RULE_EVAL_PER_SERIES = f"""{BASE_SQL},
 s AS (SELECT rule_name, tick_us, l_shard, l_type, service_name AS l_service, min({{'t': ts, 'v': value}}).v AS fst,
         max({{'t': ts, 'v': value}}).v AS lst, count(*) AS n
       FROM seen GROUP BY 1, 2, 3, 4, 5),
 subj AS (SELECT DISTINCT r.name AS rule_name, coalesce(l_shard, '') AS l_shard, coalesce(l_type, '') AS l_type,
            coalesce(l_service, '') AS l_service
          FROM rules r LEFT JOIN s ON s.rule_name = r.name),
 g AS (SELECT u.*, t.tick_us, n, lst, CASE WHEN n >= 2 AND fst <> 0 THEN (lst - fst) / fst ELSE 0 END AS chg
       FROM subj u CROSS JOIN ticks t LEFT JOIN s ON s.rule_name = u.rule_name AND s.l_shard = u.l_shard
        AND s.l_type = u.l_type AND s.l_service = u.l_service AND s.tick_us = t.tick_us)
SELECT rule_name, l_type, l_shard, l_service, tick_us, coalesce(CASE rule_name
       WHEN 'high_purchases' THEN lst > 15
       WHEN 'jumpy_clicks' THEN n IS NOT NULL AND abs(chg) >= 0.5
       WHEN 'prices_missing' THEN n IS NULL
       WHEN 'ticks_seen' THEN lst > 0
       ELSE n IS NULL OR lst < 3 OR abs(chg) > 4 END, false) AS firing
FROM g"""


def absence(spark, sf_dir):
    """Ticks on which a rule fired because it saw no data."""
    return evaluations(spark, sf_dir).filter(F.col("message").startswith("no data")).select("rule_name", "tick_us", "message")


def absence_runs(spark, sf_dir):
    """Runs of ticks on which a rule, or one of its series, sees nothing."""
    rules = ops.load_rules(rule_groups(spark))
    points = ops.rule_points(views.metrics(spark, sf_dir), SELECTORS, FIRST, LAST, rules)
    of_rules = ops.absences(points, rules, FIRST, LAST, TICK_S).withColumn("of", F.lit("rule")).withColumn("own", F.lit(""))
    of_series = ops.absences(points, rules, FIRST, LAST, TICK_S, per_series=True).withColumn("of", F.lit("series"))
    own = F.concat_ws("|", *[F.coalesce(F.map_from_entries("series")[k], F.lit("")) for k in ("type", "shard", SERVICE_LABEL)])
    columns = ["of", "rule_name", "own", "from_us", "to_us"]
    return of_rules.select(columns).unionByName(of_series.withColumn("own", own).select(columns))


#: Every tick of every subject, joined to all it sees; then the islands of ticks that see nothing.
ABSENCE_RUNS = f"""{BASE_SQL},
 subj AS (SELECT 'rule' AS "of", name AS rule_name, '' AS own FROM rules
          UNION SELECT 'series', r.name, coalesce(p.l_type || '|' || p.l_shard || '|' || p.service_name, '||')
          FROM rules r LEFT JOIN seen p ON p.rule_name = r.name),
 has AS (SELECT DISTINCT 'rule' AS "of", rule_name, '' AS own, tick_us FROM seen
         UNION SELECT DISTINCT 'series', rule_name, l_type || '|' || l_shard || '|' || service_name, tick_us FROM seen),
 bare AS (SELECT s.*, t.tick_us FROM subj s CROSS JOIN ticks t ANTI JOIN has h
          ON h."of" = s."of" AND h.rule_name = s.rule_name AND h.own = s.own AND h.tick_us = t.tick_us),
 isle AS (SELECT *, tick_us // {_US} - row_number() OVER (PARTITION BY "of", rule_name, own ORDER BY tick_us) AS g FROM bare)
SELECT "of", rule_name, own, min(tick_us) AS from_us, max(tick_us) AS to_us FROM isle GROUP BY "of", rule_name, own, g"""


def rate_of_change(spark, sf_dir):
    return evaluations(spark, sf_dir).filter(F.col("message").startswith("rate of change")).select(
        "rule_name", "tick_us", "message", F.round("value", 4).alias("value")
    )


def alert_states(spark, sf_dir):
    return states(spark, sf_dir).select("fingerprint", "rule_name", "tick_us", "state", "starts_us")


def alert_transitions(spark, sf_dir):
    return ops.alert_transitions(states(spark, sf_dir)).select(
        "fingerprint", "rule_name", "tick_us", "state", "starts_us", "ends_us", F.round("value", 4).alias("value")
    )


def active_alerts(spark, sf_dir):
    return ops.active_alerts(states(spark, sf_dir), LAST).select("fingerprint", "rule_name", "tick_us", "starts_us")


def unsilenced(spark, sf_dir):
    silences = ops.current_silences(silence_changes(spark))
    moved = ops.alert_transitions(states(spark, sf_dir)).filter(F.col("state") != "pending")
    return ops.unsilenced(moved, silences, FIRST, LAST).select("fingerprint", "rule_name", "tick_us", "state")


def silenced(spark, sf_dir):
    """The transitions held back by silences."""
    silences = ops.current_silences(silence_changes(spark))
    moved = ops.alert_transitions(states(spark, sf_dir)).filter(F.col("state") != "pending")
    loud = ops.unsilenced(moved, silences, FIRST, LAST).select("fingerprint", "tick_us")
    return moved.join(loud, ["fingerprint", "tick_us"], "left_anti").select("fingerprint", "rule_name", "tick_us", "state")


def outbox(spark, sf_dir):
    sent = ops.outbox(states(spark, sf_dir), ops.current_silences(silence_changes(spark)), channels(spark))
    return sent.select(
        "group_key", "status", "receiver", "title", F.unix_micros("sent_at").alias("sent_us"),
        F.col("alerts")[0]["rule_name"].alias("rule_name"), F.col("alerts")[0]["starts_us"].alias("starts_us"),
        F.col("group_labels")["team"].alias("team"),
    )


QUERIES = {
    "alert_rules": (
        alert_rules,
        f"{BASE_SQL} SELECT name, severity, fingerprint, (SELECT count(*) FROM pts WHERE rule_name = rules.name) AS points FROM rules",
    ),
    "rule_eval": (
        rule_eval,
        f"{BASE_SQL} SELECT rule_name, fingerprint, tick_us, firing, round(value, 4) AS value, message FROM evals",
    ),
    "rule_eval_per_series": (rule_eval_per_series, RULE_EVAL_PER_SERIES),
    "absence": (absence, f"{BASE_SQL} SELECT rule_name, tick_us, message FROM evals WHERE starts_with(message, 'no data')"),
    "absence_runs": (absence_runs, ABSENCE_RUNS),
    "rate_of_change": (
        rate_of_change,
        f"{BASE_SQL} SELECT rule_name, tick_us, message, round(value, 4) AS value FROM evals WHERE starts_with(message, 'rate of')",
    ),
    "alert_states": (alert_states, f"{BASE_SQL} SELECT fingerprint, rule_name, tick_us, state, starts_us FROM stated"),
    "alert_transitions": (
        alert_transitions,
        f"""{BASE_SQL} SELECT fingerprint, rule_name, tick_us, state, starts_us,
            CASE WHEN state = 'resolved' THEN tick_us END AS ends_us, round(value, 4) AS value FROM trans""",
    ),
    "active_alerts": (
        active_alerts,
        f"""{BASE_SQL}, latest AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY tick_us DESC) AS rn FROM stated)
            SELECT fingerprint, rule_name, tick_us, starts_us FROM latest WHERE rn = 1 AND state = 'firing'""",
    ),
    "unsilenced": (unsilenced, f"{BASE_SQL} SELECT fingerprint, rule_name, tick_us, state FROM loud"),
    "silenced": (
        silenced,
        f"""{BASE_SQL} SELECT fingerprint, rule_name, tick_us, state FROM trans WHERE state <> 'pending'
            AND (fingerprint, tick_us) NOT IN (SELECT (fingerprint, tick_us) FROM loud)""",
    ),
    "outbox": (
        outbox,
        f"""{BASE_SQL} SELECT f.fingerprint AS group_key, f.state AS status, f.channel AS receiver,
            '[' || upper(f.state) || '] 1 alert(s)' AS title, f.tick_us AS sent_us, c.rule_name, c.starts_us, c.team
            FROM fold f JOIN cand c USING (fingerprint, state, channel, j) WHERE f.sent""",
    ),
}
