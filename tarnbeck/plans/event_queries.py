"""Queries over events, standing in for trials and ledgers: user_id is the task, k in props picks rung and sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.functions import text as T
from tarnbeck.functions.stats import percentile_bootstrap
from tarnbeck.operators.ranks import nearest_ranks
from tarnbeck.operators import conversations, frames, ledger, records, trials
from tarnbeck.streaming import events as streams

NOW = 1_707_000_000.0


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def trial_rows(spark: SparkSession, d: str) -> DataFrame:
    """(task, rung, sample, prediction, finished, passed)."""
    k = F.coalesce(T.whole_number(F.col("props"), "k"), F.lit(0))
    return events(spark, d).select(
        F.col("user_id").alias("task"), F.concat(F.lit("L"), (1 + k % 4).cast("string")).alias("rung"), F.floor(k / 4).alias("sample"), (k % 3).alias("prediction"),
        (F.col("event_type") != "error").alias("finished"), F.col("event_type").isin("purchase", "click").alias("passed"), F.col("event_id"), (F.col("user_id") % 3 == 0).alias("has_reference"),
    )


TRIALS = """k AS (SELECT *, coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 0) AS k FROM events),
t AS (SELECT user_id AS task, 'L' || CAST(1 + k % 4 AS VARCHAR) AS rung, k // 4 AS sample, k % 3 AS prediction, event_type <> 'error' AS finished,
      event_type IN ('purchase', 'click') AS passed, event_id, user_id % 3 = 0 AS has_reference FROM k)"""
WIDE = """f AS (SELECT task, rung, avg(passed::INT::DOUBLE) AS fraction FROM t WHERE finished GROUP BY ALL),
w AS (SELECT task, max(fraction) FILTER (rung = 'L1') AS l1, max(fraction) FILTER (rung = 'L2') AS l2, max(fraction) FILTER (rung = 'L3') AS l3, max(fraction) FILTER (rung = 'L4') AS l4 FROM f GROUP BY task)"""
SECONDS = "epoch_us(ts) / 1000000.0"


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def seconds(ts: str = "ts") -> F.Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000.0


def two_level_pass_rate(spark, d):
    return r6(trials.rung_stats(trial_rows(spark, d)), "pass_rate")


def first_passing_rung_hist(spark, d):
    return trials.partition(trial_rows(spark, d))


def monotonicity_sign_test(spark, d):
    return r6(trials.monotonicity(trial_rows(spark, d)), "p")


def control_effect_paired(spark, d):
    return r6(trials.paired_effect(trial_rows(spark, d)), "mean_delta", "p")


def consistency_by_cell(spark, d):
    return r6(trials.consistency(trial_rows(spark, d)), "share")


def ceiling(spark, d):
    return trials.ceiling(trial_rows(spark, d))


def headroom_curve(spark, d):
    t = trial_rows(spark, d)
    return r6(trials.rung_stats(t.join(trials.headroom(t), "task", "left_semi")), "pass_rate")


def control_grouping_sets(spark, d):
    return trials.grouped_and_total(trial_rows(spark, d), "has_reference")


def common_set_report(spark, d):
    t = trial_rows(spark, d)
    # tasks that never gave the answer 2 are left out
    gave = t.groupBy("task").agg(F.max((F.col("prediction") == 2).cast("int")).alias("gave"))
    return r6(trials.common_set(t, ("L1", "L2", "L3"), gave.where("gave = 0").select("task")), "pass_rate")


def bootstrap_ci(spark, d):
    return r6(percentile_bootstrap(trials.fractions(trial_rows(spark, d)), "rung", "fraction", 2000), "mean", "low", "high")


def retry_agreement(spark, d):
    return trials.retry_agreement(trial_rows(spark, d))


def climb_gaps(spark, d):
    return trials.climb_gaps(trial_rows(spark, d).where("not (rung = 'L1' and has_reference)"))


def climb_replay(spark, d):
    return trials.climb(trial_rows(spark, d)).groupBy("rung").agg(F.count("*").alias("trials"))


def marginality(spark, d):
    f = trials.fractions(trial_rows(spark, d)).where("rung = 'L1'")
    return f.select("task", F.round(F.abs(F.col("fraction") - 0.5), 6).alias("marginality"))


def distribution(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))


def describe_nearest_rank(spark, d):
    e = events(spark, d)
    q = nearest_ranks(e, ["event_type"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
    rest = e.groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("top"))
    return q.join(rest, "event_type")


def ledger_intervals(spark, d):
    e = events(spark, d).withColumn("t", seconds())
    out = ledger.intervals(e, "user_id", "t", F.col("event_type") == "signup", F.col("event_type").isin("error", "purchase"), F.lit(NOW), "event_id")
    return r6(out, "start", "stop")


def ledger_spend(spark, d):
    e = events(spark, d).withColumn("t", seconds())
    spans = ledger.intervals(e, "user_id", "t", F.col("event_type") == "signup", F.col("event_type").isin("error", "purchase"), F.lit(NOW), "event_id")
    return r6(ledger.spend(spans, "user_id", F.lit(1_705_000_000.0), F.lit(2.0)), "total", "session")


def monitor_stall(spark, d):
    return r6(ledger.stalls(events(spark, d).withColumn("t", seconds()), "user_id", "t", "event_id", 86_400.0), "start", "gap")


def monitor_error_share(spark, d):
    return ledger.error_share(events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


def rung_scheduler(spark, d):
    e = events(spark, d).withColumn("reward", (F.col("event_type") == "purchase").cast("double"))
    return ledger.rung_schedule(e, "user_id", "event_id", "reward")


def measured_fold(spark, d):
    e = events(spark, d).withColumns({"paid": F.when(F.col("event_type") == "purchase", F.col("value")), "viewed": F.when(F.col("event_type") == "view", F.col("value"))})
    return ledger.last_known(e, "user_id", ["ts", "event_id"], ["paid", "viewed"])


def steps_per_second(spark, d):
    return r6(ledger.steps_per_second(events(spark, d).withColumn("t", seconds()), "user_id", "t"), "rate")


def repeat_guard(spark, d):
    return conversations.repeats(events(spark, d), "user_id", "event_id", "event_type", 3)


def asof_last_view(spark, d):
    e = events(spark, d)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return frames.asof_join(left, e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("seen"), F.col("event_id").alias("tie")), "user_id", "ts", ["seen"], "tie").select("event_id", "seen")


def running_columns(spark, d):
    e = events(spark, d).select("event_id", "user_id", "value")
    return r6(frames.running(e, "user_id", ["event_id"], "value"), "cum_sum", "diff", "pct_change", "roll_mean")


def forward_fill(spark, d):
    e = events(spark, d).select("event_id", "user_id", F.when(F.col("event_type") == "view", F.col("value")).alias("v"))
    return frames.filled(e, "user_id", ["event_id"], "v").select("event_id", "v")


def interpolation(spark, d):
    e = events(spark, d).select("event_id", "user_id", F.when(F.col("event_type") == "view", F.col("value")).alias("v"))
    return r6(frames.interpolated(e, "user_id", "event_id", "v").select("event_id", "v"), "v")


def ewm(spark, d):
    return r6(frames.ewm_mean(events(spark, d), "user_id", "event_id", "value", 0.3), "ewm")


def moments(spark, d):
    v = F.col("value")
    return r6(events(spark, d).groupBy("event_type").agg(frames.skew(v).alias("skew"), frames.kurt(v).alias("kurt"), frames.sem(v).alias("sem")), "skew", "kurt", "sem")


def crosstab(spark, d):
    return frames.crosstab(trial_rows(spark, d).withColumn("kind", F.when(F.col("passed"), "pass").when(F.col("finished"), "fail").otherwise("error")), "rung", "kind", ["pass", "fail", "error"]).withColumnRenamed("pass", "n_pass").withColumnRenamed("fail", "n_fail").withColumnRenamed("error", "n_error")


def gold_regrade(spark, d):
    t = trial_rows(spark, d)
    tasks = records.resolved(t.select("task").distinct(), t.where("task % 2 = 0").select("task", (F.col("task") % 3).alias("gold")).distinct(), t.where("task % 5 <> 0").select("task", (F.col("task") % 2).alias("gold")).distinct(), "task", "gold")
    both = t.where("finished").join(tasks, "task")
    return records.regraded_by_source(both, "rung", "source", F.col("passed"), F.coalesce(F.col("prediction") == F.col("gold"), F.lit(False)))


def launch_records(spark, d):
    e = events(spark, d).select("user_id", "event_id", "event_type", F.array("event_type", F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string"))).alias("ids"))
    return records.merged_launches(e, "user_id", "event_id", ["event_type"], "ids").withColumn("ids", F.array_join("ids", ","))


def stop_shares(spark, d):
    return r6(records.stop_shares(trial_rows(spark, d).withColumn("stop", F.when(F.col("finished"), F.col("prediction").cast("string"))), "rung", "stop"), "share")


SIGN = "CASE WHEN {n} > 0 THEN round(least(1.0, 2 * list_sum([exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2.0)) for i in range(0, CAST({k} AS BIGINT) + 1)])), 6) END"

SPANS = f"""o AS (SELECT user_id, event_type, {SECONDS} AS t, lead({SECONDS}) OVER (PARTITION BY user_id ORDER BY {SECONDS}, event_id) AS nxt FROM events WHERE event_type IN ('signup', 'error', 'purchase')),
s AS (SELECT user_id, t AS start, coalesce(nxt, {NOW}) AS stop, nxt IS NULL AS open FROM o WHERE event_type = 'signup')"""

STATS = """c AS (SELECT {by}, task, count(*) AS n, count(*) FILTER (finished) AS done, avg(passed::INT::DOUBLE) FILTER (finished) AS fraction FROM {src} GROUP BY ALL)
SELECT {by}, count(*) AS attempted, count(fraction) AS scored, sum(n)::BIGINT AS trials, sum(n - done)::BIGINT AS failures, round(avg(fraction), 6) AS pass_rate FROM c GROUP BY {by}"""

def _stamped(spark, d):
    return events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))


def error_windows(spark, d):
    out = streams.windowed_errors(_stamped(spark, d), "ts", F.col("event_type") == "error", "user_id")
    return out.select(F.unix_seconds("window.start").alias("start"), "user_id", "n", "errors")


def sliding_windows(spark, d):
    out = streams.sliding_rates(_stamped(spark, d), "ts", F.col("event_type") == "purchase")
    return r6(out.select(F.unix_seconds("window.start").alias("start"), "n", "rate"), "rate")


def session_windows(spark, d):
    out = streams.sessions(_stamped(spark, d), "ts", "user_id", "6 hours")
    return out.select("user_id", F.unix_micros("session_window.start").alias("start"), F.unix_micros("session_window.end").alias("stop"), "n")


#: What the event types stand for under supervision.
SIGNALS = {"view": "result", "click": "result", "error": "failure", "purchase": "healthy", "signup": "unhealthy"}


def supervisor_alarms(spark, d):
    kind = F.create_map(*(F.lit(x) for pair in SIGNALS.items() for x in pair))[F.col("event_type")]
    e = events(spark, d).select("user_id", "event_id", F.floor(seconds() * 1000).cast("long").alias("ms"), kind.alias("kind"))
    until = F.lit(1_706_600_000_000).cast("long")
    return ledger.alarms(e, "user_id", "ms", "event_id", "kind", until, stall_ms=86_400_000, window=6, share=0.5, fails=2)


QUERIES = {f.__name__: f for f in (
    supervisor_alarms,
    error_windows, sliding_windows, session_windows,
    two_level_pass_rate, first_passing_rung_hist, monotonicity_sign_test, control_effect_paired, consistency_by_cell, ceiling, headroom_curve, control_grouping_sets, common_set_report,
    bootstrap_ci, retry_agreement, climb_gaps, climb_replay, marginality, distribution, describe_nearest_rank, ledger_intervals, ledger_spend, monitor_stall, monitor_error_share,
    rung_scheduler, measured_fold, steps_per_second, repeat_guard, asof_last_view, running_columns, forward_fill, interpolation, ewm, moments, crosstab, gold_regrade, launch_records, stop_shares,
)}

_KIND = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SIGNALS.items())
_OVER = "(PARTITION BY user_id ORDER BY ms, event_id"
ORACLE = {
    "supervisor_alarms": f"""WITH e AS (SELECT user_id, event_id, floor(epoch_us(ts) / 1000)::BIGINT AS ms, CASE event_type {_KIND} END AS kind FROM events), s AS (SELECT *, row_number() OVER {_OVER}) = 1 AS first FROM e WHERE ms <= 1706600000000),
        m AS (SELECT *, lead(ms) OVER {_OVER}) AS nxt FROM s WHERE first OR kind IN ('result', 'failure')),
        r AS (SELECT *, count(*) OVER {_OVER} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS n, sum((kind = 'failure')::INT) OVER {_OVER} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS bad FROM s WHERE kind IN ('result', 'failure')),
        h AS (SELECT *, n >= 3 AND bad >= 0.5 * n AS held FROM r), g AS (SELECT *, coalesce(lag(held) OVER {_OVER}), false) AS was FROM h),
        c AS (SELECT *, sum((kind = 'healthy')::INT) OVER {_OVER} ROWS UNBOUNDED PRECEDING) AS run FROM s WHERE kind IN ('healthy', 'unhealthy')),
        i AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ms, event_id) AS i FROM c WHERE kind = 'unhealthy')
        SELECT user_id, 'stall' AS reason, ms + 86400000 AS "at" FROM m WHERE ms + 86400000 <= 1706600000000 AND coalesce(nxt, 1706600000001) >= ms + 86400000
        UNION ALL SELECT user_id, 'errors', ms FROM g WHERE held AND NOT was UNION ALL SELECT user_id, 'health', ms FROM i WHERE i = 2""",
    "error_windows": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL",
    "sliding_windows": "SELECT (floor(epoch_us(ts) / 900000000) - k)::BIGINT * 900 AS start, count(*) AS n, round(avg((event_type = 'purchase')::INT), 6) AS rate FROM events, (VALUES (0), (1), (2), (3)) v(k) GROUP BY 1",
    "session_windows": "WITH a AS (SELECT user_id, epoch_us(ts) AS t, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 21600000000, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS i FROM a) SELECT user_id, min(t) AS start, max(t) + 21600000000 AS stop, count(*) AS n FROM b GROUP BY user_id, i",
    "ewm": "WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) SELECT a.user_id, a.event_id, round(sum(b.value * pow(0.7, a.i - b.i)) / sum(CASE WHEN b.value IS NOT NULL THEN pow(0.7, a.i - b.i) END), 6) AS ewm FROM r a JOIN r b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY ALL",
    "two_level_pass_rate": f"WITH {TRIALS}, " + STATS.format(by="rung", src="t"),
    "first_passing_rung_hist": f"""WITH {TRIALS}, {WIDE}, x AS (SELECT DISTINCT task FROM t), b AS (SELECT CASE WHEN l1 > 0.5 THEN 'L1' WHEN l2 > 0.5 THEN 'L2' WHEN l3 > 0.5 THEN 'L3' WHEN l4 > 0.5 THEN 'L4'
        WHEN coalesce(l1, l2, l3, l4) IS NULL THEN 'not scored' ELSE 'never' END AS bucket FROM x LEFT JOIN w USING (task)), n AS (SELECT unnest(['L1', 'L2', 'L3', 'L4', 'never', 'not scored']) AS bucket)
        SELECT n.bucket, count(b.bucket) AS tasks FROM n LEFT JOIN b ON n.bucket = b.bucket GROUP BY n.bucket""",
    "monotonicity_sign_test": f"""WITH {TRIALS}, {WIDE}, s AS (SELECT 'L1-L2' AS step, l1 AS lo, l2 AS hi FROM w UNION ALL SELECT 'L2-L3', l2, l3 FROM w UNION ALL SELECT 'L3-L4', l3, l4 FROM w),
        g AS (SELECT step, count(*) FILTER (lo IS NOT NULL AND hi IS NOT NULL) AS paired, count(*) FILTER (hi < lo) AS fell, count(*) FILTER (hi > lo) AS rose, count(*) FILTER ((lo IS NULL) <> (hi IS NULL)) AS unpaired FROM s GROUP BY step)
        SELECT *, {SIGN.format(n='(fell + rose)', k='least(fell, rose)')} AS p FROM g""",
    "control_effect_paired": f"""WITH {TRIALS}, {WIDE}, g AS (SELECT count(*) AS paired, count(*) FILTER (l2 > l1) AS rescued, count(*) FILTER (l2 < l1) AS hurt, round(avg(l2 - l1), 6) AS mean_delta FROM w WHERE l1 IS NOT NULL AND l2 IS NOT NULL)
        SELECT *, {SIGN.format(n='(rescued + hurt)', k='least(rescued, hurt)')} AS p FROM g""",
    "consistency_by_cell": f"WITH {TRIALS}, c AS (SELECT rung, task, min(passed) AS lo, max(passed) AS hi FROM t WHERE finished GROUP BY ALL HAVING count(*) >= 2) SELECT rung, count(*) AS cells, count(*) FILTER (lo = hi) AS agreeing, round(avg((lo = hi)::INT), 6) AS share FROM c GROUP BY rung",
    "ceiling": f"WITH {TRIALS}, c AS (SELECT task, count(*) FILTER (finished AND rung = 'L1') AS n, min(passed) FILTER (finished AND rung = 'L1') AS ok FROM t GROUP BY task) SELECT count(*) FILTER (n >= 2 AND ok) AS passed_all, count(*) FILTER (n >= 2 AND NOT ok) AS failed_once, count(*) FILTER (n < 2) AS unmeasured FROM c",
    "headroom_curve": f"WITH {TRIALS}, h AS (SELECT task FROM t WHERE finished AND rung = 'L1' GROUP BY task HAVING count(*) >= 2 AND NOT min(passed)), u AS (SELECT * FROM t WHERE task IN (SELECT task FROM h)), " + STATS.format(by="rung", src="u"),
    "control_grouping_sets": f"WITH {TRIALS}, c AS (SELECT task, has_reference, max(passed) AS ok FROM t WHERE finished GROUP BY ALL) SELECT has_reference, count(*) AS attempted, count(*) FILTER (ok) AS rescued FROM c GROUP BY GROUPING SETS ((), (has_reference))",
    "common_set_report": f"WITH {TRIALS}, h AS (SELECT task FROM t WHERE finished AND rung IN ('L1', 'L2', 'L3') AND task IN (SELECT task FROM t WHERE prediction = 2) GROUP BY task HAVING count(DISTINCT rung) = 3), u AS (SELECT * FROM t WHERE rung IN ('L1', 'L2', 'L3') AND task IN (SELECT task FROM h)), " + STATS.format(by="rung", src="u"),
    "retry_agreement": f"WITH {TRIALS}, c AS (SELECT task, count(DISTINCT prediction) AS a, count(*) AS n, max(passed) AS ok FROM t WHERE finished GROUP BY task) SELECT CASE WHEN n < 2 THEN 'single' WHEN a > 1 THEN 'disagree' WHEN ok THEN 'agree right' ELSE 'agree wrong' END AS outcome, count(*) AS tasks FROM c GROUP BY 1",
    "climb_gaps": f"""WITH {TRIALS.replace('t AS (', 't0 AS (')}, t AS (SELECT * FROM t0 WHERE NOT (rung = 'L1' AND has_reference)), {WIDE}, x AS (SELECT DISTINCT task FROM t), y AS (SELECT x.task, l1, l2, l3, l4, coalesce(l1, 0) > 0.5 AS p1, coalesce(l2, 0) > 0.5 AS p2, coalesce(l3, 0) > 0.5 AS p3, coalesce(l4, 0) > 0.5 AS p4 FROM x LEFT JOIN w USING (task))
        SELECT task, 'L1' AS gap FROM y WHERE l1 IS NULL AND (p2 OR p3 OR p4) UNION ALL SELECT task, 'L2' FROM y WHERE l2 IS NULL AND NOT p1 AND (p3 OR p4) UNION ALL SELECT task, 'L3' FROM y WHERE l3 IS NULL AND NOT (p1 OR p2) AND p4""",
    "climb_replay": f"WITH {TRIALS}, s AS (SELECT task, min(rung) AS stop FROM t WHERE finished AND passed GROUP BY task) SELECT rung, count(*) AS trials FROM t LEFT JOIN s USING (task) WHERE rung <= coalesce(stop, 'L4') GROUP BY rung",
    "marginality": f"WITH {TRIALS}, {WIDE} SELECT task, round(abs(l1 - 0.5), 6) AS marginality FROM w WHERE l1 IS NOT NULL",
    "distribution": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "describe_nearest_rank": "WITH s AS (SELECT event_type, list(value ORDER BY value) FILTER (value IS NOT NULL) AS v, count(value) AS n, round(avg(value), 4) AS mean, max(value) AS top FROM events GROUP BY event_type) SELECT event_type, n, mean, top, " + ", ".join(f"v[1 + CAST(round_even({q} * (n - 1), 0) AS BIGINT)] AS p{int(q * 100)}" for q in (0.25, 0.5, 0.75, 0.95)) + " FROM s",
    "ledger_intervals": f"WITH {SPANS} SELECT user_id, round(start, 6) AS start, round(stop, 6) AS stop, open FROM s",
    "ledger_spend": f"WITH {SPANS} SELECT user_id, round(sum((stop - start) / 3600 * 2.0), 6) AS total, round(sum(greatest(0, stop - greatest(start, 1705000000.0)) / 3600 * 2.0), 6) AS session FROM s GROUP BY user_id",
    "monitor_stall": f"WITH g AS (SELECT user_id, {SECONDS} AS t, lag({SECONDS}) OVER (PARTITION BY user_id ORDER BY {SECONDS}, event_id) AS p FROM events) SELECT user_id, round(p, 6) AS start, round(t - p, 6) AS gap FROM g WHERE t - p > 86400",
    "monitor_error_share": "WITH g AS (SELECT user_id, count(*) OVER w AS n, count(*) FILTER (event_type = 'error') OVER w AS bad FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT user_id, count(*) FILTER (n >= 5 AND bad >= 0.5 * n) AS alarms FROM g GROUP BY user_id",
    "measured_fold": "SELECT user_id, max_by(value, (ts, event_id)) FILTER (event_type = 'purchase') AS paid, max_by(value, (ts, event_id)) FILTER (event_type = 'view') AS viewed FROM events GROUP BY user_id",
    "steps_per_second": f"WITH g AS (SELECT user_id, {SECONDS} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events) SELECT user_id, CASE WHEN count(*) FILTER (i > 3) >= 3 THEN round((count(*) FILTER (i > 3) - 1) / nullif(max(t) FILTER (i > 3) - min(t) FILTER (i > 3), 0), 6) END AS rate FROM g GROUP BY user_id",
    "repeat_guard": "WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events), r AS (SELECT user_id, count(*) AS n FROM a GROUP BY user_id, event_type, g) SELECT user_id, max(n) AS longest, max(n) >= 3 AS stopped FROM r GROUP BY user_id",
    "asof_last_view": "WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max_by(value, CAST(event_id AS VARCHAR)) AS seen FROM events WHERE event_type = 'view' GROUP BY ALL) SELECT l.event_id, v.seen FROM l ASOF LEFT JOIN v ON l.user_id = v.user_id AND l.ts >= v.ts",
    "running_columns": "SELECT event_id, user_id, value, round(sum(value) OVER w, 6) AS cum_sum, max(value) OVER w AS cum_max, row_number() OVER o - 1 AS cum_count, round(value - lag(value) OVER o, 6) AS diff, round(value / nullif(lag(value) OVER o, 0) - 1, 6) AS pct_change, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS roll_mean, rank() OVER (PARTITION BY user_id ORDER BY value) AS rank FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id), w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "forward_fill": "SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM events",
    "interpolation": """WITH e AS (SELECT event_id, user_id, CASE WHEN event_type = 'view' THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
        g AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS a, first_value(v IGNORE NULLS) OVER c AS z, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ia, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER c AS iz FROM e
        WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), c AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT event_id, round(coalesce(v, a + (z - a) * (i - ia) / nullif(iz - ia, 0), a), 6) AS v FROM g""",
    "moments": "SELECT event_type, round(skewness(value), 6) AS skew, round(kurtosis(value), 6) AS kurt, round(sem(value) * sqrt(count(value) / (count(value) - 1.0)), 6) AS sem FROM events GROUP BY event_type",
    "crosstab": f"WITH {TRIALS} SELECT rung, count(*) FILTER (passed) AS n_pass, count(*) FILTER (finished AND NOT passed) AS n_fail, count(*) FILTER (NOT finished) AS n_error FROM t GROUP BY rung",
    "gold_regrade": f"WITH {TRIALS}, x AS (SELECT *, CASE WHEN task % 2 = 0 THEN task % 3 WHEN task % 5 <> 0 THEN task % 2 END AS gold, CASE WHEN task % 2 = 0 THEN 'current' WHEN task % 5 <> 0 THEN 'superseded' ELSE 'none' END AS source FROM t WHERE finished), y AS (SELECT *, coalesce(prediction = gold, false) AS ok FROM x) SELECT rung, source, count(*) AS n, count(*) FILTER (passed) AS old_passes, count(*) FILTER (ok) AS new_passes, count(*) FILTER (passed <> ok) AS flips FROM y GROUP BY ALL",
    "launch_records": "WITH i AS (SELECT user_id, event_type AS id FROM events UNION SELECT user_id, 'k' || (event_id % 3) FROM events), u AS (SELECT user_id, string_agg(id, ',' ORDER BY id) AS ids FROM i GROUP BY user_id), f AS (SELECT user_id, arg_min(event_type, event_id) AS event_type, count(*) AS launches FROM events GROUP BY user_id) SELECT user_id, event_type, launches, ids FROM f JOIN u USING (user_id)",
    "stop_shares": f"WITH {TRIALS}, c AS (SELECT rung, CASE WHEN finished THEN CAST(prediction AS VARCHAR) ELSE 'other' END AS stop, count(*) AS n FROM t GROUP BY ALL) SELECT rung, stop, n, round(n / sum(n) OVER (PARTITION BY rung), 6) AS share FROM c",
}
