"""Lineage and activity: manifests, sessions and streams over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespan.operators import link as L
from lorespan.operators import rollup as R
from lorespan.sources.folders import work_dir
from lorespan.streaming import jobs as J

from .base import table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


_EV = """ev AS (SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS session, ts, event_id AS seq, CASE WHEN user_id % 5 <> 0 THEN 'a' || CAST(user_id % 3 AS VARCHAR) END AS agent,
  CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN 1 ELSE 0 END AS exit_code, CASE WHEN k % 4 <> 0 THEN value END AS wall_s, event_type || CAST(k % 10 AS VARCHAR) || '.py' AS script,
  ['f' || CAST(k AS VARCHAR), 'f' || CAST(k + 1 AS VARCHAR)] AS inputs, ['f' || CAST(k * 2 AS VARCHAR)] AS outputs FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))"""


def _events(s, d):
    k = F.get_json_object("props", "$.k").cast("long")
    f = lambda x: F.concat(F.lit("f"), x.cast("string"))
    e = table(s, d, "events").withColumn("k", k)
    k = F.col("k")
    return e.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("session"), "ts", F.col("event_id").alias("seq"), F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("a"), (F.col("user_id") % 3).cast("string"))).alias("agent"),
        F.when(k % 7 == 0, None).when(k % 5 == 0, 1).otherwise(0).alias("exit_code"), F.when(k % 4 != 0, F.col("value")).alias("wall_s"), F.concat("event_type", (k % 10).cast("string"), F.lit(".py")).alias("script"),
        F.array(f(k), f(k + 1)).alias("inputs"), F.array(f(k * 2)).alias("outputs"),
    )


def _once(column: str, name: str) -> str:
    """Distinct values of a list column of ev in the order in which they first came."""
    return f"{name} AS (SELECT session, string_agg(x, ',' ORDER BY r, j) AS l, count(*) AS n FROM (SELECT session, x, r, j, row_number() OVER (PARTITION BY session, x ORDER BY r, j) AS k FROM (SELECT session, row_number() OVER (PARTITION BY session ORDER BY ts, seq) AS r, unnest({column}) AS x, generate_subscripts({column}, 1) AS j FROM ev)) WHERE k = 1 GROUP BY session)"


@query(
    f"WITH {_EV}, {_once('inputs', 'i')}, {_once('outputs', 'o')}, {_once('[script]', 'c')}, f AS (SELECT session, script FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, seq) AS r FROM ev) WHERE r = 1) "
    "SELECT session, count(*) AS n_actions, string_agg(DISTINCT coalesce(agent, 'main'), ',' ORDER BY coalesce(agent, 'main')) AS agents, count(wall_s) AS n_timed, round_even(sum(wall_s), 3) AS total_wall, count(*) FILTER (exit_code = 0) AS n_passed, count(*) FILTER (exit_code <> 0) AS n_failed, count(*) FILTER (exit_code IS NULL) AS n_unknown, "
    "any_value(f.script) AS first_script, any_value(i.n) AS n_inputs, any_value(o.n) AS n_outputs, any_value(i.l) AS inputs, any_value(o.l) AS outputs, any_value(c.l) AS scripts, arg_min('g' || seq, (ts, seq)) FILTER (seq % 3 = 0) AS git_sha, coalesce(string_agg(DISTINCT 'w' || (seq % 4), ',' ORDER BY 'w' || (seq % 4)) FILTER (seq % 5 = 0), '') AS warnings FROM ev JOIN f USING (session) JOIN i USING (session) JOIN o USING (session) JOIN c USING (session) GROUP BY session"
)
def lineage_manifest(s, d):
    q = F.col("seq")
    e = _events(s, d).withColumn("git_sha", F.when(q % 3 == 0, F.concat(F.lit("g"), q.cast("string")))).withColumn("warnings", F.when(q % 5 == 0, F.array(F.concat(F.lit("w"), (q % 4).cast("string")))).otherwise(F.array().cast("array<string>")))
    return R.lineage_manifest(e).drop("started", "ended").withColumns({c: F.array_join(c, ",") for c in ("inputs", "outputs", "scripts", "warnings")})


@query(f"WITH {_EV} SELECT DISTINCT script, unnest(inputs) AS path, 'read' AS kind FROM ev UNION SELECT DISTINCT script, unnest(outputs), 'write' FROM ev")
def lineage_edges(s, d):
    return L.lineage_edges(_events(s, d))


@query(
    f"WITH RECURSIVE {_EV}, st AS (SELECT DISTINCT 'p' AS k0, unnest(outputs) AS x0, 's' AS k1, script AS x1 FROM ev UNION SELECT DISTINCT 's', script, 'p', unnest(inputs) FROM ev), up(k, x) AS (SELECT 'p', 'f40' UNION SELECT k1, x1 FROM up JOIN st ON k0 = k AND x0 = x) SELECT x AS path FROM up WHERE k = 'p' AND x <> 'f40'"
)
def upstream(s, d):
    return L.upstream(L.lineage_edges(_events(s, d)), "f40")


@query(
    f"WITH {_EV}, p AS (SELECT session, ts, unnest(outputs) AS path FROM ev), st AS (SELECT session, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000) AS BIGINT) AS minutes, count(DISTINCT path) AS n FROM p GROUP BY 1), nm AS (SELECT session, string_agg(path, ', ' ORDER BY path) AS names FROM (SELECT session, path, row_number() OVER (PARTITION BY session ORDER BY path) AS k FROM (SELECT DISTINCT session, path FROM p)) WHERE k <= 3 GROUP BY 1) "
    "SELECT session, minutes, n AS n_files, names || CASE WHEN n > 3 THEN ' (+' || CAST(n - 3 AS VARCHAR) || ' more)' ELSE '' END AS files FROM st JOIN nm USING (session)"
)
def session_stats(s, d):
    return R.session_stats(_events(s, d).select("session", "ts", F.explode("outputs").alias("path")))


@query(f"WITH {_EV} SELECT path, CAST(ts AS DATE) AS day, count(*) AS n FROM (SELECT ts, unnest(inputs) AS path FROM ev) GROUP BY ALL")
def read_telemetry(s, d):
    return R.read_telemetry(_events(s, d).select(F.explode("inputs").alias("path"), "ts"))


@query("SELECT c.cluster, e.event_id AS \"commit\", e.ts, CAST(row_number() OVER (PARTITION BY c.cluster ORDER BY e.ts, e.event_id) AS INTEGER) AS rank FROM (SELECT user_id AS cluster, min(ts) AS f, max(ts) AS l FROM events WHERE event_type = 'error' GROUP BY 1) c JOIN events e ON e.ts BETWEEN c.f AND c.l AND e.event_type = 'click' QUALIFY rank <= 5")
def attach_commits(s, d):
    e = table(s, d, "events")
    clusters = e.filter("event_type = 'error'").groupBy(F.col("user_id").alias("cluster")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    commits = e.select(F.col("event_id").alias("commit"), "ts", F.when(F.col("event_type") == "click", "Fix it again").otherwise("other").alias("message"))
    return L.attach_commits(clusters, commits)


def _run(s, d, job, name):
    out = work_dir(s, name)
    job(J.stream_events(s, f"{d}/event[s].parquet"), out).awaitTermination()
    return out


def _run_closed(s, d, job, name):
    """A run over the events and, after them, the event that closes all windows."""
    out, inbox = work_dir(s, name), work_dir(s, f"{name}-in")
    e = table(s, d, "events")
    e.select("event_id", "ts", "user_id", "event_type", "value", "props").write.parquet(inbox)
    job(J.stream_events(s, inbox), out).awaitTermination()
    J.close_stream(e, inbox)
    job(J.stream_events(s, inbox), out).awaitTermination()
    return out


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_counts(s, d):
    return s.read.parquet(_run_closed(s, d, J.stream_counts, "counts") + "/rows").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH x AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events), y AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM x) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM y GROUP BY user_id, k")
def stream_sessions(s, d):
    return s.read.parquet(_run_closed(s, d, J.stream_sessions, "sessions") + "/rows").withColumn("start", F.unix_micros("start"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_actions, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_manifest(s, d):
    rows = J.latest_manifest(s, _run(s, d, J.stream_manifest, "manifest"))
    return rows.select("user_id", "day", "n_actions", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), F.round("total", 4).alias("total"))


@query("SELECT event_id, user_id, event_type, props FROM events")
def stream_append(s, d):
    return s.read.schema("event_id long, user_id long, event_type string, props string").json(_run(s, d, J.stream_append, "append") + "/rows")


@query("SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events")
def stream_activity_distinct(s, d):
    return s.read.parquet(_run(s, d, J.stream_activity_distinct, "distinct") + "/rows")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, lag(event_type) OVER w AS before, ts - lag(ts) OVER w AS quiet FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE before IS NULL OR before = 'purchase' OR quiet > INTERVAL 7 DAY")
def stream_debounce(s, d):
    return s.read.parquet(_run(s, d, J.stream_debounce, "debounce") + "/rows")


@query(
    " UNION ALL ".join(f"SELECT 'null_audit' AS \"check\", '{c}' AS \"column\", CAST(NULL AS VARCHAR) AS \"group\", round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS observed, CAST(0 AS DOUBLE) AS expected, CASE WHEN count(*) FILTER ({c} IS NULL) > 0 THEN 'warning' ELSE 'ok' END AS severity, count(*) AS n FROM events" for c in ("value", "event_type"))
    + " UNION ALL SELECT 'range_check', 'value', NULL, CAST(count(*) FILTER (value < 0 OR value > 50) AS DOUBLE), 0, CASE WHEN count(*) FILTER (value < 0 OR value > 50) > 0 THEN 'error' ELSE 'ok' END, count(value) FROM events"
)
def stream_profile_checks(s, d):
    """The table is one file, and so one batch."""
    return s.read.parquet(_run(s, d, J.stream_profile_checks, "checks") + "/rows").drop("b", "batch")


@query("SELECT user_id AS job, max(ts) AS last_run FROM events GROUP BY 1 HAVING epoch(TIMESTAMP '2024-01-31 12:00:00') - floor(epoch(max(ts))) >= 86400")
def due_jobs(s, d):
    jobs = table(s, d, "events").groupBy(F.col("user_id").alias("job")).agg(F.max("ts").alias("last_run"))
    return J.due_jobs(jobs, F.lit("2024-01-31 12:00:00"))
