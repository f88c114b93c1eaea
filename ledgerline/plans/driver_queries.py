"""The engine's operators applied to the driver's tables, with the SQL that each must equal.

Operators take their part, order and time columns as parameters, so those written for logs run here unchanged.  Amounts
are whole cents and times whole milliseconds, which no order of addition changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import text as tx
from ledgerline.functions.bootstrap import bootstrap, verdict
from ledgerline.operators import encounters as enc
from ledgerline.operators import ledgers, rollup
from ledgerline.operators.asof import asof_join, best_so_far, last_value
from ledgerline.operators.parse import ending, recognised
from ledgerline.operators.rules import Registry, Rule
from ledgerline.operators.sessions import first_seen_ids, sessions, visits, with_sessions
from ledgerline.plans import diagnostics as diag
from ledgerline.session import reachable
from ledgerline.sources import sink

HOUR = 3_600_000
GAP, TIMEOUT, WINDOW = 8 * HOUR, 12 * HOUR, 6 * HOUR

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver events with milliseconds and cents."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "props", F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("ms"), F.round(F.col("value") * 100).cast("long").alias("cents"))


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


EV = "ev AS (SELECT event_id, user_id, event_type, props, epoch_us(ts) // 1000 AS ms, round(value * 100)::BIGINT AS cents FROM events)"
SESSIONS = f"""{EV}, flagged AS (
    SELECT *, CASE WHEN lag(ms) OVER w IS NULL OR ms - lag(ms) OVER w > {GAP} OR lag(event_type) OVER w = 'error' THEN 1 ELSE 0 END AS s FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    seg AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS session_no FROM flagged)"""


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_sessions(events_of(spark, sf_dir), ["user_id"], "event_id", "ms", GAP, F.col("event_type") == "error")


@query(f"WITH {SESSIONS} SELECT event_id, user_id, session_no FROM seg")
def session_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmented(spark, sf_dir).select("event_id", "user_id", "session_no")


@query(f"""WITH {SESSIONS}, per AS (SELECT user_id, session_no, arg_min(ms, event_id) AS started_ts, arg_max(ms, event_id) AS last_ts, count(*) AS events, sum(cents)::BIGINT AS cents FROM seg GROUP BY ALL)
    SELECT user_id, session_no, started_ts, CASE WHEN lead(session_no) OVER (PARTITION BY user_id ORDER BY session_no) IS NULL THEN NULL ELSE last_ts END AS ended_ts, events, cents, last_ts - started_ts AS span_ms,
    CASE WHEN last_ts > started_ts THEN round(cents / ((last_ts - started_ts) / {HOUR}.0), 6) ELSE 0 END AS cents_per_hour FROM per""")
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segmented(spark, sf_dir)
    heads = sessions(rows, ["user_id"], "event_id", "ms")
    sums = rows.groupBy("user_id", "session_no").agg(F.sum("cents").alias("cents"))
    span = F.col("last_ts") - F.col("started_ts")
    out = heads.join(sums, ["user_id", "session_no"]).withColumn("span_ms", span)
    return out.select("user_id", "session_no", "started_ts", "ended_ts", "events", "cents", "span_ms", F.when(F.col("span_ms") > 0, F.round(F.col("cents") / (F.col("span_ms") / float(HOUR)), 6)).otherwise(0.0).alias("cents_per_hour"))


@query(f"WITH {SESSIONS} SELECT user_id, session_no, event_id, ms AS entered_ts, lead(ms) OVER (PARTITION BY user_id, session_no ORDER BY event_id) AS left_ts FROM seg WHERE event_type = 'signup'")
def dwell_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = visits(segmented(spark, sf_dir).withColumn("place", F.col("event_type")), F.col("event_type") == "signup", ["user_id", "session_no"], "event_id", "ms", "place")
    return rows.select("user_id", "session_no", "event_id", "entered_ts", "left_ts")


@query(f"WITH {EV}, k AS (SELECT (json_extract(props, '$.k'))::BIGINT AS k, min(event_id) AS first_order FROM ev GROUP BY 1) SELECT k, first_order, row_number() OVER (ORDER BY first_order, k) AS id FROM k")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_of(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return first_seen_ids(rows, "k", "event_id").select("k", "first_order", F.col("id").cast("long").alias("id"))


@query(f"""WITH {EV} SELECT event_id, user_id, last_value(CASE WHEN event_type = 'click' THEN cents END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS live_cents FROM ev
    QUALIFY event_type = 'purchase'""")
def asof_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_of(spark, sf_dir).withColumn("live_cents", last_value(F.when(F.col("event_type") == "click", F.col("cents")), ["user_id"], ["event_id"]))
    return rows.filter("event_type = 'purchase'").select("event_id", "user_id", "live_cents")


@query(f"""WITH {EV}, p AS (SELECT event_id, user_id, ms FROM ev WHERE event_type = 'purchase'), c AS (SELECT event_id AS cause, user_id, ms AS cause_ms FROM ev WHERE event_type = 'click'),
    m AS (SELECT p.event_id, p.user_id, p.ms, max(c.cause) AS last_cause FROM p LEFT JOIN c ON c.user_id = p.user_id AND c.cause < p.event_id GROUP BY ALL)
    SELECT m.event_id, m.user_id, CASE WHEN m.ms - c.cause_ms BETWEEN 0 AND {WINDOW} THEN c.cause END AS cause, CASE WHEN m.ms - c.cause_ms BETWEEN 0 AND {WINDOW} THEN round(1 - (m.ms - c.cause_ms) / {WINDOW}.0, 9) END AS confidence
    FROM m LEFT JOIN c ON c.cause = m.last_cause""")
def asof_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    cause = F.when(F.col("event_type") == "click", F.col("event_id"))
    rows = ledgers.attributed(events_of(spark, sf_dir), ["user_id"], "event_id", "ms", F.col("event_type") == "purchase", cause, WINDOW)
    return rows.select("event_id", "user_id", "cause", F.round("confidence", 9).alias("confidence"))


@query(f"""WITH {EV} SELECT p.event_id, p.user_id, c.cents AS found_cents, c.ms AS found_ms FROM (SELECT * FROM ev WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'view') c ON p.user_id = c.user_id AND p.event_id > c.event_id""")
def asof_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_of(spark, sf_dir)
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ms")
    right = e.filter("event_type = 'view'").select("event_id", "user_id", "ms", F.col("cents").alias("found_cents"))
    return asof_join(left, right, ["user_id"], "event_id", "found_cents", time="ms").select("event_id", "user_id", "found_cents", F.col("value_time").alias("found_ms"))


WEIGHTS = {"view": 1, "click": 2, "error": 3, "signup": 4, "purchase": 5}
WEIGHT_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " END"


@query(f"""WITH {EV}, r AS (SELECT event_id, user_id, max({WEIGHT_SQL}::BIGINT * 1000000000 - event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best FROM ev)
    SELECT r.event_id, r.user_id, b.event_type AS best_type, b.event_id AS best_event FROM r JOIN ev b ON b.event_id = (ceil(r.best / 1000000000.0) * 1000000000 - r.best)::BIGINT""")
def running_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair]), F.col("event_type"))
    rank = F.struct(weight.alias("w"), (-F.col("event_id")).alias("e"), F.col("event_type").alias("t"))
    rows = events_of(spark, sf_dir).withColumn("best", best_so_far(rank, ["user_id"], ["event_id"]))
    return rows.select("event_id", "user_id", F.col("best.t").alias("best_type"), (-F.col("best.e")).alias("best_event"))


@query("""WITH i AS (SELECT o_orderpriority, coalesce(c_nationkey, o_custkey) AS folded, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS total, max(round(o_totalprice * 100)::BIGINT) AS top, min(o_orderstatus) AS status
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY ALL) SELECT folded, sum(total)::BIGINT AS total, max(top) AS top, min(status) AS status FROM i GROUP BY folded""")
def owner_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("nation"))
    rows = table(spark, sf_dir, "orders").join(owners, F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderpriority", "o_custkey", "nation", cents("o_totalprice").alias("total"), cents("o_totalprice").alias("top"), F.col("o_orderstatus").alias("status"))
    return rollup.folded(rows, ["o_orderpriority"], "o_custkey", "nation", ["total"], ["top"], ["status"])


@query(f"""WITH {EV} SELECT user_id, """ + ", ".join(f"sum(CASE WHEN event_type = '{t}' THEN cents ELSE 0 END)::BIGINT AS {t}_cents" for t in WEIGHTS) + ", count(*) FILTER (event_type <> 'error') AS hits, count(*) FILTER (event_type = 'error') AS misses, max(cents) AS max_hit, arg_max(event_type, event_id) AS last_type FROM ev GROUP BY user_id")
def actor_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    split = rollup.split_sums(kind, list(WEIGHTS), F.col("cents"), "_cents")
    return events_of(spark, sf_dir).groupBy("user_id").agg(*split, F.count(F.when(kind != "error", 1)).alias("hits"), F.count(F.when(kind == "error", 1)).alias("misses"), F.max("cents").alias("max_hit"), F.max_by("event_type", "event_id").alias("last_type"))


@query(f"WITH {EV} SELECT user_id, ms // {HOUR} AS bucket, sum(cents)::BIGINT AS cents, count(*) AS n FROM ev WHERE event_type <> 'error' GROUP BY ALL")
def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_of(spark, sf_dir).filter("event_type <> 'error'")
    return rollup.time_buckets(rows, ["user_id"], "ms", HOUR, F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT c_nationkey, o_custkey, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS spent FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
    SELECT c_nationkey, o_custkey, spent FROM t QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY spent DESC, o_custkey) = 1""")
def top_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey", "o_custkey").agg(F.sum(cents("o_totalprice")).alias("spent"))
    return rollup.top_per(rows, ["c_nationkey"], F.col("spent"), "o_custkey")


ISLANDS = f"""{EV}, f AS (SELECT *, CASE WHEN ms - lag(ms) OVER w <= {TIMEOUT} THEN 0 ELSE 1 END AS s FROM ev WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)),
    i AS (SELECT *, sum(s) OVER (PARTITION BY user_id, event_type ORDER BY event_id)::BIGINT AS island FROM f)"""


@query(f"WITH {ISLANDS} SELECT user_id, event_type, island, min(event_id) AS opener, arg_min(ms, event_id) AS started_ts, arg_max(ms, event_id) AS ended_ts, count(*) AS n FROM i GROUP BY ALL")
def encounter_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enc.islands(events_of(spark, sf_dir), ["user_id", "event_type"], "event_id", "ms", TIMEOUT)
    return rows.groupBy("user_id", "event_type", "island").agg(F.min("event_id").alias("opener"), F.min_by("ms", "event_id").alias("started_ts"), F.max_by("ms", "event_id").alias("ended_ts"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ISLANDS}, g AS (SELECT user_id, event_type, island, arg_max(ms, event_id) AS ended_ts, count(*) AS n FROM i GROUP BY ALL), m AS (SELECT max(ms) AS now FROM ev)
    SELECT user_id, event_type, island, CASE WHEN now - ended_ts > CASE WHEN n > 3 THEN {8 * TIMEOUT} ELSE {TIMEOUT} END THEN 'closed' ELSE 'active' END AS status, CASE WHEN n > 3 THEN 'raid' ELSE 'group' END AS scale FROM g, m""")
def finalize_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.schema import Options

    e = events_of(spark, sf_dir)
    rows = enc.islands(e, ["user_id", "event_type"], "event_id", "ms", TIMEOUT).groupBy("user_id", "event_type", "island").agg(F.max_by("ms", "event_id").alias("ended_ts"), F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("status", F.lit("active")).withColumn("scale", F.when(F.col("n") > 3, "raid").otherwise("group"))
    now = e.agg(F.max("ms")).first()[0]
    return enc.finalized(rows, now, Options(group_timeout_ms=TIMEOUT, raid_timeout_ms=8 * TIMEOUT)).select("user_id", "event_type", "island", "status", "scale")


# One step for each event of a user: open fights that it finds timed out go, its own fight is opened or goes on.
@query(f"""WITH RECURSIVE {EV}, e AS (SELECT user_id, event_id, event_type, ms, 'ally' || (json_extract(props, '$.k'))::INTEGER % 12 AS ally, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM ev),
    run(user_id, n, seq, opener_seq, enemy, fights) AS (
        SELECT user_id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, []::STRUCT(enemy VARCHAR, opener BIGINT, ended BIGINT, allies VARCHAR[])[] FROM (SELECT DISTINCT user_id FROM e)
        UNION ALL
        SELECT user_id, n, event_id, own.opener, event_type, list_append(list_filter(alive, lambda f: f.enemy <> event_type), own) FROM (
            SELECT *, struct_pack(enemy := event_type, opener := coalesce(mine.opener, event_id), ended := ms, allies := list_distinct(list_append(coalesce(mine.allies, []), ally))) AS own FROM (
                SELECT *, list_filter(alive, lambda f: f.enemy = event_type)[1] AS mine FROM (
                    SELECT e.user_id, e.n, e.event_id, e.event_type, e.ms, e.ally, list_filter(r.fights, lambda f: e.ms - f.ended <= CASE WHEN len(f.allies) > 1 THEN {8 * TIMEOUT} ELSE {TIMEOUT} END) AS alive
                    FROM run r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))))
    SELECT user_id, seq, opener_seq, enemy FROM run WHERE n > 0""")
def encounter_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequential machine: users fight event types, and their allies take turns; the second ally makes a raid."""
    from ledgerline.schema import Options

    e = events_of(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("int") % 12)
    rows = e.select(F.lit(1).cast("long").alias("log_file_id"), F.col("user_id").alias("session_no"), F.col("event_id").alias("seq"), F.col("ms").alias("ts"), F.lit("melee_hit").alias("type"), F.concat(F.lit("ally"), "k").alias("a_canonical"), F.col("event_type").alias("b_canonical"), F.lit("owner").alias("a_side"), F.lit("enemy").alias("b_side"))
    return enc.attached(rows, Options(group_timeout_ms=TIMEOUT, raid_timeout_ms=8 * TIMEOUT, raid_allies=1)).select(F.col("session_no").alias("user_id"), "seq", "opener_seq", "enemy")


@query(f"""WITH {EV} SELECT user_id, event_id, cents AS delta, 'sale' AS reason FROM ev WHERE event_type = 'purchase' UNION ALL SELECT user_id, event_id, cents AS delta, 'coin' AS reason FROM ev WHERE event_type = 'click'""")
def ledger_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_of(spark, sf_dir)
    sales = e.filter("event_type = 'purchase'").select("user_id", "event_id", F.col("cents").alias("delta"), F.lit("sale").alias("reason"))
    return sales.unionAll(e.filter("event_type = 'click'").select("user_id", "event_id", F.col("cents").alias("delta"), F.lit("coin").alias("reason")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(scope, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey < 3")
def left_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r.filter("r_regionkey < 3"), F.col("r_regionkey") == F.col("n_regionkey"), "left").select("s_suppkey", "s_name", "n_name", "r_name")


@query("""SELECT o_orderpriority, min(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE coalesce(c.conf, 0.5) END)::DOUBLE AS min_confidence FROM orders LEFT JOIN
    (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 0.95 ELSE 0.7 END AS conf FROM customer WHERE c_mktsegment <> 'BUILDING') c ON c_custkey = o_custkey GROUP BY 1""")
def provenance_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") > 0, 0.95).otherwise(0.7).alias("conf"))
    sure = F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(F.coalesce("conf", F.lit(0.5)))
    return table(spark, sf_dir, "orders").join(links, "o_custkey", "left").groupBy("o_orderpriority").agg(F.min(sure).alias("min_confidence"))


@query(f"""WITH {EV}, x AS (SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN cents ELSE 0 END)::BIGINT AS total, count(*) FILTER (event_type = 'click') AS kills, max(ms) - min(ms) AS span_ms FROM ev GROUP BY 1)
    SELECT user_id, total, kills, span_ms, CASE WHEN span_ms > 0 THEN round(total / (span_ms / {HOUR}.0), 6) ELSE 0 END AS per_hour FROM x""")
def xp_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.plans.read import rate

    kind = F.col("event_type")
    rows = events_of(spark, sf_dir).groupBy("user_id").agg(F.sum(F.when(kind == "purchase", F.col("cents")).otherwise(0)).alias("total"), F.count(F.when(kind == "click", 1)).alias("kills"), (F.max("ms") - F.min("ms")).alias("span_ms"))
    return rows.withColumn("per_hour", F.round(rate(F.col("total"), F.col("span_ms"), HOUR), 6))


#: The generator and its seeds in 64-bit arithmetic, 200 resamples of each group.
BOOTSTRAP = """v AS (SELECT event_type AS value, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    seeds AS (SELECT value, n, list_reduce(list_prepend(xor(24301::UBIGINT, 2166136261::UBIGINT), list_transform(string_split(value, ''), lambda c: unicode(c)::UBIGINT)),
        lambda h, c: (xor(h, c) * 16777619::UBIGINT) & 4294967295::UBIGINT) AS seed FROM (SELECT DISTINCT value, n FROM v)),
    state AS (SELECT value, n, b, (seed + 1831565813::UBIGINT * (b * n + j + 1)::UBIGINT) & 4294967295::UBIGINT AS a FROM (SELECT *, unnest(range(n)) AS j FROM (SELECT *, unnest(range(200)) AS b FROM seeds))),
    mixed AS (SELECT value, n, b, (xor(a, a >> 15) * (a | 1::UBIGINT)) & 4294967295::UBIGINT AS t FROM state),
    turned AS (SELECT value, n, b, xor((t + ((xor(t, t >> 7) * (t | 61::UBIGINT)) & 4294967295::UBIGINT)) & 4294967295::UBIGINT, t) AS t FROM mixed),
    picks AS (SELECT value, n, b, floor(xor(t, t >> 14)::DOUBLE / 4294967296.0 * n)::BIGINT AS i FROM turned),
    means AS (SELECT p.value, p.n, p.b, sum(v.x) / p.n AS m FROM picks p JOIN v ON v.value = p.value AND v.i = p.i GROUP BY p.value, p.n, p.b),
    ordered AS (SELECT value, n, list(m ORDER BY m) AS ms FROM means GROUP BY value, n),
    averages AS (SELECT value, avg(x) AS mean FROM v GROUP BY 1),
    bounds AS (SELECT o.value, o.n, mean, ms[floor((1 - 0.95) / 2 * 199)::INT + 1] AS ci_low, ms[floor((1 - (1 - 0.95) / 2) * 199)::INT + 1] AS ci_high FROM ordered o JOIN averages USING (value))"""


@query(f"WITH {BOOTSTRAP} SELECT value, n, round(mean, 6) AS mean, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM bounds")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bootstrap(table(spark, sf_dir, "events"), "event_type", "value", resamples=200)
    return rows.select("value", "n", *[F.round(c, 6).alias(c) for c in ("mean", "ci_low", "ci_high")])


@query("SELECT event_type AS value, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def bootstrap_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bootstrap(table(spark, sf_dir, "events"), "event_type", "value", resamples=20)
    return rows.select("value", "n", F.round("mean", 6).alias("mean"))


@query(f"""WITH {BOOTSTRAP}, r AS (SELECT *, row_number() OVER (ORDER BY mean DESC, value) AS k FROM bounds), t AS (SELECT a.value, a.mean, a.n, a.ci_low, b.ci_high AS other FROM (SELECT * FROM r WHERE k = 1) a LEFT JOIN (SELECT * FROM r WHERE k = 2) b ON true),
    d AS (SELECT *, CASE WHEN n < 8 THEN 'top group ' || chr(39) || value || chr(39) || ' has n=' || n || ', below the minimum n (8)' WHEN ci_low <= other THEN 'top groups' || chr(39) || ' confidence intervals overlap' END AS refused_reason FROM t)
    SELECT CASE WHEN refused_reason IS NULL THEN value END AS winner, CASE WHEN refused_reason IS NULL THEN round(mean, 6) END AS winner_mean, refused_reason FROM d""")
def bootstrap_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verdict(bootstrap(table(spark, sf_dir, "events"), "event_type", "value", resamples=200))
    return rows.withColumn("winner_mean", F.round("winner_mean", 6))


@query(f"WITH {EV} SELECT event_id, ms // 1000 * 1000 AS ts, 'melee_hit' AS type, 'melee-hit-you' AS rule_id, 'user' || user_id AS target, cents AS amount FROM ev")
def log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events rendered as log lines and read back by the recogniser."""
    raw = F.concat(F.lit("["), F.date_format("at", "EEE MMM dd HH:mm:ss yyyy"), F.lit("] You slash user"), "user_id", F.lit(" for "), "cents", F.lit(" points of damage."))
    lines = events_of(spark, sf_dir).withColumn("at", F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, ms / 1000)")).withColumn("raw", raw)
    lines = lines.select("event_id", "raw").withColumn("line_ts", tx.timestamp_ms(F.col("raw"))).withColumn("overflow", F.lit(False))
    return recognised(lines).select("event_id", F.col("line_ts").alias("ts"), "type", "rule_id", "target", "amount")


@query("""WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, line_no::INTEGER AS line_no, parts[line_no] AS line, (coalesce(list_sum(list_transform(parts[1:line_no - 1], lambda x: strlen(x) + 1)), 0))::BIGINT AS byte_offset FROM l""")
def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to lines with byte offsets, in one projection."""
    parts = F.split("text", "\n", -1)
    ends = F.expr("aggregate(parts, named_struct('at', 0L, 'out', cast(array() as array<bigint>)), (a, x) -> named_struct('at', a.at + octet_length(x) + 1, 'out', concat(a.out, array(a.at))), a -> a.out)")
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", parts.alias("parts"))
    rows = rows.select("doc_id", F.posexplode(F.arrays_zip("parts", ends.alias("offsets"))).alias("n", "x"))
    return rows.select("doc_id", (F.col("n") + 1).alias("line_no"), F.col("x.parts").alias("line"), F.col("x.offsets").alias("byte_offset"))


@query(r"""SELECT regexp_replace(regexp_replace(lower(text), '''.*''', '''…''', 'gs'), '[0-9]+', '#', 'g') AS shape, count(*) AS n, arg_min(conv_id * 100000 + turn, conv_id * 100000 + turn) AS first_line FROM conversations
    GROUP BY 1 ORDER BY n DESC, first_line LIMIT 20""")
def shape_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent shapes; the top-N is the feature.  Lower-cased here, since the oracle's regexes have no look-around."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("line_no"), F.lower("text").alias("message"))
    return diag.unknown_shapes(rows, "message", "line_no", top=20).select("shape", "n", "first_line")


@query("SELECT p_partkey, p_name IN ('red widget', 'blue bolt', 'hot gear') AS exact, CASE WHEN ends_with(p_name, ' widget') THEN ' widget' WHEN ends_with(p_name, 'et') THEN 'et' WHEN ends_with(p_name, ' bolt') THEN ' bolt' END AS tail FROM part")
def dict_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", name.isin("red widget", "blue bolt", "hot gear").alias("exact"), ending(name, (" widget", "et", " bolt")).alias("tail"))


PART_RULES = [(10, "small-round", "small {what:bolt|ring}"), (20, "any-bolt", "{colour:w} bolt"), (30, "red", "red {what}"), (40, "gizmo", "{colour:w} gizmo")]


@query("""SELECT p_partkey, CASE WHEN regexp_full_match(p_name, 'small (bolt|ring)') THEN 'small-round' WHEN regexp_full_match(p_name, '\\S+ bolt') THEN 'any-bolt' WHEN regexp_full_match(p_name, 'red .+') THEN 'red'
    WHEN regexp_full_match(p_name, '\\S+ gizmo') THEN 'gizmo' END AS rule_id FROM part""".replace("\\\\", "\\"))
def rule_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping rules: the lowest rank wins."""
    rules = Registry([Rule(rank, rule_id, "part", template) for rank, rule_id, template in PART_RULES])
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("raw"), F.lit(0).cast("long").alias("line_ts"), F.lit(False).alias("overflow"))
    return recognised(rows, rules, F.col("raw")).select("p_partkey", "rule_id")


@query("SELECT p_partkey, (p_size * 1000 + (p_partkey % 10) * 100 + (p_partkey % 7) * 10 + p_partkey % 9)::BIGINT AS copper FROM part")
def coin_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    coins = F.concat(F.col("p_size"), F.lit(" platinum, "), k % 10, F.lit(" gold, "), k % 7, F.lit(" silver and "), k % 9, F.lit(" copper"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.copper(coins).alias("copper"))


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def dedup_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replayed batch is a no-op: the same rows again are taken once, rows that differ under one key raise."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return sink.idempotent(e.union(e.filter("event_id % 3 = 0")), ["event_id"])


@query("SELECT user_id, max(event_id) AS seq, count(*) AS n FROM events GROUP BY 1")
def watermark_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return sink.watermarks(e, ["user_id"], "event_id")


@query("SELECT event_type AS family, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM events GROUP BY 1")
def benchmark_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diag.family_shares(table(spark, sf_dir, "events"), F.col("event_type"))
    return rows.select("family", "n", F.round("share", 9).alias("share"))


@query("""WITH b AS (SELECT event_type AS family, count(*) / sum(count(*)) OVER () AS base FROM events WHERE event_id % 2 = 0 GROUP BY 1), o AS (SELECT event_type AS family, count(*) / sum(count(*)) OVER () AS share FROM events WHERE user_id % 5 = 0 AND NOT (event_type = 'view' AND event_id % 4 <> 0) GROUP BY 1)
    SELECT family, round(base, 9) AS baseline, round(coalesce(share, 0), 9) AS observed, round((base - coalesce(share, 0)) / base, 9) AS drop_share FROM b LEFT JOIN o USING (family) WHERE base > 0 AND (base - coalesce(share, 0)) / base > 0.5""")
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    base = diag.family_shares(e.filter("event_id % 2 = 0"), F.col("event_type"))
    seen = diag.family_shares(e.filter("user_id % 5 = 0 and not (event_type = 'view' and event_id % 4 <> 0)"), F.col("event_type"))
    return diag.drifted(base, seen).select("family", *[F.round(c, 9).alias(c) for c in ("baseline", "observed", "drop_share")])


@query("""WITH r AS (SELECT 'alpha' AS dialect, avg(CASE WHEN p_name LIKE '% bolt' OR p_name LIKE '%g%' THEN 0 ELSE 1 END) AS rate FROM part UNION ALL SELECT 'beta', avg(CASE WHEN p_name LIKE '%e%' OR p_name LIKE '%o%' OR p_name LIKE '%i%' THEN 0 ELSE 1 END) FROM part)
    SELECT CASE WHEN min(rate) > 0.05 THEN 'unknown' WHEN (SELECT count(*) FROM r WHERE rate <= (SELECT min(rate) FROM r) + 1e-9) > 1 THEN 'unknown' ELSE arg_min(dialect, rate) END AS dialect, round(1 - min(rate), 9) AS confidence FROM r""")
def detect_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    fits = {"alpha": name.like("% bolt") | name.like("%g%"), "beta": name.like("%e%") | name.like("%o%") | name.like("%i%")}
    rows = diag.detected(table(spark, sf_dir, "part"), fits)
    return rows.select("dialect", F.round("confidence", 9).alias("confidence"))


@query("""SELECT o_orderkey AS rule, o_orderpriority AS body, 'base' AS dialect FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)
    UNION ALL SELECT DISTINCT l_orderkey, 'override', 'own' FROM lineitem WHERE l_quantity > 45""")
def override_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rule"), F.col("o_orderpriority").alias("body"))
    own = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("rule")).distinct().withColumn("body", F.lit("override"))
    return diag.overridden(base, own, "rule")


@query(f"""WITH {SESSIONS}, per AS (SELECT user_id, session_no, arg_min(ms, event_id) AS started_ts, count(*) AS n FROM seg GROUP BY ALL)
    SELECT user_id, arg_max(session_no, session_no) AS session_no, arg_max(started_ts, session_no) AS started_ts, arg_max(n, session_no) AS n FROM per GROUP BY user_id""")
def live_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions(segmented(spark, sf_dir), ["user_id"], "event_id", "ms")
    return rows.filter("ended_ts is null").select("user_id", "session_no", "started_ts", F.col("events").alias("n"))


@query("SELECT event_id, epoch_us(ts) // 1000000 * 1000 AS ms FROM events")
def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("["), F.date_format("ts", "EEE MMM dd HH:mm:ss yyyy"), F.lit("] x"))
    return table(spark, sf_dir, "events").select("event_id", tx.timestamp_ms(raw).alias("ms"))


@query("SELECT l_orderkey, l_linenumber, (floor(l_quantity) * 1000 + (l_orderkey % 1000))::BIGINT AS milli, CASE WHEN l_linenumber = 1 THEN 1 ELSE l_linenumber END::BIGINT AS quantity FROM lineitem")
def progress_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentages to thousandths and counts from words."""
    whole, fraction = F.floor("l_quantity").cast("string"), F.lpad((F.col("l_orderkey") % 1000).cast("string"), 3, "0")
    count = F.when(F.col("l_linenumber") == 1, "an").otherwise(F.col("l_linenumber").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tx.milli(whole, fraction).alias("milli"), tx.quantity(count).alias("quantity"))


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'miss' WHEN 1 THEN 'riposte' WHEN 2 THEN 'dodge' WHEN 3 THEN 'parry' WHEN 4 THEN 'block' WHEN 5 THEN 'absorb' ELSE 'falls over ' || p_name END AS outcome FROM part""")
def miss_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    wording = F.element_at(F.array(*[F.lit(x) for x in ("misses", "YOU riposte", "a rat dodges", "YOU parry", "a bat blocks", "magical skin absorbs the blow", "")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.outcome(F.when(wording == "", F.concat(F.lit("falls over "), "p_name")).otherwise(wording)).alias("outcome"))
