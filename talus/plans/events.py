"""Event, session and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import columns as X
from talus.operators import events as E
from talus.operators.related import related
from talus.plans.registry import query, table

HOUR = 3_600_000_000


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS card, count(DISTINCT user_id) AS viewers, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1")
def evt_unique_viewers(spark, sf_dir):
    """Distinct viewers per card (A14 ST2)."""
    v = events(spark, sf_dir).where("event_type = 'view'").withColumn("card", F.get_json_object("props", "$.k").cast("long"))
    return E.unique_viewers(v, "card", "user_id")


@query(
    """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    f AS (SELECT user_id, event_id, rn, us AS start, 1 AS n FROM o WHERE rn = 1 UNION ALL
      SELECT o.user_id, o.event_id, o.rn, CASE WHEN o.us >= f.start + 21600000000 THEN o.us ELSE f.start END, CASE WHEN o.us >= f.start + 21600000000 THEN 1 ELSE f.n + 1 END
      FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
    SELECT user_id, event_id, CAST(n AS INTEGER) AS window_count, n <= 2 AS allowed FROM f"""
)
def evt_rate_limit_fixed(spark, sf_dir):
    """Two events per user and six hours, windows from the first event on (ST1)."""
    return E.fixed_window_limit(events(spark, sf_dir), "user_id", "us", "event_id", 6 * HOUR, 2)


@query(
    """SELECT user_id, count(*) AS kept, max(epoch_us(ts + INTERVAL 10 DAY)) AS last_expiry FROM events WHERE ts + INTERVAL 10 DAY >= TIMESTAMP '2024-01-25 00:00:00' GROUP BY 1"""
)
def evt_retention(spark, sf_dir):
    """Rows alive at a given time under a ten-day retention (ST3 P16)."""
    e = events(spark, sf_dir)
    kept = E.retained(e, F.col("ts").cast("timestamp"), F.lit("2024-01-25 00:00:00").cast("timestamp"), 10)
    return kept.groupBy("user_id").agg(F.count("*").alias("kept"), F.max(F.unix_micros("expires_at")).alias("last_expiry"))


@query("SELECT event_id, user_id, value FROM events WHERE event_type <> 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
def evt_recent_list(spark, sf_dir):
    """The fifty newest live rows."""
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    return e.orderBy(F.desc_nulls_first("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "value")


@query(
    """SELECT user_id, event_id, value FROM (SELECT *, CASE WHEN value < 5 THEN NULL ELSE value END AS v FROM events) ORDER BY v ASC NULLS LAST, event_id LIMIT 20 OFFSET 10"""
)
def evt_offset_page(spark, sf_dir):
    """A page by offset, unknown values last."""
    e = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("value") >= 5, F.col("value")))
    return e.orderBy(F.asc_nulls_last("v"), F.asc("event_id")).offset(10).limit(20).select("user_id", "event_id", "value")


@query(
    """WITH w(answer, code, weight) AS (VALUES ('view', 'explorer', 2), ('click', 'explorer', 3), ('click', 'planner', 1), ('purchase', 'buyer', 5), ('signup', 'planner', 4), ('error', 'buyer', 1)),
    s AS (SELECT user_id, code, CAST(sum(weight) AS BIGINT) AS votes FROM events JOIN w ON answer = event_type GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, code) AS rn FROM s)
    SELECT user_id, max(code) FILTER (WHERE rn = 1) AS winner, max(code) FILTER (WHERE rn = 2) AS runner_up, CAST(sum(votes) AS BIGINT) AS power,
      CASE WHEN sum(votes) >= 300 THEN 'high' WHEN sum(votes) >= 150 THEN 'middle' ELSE 'low' END AS grade FROM r GROUP BY 1"""
)
def vote_persona(spark, sf_dir):
    """Weighted vote with winner, runner-up and grade."""
    rows = [("view", "explorer", 2), ("click", "explorer", 3), ("click", "planner", 1), ("purchase", "buyer", 5), ("signup", "planner", 4), ("error", "buyer", 1)]
    weights = spark.createDataFrame(rows, "answer string, code string, weight int")
    return E.vote(events(spark, sf_dir).select("user_id", F.col("event_type").alias("answer")), weights, "user_id")


@query(
    """WITH RECURSIVE o AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    f AS (SELECT user_id, rn, [s] AS path FROM o WHERE rn = 1 UNION ALL
      SELECT o.user_id, o.rn, list_append(list_filter(path, lambda x: x < o.s), o.s) FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
    SELECT user_id, array_to_string(arg_max(path, rn), '>') AS path FROM f GROUP BY 1"""
)
def evt_answer_path(spark, sf_dir):
    """Answer path with truncation from a repeated step (ST7)."""
    e = events(spark, sf_dir).select("user_id", "event_id", (F.get_json_object("props", "$.k").cast("long") % 6).alias("s"))
    return E.answer_path(e, "user_id", "event_id", "s").select("user_id", F.array_join("path", ">").alias("path"))


@query(
    """SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS k_plus, '{"k":"' || json_extract_string(props, '$.k') || '","seen":"1"}' AS with_seen,
    '{"k":"7","t":"' || event_type || '"}' AS merged, 1 AS n_keys FROM events"""
)
def json_props_ops(spark, sf_dir):
    """JSON field, cast, set, shallow merge and size."""
    p = F.col("props")
    k = F.get_json_object(p, "$.k")
    new = F.to_json(F.create_map(F.lit("k"), F.lit("7"), F.lit("t"), F.col("event_type")))
    return events(spark, sf_dir).select(
        "event_id", k.alias("k"), (F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)") + 1).alias("k_plus"), X.json_set(p, "seen", F.lit("1")).alias("with_seen"),
        X.json_merge(p, new).alias("merged"), F.size(F.json_object_keys(p)).alias("n_keys"),
    )




@query(
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 50 = 0),
    s AS (SELECT q.vec_id AS q, e.vec_id AS c, list_cosine_similarity(q.v, e.v) AS cos FROM q JOIN e ON q.label = e.label AND q.vec_id <> e.vec_id)
    SELECT q, c, round(cos, 6) AS cos, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(cos, 9) DESC, c) AS rn FROM s) WHERE rn <= 3"""
)
def vec_related_topk(spark, sf_dir):
    """Three related rows of the same topic by cosine, for the stated queries."""
    got = related(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", F.expr("vec_id % 50 = 0"), 3, 9)
    return got.select("q", "c", F.round("score", 6).alias("cos"), "rank")


def _hybrid_sql(extra: str) -> str:
    return f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, ['t' || vec_id % 3, 't' || vec_id % 5, 't' || vec_id % 3] AS tags, vec_id % 9 AS views FROM embeddings),
    q AS (SELECT * FROM e WHERE vec_id % 50 = 0),
    s AS (SELECT q.vec_id AS q, e.vec_id AS c, round(100 * list_cosine_similarity(q.v, e.v) + 8 * len(list_filter(q.tags, lambda x: list_contains(e.tags, x)))
      + {extra}, 6) AS score FROM q JOIN e ON q.label = e.label AND q.vec_id <> e.vec_id)
    SELECT q, c, score, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rn FROM s) WHERE rn <= 3"""


def _hybrid(spark, sf_dir, bonus):
    """Cosine and tag overlap (repeats on the left count) with a bonus of the candidate's own columns."""
    i = F.col("vec_id")
    tag = lambda n: F.concat(F.lit("t"), (i % n).cast("string"))
    e = table(spark, sf_dir, "embeddings").withColumns({"tags": F.array(tag(3), tag(5), tag(3)), "views": i % 9, "featured": i % 10 == 0})
    got = related(e, "label", "vec_id", "embedding", i % 50 == 0, 3, 6, 100.0, "tags", 8.0, bonus)
    return got.withColumn("score", F.round("score", 6))


@query(_hybrid_sql("CASE WHEN e.vec_id % 10 = 0 THEN 2 ELSE 0 END + least(e.views, 20) / 20.0::DOUBLE"))
def vec_hybrid_related(spark, sf_dir):
    """Cosine, tag overlap, featured and views in one score (V2 U4)."""
    return _hybrid(spark, sf_dir, F.when(F.col("featured"), 2).otherwise(0) + F.least("views", F.lit(20)) / 20)


@query(_hybrid_sql("0"))
def vec_hybrid_plain(spark, sf_dir):
    """The same without featured and views (V3)."""
    return _hybrid(spark, sf_dir, F.lit(0))
