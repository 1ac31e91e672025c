"""Queries on agent logs, metadata checks and screening."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import vocab as v
from ..functions.scalar import gsd_mm, rnd
from ..operators import joins, judging, logs, screening, spectral
from ..operators import timeseries as ts
from ..operators.graph import shared_folder
from ..sources import adapters as a
from ..sources import files
from .events import I, ROUNDS, _rounds
from .registry import query

LOGS = ROUNDS + """, t AS (SELECT event_id, round AS line, (['converged','escalated','no_new_evidence'])[CAST((event_id + round) % 3 + 1 AS INT)] AS fin, event_id % 5 = 0 AS esc FROM r WHERE round % 2 = 0 AND event_id % 4 > 0),
w AS (SELECT event_id, round AS line, CASE WHEN status = 'ok' THEN 'llm' ELSE status END AS source, CASE WHEN status = 'ok' THEN label END AS label FROM r WHERE round % 2 = 1),
x AS (SELECT event_id, arg_max(fin, line) AS fin, bool_or(esc) AS esc, count(*) AS n FROM t GROUP BY event_id), y AS (SELECT event_id, arg_max(source, line) AS source, arg_max_null(label, line) AS label, count(*) AS n FROM w GROUP BY event_id), z AS (SELECT DISTINCT event_id FROM r WHERE event_id % 7 = 0),
j AS (SELECT coalesce(x.event_id, y.event_id, z.event_id) AS event_id, coalesce(fin, source, 'unknown') AS status, source, label, z.event_id IS NOT NULL AS escd, coalesce(esc, false) AS esc, x.n AS nt, y.n AS nr FROM x FULL JOIN y ON x.event_id = y.event_id FULL JOIN z ON z.event_id = coalesce(x.event_id, y.event_id)),
k AS (SELECT event_id, status, escd OR esc OR status IN ('escalated', 'budget_exhausted', 'no_new_evidence', 'net_failed', 'parse_failed') OR coalesce(source IN ('net_failed', 'parse_failed'), false) AS attention, label AS visual_label, source, CASE WHEN greatest(coalesce(nt, 0), coalesce(nr, 0)) > 1 THEN 'repeated' WHEN nt IS NULL THEN 'no_trace' END AS warning FROM j)"""


def _joined(spark, d):
    r = _rounds(spark, d)
    t = r.filter("round % 2 = 0 and event_id % 4 > 0").select("event_id", F.col("round").alias("line"), a.pick(F.col("event_id") + F.col("round"), ("converged", "escalated", "no_new_evidence")).alias("final"), (F.col("event_id") % 5 == 0).alias("escalated"))
    good = F.col("status") == "ok"
    w = r.filter("round % 2 = 1").select("event_id", F.col("round").alias("line"), F.when(good, "llm").otherwise(F.col("status")).alias("source"), F.when(good, F.col("label")).alias("visual_label"))
    return logs.join_logs(t, w, r.filter("event_id % 7 = 0").select("event_id").distinct())


@query(LOGS + " SELECT * FROM k")
def log_join(spark, d):
    return _joined(spark, d)


@query(LOGS + " SELECT event_id, visual_label FROM k WHERE source NOT IN ('net_failed', 'parse_failed', 'l0_blocked')")
def log_to_vision(spark, d):
    return logs.vision_records(_joined(spark, d)).select("event_id", "visual_label")


@query(I + """, r AS (SELECT CASE WHEN id % 10 = 0 THEN concat('x', id) WHEN id % 10 = 1 THEN CAST(id + 1000000000 AS VARCHAR) ELSE CAST(id AS VARCHAR) END AS event_id, pack_id + CASE WHEN id % 10 = 2 THEN 1 ELSE 0 END AS pack_id, CASE WHEN id % 10 <> 3 THEN 1 END AS n_rounds FROM imu),
j AS (SELECT r.*, TRY_CAST(r.event_id AS BIGINT) AS number, imu.id AS known_id, imu.pack_id AS known_pack FROM r LEFT JOIN imu ON TRY_CAST(r.event_id AS BIGINT) = imu.id)
SELECT event_id, unnest(list_filter([CASE WHEN number IS NULL OR number < 0 THEN 'bad_id' END, CASE WHEN number >= 0 AND known_id IS NULL THEN 'unknown_event' END, CASE WHEN pack_id <> known_pack THEN 'other_pack' END, CASE WHEN n_rounds IS NULL THEN 'no_rounds' END], lambda q: q IS NOT NULL)) AS problem FROM j""")
def log_problems(spark, d):
    i = a.imu_events(spark, d).select("id", "pack_id")
    m = F.col("id") % 10
    r = i.select(F.when(m == 0, F.concat(F.lit("x"), F.col("id").cast("string"))).when(m == 1, (F.col("id") + 1000000000).cast("string")).otherwise(F.col("id").cast("string")).alias("event_id"), (F.col("pack_id") + (m == 2).cast("int")).alias("pack_id"), F.when(m != 3, 1).alias("n_rounds"))
    return logs.problems(r, i.select("pack_id", F.col("id").alias("event_id")))


@query(I + """, e AS (SELECT pack_id, id, (['0','1',''])[CAST(id % 3 + 1 AS INT)] AS low FROM imu), r AS (SELECT pack_id + CASE WHEN id % 6 = 1 THEN 1 ELSE 0 END AS pack_id, id, id % 4 = 0 AS attention, id % 5 > 0 AS agree FROM imu WHERE id % 6 > 0)
SELECT pack_id, count(*) AS events, count(*) FILTER (WHERE r.id IS NULL) AS unreviewed, count(*) FILTER (WHERE attention) AS attention, count(*) FILTER (WHERE NOT agree) AS disagree, count(*) FILTER (WHERE low = '1') AS low_speed, count(*) FILTER (WHERE low NOT IN ('0', '1')) AS low_speed_unknown FROM e LEFT JOIN r USING (pack_id, id) GROUP BY pack_id""")
def pack_summary(spark, d):
    i = a.imu_events(spark, d).withColumnRenamed("id", "event_id")
    e = i.select("pack_id", "event_id", a.pick(F.col("event_id"), ("0", "1", "")).alias("low_speed"))
    other = (F.col("event_id") % 6 == 1).cast("int")  # reviews of another pack's event of that id
    r = i.filter("event_id % 6 > 0").select((F.col("pack_id") + other).alias("pack_id"), "event_id", (F.col("event_id") % 4 == 0).alias("attention"), (F.col("event_id") % 5 > 0).alias("agree"))
    return logs.summarize(e, r, ["pack_id"])


@query(I + """, c AS (SELECT pack_id, count(*) AS samples, count(*) FILTER (WHERE label_raw = 'error') AS events, max(t_ms) - min(t_ms) AS ms FROM samples GROUP BY pack_id), m AS (SELECT pack_id, unnest(['samples', 'events', 'ms']) AS item, unnest([samples, events, ms]) AS value, unnest([samples + pack_id % 2, events, NULL]) AS expected FROM c)
SELECT pack_id, item, value, expected, coalesce(value = expected, true) AS ok FROM m""")
def checklist(spark, d):
    c = a.samples(spark, d).groupBy("pack_id").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("label_raw") == "error").alias("events"), (F.max("t_ms") - F.min("t_ms")).alias("ms"))
    return logs.checklist(c, {"samples": F.col("samples") + F.col("pack_id") % 2, "events": F.col("events"), "ms": F.lit(None)})


@query("SELECT event_id, strftime(ts + INTERVAL 8 HOUR - INTERVAL 600 SECOND, '%Y-%m-%d %H:%M') AS start, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS \"end\", hour(ts + INTERVAL 8 HOUR - INTERVAL 600 SECOND) + minute(ts + INTERVAL 8 HOUR - INTERVAL 600 SECOND) / 60 >= 16.5 AS evening FROM events")
def collection_window(spark, d):
    w = logs.collection_window(F.col("ts").cast("timestamp"), F.lit(600.0))
    return a.table(spark, d, "events").select("event_id", w.alias("w")).select("event_id", "w.*")


@query("SELECT vec_id, round((1000.0 * 1000 + x * x) / (1000.0 * (480 / (2 * tan(radians(68.0) / 2)))), 6) AS gsd FROM (SELECT vec_id, 500.0 + label * 250 AS x FROM embeddings)")
def ground_sampling(spark, d):
    return a.table(spark, d, "embeddings").select("vec_id", rnd(gsd_mm(500.0 + F.col("label") * 250)).alias("gsd"))


@query("""WITH r AS (SELECT item_id // 2 AS event_id, CASE WHEN item_id % 5 = 0 THEN 'other' ELSE 'llm' END AS generated, CASE WHEN item_id % 7 = 0 THEN ' ' ELSE text END AS why, CASE WHEN item_id % 11 > 0 THEN 'review.v0' END AS schema, item_id % 3 AS pack_id FROM benchmark), k AS (SELECT DISTINCT item_id % 3 AS pack_id, item_id // 2 AS event_id FROM benchmark WHERE item_id % 4 > 0),
c AS (SELECT r.*, count(*) OVER (PARTITION BY r.event_id) AS n, k.event_id IS NULL AS lost FROM r LEFT JOIN k ON k.pack_id = r.pack_id AND k.event_id = r.event_id) SELECT event_id, unnest(list_filter([CASE WHEN generated NOT IN ('llm', 'human_example') THEN 'bad_origin' END, CASE WHEN trim(coalesce(why, '')) = '' THEN 'blank_text' END, CASE WHEN n > 1 THEN 'repeated_id' END, CASE WHEN schema IS NULL THEN 'other_schema' END, CASE WHEN lost THEN 'unknown_event' END], lambda q: q IS NOT NULL)) AS problem FROM c""")
def schema_validation(spark, d):
    i = F.col("item_id")
    r = a.table(spark, d, "benchmark").select(F.floor(i / 2).alias("event_id"), F.when(i % 5 == 0, "other").otherwise("llm").alias("generated"), F.when(i % 7 == 0, " ").otherwise(F.col("text")).alias("why"), F.when(i % 11 > 0, "review.v0").alias("schema"), (i % 3).alias("pack_id"))
    known = a.table(spark, d, "benchmark").filter("item_id % 4 > 0").select((i % 3).alias("pack_id"), F.floor(i / 2).alias("event_id"))
    return logs.schema_problems(r, "review.v0", known)


@query("SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS digest FROM documents")
def file_digest(spark, d):
    return a.table(spark, d, "documents").select("doc_id", files.digest(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("digest"))


@query(I + """, t AS (SELECT pack_id, event_id, t_ms FROM samples WHERE label_raw = 'signup') SELECT i.id, min(t.event_id) AS truth FROM imu i JOIN t ON t.pack_id = i.pack_id AND abs(t.t_ms - i.t_ms) < 20 GROUP BY i.id""")
def truth_match(spark, d):
    t = a.samples(spark, d).filter("label_raw = 'signup'").select("pack_id", F.col("event_id").alias("truth"), "t_ms")
    e = a.imu_events(spark, d).select("id", "pack_id", F.col("t_ms").alias("t0"))
    return joins.interval_join(t, e, ["pack_id"], "t_ms", F.col("t0") - 19, F.col("t0") + 19, 20).groupBy("id").agg(F.min("truth").alias("truth"))


@query(I + " SELECT final_type, count(*) AS n, round(avg(peak), 6) AS peak, round(avg(duration), 6) AS duration, round(avg(speed), 6) AS speed FROM imu GROUP BY final_type")
def class_means(spark, d):
    g = a.imu_events(spark, d).groupBy("final_type")
    return g.agg(F.count(F.lit(1)).alias("n"), *[rnd(F.avg(c)).alias(c) for c in ("peak", "duration", "speed")])


@query(I + f""", x AS (SELECT pack_id, t_ms, event_id, hp, label_raw = 'error' AS truth, lead(hp) OVER w AS nx, lag(hp) OVER w AS pv FROM samples WINDOW w AS (PARTITION BY pack_id ORDER BY t_ms, event_id))
SELECT pack_id, truth, round(avg(abs(nx - hp)), 6) AS rise, round(avg(CASE WHEN sign(hp) <> sign(pv) THEN 1.0 ELSE 0 END), 6) AS zc_rate, round(max(hp) - min(hp), 6) AS p2p, round({v.MIN_THRESHOLD}, 6) AS least FROM x GROUP BY pack_id, truth""")
def screening_features(spark, d):
    w = ts.in_time()
    x = a.samples(spark, d).select("pack_id", "hp", (F.col("label_raw") == "error").alias("truth"), F.lead("hp").over(w).alias("nx"), F.lag("hp").over(w).alias("pv"))
    return x.groupBy("pack_id", "truth").agg(rnd(F.avg(F.abs(F.col("nx") - F.col("hp")))).alias("rise"), rnd(F.avg(F.coalesce((F.signum("hp") != F.signum("pv")).cast("double"), F.lit(0.0)))).alias("zc_rate"), rnd(F.max("hp") - F.min("hp")).alias("p2p"), F.lit(v.MIN_THRESHOLD).alias("least"))


AXES_SQL = I + """, ax AS (SELECT *, vz / 20 AS ax, vz / -30 AS ay, 9.81 + hp / 20 AS az, hp / 7 AS gx, vz / 9 AS gy, speed / 3 AS gz FROM samples), ev AS (SELECT id, pack_id, t_ms AS t0, t_ms + CAST(round(duration * 1000) AS BIGINT) AS t1 FROM imu)"""


def _axes(spark, d):
    s = a.samples(spark, d)
    c = F.col
    axes = s.withColumns({"ax": c("vz") / 20, "ay": c("vz") / -30, "az": 9.81 + c("hp") / 20, "gx": c("hp") / 7, "gy": c("vz") / 9, "gz": c("speed") / 3})
    e = a.imu_events(spark, d).select("id", "pack_id", c("t_ms").alias("t0_ms"), F.round(c("duration") * 1000).cast("bigint").alias("duration_ms"), "speed", "final_type")
    return axes, e


@query(AXES_SQL + """, nr AS (SELECT e.id, e.pack_id, s.*, s.t_ms BETWEEN t0 - 150 AND t1 + 400 AS own, s.t_ms BETWEEN t0 - 5000 AND t1 + 5000 AND NOT s.t_ms BETWEEN t0 - 150 AND t1 + 400 AS bg FROM ev e JOIN (SELECT * RENAME (pack_id AS pid) FROM ax) s ON s.pid = e.pack_id AND s.t_ms BETWEEN t0 - 15000 AND t1 + 15000),
g AS (SELECT id, pack_id, count(*) FILTER (WHERE own) AS n, sqrt(avg(hp * hp) FILTER (WHERE own)) AS own, coalesce(sqrt(avg(hp * hp) FILTER (WHERE bg)), 0) AS c5, coalesce(sqrt(avg(hp * hp) FILTER (WHERE NOT own)), 0) AS c15, """
  + ", ".join(f"(max({x}) FILTER (WHERE own) - min({x}) FILTER (WHERE own)) / greatest(coalesce(max({x}) FILTER (WHERE bg) - min({x}) FILTER (WHERE bg), 0), 1e-9) AS p_{x}" for x in screening.AXES)
  + """ FROM nr GROUP BY id, pack_id) SELECT id, round(c5, 6) AS ctx_rms_5s, round(c15, 6) AS ctx_rms_15s, round(own / greatest(c5, 1e-9), 6) AS contrast_5s, round(own / greatest(c15, 1e-9), 6) AS contrast_15s, round(p_az, 6) AS p2p_az, round(greatest(p_ax, p_ay), 6) AS p2p_horiz_max, round(greatest(p_gx, p_gy, p_gz), 6) AS p2p_gyro_max FROM g WHERE n >= 8""")
def screening_surroundings(spark, d):
    f = screening.surroundings(*_axes(spark, d))
    return f.select("id", *[rnd(F.col(c)).alias(c) for c in ("ctx_rms_5s", "ctx_rms_15s", "contrast_5s", "contrast_15s", "p2p_az", "p2p_horiz_max", "p2p_gyro_max")])


@query()
def screening_ranking(spark, d):
    """Every candidate feature, and how well it parts one kind of event from the rest."""
    s, e = _axes(spark, d)
    f = screening.candidates(s, e).join(e.select("pack_id", "id", "final_type"), ["pack_id", "id"])
    names = [c for c in f.columns if c not in ("pack_id", "id", "final_type")]
    return screening.ranked(f, F.col("final_type") == v.POTHOLE, names)


@query()
def tuning_grid(spark, d):
    """Floors and factors against the shaken samples, best settings last of all sorted out by recall and false alarms."""
    raw = a.raw_samples(spark, d)
    truths = raw.filter("event_id % 30 = 0 and abs(az - 9.81) > 6").select("pack_id", "t_ms")
    return screening.grid(spectral.prepare(ts.resample(raw, 10, ["ax", "ay", "az"])), truths)


@query(I + ", r AS (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY peak DESC, id) AS place FROM imu) SELECT pack_id, id, place FROM r WHERE place <= 3")
def top_events(spark, d):
    w = ts.Window.partitionBy("pack_id").orderBy(F.desc("peak"), "id")
    return a.imu_events(spark, d).withColumn("place", F.row_number().over(w)).filter("place <= 3").select("pack_id", "id", "place")


@query(AXES_SQL + """, nr AS (SELECT e.id, e.pack_id, s.event_id AS n, s.t_ms AS ts, abs(s.hp) AS a FROM ev e JOIN (SELECT * RENAME (pack_id AS pid) FROM ax) s ON s.pid = e.pack_id AND s.t_ms BETWEEN t0 - 150 AND t1 + 900),
o AS (SELECT *, row_number() OVER (PARTITION BY pack_id, id ORDER BY ts, n) AS i FROM nr), p AS (SELECT pack_id, id, arg_max(i, {'a': a, 'i': -i}) AS i, max(a) AS peak FROM o GROUP BY ALL),
af AS (SELECT o.*, a < 0.3 * peak AS below, ts - min(ts) OVER (PARTITION BY o.pack_id, o.id) AS ms FROM o JOIN p ON p.pack_id = o.pack_id AND p.id = o.id AND o.i >= p.i),
ld AS (SELECT *, coalesce(lead(below, 3) OVER (PARTITION BY pack_id, id ORDER BY i), last_value(below) OVER (PARTITION BY pack_id, id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS later FROM af)
SELECT id, min(ms) FILTER (WHERE below AND later) AS decay_ms FROM ld GROUP BY id""")
def decay_time(spark, d):
    return screening.decay_ms(*_axes(spark, d)).select("id", "decay_ms")


# the loop over recorded answers, told case by case: a first answer, evidence if the rules ask for it and there is any, a second answer
ANSWERS = """WITH c AS (SELECT conv_id, length(max(text) FILTER (WHERE turn = 0)) AS n1, length(max(text) FILTER (WHERE turn = 1)) AS n2 FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id AS event_id, conv_id % 10 = 0 AS blocked, conv_id % 4 AS usable, conv_id % 5 % 3 AS spare, CASE conv_id % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 9.0 END AS crest,
(['坑洼','平路','纵向裂缝','粗糙路面','井盖'])[CAST(coalesce(n1, 0) % 5 + 1 AS INT)] AS l1, (['high','mid','low','high'])[CAST(coalesce(n1, 0) % 4 + 1 AS INT)] AS c1,
(['坑洼','平路','纵向裂缝','粗糙路面','井盖'])[CAST(coalesce(n2, 0) % 5 + 1 AS INT)] AS l2, (['high','mid','low','high'])[CAST(coalesce(n2, 0) % 4 + 1 AS INT)] AS c2 FROM c),
d AS (SELECT *, usable <= 1 AS r2, l1 IN ('坑洼','纵向裂缝','粗糙路面') AND coalesce(crest, 0) < 4 AS r3 FROM r),
e AS (SELECT *, least(spare, CASE WHEN r2 THEN 3 ELSE 0 END + CASE WHEN r3 THEN 2 ELSE 0 END) AS got FROM d),
f AS (SELECT *, CASE WHEN blocked THEN 'blocked' WHEN c1 = 'low' THEN 'escalated' WHEN NOT r2 AND NOT r3 THEN 'converged' WHEN got = 0 THEN 'no_new_evidence' WHEN r2 OR c2 = 'low' THEN 'escalated' ELSE 'converged' END AS final,
CASE WHEN blocked THEN 0 WHEN c1 = 'low' OR NOT (r2 OR r3) OR got = 0 THEN 1 ELSE 2 END AS calls FROM e),
g AS (SELECT *, CASE WHEN blocked THEN '遮挡/无法判定' WHEN calls = 2 THEN l2 ELSE l1 END AS label, usable + CASE WHEN calls = 2 THEN got ELSE 0 END AS seen FROM f)
SELECT event_id, label AS visual_label, CASE WHEN blocked THEN 'high' WHEN final = 'escalated' THEN 'low' WHEN label NOT IN ('坑洼','纵向裂缝','粗糙路面') THEN CASE WHEN seen >= 2 THEN 'high' WHEN seen = 1 THEN 'mid' ELSE 'low' END
WHEN crest >= 4 AND seen >= 2 THEN 'high' WHEN seen >= 2 AND NOT (final = 'no_new_evidence' AND r3) THEN 'mid' ELSE 'low' END AS confidence, CASE WHEN blocked THEN 'l0_blocked' ELSE 'llm' END AS source, final, calls FROM g"""


def recorded(record):
    """A model that gives a record's answers in turn."""
    left = list(record["answers"])
    return lambda request: left.pop(0) if len(left) > 1 else left[0]


@query(ANSWERS)
def judged_events(spark, d):
    """The judging loop over recorded answers, written so that it can be resumed, and read back."""
    text = lambda turn: F.length(F.max(F.when(F.col("turn") == turn, F.col("text"))))
    c = a.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("event_id")).agg(text(0).alias("n1"), text(1).alias("n2"))
    i = F.col("event_id")
    answer = lambda n: F.to_json(F.struct(a.pick(F.coalesce(n, F.lit(0)), (v.POTHOLE, v.FLAT, v.LONGITUDINAL, v.ROUGH, v.MANHOLE)).alias("visual_label"), a.pick(F.coalesce(n, F.lit(0)), ("high", "mid", "low", "high")).alias("confidence"), F.lit("").alias("why")))
    records = c.select(
        "event_id", (i % 10 == 0).alias("blocked"), F.concat(F.lit("event "), i.cast("string")).alias("text"), F.array(F.lit("k")).alias("keyframes"), (i % 4).cast("int").alias("usable"),
        F.slice(F.array(F.lit("x"), F.lit("y")), F.lit(1), (i % 5 % 3).cast("int")).alias("spare"), F.when(i % 3 == 0, 1.5).when(i % 3 == 1, 9.0).alias("crest"), F.array(answer(F.col("n1")), answer(F.col("n2"))).alias("answers"),
    )
    path = f"{shared_folder(spark).rstrip('/')}/reviews-{uuid.uuid4().hex}"
    judging.judge_into(records, recorded, path, buckets=16).write.format("noop").mode("overwrite").save()
    return judging.reviews(spark, path).select("event_id", "visual_label", "confidence", "source", "final", "calls")
