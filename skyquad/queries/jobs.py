"""Jobs: streaming states, queue, legacy views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import with_sql
from ..storage import new_folder
from ..streaming import jobs
from .base import Registry, fixture, r6

REGISTRY = Registry()
A = REGISTRY.add
_EVENTS = {"signup": "submit", "view": "start", "purchase": "succeed", "click": "fail", "error": "error"}
_CASE = "CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'cancel' " + " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in _EVENTS.items()) + " ELSE 'cancel' END"
_JOB_EVENTS = f"WITH job_events AS (SELECT CAST(user_id AS VARCHAR) AS job_id, ts, {_CASE} AS event, event_id FROM events)"


def job_events(spark, sf_dir, stream: bool = False):
    kinds = F.create_map(*[F.lit(x) for p in _EVENTS.items() for x in p])
    if stream:
        schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
        rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(F.col("user_id").cast("string").alias("job_id"), "ts", F.when((F.col("event_type") == "click") & (F.col("event_id") % 3 == 0), "cancel").otherwise(F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("cancel"))).alias("event"), "event_id")


def shown(df, column):
    """A time as text, so that both engines' time types compare."""
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _moves() -> str:
    """The state after event e in state s, as SQL; null where nothing changes."""
    return "CASE " + " ".join(f"WHEN split_part(s, '|', 1) = '{state or 'none'}' AND split_part(e, '|', 1) = '{event}' THEN '{to}'" for state, moves in jobs.TRANSITIONS.items() for event, to in moves.items()) + " END"


#: Each job's events folded in their order, as texts of state and time.
_FOLDED = _JOB_EVENTS + f""", lists AS (SELECT job_id, count(*) AS n_events, list(event || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') ORDER BY ts, event) AS es FROM job_events GROUP BY job_id),
    folded AS (SELECT job_id, n_events, list_reduce(list_concat(['none|'], es), lambda s, e: coalesce(({_moves()}) || '|' || split_part(e, '|', 2), s)) AS s FROM lists),
    states AS (SELECT job_id, n_events, nullif(split_part(s, '|', 1), 'none') AS status, nullif(split_part(s, '|', 2), '') AS updated FROM folded)"""


def states_at_the_end(spark, events):
    """The stream runs to the end of the events; the final states are returned."""
    folder, checkpoint = new_folder(spark, "jobs"), new_folder(spark, "jobs-checkpoint")
    jobs.write_states(jobs.job_states(events), folder, checkpoint).awaitTermination()
    return shown(jobs.latest_states(spark, folder), "updated")


@A("str_03_job_states", _FOLDED + " SELECT job_id, status, updated, n_events FROM states")
def str_03(spark, sf_dir):
    return states_at_the_end(spark, job_events(spark, sf_dir, stream=True))


@A("str_06_latest_status", _JOB_EVENTS + " SELECT job_id, arg_max(event, (ts, event)) AS event, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS updated, count(*) AS n_events FROM job_events GROUP BY job_id")
def str_06(spark, sf_dir):
    return shown(jobs.latest_status(job_events(spark, sf_dir)), "updated")


@A("str_04_purge", _JOB_EVENTS + ", latest AS (SELECT job_id, max(ts) AS updated FROM job_events GROUP BY job_id) SELECT job_id, strftime(updated, '%Y-%m-%d %H:%M:%S.%f') AS updated FROM latest WHERE updated + INTERVAL 7 DAYS >= (SELECT max(ts) FROM events)")
def str_04(spark, sf_dir):
    events = job_events(spark, sf_dir)
    now = F.lit(events.agg(F.max("ts").cast("string")).first()[0]).cast(events.schema["ts"].dataType)
    return shown(jobs.purge(jobs.latest_status(events), now).select("job_id", "updated"), "updated")


@A("str_01_queue_order", _JOB_EVENTS + ", first_seen AS (SELECT job_id, min(ts) AS ts FROM job_events GROUP BY job_id) SELECT job_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, row_number() OVER (ORDER BY ts, job_id) - 1 AS \"position\", CAST((row_number() OVER (ORDER BY ts, job_id) - 1) % 5 AS INTEGER) AS worker FROM first_seen")
def str_01(spark, sf_dir):
    first = job_events(spark, sf_dir).groupBy("job_id").agg(F.min("ts").alias("ts"))
    return shown(jobs.queue_order(first, 5), "ts")


@A("top_08_first_in_queue", _JOB_EVENTS + ", first_seen AS (SELECT job_id, min(ts) AS ts FROM job_events GROUP BY job_id) SELECT job_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM (SELECT * FROM first_seen ORDER BY ts, job_id LIMIT 10) t")
def top_08(spark, sf_dir):
    first = job_events(spark, sf_dir).groupBy("job_id").agg(F.min("ts").alias("ts"))
    return shown(jobs.first_in_queue(first, 10), "ts")


@A("str_02_canceled_jobs", _FOLDED + " SELECT job_id, updated AS canceled_at FROM states WHERE status = 'Canceled'")
def str_02(spark, sf_dir):
    """Cancel requests come by a stream of their own; those count that find a job waiting or at work."""
    rows = job_events(spark, sf_dir, stream=True)
    requests = job_events(spark, sf_dir, stream=True).filter("event = 'cancel'").select("job_id", "ts")
    found = states_at_the_end(spark, jobs.with_cancellations(rows.filter("event <> 'cancel'"), requests))
    return found.filter("status = 'Canceled'").select("job_id", F.col("updated").alias("canceled_at"))


@A("fn_39_legacy_status", "SELECT event_id, CASE event_type WHEN 'view' THEN 'solving' WHEN 'signup' THEN 'none' WHEN 'purchase' THEN 'success' ELSE 'failure' END AS status FROM events")
def fn_39(spark, sf_dir):
    status = F.col("event")
    named = job_events(spark, sf_dir).select("event_id", F.when(status == "submit", "Queued").when(status == "start", "Solving").when(status == "succeed", "Success").otherwise("Failure").alias("s"))
    return named.select("event_id", jobs.legacy_status("s").alias("status"))


@A("fn_40_calibration", with_sql("search_centers") + " SELECT CAST(run_id AS VARCHAR) AS job_id, round(dec, 6) + 0e0 AS orientation, radius, ra, dec, CAST(CASE WHEN run_id % 2 = 0 THEN -1 ELSE 1 END AS INTEGER) AS parity, round(radius*1600, 6) AS width_arcsec, round(radius*1200, 6) AS height_arcsec, radius AS pixscale FROM search_centers WHERE run_id % 3 > 0")
def fn_40(spark, sf_dir):
    rows = fixture(spark, sf_dir, "search_centers").select(
        F.col("run_id").cast("string").alias("job_id"), F.when(F.col("run_id") % 3 > 0, "Success").otherwise("Failure").alias("status"), r6(F.col("dec")).alias("orientation"), "radius", "ra", "dec",
        F.when(F.col("run_id") % 2 == 0, "Normal").otherwise("flipped").alias("parity"), F.col("radius").alias("pix_scale"), F.lit(1600).alias("width"), F.lit(1200).alias("height"),
    )
    return jobs.calibration(rows).withColumns({c: r6(F.col(c)) for c in ("width_arcsec", "height_arcsec")})


_LEGACY = "CASE WHEN run_id % 5 = 0 THEN NULL WHEN run_id % 5 < 3 THEN 'ul' WHEN run_id % 5 = 3 THEN 'ev' ELSE 'xx' END AS scale_type, CASE run_id % 3 WHEN 0 THEN 'degwidth' WHEN 1 THEN 'arcminwidth' ELSE 'arcsecperpix' END AS scale_units, CASE WHEN run_id % 11 = 0 THEN radius*9 ELSE radius END AS scale_lower, radius*3 AS scale_upper, radius*2 AS scale_est, ra AS center_ra, CASE WHEN run_id % 7 = 0 THEN NULL ELSE dec END AS center_dec, CASE WHEN run_id % 13 = 0 THEN 0e0 ELSE 10e0 END AS search_radius, 1600 AS width, 1200 AS height"


@A("flt_19_legacy_scales", with_sql("search_centers") + f""", j AS (SELECT run_id, {_LEGACY} FROM search_centers),
    v AS (SELECT *, search_radius > 0 AND (center_dec IS NULL OR (scale_type IS NULL OR (scale_type = 'ul' AND scale_lower <= scale_upper) OR scale_type = 'ev')) AS valid,
          CASE scale_units WHEN 'degwidth' THEN 1e0 WHEN 'arcminwidth' THEN 1e0/60 ELSE sqrt(1600e0*1600 + 1200e0*1200)*0.5e0/3600 END AS f FROM j)
    SELECT run_id, valid, round(CASE WHEN valid AND center_dec IS NOT NULL THEN CASE scale_type WHEN 'ul' THEN scale_upper*f WHEN 'ev' THEN scale_est*f END END, 6) AS max_field_radius,
           round(CASE WHEN valid AND center_dec IS NOT NULL THEN CASE scale_type WHEN 'ul' THEN scale_lower*f WHEN 'ev' THEN scale_est*f END END, 6) AS min_field_radius FROM v""")
def flt_19(spark, sf_dir):
    rows = fixture(spark, sf_dir, "search_centers").selectExpr("run_id", *[p.strip() for p in _split(_LEGACY)])
    found = jobs.legacy_field_radii(rows)
    return found.select("run_id", "valid", F.round("max_field_radius", 6).alias("max_field_radius"), F.round("min_field_radius", 6).alias("min_field_radius"))


def _split(columns: str) -> list[str]:
    import re

    return re.split(r",\s*(?=CASE|radius|ra AS|1600|1200)", columns)


_BYTES = " || ".join(f"substr(h, {2 * i + 1}, 2)" for i in (3, 2, 1, 0, 5, 4, 7, 6, *range(8, 16)))


@A("fn_38_short_id", with_sql("search_centers") + f" SELECT run_id, regexp_replace(to_base64(unhex({_BYTES})), '[/+=]', '', 'g') AS short_id FROM (SELECT run_id, md5(CAST(run_id AS VARCHAR)) AS h FROM search_centers) t")
def fn_38(spark, sf_dir):
    rows = fixture(spark, sf_dir, "search_centers").select("run_id", F.md5(F.col("run_id").cast("string").cast("binary")).alias("guid"))
    return rows.select("run_id", jobs.short_id("guid").alias("short_id"))


_REST_JOBS = with_sql("search_centers") + ", j AS (SELECT CAST(run_id AS VARCHAR) AS id, CASE WHEN run_id % 3 = 0 THEN 'Success' ELSE 'Failure' END AS status, run_id % 3 = 0 AS ok, run_id*3 AS stars, ra, dec, radius FROM search_centers)"


@A("prj_02_rest_jobs", _REST_JOBS + " SELECT id, status, CAST(1600 AS BIGINT) AS image_width, stars AS stars_detected, CASE WHEN ok THEN ra END AS ra, CASE WHEN ok THEN radius END AS field_radius FROM j")
def prj_02(spark, sf_dir):
    rows, ok = fixture(spark, sf_dir, "search_centers"), F.col("run_id") % 3 == 0
    given = rows.select(
        F.col("run_id").cast("string").alias("job_id"), F.when(ok, "Success").otherwise("Failure").alias("status"), F.lit(1600).cast("long").alias("width"), (F.col("run_id") * 3).alias("n_stars"),
        F.when(ok, F.col("ra")).alias("ra"), "dec", "radius", F.lit(1e0).alias("orientation"), F.lit(2e0).alias("pix_scale"), F.lit("normal").alias("parity"),
    )
    seen = jobs.rest_view(given)
    return seen.select("id", "status", F.col("imageWidth").alias("image_width"), F.col("starsDetected").alias("stars_detected"), "solution.ra", F.col("solution.fieldRadius").alias("field_radius"))


_ASKED = with_sql("search_centers") + """,
    a AS (SELECT run_id, 'p' || CAST(run_id AS VARCHAR) || CASE WHEN run_id % 5 = 0 THEN '.gif' ELSE '.fits' END AS file_name, run_id % 4 AS n_bytes,
                 CASE run_id % 3 WHEN 0 THEN 'nearby' WHEN 1 THEN 'blind' ELSE 'other' END AS mode, run_id % 2 = 0 AS headers, ra, dec, ra*3 AS search_radius,
                 CASE WHEN run_id % 7 <> 0 THEN radius/25 END AS min_radius, CASE WHEN run_id % 11 <> 0 THEN radius*4 END AS max_radius, CAST(run_id % 6 AS INTEGER) AS lower_offset, CAST(run_id % 5 AS INTEGER) AS higher_offset
          FROM search_centers),
    p AS (SELECT *, mode = 'nearby' AND NOT headers AS given FROM a)"""


@A("flt_18_job_problems", _ASKED + """ SELECT run_id, CAST((n_bytes = 0)::INT + (run_id % 5 = 0)::INT + (mode = 'other')::INT + (mode = 'nearby' AND search_radius > 60)::INT
    + coalesce(given AND (min_radius IS NULL OR max_radius IS NULL), false)::INT + (mode = 'blind' AND max_radius IS NULL)::INT + coalesce((given OR mode = 'blind') AND max_radius > 16, false)::INT
    + (mode = 'blind' AND min_radius IS NULL)::INT + coalesce((given OR mode = 'blind') AND min_radius < 0.1, false)::INT + (higher_offset > 3)::INT + (lower_offset > 3)::INT AS BIGINT) AS n_problems FROM p""")
def flt_18(spark, sf_dir):
    from ..plans.validation import with_problems

    n = F.col("run_id")
    asked = fixture(spark, sf_dir, "search_centers").select(
        n, F.concat(F.lit("p"), n.cast("string"), F.when(n % 5 == 0, ".gif").otherwise(".fits")).alias("file_name"), (n % 4).alias("n_bytes"),
        F.when(n % 3 == 0, "nearby").when(n % 3 == 1, "blind").otherwise("other").alias("mode"), (n % 2 == 0).alias("use_fits_headers"), "ra", "dec", (F.col("ra") * 3).alias("search_radius"),
        F.when(n % 7 != 0, F.col("radius") / 25).alias("min_radius"), F.when(n % 11 != 0, F.col("radius") * 4).alias("max_radius"), (n % 6).cast("int").alias("lower_offset"), (n % 5).cast("int").alias("higher_offset"),
    )
    return with_problems(asked).select("run_id", F.size("problems").cast("long").alias("n_problems"))
