"""Every operator on the supplied tables, each with its SQL where SQL can say it.

A user's events are a series: ``event_id`` orders it, ``value`` and the number
in ``props`` are its signals, ``event_type`` its labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as C
from .frames import with_ordinal
from .functions import box_muller, human_format, linear_degrees, arctangent_degrees, one_hot, pixels_per_degree, recode, round_up_to_odd, shifted_labels
from .operators import align, autoencoder, classifier, clean, grid, label, segment, sequence, stats, training, vector
from .sources import datasource

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
U = ["user_id"]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With ``t`` in seconds, ``k`` from the properties and ``code``, 1 to 5."""
    kinds = ["view", "click", "purchase", "signup", "error"]
    code = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("event_type")).cast("int")
    e = table(spark, sf_dir, "events")
    return e.withColumns({"ts": F.col("ts").cast("timestamp"), "k": F.get_json_object("props", "$.k").cast("double"), "code": code}).withColumn("t", F.unix_micros("ts") / 1e6)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With ``idx``, from 0 for each user."""
    return with_ordinal(events(spark, sf_dir), U, "event_id")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``;
    deleted when the application ends. Where that is unset, of one machine."""
    import tempfile
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.gettempdir()
    path = f"{top.rstrip('/')}/isoptic-{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def r_avg(c: str, n: int = 6):
    return F.round(F.avg(c), n).alias(c)


#: The same tables for SQL.
E = """e AS (SELECT event_id, user_id, event_type, value, ts, epoch_us(ts) / 1000000.0 AS t, (props::JSON ->> '$.k')::DOUBLE AS k,
  list_position(['view', 'click', 'purchase', 'signup', 'error'], event_type)::INT AS code FROM events)"""
S = E + """,
s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM e)"""
W = "WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"


# Cleaning.


@query(f"WITH {E} SELECT user_id, event_id, round(value - lag(value) OVER w, 6) AS step, round(lead(value) OVER w - value, 6) AS ahead FROM e {W}")
def lag_diff(spark, sf_dir):
    e = events(spark, sf_dir)
    both = clean.difference(clean.difference(e, "value", U, "event_id", "step"), "value", U, "event_id", "ahead", ahead=True)
    return both.select("user_id", "event_id", r("step"), r("ahead"))


_MASK = """m AS (SELECT *, abs(value - lag(value) OVER w) AS d FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
o AS (SELECT *, CASE WHEN d IS NULL OR d <= 2 * stddev_pop(d) OVER (PARTITION BY user_id) + avg(d) OVER (PARTITION BY user_id) THEN value END AS v FROM m)"""
_FILL = """i AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS i0,
  first_value(v IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER f AS i1 FROM o
  WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING),
         f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN i0 IS NULL THEN v1 WHEN i1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (idx - i0) / (i1 - i0) END, 6) AS value FROM i"""


@query(f"WITH {S}, {_MASK} SELECT user_id, event_id, v AS value FROM o")
def outlier_mask(spark, sf_dir):
    return clean.mask_outliers(series(spark, sf_dir), ["value"], U, "event_id", 2.0).select("user_id", "event_id", "value")


@query(f"WITH {S}, o AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS v FROM s), {_FILL}")
def interpolate_gaps(spark, sf_dir):
    gaps = series(spark, sf_dir).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return clean.interpolate(gaps, ["value"], U, "idx").select("user_id", "event_id", r("value"))


@query(f"WITH {S}, {_MASK}, {_FILL}")
def clean_chain(spark, sf_dir):
    return clean.clean(series(spark, sf_dir), ["value"], U, "idx", 2.0).select("user_id", "event_id", r("value"))


@query(f"WITH {E} SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9, 6) AS value FROM e")
def boxcar_smooth(spark, sf_dir):
    return clean.smooth(events(spark, sf_dir), ["value"], U, "event_id", 9).select("user_id", "event_id", r("value"))


@query(f"WITH {S} SELECT user_id, event_id, round(t - first_value(t) OVER w, 6) AS t, round(coalesce(t - lag(t) OVER w, 0), 6) AS width FROM s {W}")
def rebased_time(spark, sf_dir):
    e = clean.bar_widths(series(spark, sf_dir), "t", U, "idx")
    return clean.rebase(e, "t", U, "idx").select("user_id", "event_id", r("t"), r("width"))


@query(f"""WITH {E} SELECT user_id, event_id, round((value - min(value) OVER p) / (max(value) OVER p - min(value) OVER p + 1e-10), 6) AS value,
  round((k - min(k) OVER p) / nullif(max(k) OVER p - min(k) OVER p, 0), 6) AS k FROM e WINDOW p AS (PARTITION BY user_id)""")
def minmax_norm(spark, sf_dir):
    return clean.min_max(clean.min_max(events(spark, sf_dir), ["value"], U), ["k"], U, eps=0.0).select("user_id", "event_id", r("value"), r("k"))


@query(f"WITH {S} SELECT user_id, event_id FROM s WHERE idx % 6 = 0")
def downsample(spark, sf_dir):
    return clean.downsample(events(spark, sf_dir), U, "event_id", 6).select("user_id", "event_id")


@query(f"""WITH {E}, c AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS v FROM e),
g AS (SELECT user_id FROM c GROUP BY user_id HAVING floor(count(*) FILTER (v IS NULL) / 2) / count(*) < 0.1)
SELECT c.user_id, event_id, (v IS NOT NULL)::INT AS status FROM c JOIN g USING (user_id)""")
def quality_gate(spark, sf_dir):
    gaps = events(spark, sf_dir).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return clean.with_validity(clean.quality_gate(gaps, ["value"], U), "value").select("user_id", "event_id", "status")


@query(f"WITH {S} SELECT user_id, event_id, idx < 5 AS early FROM s QUALIFY idx < 5 OR idx < count(*) OVER (PARTITION BY user_id) - 60")
def heads(spark, sf_dir):
    s = series(spark, sf_dir)
    first, cut = clean.head(s, U, "idx", 5), clean.head(s, U, "idx", -60)
    return first.unionByName(cut).select("user_id", "event_id", (F.col("idx") < 5).alias("early")).distinct()


# Labels.


_MOVE = """b AS (SELECT *, sum(value) OVER z / 3 AS x, sum(k) OVER z / 3 AS y FROM s WINDOW z AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
v AS (SELECT *, sqrt(pow((lead(x) OVER w - x) * 0.05, 2) + pow((lead(y) OVER w - y) * 0.05, 2)) AS speed,
  degrees(abs(atan2(radians(lead(y) OVER w), radians(lead(x) OVER w)) - atan2(radians(y), radians(x)))) AS angle FROM b WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
f AS (SELECT *, coalesce((speed > 2 AND angle < 30)::INT, 0) AS flag FROM v)"""


@query(f"WITH {S}, {_MOVE} SELECT user_id, event_id, round(speed, 6) AS speed, round(angle, 6) AS angle, flag FROM f")
def velocity_flags(spark, sf_dir):
    s = clean.smooth(series(spark, sf_dir), ["value", "k"], U, "idx", 3)
    return label.flag_saccades(label.with_velocity(s, "value", "k", U, "idx", 0.05), 2.0, 30.0, "flag").select("user_id", "event_id", r("speed"), r("angle"), "flag")


@query(f"WITH {S}, {_MOVE} SELECT user_id, event_id, CASE WHEN sum(flag) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 0 THEN 1 ELSE 2 END AS evt FROM f")
def fixation_labels(spark, sf_dir):
    s = clean.smooth(series(spark, sf_dir), ["value", "k"], U, "idx", 3)
    flagged = label.flag_saccades(label.with_velocity(s, "value", "k", U, "idx", 0.05), 2.0, 30.0, "flag")
    return label.forward_dwell(flagged, "flag", U, "idx", 3).select("user_id", "event_id", "evt")


@query(f"WITH {E} SELECT user_id, event_id, CASE WHEN sum((value > 100)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) = 0 THEN 1 ELSE 2 END AS evt FROM e")
def forward_dwell(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("flag", (F.col("value") > 100).cast("int"))
    return label.forward_dwell(e, "flag", U, "event_id", 6).select("user_id", "event_id", "evt")


_RUNS = """c AS (SELECT *, coalesce((event_type <> lag(event_type) OVER w)::INT, 0) AS ch FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run FROM c)"""


@query(f"WITH {S}, {_RUNS} SELECT user_id, run, min(idx) AS s, max(idx) + 1 AS e, any_value(event_type) AS event_type, count(*) AS n, round(avg(value), 6) AS mean FROM g GROUP BY user_id, run")
def run_lengths(spark, sf_dir):
    return label.run_lengths(events(spark, sf_dir), "event_type", U, "event_id", F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"""WITH {S}, c AS (SELECT *, (value > 20)::INT AS status FROM s),
d AS (SELECT *, coalesce((status <> lag(status) OVER w)::INT, 0) AS ch FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM d),
n AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS n FROM g) SELECT user_id, event_id, run::BIGINT AS run FROM n WHERE status = 1 AND n >= 5""")
def valid_runs(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("status", (F.col("value") > 20).cast("int"))
    return label.valid_runs(e, "status", U, "event_id", 5).select("user_id", "event_id", "run")






_MARKED = """c AS (SELECT *, coalesce(((code > 2) <> (lag(code) OVER w > 2))::INT, 0) AS ch FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run FROM c)"""


def _savgol_sql(col: str, out: str) -> str:
    """The derivative of a quadratic through 5 samples, and its ends."""
    at = {k: f"lead({col}, {k}) OVER w" if k > 0 else f"lag({col}, {-k}) OVER w" if k < 0 else col for k in range(-2, 3)}
    slope = " + ".join(f"{k} * ({x})" for k, x in at.items())
    bend = " + ".join(f"{5 * k * k - 10} * ({x})" for k, x in at.items())
    return f"({slope}) / 10.0 AS b_{out}, ({bend}) / 70.0 AS c_{out}"


def _slope_sql(out: str) -> str:
    end = lambda centre: f"max(CASE WHEN idx = {centre} THEN b_{out} END) OVER p + 2 * max(CASE WHEN idx = {centre} THEN c_{out} END) OVER p * (idx - ({centre}))"
    return f"CASE WHEN idx < 2 THEN {end('2')} WHEN idx >= n - 2 THEN {end('n - 3')} ELSE b_{out} END AS s_{out}"


_VEL = f"""q AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, {_savgol_sql('value', 'x')}, {_savgol_sql('k', 'y')} FROM {{src}} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
h AS (SELECT *, {_slope_sql('x')}, {_slope_sql('y')} FROM q WINDOW p AS (PARTITION BY user_id)),
vel AS (SELECT *, sqrt(s_x * s_x + s_y * s_y) * 2 AS vel FROM h)"""


@query(f"WITH {S}, {_VEL.format(src='s')} SELECT user_id, event_id, round(vel, 6) AS velocity FROM vel")
def savgol_velocity(spark, sf_dir):
    return label.savgol_velocity(series(spark, sf_dir), ["value", "k"], U, "idx", 2.0, 5).select("user_id", "event_id", r("velocity"))


@query(f"""WITH {S}, {_RUNS}, d AS (SELECT *, lead(value) OVER o - value AS dx, lead(k) OVER o - k AS dy FROM g WINDOW o AS (PARTITION BY user_id, run ORDER BY event_id))
SELECT user_id, event_id, CASE WHEN count(*) OVER f = 2 THEN round(sqrt(pow(stddev_pop(value) OVER f, 2) + pow(stddev_pop(k) OVER f, 2)), 6) END AS roll_std,
  CASE WHEN count(*) OVER f = 2 THEN round(sqrt(avg(dx * dx) OVER c + avg(dy * dy) OVER c), 6) END AS roll_rms FROM d
WINDOW f AS (PARTITION BY user_id, run ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), c AS (PARTITION BY user_id, run ORDER BY event_id ROWS BETWEEN CURRENT ROW AND CURRENT ROW)""")
def rolling_std(spark, sf_dir):
    runs = label.with_runs(events(spark, sf_dir), "event_type", U, "event_id")
    return label.rolling_in_run(runs, "value", "k", U, "event_id", 2).select("user_id", "event_id", r("roll_std"), r("roll_rms"))


@query(f"""WITH {S}, {_MARKED}, d AS (SELECT *, lead(value) OVER o - value AS dx, lead(k) OVER o - k AS dy FROM g WINDOW o AS (PARTITION BY user_id, run ORDER BY event_id))
SELECT user_id, event_id, CASE WHEN count(*) OVER f = 4 THEN round(sqrt(pow(stddev_pop(value) OVER f, 2) + pow(stddev_pop(k) OVER f, 2)), 6) END AS roll_std,
  CASE WHEN count(*) OVER f = 4 THEN round(sqrt(avg(dx * dx) OVER c + avg(dy * dy) OVER c), 6) END AS roll_rms FROM d
WINDOW f AS (PARTITION BY user_id, run ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), c AS (PARTITION BY user_id, run ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)""")
def rolling_wide(spark, sf_dir):
    runs = label.with_runs(events(spark, sf_dir).withColumn("high", F.col("code") > 2), "high", U, "event_id")
    return label.rolling_in_run(runs, "value", "k", U, "event_id", 4).select("user_id", "event_id", r("roll_std"), r("roll_rms"))


@query(f"""WITH {S}, {_RUNS}, {_VEL.format(src='g').replace('* 2 AS vel', '* 10.0 AS vel')},
dif AS (SELECT *, lead(value) OVER o - value AS dx, lead(k) OVER o - k AS dy FROM vel WINDOW o AS (PARTITION BY user_id, run ORDER BY event_id)),
z AS (SELECT *, row_number() OVER o - 1 AS j, count(*) OVER (PARTITION BY user_id, run) AS m,
  CASE WHEN dx IS NOT NULL THEN sqrt(pow(stddev_pop(value) OVER f, 2) + pow(stddev_pop(k) OVER f, 2)) END AS roll_std, sqrt(dx * dx + dy * dy) AS roll_rms
  FROM dif WINDOW o AS (PARTITION BY user_id, run ORDER BY event_id), f AS (PARTITION BY user_id, run ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING))
SELECT user_id, run, min(idx) AS s, max(idx) + 1 AS e, any_value(code) AS code, round(avg(value) FILTER (j < 3), 6) AS posx_s, round(avg(value) FILTER (j >= m - 3), 6) AS posx_e,
  round(avg(value), 6) AS posx_mean, round(median(value), 6) AS posx_med, round(avg(k) FILTER (j < 3), 6) AS posy_s, round(avg(k) FILTER (j >= m - 3), 6) AS posy_e,
  round(avg(k), 6) AS posy_mean, round(median(k), 6) AS posy_med, round(max(vel), 6) AS pv, arg_max(idx, (vel, -idx)) AS pv_index,
  round(avg(value) FILTER (j >= m - 3) - avg(value) FILTER (j < 3), 6) AS ampl_x, round(avg(k) FILTER (j >= m - 3) - avg(k) FILTER (j < 3), 6) AS ampl_y,
  CASE WHEN count(*) > 2 THEN round(median(roll_rms), 6) ELSE 0 END AS rms, CASE WHEN count(*) > 2 THEN round(median(roll_std), 6) ELSE 0 END AS std,
  round(count(*) / 10.0, 6) AS dur, round(sqrt(pow(avg(value) FILTER (j >= m - 3) - avg(value) FILTER (j < 3), 2) + pow(avg(k) FILTER (j >= m - 3) - avg(k) FILTER (j < 3), 2)), 6) AS ampl
FROM z GROUP BY user_id, run""")
def event_features(spark, sf_dir):
    e = series(spark, sf_dir)
    wide = {k: 300 for k in range(1, 6)}  # at 10 samples a second: 3 samples
    out = label.event_features(e, U, "idx", 10.0, "code", "value", "k", wide, velocity_ms=500)
    return out.select("user_id", "run", "s", "e", "code", *[r(c) for c in ("posx_s", "posx_e", "posx_mean", "posx_med", "posy_s", "posy_e", "posy_mean", "posy_med", "pv", "ampl_x", "ampl_y", "rms", "std")], "pv_index", r("dur"), r("ampl"))


@query(f"""WITH {E}, d AS (SELECT user_id, 1 / (t - lag(t) OVER w) AS x FROM e {W}), m AS (SELECT user_id, median(x) AS rate FROM d GROUP BY user_id)
SELECT user_id, round(rate, 9) AS rate, list_sort([{', '.join(f'({{"d": abs(rate - {f}), "i": {i}, "f": {f}}})'.replace('"', "'") for i, f in enumerate((2000, 500, 25, 1)))}])[1].f AS fs FROM m""")
def rate_estimate(spark, sf_dir):
    return label.sampling_rate(events(spark, sf_dir), "t", U, "event_id", (2000, 500, 25, 1)).select("user_id", r("rate", 9), "fs")


@query(f"WITH {E} SELECT user_id, event_id, coalesce(lead(code) OVER w - code = 1, false) AS onset FROM e {W}")
def onsets(spark, sf_dir):
    return label.onsets(events(spark, sf_dir), "code", U, "event_id").select("user_id", "event_id", "onset")


@query(f"WITH {E} SELECT event_id, CASE WHEN code = 5 THEN 1 ELSE code END AS known, CASE WHEN code IN (1, 2, 3) THEN 1 ELSE 0 END AS status, CASE WHEN code = 1 THEN 1 ELSE 2 END AS evt FROM e")
def event_recodes(spark, sf_dir):
    e = events(spark, sf_dir).withColumns({"evt": F.when(F.col("code") == 5, 0).otherwise(F.col("code")), "status": F.lit(1)})
    known = label.recode_unknown(e).withColumnRenamed("evt", "known")
    return label.binary_events(label.clear_status(known, (1, 2, 3), "code").withColumn("evt", F.col("code"))).select("event_id", "known", "status", "evt")


# Alignment.


@query("""WITH p AS (SELECT user_id, event_id AS pid, epoch_us(ts) / 1000000.0 AS lo, epoch_us(ts) / 1000000.0 + 86400 AS hi FROM events WHERE event_type = 'purchase')
SELECT v.user_id, v.event_id, pid FROM events v JOIN p ON v.user_id = p.user_id AND epoch_us(v.ts) / 1000000.0 > lo AND epoch_us(v.ts) / 1000000.0 < hi WHERE v.event_type = 'view'""")
def range_join_open(spark, sf_dir):
    e = events(spark, sf_dir)
    p = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("pid"), F.col("t").alias("lo"), (F.col("t") + 86400).alias("hi"))
    return align.range_join(e.where("event_type = 'view'"), p, U, "t").select("user_id", "event_id", "pid")


QUERIES["range_join_bucketed"] = lambda spark, sf_dir: (
    lambda e: align.bucketed_range_join(
        e.where("event_type = 'view'"), e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("pid"), F.col("t").alias("lo"), (F.col("t") + 86400).alias("hi")), U, "t", 86400.0
    ).select("user_id", "event_id", "pid")
)(events(spark, sf_dir))
SQL["range_join_bucketed"] = SQL["range_join_open"]

_NEAR = """v AS (SELECT * FROM s WHERE event_type = 'view'), p AS (SELECT * FROM s WHERE event_type = 'purchase'),
n AS (SELECT p.user_id, p.event_id, (SELECT v.event_id FROM v WHERE v.user_id = p.user_id ORDER BY abs(v.t - p.t), v.t, v.event_id LIMIT 1) AS nearest FROM p)"""


@query(f"WITH {S}, {_NEAR} SELECT user_id, event_id, nearest FROM n")
def nearest_event(spark, sf_dir):
    e = events(spark, sf_dir)
    views = e.where("event_type = 'view'").withColumnRenamed("event_id", "vid")
    return align.nearest_asof(e.where("event_type = 'purchase'").select("user_id", "event_id", "t"), views, U, "t", "event_id", "vid").select("user_id", "event_id", "nearest")


@query(f"""WITH {S}, {_NEAR}, o AS (SELECT n.user_id, nearest, arg_max(p.code, n.event_id) AS c FROM n JOIN p ON p.event_id = n.event_id GROUP BY n.user_id, nearest)
SELECT v.user_id, v.event_id, coalesce(c, 0) AS audio_event FROM v LEFT JOIN o ON o.nearest = v.event_id""")
def correlate_events(spark, sf_dir):
    e = events(spark, sf_dir)
    p = e.where("event_type = 'purchase'").select("user_id", "t", F.col("event_id").alias("pid"), "code")
    return align.correlate(e.where("event_type = 'view'"), p, U, "t", "code", "pid", "event_id").select("user_id", "event_id", "audio_event")


@query(f"""WITH {S}, b AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT user_id, event_id, before FROM b WHERE event_type = 'purchase'""")
def strict_prev_event(spark, sf_dir):
    e = align.strict_before(events(spark, sf_dir), F.col("event_type") == "view", "event_id", U, "event_id", "before")
    return e.where("event_type = 'purchase'").select("user_id", "event_id", "before")


_SEG = """g AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS segment,
  sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id) AS total FROM s),
x AS (SELECT * FROM g WHERE event_type <> 'purchase' AND idx > 0 AND segment < total)"""


@query(f"WITH {S}, {_SEG} SELECT user_id, event_id, segment FROM x")
def segment_between(spark, sf_dir):
    return align.segments_between(events(spark, sf_dir), F.col("event_type") == "purchase", U, "event_id").select("user_id", "event_id", "segment")


_PAIR = """a AS (SELECT user_id, event_id AS lo, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ord FROM s WHERE event_type = 'purchase'),
b AS (SELECT user_id, event_id AS hi, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ord FROM s WHERE event_type = 'signup')"""


@query(f"WITH {S}, {_PAIR} SELECT s.user_id, s.event_id, a.ord::INT AS ord FROM s JOIN a ON a.user_id = s.user_id JOIN b ON b.user_id = a.user_id AND b.ord = a.ord WHERE s.event_id >= lo AND s.event_id < hi")
def paired_slices(spark, sf_dir):
    e = events(spark, sf_dir)
    return align.slices(e.where("event_type = 'purchase'"), e.where("event_type = 'signup'"), e, U, "event_id").select("user_id", "event_id", "ord")


_GRID = "t AS (SELECT i::INT AS ord, 537 + (i % 15) * (1379 - 537) / 14.0 AS tx, 296 + (i // 15) * (1034 - 296) / 7.0 AS ty FROM range(120) r(i))"


@query(f"WITH {S}, {_GRID} SELECT ord, round(tx, 6) AS x, round(ty, 6) AS y, count(idx) AS n, round(avg(value), 6) AS value FROM t LEFT JOIN s ON idx = ord GROUP BY ALL")
def target_grid(spark, sf_dir):
    """Every target with the users' samples of its number."""
    s = series(spark, sf_dir).groupBy(F.col("idx").alias("ord")).agg(F.count(F.lit(1)).alias("n"), r_avg("value"))
    return grid.target_grid(spark).join(s, "ord", "left").select("ord", r("x"), r("y"), F.coalesce("n", F.lit(0)).alias("n"), "value")


@query(f"WITH {S}, {_SEG}, {_GRID} SELECT user_id, event_id, segment, round(tx, 6) AS x, round(ty, 6) AS y FROM x JOIN t ON t.ord = segment")
def ordinal_targets(spark, sf_dir):
    parts = align.segments_between(events(spark, sf_dir), F.col("event_type") == "purchase", U, "event_id")
    return align.targets_of(parts, grid.target_grid(spark), "segment").select("user_id", "event_id", "segment", r("x"), r("y"))


@query(f"""WITH {S}, {_SEG}, {_GRID}, c AS (SELECT *, coalesce((code <> lag(code) OVER w)::INT, 0) AS ch FROM x WINDOW w AS (PARTITION BY user_id, segment ORDER BY event_id)),
g2 AS (SELECT *, sum(ch) OVER (PARTITION BY user_id, segment ORDER BY event_id) AS run FROM c),
m AS (SELECT user_id, segment, run, any_value(code) AS code, avg(value) AS x, avg(k) AS y FROM g2 GROUP BY ALL),
d AS (SELECT user_id, segment, min(CASE WHEN code = 1 THEN sqrt(pow(x - tx, 2) + pow(y - ty, 2)) END) AS d FROM m JOIN t ON t.ord = segment GROUP BY ALL)
SELECT user_id, segment, coalesce(round(d, 6), 1e18) AS distance FROM d""")
def closest_run(spark, sf_dir):
    parts = align.segments_between(events(spark, sf_dir), F.col("event_type") == "purchase", U, "event_id")
    aimed = align.targets_of(parts, grid.target_grid(spark).withColumnsRenamed({"x": "tx", "y": "ty"}), "segment")
    out = stats.closest_run(aimed, "value", "k", "tx", "ty", "code", U, "segment", "event_id")
    return out.select("user_id", "segment", F.when(F.col("distance") == float("inf"), 1e18).otherwise(F.round("distance", 6)).alias("distance"))


@query("""SELECT n_nationkey, n_name, min(s_name) AS s_name FROM nation LEFT JOIN supplier ON ends_with(s_name, lpad(n_nationkey::VARCHAR, 2, '0')) GROUP BY ALL""")
def first_match(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    on = F.substring(s["s_name"], -2, 2) == F.lpad(n["n_nationkey"].cast("string"), 2, "0")
    return align.first_match(n, s, on, ["n_nationkey"], F.col("s_name")).select("n_nationkey", "n_name", "s_name")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_override(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("_at", F.struct("o_orderdate", "o_orderkey"))
    return align.latest(o, ["o_custkey"], "_at").select("o_custkey", "o_orderkey")


@query(f"""WITH {S}, p AS (SELECT user_id, event_id // 2 * 2 AS event_id, code, count(*) AS n FROM s GROUP BY ALL),
o AS (SELECT user_id, event_id, arg_max(code, (n, -code)) AS c FROM p GROUP BY ALL) SELECT s.user_id, s.event_id, coalesce(c, 0) AS code_pred FROM s LEFT JOIN o USING (user_id, event_id)""")
def joined_predictions(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_id", "code")
    guess = e.withColumn("event_id", F.floor(F.col("event_id") / 2) * 2)
    return align.with_predictions(e, guess, U, "event_id", "code").select("user_id", "event_id", "code_pred")


@query("""WITH m AS (SELECT *, role = 'user' AS u FROM conversations), c AS (SELECT conv_id FROM m GROUP BY conv_id HAVING count(*) FILTER (u) = count(*) FILTER (NOT u)),
a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ord FROM m JOIN c USING (conv_id) WHERE u),
b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ord FROM m JOIN c USING (conv_id) WHERE NOT u)
SELECT conv_id, ord::INT AS ord, a.turn AS lo, b.turn AS hi FROM a JOIN b USING (conv_id, ord)""")
def ordinal_pairs(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").withColumn("_u", F.col("role") == "user")
    even = m.groupBy("conv_id").agg(F.count_if("_u").alias("a"), F.count_if(~F.col("_u")).alias("b")).where("a = b")
    m = m.join(even, "conv_id", "left_semi")
    return align.pair_in_order(m.where("_u"), m.where(~F.col("_u")), ["conv_id"], "turn", "turn").select("conv_id", "ord", "lo", "hi")


@query(f"WITH {S} SELECT a.user_id, a.idx, a.code AS a, b.code AS b FROM s a JOIN s b ON a.user_id = b.user_id AND b.idx = a.idx AND b.idx % 2 = 0")
def zipped_rows(spark, sf_dir):
    s = series(spark, sf_dir)
    other = s.where("idx % 2 = 0").select("user_id", "idx", F.col("code").alias("b"))
    return align.zip_rows(s.select("user_id", "idx", F.col("code").alias("a")), other, U, "idx")


# Segmentation.


_FRAMES = """z AS (SELECT u.user_id, f.f AS frame FROM (SELECT user_id, max(idx) AS m FROM s GROUP BY user_id) u, range(0, 1000) f(f) WHERE f.f <= (u.m + 1) // 4),
rms AS (SELECT z.user_id, frame, sqrt(coalesce(sum(value * value), 0) / 16) AS rms FROM z LEFT JOIN s ON s.user_id = z.user_id AND s.idx >= frame * 4 - 8 + 4 - 4 AND s.idx < frame * 4 + 8 GROUP BY ALL)"""
_ACTIVE = """nrm AS (SELECT *, (rms - min(rms) OVER p) / nullif(max(rms) OVER p - min(rms) OVER p, 0) AS v FROM rms WINDOW p AS (PARTITION BY user_id)),
act AS (SELECT *, coalesce((v >= median(v) OVER p + stddev_pop(v) OVER p / 4 AND v > 0)::INT, 0) AS active FROM nrm WINDOW p AS (PARTITION BY user_id)),
edg AS (SELECT *, CASE WHEN row_number() OVER w = 1 AND active = 1 THEN 1 ELSE coalesce(lead(active) OVER w - active, 0) END AS edge FROM act WINDOW w AS (PARTITION BY user_id ORDER BY frame))"""


@query(f"WITH {S}, {_FRAMES} SELECT user_id, frame, round(rms, 6) AS rms FROM rms")
def rms_frames(spark, sf_dir):
    return segment.rms_frames(series(spark, sf_dir), "value", U, "idx", 16, 4).select("user_id", "frame", r("rms"))


@query(f"WITH {S}, {_FRAMES}, {_ACTIVE} SELECT user_id, frame, active, edge FROM edg")
def threshold_edges(spark, sf_dir):
    frames = segment.rms_frames(series(spark, sf_dir), "value", U, "idx", 16, 4)
    return segment.edges(segment.above_threshold(frames, "rms", U), "active", U, "frame").select("user_id", "frame", "active", "edge")


@query(f"""WITH {S}, {_FRAMES}, {_ACTIVE}, q AS (SELECT user_id FROM s GROUP BY user_id HAVING median(abs(value)) <= 40),
n AS (SELECT user_id, edge, frame, row_number() OVER (PARTITION BY user_id, edge ORDER BY frame) AS ord FROM edg JOIN q USING (user_id) WHERE edge <> 0),
i AS (SELECT a.user_id, a.ord, a.frame * 4 AS s0, coalesce(b.frame * 4, l.m) AS e0, l.m FROM n a LEFT JOIN n b ON b.user_id = a.user_id AND b.ord = a.ord AND b.edge = -1
  JOIN (SELECT user_id, max(idx) AS m FROM s GROUP BY user_id) l ON l.user_id = a.user_id WHERE a.edge = 1),
k AS (SELECT * FROM i WHERE e0 - s0 >= 4)
SELECT user_id, ord::INT AS ord, round(least(s0, m) / 16.0 * 1000000, 5) AS t, s0 AS signal_index, 1 AS sentence_breaks FROM k
UNION ALL SELECT user_id, ord::INT, round(least(e0, m) / 16.0 * 1000000, 5), e0, -1 FROM k""")
def speech_events(spark, sf_dir):
    return segment.speech_events(series(spark, sf_dir), "value", U, "idx", 16, 16, 4, 0.25, 40.0)


@query(f"""WITH {S}, p AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY event_id) - t AS gap FROM s WHERE event_type = 'purchase') SELECT user_id, event_id, round(gap, 6) AS gap FROM p WHERE gap IS NOT NULL""")
def utterance_gaps(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("mark", F.when(F.col("event_type") == "purchase", 1).otherwise(-1))
    return segment.utterance_gaps(e, "t", U, "event_id", mark="mark", name="gap").select("user_id", "event_id", r("gap"))


@query(f"""WITH {S}, p AS (SELECT *, lead(t) OVER w - t AS gap, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id) AS m FROM s {W}) SELECT user_id, event_id, round(gap, 6) AS gap FROM p WHERE gap IS NOT NULL AND n <= m // 2""")
def utterance_gaps_first_half(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("mark", F.lit(1))
    return segment.utterance_gaps(e, "t", U, "event_id", parity=True, mark="mark", name="gap").select("user_id", "event_id", r("gap"))


# Statistics.


@query("""WITH o AS (SELECT c_nationkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT c_nationkey, c_mktsegment, median(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM o GROUP BY ALL HAVING count(*) > 25)
SELECT c_nationkey, round(median(m), 4) AS median, round(median(s), 4) AS std, count(*) AS groups FROM g GROUP BY c_nationkey HAVING count(*) = 5""")
def group_median_std(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return stats.two_level_median(o, "o_totalprice", ["c_nationkey"], ["c_mktsegment"], 5, 25).select("c_nationkey", r("median", 4), r("std", 4), "groups")


@query("SELECT c_nationkey, round(avg(c_acctbal), 4) AS mean, round(stddev_pop(c_acctbal), 4) AS std, count(*) AS n FROM customer GROUP BY c_nationkey")
def subject_mean_std(spark, sf_dir):
    return stats.mean_std(table(spark, sf_dir, "customer"), "c_acctbal", ["c_nationkey"]).select("c_nationkey", r("mean", 4), r("std", 4), "n")


@query(f"WITH {E}, c AS (SELECT user_id, count(*) AS n FROM e GROUP BY user_id) SELECT min(n) AS least FROM c")
def least_count(spark, sf_dir):
    return stats.least_count(events(spark, sf_dir), U)


@query(f"""WITH {E}, c AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS p FROM e)
SELECT user_id, event_id FROM c WHERE n > 60 AND n < 75 AND 5.0 * p / n > 0.8 AND 5.0 * p / n < 1.2""")
def count_gates(spark, sf_dir):
    e = stats.count_gate(events(spark, sf_dir), U, more_than=60, fewer_than=75)
    n = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("event_type") == "purchase") * 5).alias("p"))
    return e.join(stats.ratio_gate(n, "p", "n").select("user_id"), U, "left_semi").select("user_id", "event_id")


@query(f"""WITH {S}, {_SEG}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, segment ORDER BY event_id) AS j FROM x)
SELECT user_id, segment, round(avg((value < 40)::INT), 6) AS key_share, round(avg((code = 1)::INT), 6) AS fixation_share, CASE WHEN avg(value) FILTER (j <= 3) < 40 THEN 'up' ELSE 'down' END AS place FROM n GROUP BY user_id, segment""")
def roi_share(spark, sf_dir):
    parts = align.segments_between(events(spark, sf_dir), F.col("event_type") == "purchase", U, "event_id")
    return stats.roi_shares(parts, "value", "code", U, "segment", "event_id", 40.0, 3).select("user_id", "segment", r("key_share"), r("fixation_share"), "place")


@query(f"""WITH {S}, {_SEG}, u AS (SELECT user_id, segment, avg((value < 40)::INT) AS a, avg((code = 1)::INT) AS b FROM x GROUP BY user_id, segment)
SELECT user_id, round(avg(a), 6) AS key_share, round(avg(b), 6) AS fixation_share, round(arg_max(a, segment), 6) AS last_share FROM u GROUP BY user_id""")
def roi_means(spark, sf_dir):
    parts = align.segments_between(events(spark, sf_dir), F.col("event_type") == "purchase", U, "event_id")
    shares = stats.roi_shares(parts, "value", "code", U, "segment", "event_id", 40.0, 3)
    last = stats.mean_roi_shares(shares, U, "segment", parity=True).select("user_id", F.col("key_share").alias("last_share"))
    return stats.mean_roi_shares(shares, U, "segment").join(last, U).select("user_id", r("key_share"), r("fixation_share"), r("last_share"))


@query(f"WITH {E}, c AS (SELECT user_id, CASE WHEN value > 50 THEN 2 ELSE 1 END AS a, CASE WHEN k > 50 THEN 2 ELSE 1 END AS b FROM e) SELECT user_id, round(avg((a = b)::INT) * 100, 6) AS agreement, round(avg(a & b) * 100, 6) AS bitwise FROM c GROUP BY user_id")
def agreement(spark, sf_dir):
    e = events(spark, sf_dir).withColumns({"a": F.when(F.col("value") > 50, 2).otherwise(1), "b": F.when(F.col("k") > 50, 2).otherwise(1)})
    bits = stats.agreement(e, "a", "b", U, parity=True).withColumnRenamed("agreement", "bitwise")
    return stats.agreement(e, "a", "b", U).join(bits, U).select("user_id", r("agreement"), r("bitwise"))


@query(f"WITH {E} SELECT user_id, round(avg(pow(value - k, 2)), 4) AS mse FROM e GROUP BY user_id")
def mse(spark, sf_dir):
    return stats.mse(events(spark, sf_dir), "value", "k", U).select("user_id", r("mse", 4))


@query(f"WITH {S}, m AS (SELECT user_id, avg(value) FILTER (idx % 2 = 0) AS a, avg(value) FILTER (idx % 2 = 1) AS b FROM s GROUP BY user_id) SELECT round(corr(a, b), 6) AS r FROM m")
def half_corr(spark, sf_dir):
    return stats.half_correlation(events(spark, sf_dir), "value", "user_id", "event_id").select(r("r"))


_HALVES = """k AS (SELECT rep, pos, row_number() OVER (PARTITION BY rep ORDER BY ((rep * 7919 + pos * 104729 + 220617) * 2654435761) % 4294967291, pos) AS rk FROM range(20) a(rep), range(40) b(pos)),
h AS (SELECT l, rep, pos, rk <= l AS one FROM k, (SELECT unnest([5, 8, 10, 15])::INT AS l) WHERE rk <= 2 * l),
m AS (SELECT l, rep, user_id, avg(value) FILTER (one) AS a, avg(value) FILTER (NOT one) AS b FROM h JOIN s ON s.idx = h.pos GROUP BY ALL),
c AS (SELECT l, rep, corr(a, b) AS r FROM m GROUP BY ALL)"""


def _values(spark, sf_dir):
    return series(spark, sf_dir).select("user_id", F.col("idx").alias("pos"), "value")


@query(f"WITH {S}, {_HALVES} SELECT l, rep, round(r, 6) AS r FROM c")
def split_half(spark, sf_dir):
    return stats.split_half(_values(spark, sf_dir), (5, 8, 10, 15), 20, 40, "user_id", "pos", "value").select("l", "rep", r("r"))


@query(f"WITH {S}, {_HALVES.replace('[5, 8, 10, 15]', '[5, 6, 7, 8]')} SELECT l, round(avg(r), 6) AS reliability FROM c GROUP BY l")
def split_half_curve(spark, sf_dir):
    return stats.reliability_curve(_values(spark, sf_dir), 3, 9, 20, 40, subject="user_id", value="value").select("l", r("reliability"))


@query(f"WITH {E}, m AS (SELECT min(value) AS lo, max(value) AS hi FROM e) SELECT least(floor((value - lo) * 100 / (hi - lo)), 99)::INT AS bin, count(*) AS n FROM e, m GROUP BY ALL")
def histogram(spark, sf_dir):
    return stats.histogram(events(spark, sf_dir), "value", 100)


@query(f"WITH {E} SELECT least(floor(value * 12 / 120), 11)::INT AS bx, least(floor(k * 10 / 100), 9)::INT AS by, count(*) AS n FROM e WHERE value BETWEEN 0 AND 120 AND k BETWEEN 0 AND 100 GROUP BY ALL")
def histogram_2d(spark, sf_dir):
    return grid.histogram_2d(events(spark, sf_dir), "value", "k", 12, 10, x_range=(0.0, 120.0), y_range=(0.0, 100.0))


@query(f"WITH {E} SELECT user_id, max(abs(value)) AS value_max, round(min(t), 6) AS t_min, round(max(t), 6) AS t_max FROM e GROUP BY user_id")
def extents(spark, sf_dir):
    return stats.extents(events(spark, sf_dir), ["value"], "t", U).select("user_id", "value_max", r("t_min"), r("t_max"))


# Sequences.


@query(f"""WITH {S}, g AS (SELECT *, t - lag(t) OVER w AS gap FROM s {W}), c AS (SELECT *, coalesce((gap > 2 * median(gap) OVER (PARTITION BY user_id) + 2)::INT, 0) AS cut FROM g),
n AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS session FROM c) SELECT user_id, session, count(*) AS n, min(event_id) AS first_id FROM n GROUP BY user_id, session""")
def gap_sessions(spark, sf_dir):
    s = sequence.gap_sessions(events(spark, sf_dir), "t", U, "event_id", factor=2.0)
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


_WIN = """c AS (SELECT user_id, count(*) AS n FROM s GROUP BY user_id HAVING count(*) >= 21),
p AS (SELECT user_id, n, w::INT AS win, w * 5 AS p FROM c, range(0, 200) r(w) WHERE w * 5 < n),
l AS (SELECT user_id, win, CASE WHEN p + 21 < n THEN p ELSE n - 21 END AS lo FROM p)"""


@query(f'WITH {S}, {_WIN} SELECT user_id, win AS "window", lo, lo + 21 AS hi FROM l')
def strided_windows(spark, sf_dir):
    return sequence.strided_windows(events(spark, sf_dir), U, "event_id", 21, 5, parity=True)


@query(f"""WITH {S}, {_WIN}, d AS (SELECT user_id, lo, min(win) AS win FROM l GROUP BY ALL)
SELECT d.user_id, win AS "window", count(*)::INT AS n, round(sum(value * (idx - lo + 1)), 4) AS checksum FROM d JOIN s ON s.user_id = d.user_id AND idx >= lo AND idx < lo + 21 GROUP BY ALL""")
def sequences(spark, sf_dir):
    e = events(spark, sf_dir)
    got = sequence.sequences(e, sequence.strided_windows(e, U, "event_id", 21, 5), U, "event_id", "value")
    total = F.aggregate(F.transform("samples", lambda x, i: x["value"] * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return got.select("user_id", "window", F.size("samples").alias("n"), F.round(total, 4).alias("checksum"))


@query("""WITH m AS (SELECT conv_id, list(length(text)::DOUBLE ORDER BY turn) AS a, conv_id % 8 AS b FROM conversations GROUP BY conv_id), x AS (SELECT *, max(len(a)) OVER (PARTITION BY b) AS l FROM m)
SELECT conv_id, l::INT AS size, round(len(a) / l, 6) AS share, list_sum(a) AS total FROM x""")
def padded_batches(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("double").alias("n")))), lambda x: x["n"]).alias("a"))
    out = sequence.collate(m.withColumn("b", F.col("conv_id") % 8), "a", "b")
    return out.select("conv_id", F.size("a").alias("size"), r("share"), F.aggregate("a", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query(f"WITH {S}, l AS (SELECT user_id, list(code ORDER BY event_id) AS c FROM s GROUP BY user_id) SELECT user_id, (len(c) - 1)::INT AS n, (list_sum(c[2:]) - (len(c) - 1))::BIGINT AS total, list_sum(c[:20])::BIGINT AS first_20 FROM l")
def shifted_sequence_labels(spark, sf_dir):
    c = series(spark, sf_dir).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "code"))), lambda x: x["code"]).alias("c"))
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return c.select("user_id", F.size(shifted_labels(F.col("c"))).alias("n"), add(shifted_labels(F.col("c"))).alias("total"), add(sequence.stripped(F.col("c"), 20)).alias("first_20"))


# Grids.


_CELL = 'least(floor(value / 10), 11)::INT AS bx, least(floor(k / 10), 9)::INT AS "by"'


def _cells(spark, sf_dir):
    cell = lambda c, n: F.least(F.floor(F.col(c) / 10), F.lit(n)).cast("int")
    return series(spark, sf_dir).withColumns({"bx": cell("value", 11), "by": cell("k", 9)})


@query(f"WITH {S}, c AS (SELECT *, {_CELL}, max(idx) OVER (PARTITION BY user_id) AS last FROM s) SELECT user_id, \"by\", round(sum(pow(0.99, last - idx)), 6) AS heat FROM c GROUP BY user_id, \"by\"")
def decay_sum(spark, sf_dir):
    s = series(spark, sf_dir).withColumns({"bx": F.lit(0), "by": F.least(F.floor(F.col("k") / 10), F.lit(9)).cast("int")})
    return grid.decayed_heat(s, "bx", "by", "idx", U).select("user_id", "by", r("heat"))


@query(f"""WITH {S}, c AS (SELECT user_id, idx, {_CELL} FROM s)
SELECT a.user_id, a.idx AS frame, a.bx, a."by", round(sum(pow(0.99, a.idx - b.idx)), 6) AS heat FROM c a JOIN c b ON a.user_id = b.user_id AND a.bx = b.bx AND a."by" = b."by" AND b.idx <= a.idx GROUP BY ALL""")
def decayed_frames(spark, sf_dir):
    """In blocks of 16 frames, so that most series have several."""
    s = _cells(spark, sf_dir)
    return grid.decayed_frames(s, "bx", "by", "idx", U, block=16).select("user_id", "frame", "bx", "by", r("heat"))


@query(f"""WITH {S}, c AS (SELECT user_id, idx, {_CELL} FROM s)
SELECT user_id, n AS frame, bx, "by", round(sum(pow(0.99, n - idx)), 6) AS heat FROM c, (SELECT unnest([9, 50, 90])::BIGINT AS n) WHERE idx <= n GROUP BY ALL""")
def heat_frames(spark, sf_dir):
    touched = grid.decayed_frames(_cells(spark, sf_dir), "bx", "by", "idx", U, block=16)
    return grid.heat_at(touched, (9, 50, 90), "bx", "by", U).select("user_id", "frame", "bx", "by", r("heat"))


@query(f"""WITH {S}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM s), f AS (SELECT *, greatest(1000 // n, 1) AS each FROM n)
SELECT user_id, event_id, idx * each AS first, least((idx + 1) * each, 1000) - 1 AS last FROM f WHERE idx * each < 1000""")
def movie_frames(spark, sf_dir):
    return grid.movie_frames(series(spark, sf_dir), "idx", U, 1000).select("user_id", "event_id", "first", "last")


@query(f"""WITH {E}, b AS (SELECT user_id, min(t) AS t0, max(t) - min(t) AS d FROM e GROUP BY user_id),
f AS (SELECT user_id, t0, unnest(range(0, floor(d * 0.001)::BIGINT + 1)) AS frame FROM b)
SELECT f.user_id, frame, arg_max(event_id, (t - t0, event_id)) AS event_id FROM f JOIN e ON e.user_id = f.user_id AND ceil((t - t0) * 0.001) <= frame GROUP BY f.user_id, frame""")
def frame_clock(spark, sf_dir):
    """A frame every 1000 seconds."""
    return clean.on_clock(events(spark, sf_dir), U, "t", "event_id", 0.001).select("user_id", "frame", "event_id")


_BLUR = f"kern AS (SELECT d - 4 AS d, w FROM (SELECT unnest(range(9)) AS d, unnest({grid.gaussian_kernel(1.0)}::DOUBLE[]) AS w))"


@query(f"""WITH {E}, {_BLUR}, h AS (SELECT least(floor(value * 12 / 120), 11)::INT AS bx, least(floor(k * 10 / 100), 9)::INT AS "by", count(*) AS n FROM e WHERE value BETWEEN 0 AND 120 AND k BETWEEN 0 AND 100 GROUP BY ALL),
a AS (SELECT bx + d AS bx, "by", sum(n * w) AS n FROM h, kern WHERE bx + d BETWEEN 0 AND 11 GROUP BY ALL) SELECT bx::INT AS bx, ("by" + d)::INT AS "by", round(sum(n * w), 6) AS n FROM a, kern WHERE "by" + d BETWEEN 0 AND 9 GROUP BY ALL""")
def gaussian_blur(spark, sf_dir):
    cells = grid.histogram_2d(events(spark, sf_dir), "value", "k", 12, 10, x_range=(0.0, 120.0), y_range=(0.0, 100.0))
    return grid.gaussian_blur(cells, 12, 10, sigma=1.0).select(F.col("bx").cast("int").alias("bx"), F.col("by").cast("int").alias("by"), r("n"))


@query(f"WITH {E}, {_GRID} SELECT event_id, arg_min(ord, (round(sqrt(pow(tx - value * 10, 2) + pow(ty - k * 10, 2)), 9), ord)) AS target FROM e, t GROUP BY event_id")
def nearest_target(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", (F.col("value") * 10).alias("x"), (F.col("k") * 10).alias("y"))
    return grid.nearest_target(e, grid.target_grid(spark), "x", "y", ["event_id"]).select("event_id", "target")


# Expressions.


@query("""SELECT event_id, value / 500 AS share, round((value / 500 * 1920 - 960) * 0.02332229080245354, 6) AS linear_x, round((value / 500 * 1080 - 540) * 0.02332229080245354, 6) AS linear_y,
 round(degrees(atan2((value / 500 * 1920 - 960) * 0.000264583, 0.65)), 6) AS arctan FROM events""")
def degrees_of_gaze(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("share", F.col("value") / 500)
    x, y = linear_degrees(F.col("share"), F.col("share"))
    return e.select("event_id", "share", F.round(x, 6).alias("linear_x"), F.round(y, 6).alias("linear_y"), F.round(arctangent_degrees(F.col("share") * 1920, 960), 6).alias("arctan"))


@query("SELECT p_partkey, round((1 / (degrees(2 * atan(p_size / (2 * 60.0))) / 1920) + 1 / (degrees(2 * atan((p_size + 1) / (2 * 60.0))) / 1080)) / 2, 6) AS px FROM part")
def px_per_degree(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(pixels_per_degree(F.col("p_size"), F.col("p_size") + 1, F.lit(1920), F.lit(1080), F.lit(60.0)), 6).alias("px"))


@query("""SELECT event_id, greatest(ceil(value)::BIGINT // 2 * 2 + 1, 3) AS odd, printf('%.3f', value * 1000 / pow(1000, p)) || ['', 'K', 'M', 'G', 'T', 'P'][p + 1] AS short, round(sqrt(-2 * ln(value / 1000)) * cos(2 * pi() * value / 700), 6) AS normal
FROM (SELECT *, list_sum(list_transform([1, 2, 3, 4, 5], lambda i: (abs(value * 1000) >= pow(1000, i))::INT))::INT AS p FROM events)""")
def scalar_helpers(spark, sf_dir):
    e, v = table(spark, sf_dir, "events"), F.col("value")
    return e.select("event_id", round_up_to_odd(v).alias("odd"), human_format(v * 1000).alias("short"), F.round(box_muller(v / 1000, v / 700), 6).alias("normal"))


@query(f"WITH {E} SELECT event_id, unnest(range(6))::INT AS class, unnest(list_transform(range(6), lambda c: (c = code)::INT)) AS hot FROM e")
def one_hot_events(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.posexplode(one_hot(F.col("code"), 6)).alias("class", "hot"))


@query(f"WITH {E} SELECT event_id, CASE code WHEN 1 THEN 10 WHEN 2 THEN 20 ELSE code END AS some, CASE code WHEN 1 THEN 1 ELSE 2 END AS every FROM e")
def recoded(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", recode(F.col("code"), {1: 10, 2: 20}).alias("some"), recode(F.col("code"), {1: 1}, 2).alias("every"))


@query("SELECT o_orderkey, CASE WHEN lower(substr(o_orderstatus, 1, 1)) = 'o' THEN o_totalprice ELSE o_custkey END AS x FROM orders")
def dominant_eye(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    eyes = o.withColumns({"dom_eye": F.when(F.lower(F.substring("o_orderstatus", 1, 1)) == "o", "R").otherwise("l"), "right_x": F.col("o_totalprice"), "left_x": F.col("o_custkey").cast("double"), "right_y": F.lit(0), "left_y": F.lit(0)})
    return clean.dominant_eye(eyes).select("o_orderkey", "x")


@query("SELECT n_nationkey, make_timestamp(2024, 1 + n_nationkey % 12, 1 + n_nationkey, 10, 11, 12) AS at FROM nation")
def recording_dates(spark, sf_dir):
    from .sources import recording_date

    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    day = F.make_timestamp(F.lit(2024), 1 + k % 12, 1 + k, F.lit(10), F.lit(11), F.lit(12))
    header = F.concat(F.lit("MATLAB 5.0 MAT-file, Platform: PCWIN64, Created on: "), F.date_format(day, "EEE MMM d HH:mm:ss yyyy"))
    return n.select("n_nationkey", recording_date(header).cast("timestamp_ntz").alias("at"))


@query("SELECT s_name AS name, s_nationkey AS grp FROM supplier UNION ALL SELECT c_name, c_nationkey FROM customer ORDER BY grp, name")
def cohorts_in_order(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("grp"))
    return s.unionByName(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("grp"))).orderBy("grp", "name")


# Names, files and records.


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 1")
def fixations_only(spark, sf_dir):
    return label.only_fixations(table(spark, sf_dir, "lineitem"), "l_linenumber").select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, replace(p_name, ' ', '_') AS name FROM part WHERE split_part(replace(p_name, ' ', '_'), '_', 1) IN (SELECT DISTINCT split_part(p_name, ' ', 1) FROM part WHERE p_partkey <= 3)")
def allowed_names(spark, sf_dir):
    from .sources import allowed

    p = table(spark, sf_dir, "part")
    names = [x[0] for x in p.where("p_partkey <= 3").select(F.split("p_name", " ")[0]).distinct().collect()]
    return allowed(p.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("name")), names)


@query("""WITH i AS (SELECT 'x/' || replace(s_name, '#', '') || '_' || s_nationkey || '.jpg' AS path, s_nationkey::VARCHAR AS panel FROM supplier)
SELECT (n_nationkey * 3)::VARCHAR AS panel, min(path) AS path FROM nation LEFT JOIN i ON panel = (n_nationkey * 3)::VARCHAR GROUP BY 1""")
def panel_images(spark, sf_dir):
    """Panels beyond the last nation's number have no image."""
    s = table(spark, sf_dir, "supplier")
    images = s.select(F.concat(F.lit("x/"), F.replace("s_name", F.lit("#"), F.lit("")), F.lit("_"), F.col("s_nationkey").cast("string"), F.lit(".jpg")).alias("path"))
    panels = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 3).cast("string").alias("panel"))
    return align.image_of_panel(panels, images).select("panel", "path")


@query("""WITH a AS (SELECT 'x/a_b_RUN' || s_nationkey || 'x_' || s_suppkey || '.wav' AS path, 'run' || s_nationkey || 'x' AS token FROM supplier),
p AS (SELECT n_nationkey, 'n' || n_nationkey * 2 AS panel FROM nation) SELECT panel, min(path) AS path FROM p LEFT JOIN a ON contains(token, panel) GROUP BY panel""")
def panel_audio(spark, sf_dir):
    """Panels beyond the last nation's number have no recording."""
    s = table(spark, sf_dir, "supplier")
    audio = s.select(F.concat(F.lit("x/a_b_RUN"), F.col("s_nationkey").cast("string"), F.lit("x_"), F.col("s_suppkey").cast("string"), F.lit(".wav")).alias("path"))
    panels = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), (F.col("n_nationkey") * 2).cast("string")).alias("panel"))
    return align.audio_of_panel(panels, audio).select("panel", "path")


@query("""SELECT least(floor(value / 500 * 1920), 1919)::INT AS bx, least(floor((code - 1) / 5.0 * 1080), 1079)::INT AS by, count(*) AS n
FROM (SELECT value, list_position(['view', 'click', 'purchase', 'signup', 'error'], event_type) AS code FROM events) WHERE value BETWEEN 0 AND 500 GROUP BY ALL""")
def gaze_heatmap(spark, sf_dir):
    e = events(spark, sf_dir).select((F.col("value") / 500).alias("x"), ((F.col("code") - 1) / 5.0).alias("y"))
    return grid.gaze_heatmap(e)


_PLACES = "SELECT user_id::VARCHAR AS participant, event_id AS t, value AS x, k AS y, 1 AS status, code AS evt FROM e"


def _samples(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select(F.col("user_id").cast("string").alias("participant"), F.col("event_id").cast("double").alias("t"), F.col("value").alias("x"), F.col("k").alias("y"), F.lit(1.0).alias("status"), F.col("code").cast("double").alias("evt"))


@query(f"WITH {E}, p AS ({_PLACES}) SELECT participant, t::BIGINT AS t, round(x, 6) AS x, round(y, 6) AS y FROM p")
def written_records(spark, sf_dir):
    """Records to Parquet by series, twice, of which the second time writes none; and back."""
    from .sources import append_missing

    path, rows = scratch(spark, "records"), _samples(spark, sf_dir)
    append_missing(rows, path, ["participant"])
    append_missing(rows, path, ["participant"])
    return spark.read.parquet(path).select(F.col("participant").cast("string").alias("participant"), F.col("t").cast("long").alias("t"), r("x"), r("y"))


@query(f"WITH {E}, p AS ({_PLACES}) SELECT t::BIGINT AS t, round(x, 6) AS eye_horizontal, round(y, 6) AS eye_vertical, evt::INT AS evt FROM p")
def written_csv(spark, sf_dir):
    """Fixations to CSV and back."""
    from .sources import fixation_csv, write_csv

    path, rows = scratch(spark, "csv"), _samples(spark, sf_dir)
    write_csv(rows.select(F.col("t").cast("long").alias("idx"), "t", F.col("x").alias("eye_horizontal"), F.col("y").alias("eye_vertical"), "status", "evt"), path, "idx")
    got = fixation_csv(spark, path)
    return got.select(F.col("t").cast("long").alias("t"), r("eye_horizontal"), r("eye_vertical"), F.col("evt").cast("int").alias("evt"))


@query(f"WITH {E}, p AS ({_PLACES}) SELECT participant, t::BIGINT AS t, round(x, 6) AS x FROM p")
def written_json(spark, sf_dir):
    from .sources import write_json

    path, rows = scratch(spark, "json"), _samples(spark, sf_dir)
    write_json(rows, path)
    return spark.read.schema(rows.schema).json(path).select("participant", F.col("t").cast("long").alias("t"), r("x"))


@query(f"""WITH {E}, p AS ({_PLACES}) SELECT participant, (row_number() OVER (PARTITION BY participant ORDER BY t) - 1) AS idx, round(x::FLOAT::DOUBLE, 3) AS x, round(y::FLOAT::DOUBLE, 3) AS y,
  (evt <= 3)::INT AS status, evt::INT AS evt FROM p""")
def written_npy(spark, sf_dir):
    """A file of records a series, listed and decoded again."""
    from .sources import listed, npy_records, write_npy

    path = scratch(spark, "npy")
    write_npy(_samples(spark, sf_dir), path, ["participant"], "t", ["t", "x", "y", "status", "evt"])
    got = npy_records(listed(spark, path, "*.npy", contents=True))
    return got.select(F.regexp_extract("path", "([^/]+)\\.npy$", 1).alias("participant"), "idx", F.round(F.col("x").cast("double"), 3).alias("x"), F.round(F.col("y").cast("double"), 3).alias("y"), F.col("status").cast("int").alias("status"), F.col("evt").cast("int").alias("evt"))


# Whole analyses: a user's events are a panel, purchases its utterances.


@query(f"WITH {S} SELECT user_id, event_id, idx, round(value, 6) AS value FROM s WHERE idx < 40")
def npy_source(spark, sf_dir):
    """Series written as NPY files in two phases and read as a data source, a file's
    first 40 rows alone."""
    path = scratch(spark, "npy-source")
    datasource.write_npy(events(spark, sf_dir), path, U, "event_id", ["event_id", "value"])
    datasource.register(spark)
    rows = spark.read.format("npy").option("rows", "64").load(path).where("idx < 40")
    return rows.select(F.regexp_extract("path", r"([0-9]+)\.npy$", 1).cast("long").alias("user_id"), "event_id", "idx", r("value"))


def _utterances(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type in ('purchase', 'signup')")
    return with_ordinal(e, U, "event_id", name="ord").select("user_id", "ord", "t", F.when(F.col("event_type") == "purchase", 1).otherwise(-1).alias("sentence_breaks"))


_SPOKEN = "u AS (SELECT user_id, t, event_id, CASE event_type WHEN 'purchase' THEN 1 ELSE -1 END AS b FROM e WHERE event_type IN ('purchase', 'signup'))"


@query(f"""WITH {E}, {_SPOKEN}, c AS (SELECT user_id, count(*) AS n FROM u GROUP BY user_id), o AS (SELECT user_id, count(*) AS m FROM e WHERE code = 1 GROUP BY user_id),
k AS (SELECT c.user_id FROM c JOIN o USING (user_id) WHERE (n // 2) * 1.0 / m > 0.8 AND (n // 2) * 1.0 / m < 1.2),
i AS (SELECT user_id, lead(t) OVER (PARTITION BY user_id ORDER BY t) - t AS gap FROM u JOIN k USING (user_id) WHERE b = 1)
SELECT user_id, round(median(gap), 6) AS med, round(stddev_pop(gap), 4) AS std FROM i WHERE gap IS NOT NULL GROUP BY user_id HAVING count(gap) > 5""")
def speech_timing(spark, sf_dir):
    """Expected of each panel are as many utterances as there are views."""
    from . import plans

    scores = events(spark, sf_dir).where("code = 1").groupBy("user_id").agg(F.count(F.lit(1)).alias("strike_score")).withColumn("panel", F.lit(1))
    out = plans.speech_timing(_utterances(spark, sf_dir).withColumn("panel", F.lit(1)), U, ["panel"], scores, least=5, panels=1)
    return out.select("user_id", F.round("median", 6).alias("med"), r("std", 4))


@query(f"""WITH {S}, {_SPOKEN}, c AS (SELECT user_id FROM u GROUP BY user_id HAVING count(*) > 10 AND count(*) < 250),
j AS (SELECT s.*, coalesce((SELECT any_value(1) FROM c WHERE c.user_id = s.user_id AND s.event_type = 'purchase'), 0) AS opens FROM s),
w AS (SELECT *, coalesce(sum(opens) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg, sum(opens) OVER (PARTITION BY user_id) AS total FROM j),
x AS (SELECT user_id, seg, avg((value / 500 < {C.KEY_AREA_BOTTOM})::INT::DOUBLE) AS a, avg((code = 1)::INT::DOUBLE) AS b FROM w WHERE opens = 0 AND idx > 0 AND seg < total GROUP BY ALL)
SELECT user_id, round(avg(a), 6) AS key_share, round(avg(b), 6) AS fixation_share FROM x GROUP BY user_id""")
def declaration_shares(spark, sf_dir):
    from . import plans

    samples = series(spark, sf_dir).select("user_id", "idx", "t", (F.col("value") / 500).alias("y"), F.col("code").alias("evt"))
    return plans.declaration_shares(samples, _utterances(spark, sf_dir), U, []).select("user_id", r("key_share"), r("fixation_share"))


# Vectors.


@query("""WITH c AS (SELECT label AS cluster, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
d AS (SELECT vec_id, cluster, list_distance(embedding::DOUBLE[], v) AS d FROM embeddings, c) SELECT vec_id, arg_min(cluster, (round(d, 9), cluster)) AS cluster, round(min(d), 6) AS distance FROM d GROUP BY vec_id""")
def nearest_centroid(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy(F.col("label").alias("cluster")).agg(F.min_by("embedding", "vec_id").alias("centroid"))
    return vector.nearest_centroid(e.select("vec_id", "embedding"), first, "embedding").select("vec_id", "cluster", r("distance"))


@query("""WITH c AS (SELECT label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label))
SELECT vec_id AS left_id, c.label AS right_id, round(list_distance(embedding::DOUBLE[], v), 6) AS distance FROM embeddings, c""")
def centroid_distances(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return vector.pairwise_distances(e, first, "vec_id", "label", "embedding").select("left_id", "right_id", r("distance"))


def _lloyd_sql(select: str, k: int = 7, rounds: int = 10, seed: int = 0) -> str:
    """Lloyd's rounds one after the other, each with a row drawn for an empty cluster."""
    pick = lambda draw, j: f"arg_min(v, md5(vec_id || ':{seed}:{draw}:' || {j}))"
    out = ["v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)", f"j AS (SELECT range::INT AS j FROM range({k}))", f"c0 AS MATERIALIZED (SELECT j, {pick(0, 'j')} AS c FROM j, v GROUP BY j)"]
    for n in range(1, rounds + 1):
        out.append(f"a{n} AS MATERIALIZED (SELECT vec_id, arg_min(j, (d, j)) AS j FROM (SELECT vec_id, j, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{n - 1}) GROUP BY vec_id)")
        out.append(f"m{n} AS (SELECT j, list(m ORDER BY i) AS m FROM (SELECT j, i, avg(x) AS m FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n} JOIN v USING (vec_id)) GROUP BY j, i) GROUP BY j)")
        out.append(f"c{n} AS MATERIALIZED (SELECT j.j, coalesce(any_value(m.m), {pick(n, 'j.j')}) AS c FROM j LEFT JOIN m{n} m ON m.j = j.j, v GROUP BY j.j)")
    return f"WITH {', '.join(out)} {select.format(n=rounds)}"


@query(_lloyd_sql("SELECT vec_id, j AS cluster FROM a{n}"))
def kmeans_clusters(spark, sf_dir):
    return vector.lloyd(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")[1].select("vec_id", "cluster")


@query(
    _lloyd_sql("""SELECT round(10000 * f + 0.001 * p, 4) AS loss FROM (SELECT avg(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / len(v)) AS f FROM a{n} JOIN v USING (vec_id) JOIN c{n} USING (j)),
(SELECT sum(1 / (list_distance(x.c, y.c) + 1e-6)) AS p FROM c{n} x JOIN c{n} y ON x.j < y.j)""")
)
def clustering_loss(spark, sf_dir):
    centres, out = vector.lloyd(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return vector.centroid_loss(out, centres, "embedding").select(r("loss", 4))


@query()
def pca_components(spark, sf_dir):
    return vector.pca(table(spark, sf_dir, "embeddings"), "embedding")[1].select("vec_id", "components")


def _mean_model():
    import pandas as pd

    return lambda batch: pd.DataFrame({"vec_id": batch["vec_id"], "score": [float(sum(map(float, v)) / len(v)) for v in batch["embedding"]]})


@query("SELECT vec_id, round(list_avg(embedding::DOUBLE[]), 6) AS score FROM embeddings")
def model_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector.score_sequences(e, _mean_model, "vec_id long, score double").select("vec_id", r("score"))


def _user_windows(spark, sf_dir, length: int, stride: int) -> DataFrame:
    """Windows of every user's ``value`` and ``k``, in shares of their ranges."""
    e = events(spark, sf_dir).withColumns({"x": F.col("value") / 200, "y": F.col("k") / 100})
    return sequence.sequences(e, sequence.strided_windows(e, U, "event_id", length, stride), U, "event_id", "t", "x", "y")


#: Windows of the auto-encoder's queries, and sizes of its layers.
_AUTO = {"length": 24, "latent": 8, "channels": (8, 16), "hidden": (16, 8), "outward": (8, 16, 32)}


def _auto_weights():
    return autoencoder.initial(**_AUTO)


@query()
def autoencoder_errors(spark, sf_dir):
    """Latent vectors and errors of all users' windows, by an untrained model."""
    w = _user_windows(spark, sf_dir, 24, 12).withColumn("x", autoencoder.flat_window(F.col("samples"), "x", "y"))
    return autoencoder.reconstructed(w, ["user_id", "window"], _auto_weights).select("user_id", "window", F.transform("latent", lambda x: F.round(x, 6)).alias("latent"), r("error"))


@query()
def autoencoder_training(spark, sf_dir):
    """The mean loss of two epochs over all users' windows, and the score of the second."""
    w = _user_windows(spark, sf_dir, 24, 12).withColumn("x", autoencoder.flat_window(F.col("samples"), "x", "y"))
    got = training.train(w, ["user_id", "window"], "x", (2, 24), _auto_weights(), autoencoder.gradient, autoencoder.squared_error, scratch(spark, "batches"), epochs=2, batch=1024, rate=0.01)
    rows = [(n, loss, got.scores.get(n)) for n, loss in enumerate(got.losses)]
    return spark.createDataFrame(rows, "epoch int, loss double, score double").select("epoch", r("loss", 4), r("score", 4))


@query()
def classified_windows(spark, sf_dir):
    """Event codes of all users' samples by a classifier with seeded weights: windows,
    classification, and the last window's code for each sample."""
    guess = classifier.classified(_user_windows(spark, sf_dir, 24, 12), "user_id long, window int", lambda: classifier.seeded_weights(channels=4, hidden=8))
    e = events(spark, sf_dir).select("user_id", "event_id", "t", "code")
    return align.with_predictions(e, guess, U, "t", "evt", "window").select("user_id", "event_id", "code", "evt_pred")


@query("SELECT range AS batch, least(64, n - 64 * range) AS size FROM (SELECT count(*) AS n FROM events), range(0, (SELECT count(*) FROM events) // 64 + 1) WHERE n > 64 * range")
def seeded_batches(spark, sf_dir):
    return sequence.seeded_batches(table(spark, sf_dir, "events").select("event_id"), ["event_id"], 64).groupBy("batch").agg(F.count(F.lit(1)).alias("size"))


@query()
def noisy_copies(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "value", "k")
    return sequence.augmented(e, ["value", "k"], (0.0, 0.25, 0.5))


@query()
def seeded_shuffle(spark, sf_dir):
    return sequence.shuffled(events(spark, sf_dir).select("event_id", "value"), "event_id")


# Streams.


@query(f"""WITH {S}, g AS (SELECT *, coalesce(t - lag(t) OVER w > 21600, false)::INT AS ch FROM s {W}),
r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM g),
x AS (SELECT user_id, run, min(t) AS a, max(t) AS b, count(*) AS n FROM r GROUP BY user_id, run)
SELECT user_id, round(a, 6) AS start, n FROM x WHERE b + 21600 <= (SELECT max(t) FROM s) - 3600""")
def streamed_sessions(spark, sf_dir):
    """Sessions of a stream of the events, as far as its watermark closes them:
    those that end an hour before the last event, 5,652 of 5,725 at sf0.01."""
    from . import streaming

    out = scratch(spark, "sessions")
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    sessions = streaming.gap_sessions(stream, "ts", U, "6 hours")
    sessions.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "stream")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(sessions.schema).parquet(out).select("user_id", F.round(F.unix_micros("start") / 1e6, 6).alias("start"), "n")


@query("""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t FROM events),
v AS (SELECT user_id, t, min(event_id) AS i FROM e WHERE event_type = 'view' GROUP BY user_id, t), c AS (SELECT * FROM e WHERE event_type = 'click'),
k AS (SELECT (least((SELECT max(t) FROM v), (SELECT max(t) FROM c)) // 1000 - 3600000) * 1000 AS mark),
b AS (SELECT c.event_id, c.user_id, c.t, p.t AS pt, p.i AS pi FROM c ASOF LEFT JOIN v p ON p.user_id = c.user_id AND p.t <= c.t),
n AS (SELECT b.*, f.t AS ft, f.i AS fi FROM b ASOF LEFT JOIN v f ON f.user_id = b.user_id AND f.t > b.t)
SELECT user_id, event_id, CASE WHEN ft IS NULL OR t - pt <= ft - t THEN pi ELSE fi END AS nearest FROM n, k
WHERE coalesce(pt, ft) IS NOT NULL AND mark > greatest(t, least(ft, 2 * t - pt))""")
def streamed_nearest(spark, sf_dir):
    """The view nearest to each click, out of two streams, as far as their watermark
    settles it: an hour before the stream that ends first."""
    from . import streaming
    from .streaming.asof import PROVIDER

    out, provider = scratch(spark, "nearest"), "spark.sql.streaming.stateStore.providerClass"
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = lambda what: spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir).where(F.col("event_type") == what)
    views = stream("view").withColumnRenamed("event_id", "view_id")
    found = streaming.nearest_asof(stream("click"), views, "user_id", "ts", "event_id", "view_id", idle_s=1e8)
    before = spark.conf.get(provider)
    spark.conf.set(provider, PROVIDER)  # read as the stream starts
    try:
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "nearest-state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(found.schema).parquet(out).select("user_id", "event_id", "nearest")
