"""Labels, splits, models and their scores."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stopwise.functions import scoring, timecols
from stopwise.operators import clean, encoding, evaluate, features, graph, lookup, models, nested, numbering
from stopwise.plans.aggregates import rounded
from stopwise.plans.joins import NEWEST
from stopwise.plans.nested import CHANCES, chances, raw_connections
from stopwise.plans.registry import query
from stopwise.session import cut_lineage


def _located(t):
    return lookup.add_coordinates(t.delayed, t.stations)


_code = lambda c: f"CASE WHEN {c} IS NULL THEN -1 ELSE CAST(dense_rank() OVER (ORDER BY {c} NULLS LAST) - 1 AS INT) END AS {c}"


@query("ml_frame", "WITH " + NEWEST + f""", d AS (SELECT d.*, lat, lon, coalesce(ar_pt, dp_pt) AS p FROM delayed d LEFT JOIN newest ON name = station)
SELECT hash_id, {', '.join(_code(c) for c in features.CATEGORICAL)}, lat, lon, distance_to_start, distance_to_end, stop_id,
  CAST(extract(hour FROM p) * 60 + extract(minute FROM p) AS INT) AS minute, CAST(isodow(p) - 1 AS INT) AS day,
  CAST(floor(((epoch(dp_pt) - epoch(ar_pt)) % 86400 + 86400) % 86400 / 60) AS INT) AS stay_time, {', '.join(f'coalesce({c}, 0) AS {c}' for c in clean.OBSTACLE_COLUMNS)}, ar_delay, dp_delay FROM d""", views="delayed stations")
def _(t):
    return features.ml_frame(_located(t), keep=("hash_id",))


LABELS = [f"ar_{m}" for m in range(15)] + [f"dp_{m + 1}" for m in range(15)]


def _label_sql(name: str) -> str:
    end, minute = name.split("_")
    test = f"{end}_delay <= {minute}" if end == "ar" else f"{end}_delay >= {minute}"
    return f"(coalesce({test}, FALSE) AND {end}_cs IS DISTINCT FROM 'c') AS {name}"


@query("delay_labels", f"SELECT hash_id, {', '.join(map(_label_sql, LABELS))} FROM delayed", views="delayed")
def _(t):
    return t.delayed.select("hash_id", *[c.alias(n) for n, c in features.delay_labels().items()])


@query("split_by_date", """
SELECT hash_id, 'train' AS part FROM stops WHERE (ar_pt >= TIMESTAMP '2024-01-08' OR dp_pt >= TIMESTAMP '2024-01-08') AND (ar_pt < TIMESTAMP '2024-01-15' OR dp_pt < TIMESTAMP '2024-01-15')
UNION ALL SELECT hash_id, 'test' FROM stops WHERE (ar_pt >= TIMESTAMP '2024-01-15' OR dp_pt >= TIMESTAMP '2024-01-15') AND (ar_pt < TIMESTAMP '2024-01-29' OR dp_pt < TIMESTAMP '2024-01-29')""", views="stops")
def _(t):
    train, test = features.split_by_date(t.stops, dt.datetime(2024, 1, 15), 7)
    return train.select("hash_id", F.lit("train").alias("part")).union(test.select("hash_id", F.lit("test")))


ORDER = "md5('0:' || CAST(hash_id AS VARCHAR))"


@query("balance_undersample", f"""
WITH y AS (SELECT hash_id, CAST(ar_delay <= 5 AS INT) AS label FROM delayed WHERE ar_delay IS NOT NULL), m AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM y GROUP BY label))
SELECT hash_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {ORDER}, hash_id) AS r FROM y), m WHERE r <= least""", views="delayed")
def _(t):
    rows = t.delayed.select("hash_id", (F.col("ar_delay") <= 5).cast("int").alias("label"))
    return features.balance_undersample(rows, "label", "hash_id")


@query("random_split", f"SELECT hash_id, CAST('0x' || substr({ORDER}, 1, 8) AS BIGINT) < {int(0.9 * 2 ** 32)} AS is_train FROM stops", views="stops")
def _(t):
    return features.random_split(t.stops.select("hash_id"), "hash_id")


@query("ordered_split", "SELECT hash_id, row_number() OVER (ORDER BY hash_id) <= floor((SELECT count(*) FROM stops) * 0.8) AS is_train FROM stops", views="stops")
def _(t):
    return numbering.ordered_split(t.stops.select("hash_id"), [F.col("hash_id")])


@query("held_out_group", "SELECT hash_id, CASE WHEN c = 'view' THEN 'test' ELSE 'train' END AS part FROM stops", views="stops")
def _(t):
    train, test = features.held_out(t.stops.select("hash_id", "c"), "c", "view")
    return train.select("hash_id", F.lit("train").alias("part")).union(test.select("hash_id", F.lit("test")))


# --- scores of given predictions -------------------------------------------------------

SCORED = "WITH y AS (SELECT hash_id, CAST(ar_delay <= 5 AS INT) AS label, CAST(distance_to_last < 600 AS INT) AS prediction, -distance_to_last AS score, CAST(dp_delay <= 5 AS INT) AS label2, CAST(distance_to_next < 500 AS INT) AS prediction2 FROM delayed WHERE ar_delay IS NOT NULL) "


def _scored(t):
    known = t.delayed.filter("ar_delay is not null")
    return known.select("hash_id", (F.col("ar_delay") <= 5).cast("int").alias("label"), (F.col("distance_to_last") < 600).cast("int").alias("prediction"),
                            (-F.col("distance_to_last")).alias("score"), (F.col("dp_delay") <= 5).cast("int").alias("label2"),
                            (F.col("distance_to_next") < 500).cast("int").alias("prediction2"))


@query("majority_baseline", SCORED + "SELECT round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS baseline FROM (SELECT count(*) AS n FROM y GROUP BY label)", views="delayed")
def _(t):
    return rounded(evaluate.majority_baseline(_scored(t), "label"))


@query("accuracy_lift", SCORED + """
SELECT round(a, 6) AS accuracy, round(b, 6) AS baseline, round((a - b) * 100, 6) AS lift_percent FROM (SELECT avg(CAST(label = prediction AS INT)) AS a, greatest(avg(label), 1 - avg(label)) AS b FROM y)""", views="delayed")
def _(t):
    return rounded(evaluate.accuracy_lift(_scored(t), "label", "prediction"))


@query("confusion_matrix", SCORED + "SELECT label, count(*) FILTER (WHERE prediction = 0) AS predicted_0, count(*) FILTER (WHERE prediction = 1) AS predicted_1 FROM y GROUP BY label", views="delayed")
def _(t):
    return evaluate.confusion_matrix(_scored(t), "label", "prediction", [0, 1])


_multi = lambda n, y, p: f"""SELECT '{n}' AS label, tn, fp, fn, tp, round(tn / CAST(tn + fp AS DOUBLE), 6) AS acc1, round(tp / CAST(tp + fn AS DOUBLE), 6) AS acc2 FROM (SELECT count(*) FILTER (WHERE {y} = 0 AND {p} = 0) AS tn,
 count(*) FILTER (WHERE {y} = 0 AND {p} = 1) AS fp, count(*) FILTER (WHERE {y} = 1 AND {p} = 0) AS fn, count(*) FILTER (WHERE {y} = 1 AND {p} = 1) AS tp FROM y)"""


@query("multilabel_counts", SCORED + _multi("ar", "label", "prediction") + " UNION ALL " + _multi("dp", "label2", "prediction2"), views="delayed")
def _(t):
    return rounded(evaluate.multilabel_counts(_scored(t), {"ar": ("label", "prediction"), "dp": ("label2", "prediction2")}))


ROC = SCORED + """, g AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM y GROUP BY score),
r AS (SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY score DESC))
"""


@query("roc_points", ROC + "SELECT score, round(fp / CAST(n AS DOUBLE), 6) AS fpr, round(tp / CAST(p AS DOUBLE), 6) AS tpr FROM r", views="delayed")
def _(t):
    return rounded(evaluate.roc_points(_scored(t), "score", "label").drop("area"))


@query("roc_auc", ROC + "SELECT round(sum(CAST(neg AS DOUBLE) / n * (2 * tp - pos) / p / 2), 6) AS auc FROM r", views="delayed")
def _(t):
    return rounded(evaluate.roc_auc(_scored(t), "score", "label"))


_report = lambda c: f"""SELECT {c} AS class, tp / CAST(pp AS DOUBLE) AS p, tp / CAST(s AS DOUBLE) AS r, s FROM (SELECT count(*) FILTER (WHERE label = {c} AND prediction = {c}) AS tp, count(*) FILTER (WHERE prediction = {c}) AS pp, count(*) FILTER (WHERE label = {c}) AS s FROM y)"""


@query("classification_report", SCORED + f"SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, s AS support FROM ({_report(0)} UNION ALL {_report(1)})", views="delayed")
def _(t):
    return rounded(evaluate.classification_report(_scored(t), "label", "prediction"))


@query("score_vs_actual", CHANCES + """, x AS (SELECT s.score, CAST((epoch(dp_pt) - epoch(ar_pt)) / 60 AS INT) AS planned, CAST(floor((epoch(dp_ct) - epoch(ar_ct)) / 60) AS INT) AS real FROM s JOIN stops ON hash_id = s.k)
SELECT round(regr_slope(CAST(real AS DOUBLE), CAST(score AS DOUBLE)), 6) AS slope, round(regr_intercept(CAST(real AS DOUBLE), CAST(score AS DOUBLE)), 6) AS intercept, count(*) AS n FROM x WHERE planned = 5 AND real < 60 AND real > -60""", views="stops")
def _(t):
    score = scoring.connection_score(F.col("ar"), F.col("dp"), F.col("transfer"))
    scored = chances(t).select("hash_id", score.alias("score"))
    times = t.stops.select("hash_id", timecols.minutes_between(F.col("dp_pt"), F.col("ar_pt")).alias("planned"), timecols.minutes_between(F.col("dp_ct"), F.col("ar_ct")).alias("real"))
    return rounded(evaluate.score_vs_actual(scored.join(times, "hash_id"), "score", "planned", "real"))


@query("prediction_features", """
WITH codes AS (SELECT name, dense_rank() OVER (ORDER BY name) - 1 AS code FROM (SELECT DISTINCT name FROM stations)),
o AS (SELECT o_orderkey AS k, o_orderkey % 4 AS last, o_orderdate + INTERVAL '1' MINUTE * CAST(o_custkey % 1440 AS INT) AS base FROM orders WHERE o_orderkey % 10 <> 3),
s AS (SELECT *, unnest(range(0, last + 1)) AS i FROM o),
x AS (SELECT k, i, CAST(timezone('Europe/Berlin', timezone('UTC', base + INTERVAL '1' MINUTE * CAST(i * 50 + 35 + (k + i * 7) % 23 AS INT))) AS TIMESTAMP) AS ar_ct,
  CAST(timezone('Europe/Berlin', timezone('UTC', base + INTERVAL '1' MINUTE * CAST(i * 50 + k % 9 AS INT))) AS TIMESTAMP) AS dp_ct FROM s)
SELECT k AS o_orderkey, CAST(i AS INT) AS position, CAST(coalesce(d.code, -1) AS INT) AS dp_station, CAST(coalesce(a.code, -1) AS INT) AS ar_station,
  CAST(hour(ar_ct) * 60 + minute(ar_ct) AS INT) AS ar_minute, CAST(isodow(ar_ct) - 1 AS INT) AS ar_day, CAST(hour(dp_ct) * 60 + minute(dp_ct) AS INT) AS dp_minute, CAST(isodow(dp_ct) - 1 AS INT) AS dp_day,
  CAST(k % 10 AS DOUBLE) AS dp_lat, CAST(i + 20 AS DOUBLE) AS ar_lat
FROM x LEFT JOIN (SELECT DISTINCT name, eva FROM stations WHERE valid_from IS NULL) sd ON sd.eva = 8000000 + (k + i) % 120 LEFT JOIN codes d ON d.name = sd.name
LEFT JOIN (SELECT DISTINCT name, eva FROM stations WHERE valid_from IS NULL) sa ON sa.eva = 8000000 + (k + i + 1) % 120 LEFT JOIN codes a ON a.name = sa.name""", views="stations")
def _(t):
    rows = nested.connection_segments(nested.parse_connections(raw_connections(t)), t.stations, "o_orderkey")
    encoders = encoding.build_encoders(t.stations.select(F.col("name").alias("station")), ["station"])
    for end in ("dp", "ar"):
        named = encoders.withColumn("name", F.lit(f"{end}_station"))
        rows = encoding.encode(rows, named, [f"{end}_station"])
    clock = lambda e: [timecols.minute_of_day(F.col(f"{e}_ct")).alias(f"{e}_minute"), timecols.weekday_from_monday(F.col(f"{e}_ct")).alias(f"{e}_day")]
    return rows.select("o_orderkey", "position", F.col("dp_station_code").alias("dp_station"), F.col("ar_station_code").alias("ar_station"),
                       *clock("ar"), *clock("dp"), "dp_lat", "ar_lat")


# --- models (rows only: training has no SQL twin) --------------------------------------

COLUMNS = ["distance_to_start", "distance_to_end", "stop_id", "minute", "day", "stay_time", "obstacles_priority_37"]


def _frame(t):
    """Numeric features with label ``ar_5``, the status columns and the planned times."""
    stops = clean.fill_obstacles(clean.time_features(t.delayed))
    label = features.delay_labels([5])["ar_5"].cast("int")
    return stops.select("hash_id", *COLUMNS, "ar_delay", "dp_delay", "ar_cs", "dp_cs", "ar_pt", "dp_pt", "c", label.alias("label"))


def _halves(t):
    placed = features.random_split(_frame(t), "hash_id", 0.8)
    return placed.filter("is_train"), placed.filter("not is_train")


def _stored_models(t) -> models.Models:
    """The 30 models of the table, grown and stored once per application and state of the input files."""
    def grow(frame, path):
        models.train_threshold_models(frame, COLUMNS, path=path)

    path = t.stored_path("threshold_models", lambda: cut_lineage(_halves(t)[0]), grow)
    return models.Models.load(t.spark, path)


@query("train_threshold_models")
def _(t):
    return models.lift_of_models(_stored_models(t), _halves(t)[1], features.delay_labels())


@query("predict_matrix")
def _(t):
    made = _stored_models(t)
    return models.predict_matrix(made, _halves(t)[1]).select("hash_id", *[f"p_{n}" for n in made.trees])


@query("other_classifiers")
def _(t):
    return models.compare_classifiers(*_halves(t), COLUMNS)


DATES = dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 28)  # six dates, four days apart


@query("rolling_backtest")
def _(t):
    return models.rolling_backtest(cut_lineage(_frame(t)), COLUMNS, F.col("label"), *DATES)


@query("kfold_cv")
def _(t):
    scores = models.kfold_accuracy(_frame(t), COLUMNS, "hash_id")
    return scores.agg(F.avg("accuracy").alias("mean"), (2 * F.stddev_pop("accuracy")).alias("two_deviations"), F.count(F.lit(1)).alias("folds"))


@query("feature_importance")
def _(t):
    train, _test = _halves(t)
    forest = models.fit(train, COLUMNS, models.RandomForestClassifier(numTrees=models.TREES, seed=0))
    return models.feature_importance([_stored_models(t), forest], COLUMNS, t.spark)


@query("permutation_importance")
def _(t):
    train, test = _halves(t)
    model = models.fit(train, COLUMNS, models.DecisionTreeClassifier(seed=0))
    return models.permutation_importance(model, test, COLUMNS, "hash_id")


@query("drop_column_importance")
def _(t):
    return models.drop_column_importance(*_halves(t), COLUMNS)


@query("grid_search")
def _(t):
    return models.grid_search(cut_lineage(_frame(t)), COLUMNS, F.col("label"), *DATES)
