"""Registered queries of labels, sampling and evaluation, with their DuckDB text."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from checks import fixture
from checks.features import _windows, features_cte, rounded
from checks.fixture import ROLLING_ERRORS
from checks.sqltext import query, text
from memsight.constants import FREQUENCIES
from memsight.functions.calendar import offset_to_text
from memsight.operators import evaluate, labels, windows
from memsight.operators.features import feature_columns
from memsight.plans.features import feature_table
from memsight.session import stage

BY = ["failure_type", "split"]
TEST_MONTHS = [6, 7, 8]
WEEK = 7 * 86400   # with the usual day, most failure types have no positive row in this data


def _rows(spark, d, months=range(1, 9)):
    """Active one-hour windows, standing for feature rows."""
    rows = windows.active_windows(fixture.log(spark, d), FREQUENCIES["1h"], months)
    return rows.select("sid", offset_to_text(F.col("rb")).alias("predict_time"), F.col("rb").alias("t_predict"), "month")


CASES = [(t, s) for t in (1, 2, 3) for s in labels.SPLITS]


def _l1(spark, d):
    return labels.cell_labels(_rows(spark, d), fixture.tickets(spark, d), "train")


def _l2(spark, d):
    return labels.cell_labels(_rows(spark, d, TEST_MONTHS), fixture.tickets(spark, d), "test")


def _l4(spark, d):
    return labels.under_sample(stage(_l1(spark, d)), by=BY).drop("month")


def _features(spark, d, freq="5d", months=TEST_MONTHS):
    log, _, inventory = fixture.inputs(spark, d)
    return feature_table(log, inventory, freq, months, ROLLING_ERRORS)


def _labelled_features(spark, d):
    return labels.cell_labels(_features(spark, d), fixture.tickets(spark, d), "test")


def _l5(group):
    return lambda spark, d: rounded(labels.select_features(_labelled_features(spark, d), group, BY).drop("t_predict"))


def _l6(spark, d):
    values = vector_to_array("features")
    return labels.matrix(_labelled_features(spark, d), keep=BY).select(
        *BY, "sid", "predict_time", "class", F.size(values).cast("long").alias("n_features"),
        F.aggregate(values, F.lit(0.0), lambda total, v: total + F.floor(v + 0.0001)).alias("total"))


def scored(spark, d) -> DataFrame:
    """Test rows of all types and splits with an arithmetic score."""
    out = labels.cell_labels(_rows(spark, d, TEST_MONTHS), fixture.tickets(spark, d), "test", horizon=WEEK)
    score = F.expr("((sid * 7919 + t_predict div 60) % 101) / 100.0D")
    # scores of servers without failures are lowered, so that some false-positive rates pass
    return out.withColumn("pred", F.when((F.col("class") == 1) | (F.col("sid") % 17 == 0), score).otherwise(score / 2))


def _positives(spark, d):
    return evaluate.known_positives(*fixture.inputs(spark, d), labels.SPLITS)


def _e4(spark, d):
    return rounded(evaluate.best_threshold(scored(spark, d), BY), 8).fillna(-1)


def _e5(spark, d):
    return rounded(evaluate.best_threshold(scored(spark, d), BY, _positives(spark, d)), 8).fillna(-1)


def _e3(spark, d):
    cells = evaluate.confusion(scored(spark, d), 0.5, BY).join(_positives(spark, d), BY, "left").fillna(0, ["positives"])
    return rounded(evaluate.with_metrics(cells, "positives"), 8)


QUERIES = {
    "l1_train_labels": _l1,
    "l2_test_labels": _l2,
    "l3_month_splits": lambda s, d: labels.with_splits(_rows(s, d)),
    "l4_under_sample": _l4,
    "l5_feature_group": _l5(2),
    "l5_feature_group_1": _l5(1),
    "l5_feature_group_3": _l5(3),
    "l5_feature_group_4": _l5(4),
    "l6_matrix": _l6,
    "e1_confusion": lambda s, d: evaluate.confusion(scored(s, d), 0.5, BY),
    "e2_metrics": lambda s, d: rounded(evaluate.with_metrics(evaluate.confusion(scored(s, d), 0.5, BY)), 8),
    "e3_metrics_known": _e3,
    "e4_best_threshold": _e4,
    "e5_best_threshold_known": _e5,
    "e6_lead_time": lambda s, d: evaluate.lead_time(scored(s, d), fixture.tickets(s, d), 0.5, BY),
}

ROWS = _windows("1h", range(1, 9)) + f""",
rows AS (SELECT sid, {text('a.rb')} AS predict_time, rb AS t_predict, month FROM active a)"""


def _labelled(source, kind, test, horizon=86400):
    """Labels by cases: no ticket, own ticket in time, other ticket."""
    other = f"""
      UNION ALL SELECT r.*, 0 FROM {source} r JOIN tickets k USING (sid) WHERE k.failure_type > 0 AND k.failure_type <> {kind}"""
    return f"""
      SELECT r.*, 0 AS class FROM {source} r WHERE sid NOT IN (SELECT sid FROM tickets)
      UNION ALL SELECT r.*, 0 FROM {source} r JOIN tickets k USING (sid) WHERE k.failure_type = 0
      UNION ALL SELECT r.*, CASE WHEN t_predict + {horizon} < failed_off THEN 0 ELSE 1 END FROM {source} r
        JOIN tickets k USING (sid) WHERE k.failure_type = {kind} AND t_predict <= failed_off{other if test else ''}"""


TRAIN = ROWS + ",\ntrain AS (" + " UNION ALL ".join(
    f"SELECT *, {t} AS failure_type, {s} AS split FROM ({_labelled(f'(SELECT * FROM rows WHERE month BETWEEN {s} AND {s + 4})', t, False)})"
    for t, s in CASES) + ")"

SCORE = "CAST((sid * 7919 + t_predict // 60) % 101 AS double) / 100.0"
SCORED = ROWS + """,
test_rows AS (SELECT * FROM rows WHERE month >= 6),
labelled AS (""" + " UNION ALL ".join(
    f"SELECT {t} AS failure_type, month - 5 AS split, * FROM ({_labelled('test_rows', t, True, WEEK)})" for t in (1, 2, 3)) + f"""),
scored AS (SELECT *, CASE WHEN class = 1 OR sid % 17 = 0 THEN {SCORE} ELSE {SCORE} / 2 END AS pred FROM labelled)"""

CONFUSION = """
ths AS (SELECT CAST(i AS double) / 100 AS threshold FROM range(100) r(i)),
raw AS (
  SELECT failure_type, split, threshold,
    count(DISTINCT sid) FILTER (pred > threshold AND class = 1) AS tp,
    count(DISTINCT sid) FILTER (pred > threshold) AS predicted,
    count(DISTINCT sid) AS servers
  FROM scored CROSS JOIN ths GROUP BY ALL),
lasts AS (SELECT failure_type, split, count(*) FILTER (class > 0) AS positives FROM (
  SELECT *, row_number() OVER (PARTITION BY failure_type, split, sid ORDER BY t_predict DESC, class DESC) AS k FROM scored)
  WHERE k = 1 GROUP BY ALL),
confusion AS (SELECT failure_type, split, threshold, tp, predicted - tp AS fp, positives - tp AS fn,
  servers - predicted - (positives - tp) AS tn FROM raw JOIN lasts USING (failure_type, split))"""


def _metrics(fn="fn", low=False):
    bad = "fp / (fp + tn) > 0.01" + (" OR fp / (fp + tn) < 0.002" if low else "")
    keep = f"tp = 0 OR tp + {fn} = 0 OR {bad}"
    return f"""failure_type, split, threshold, tp, fp, {fn} AS fn, tn,
      CASE WHEN {keep} THEN 0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + {fn})) / (tp / (tp + fp) + tp / (tp + {fn})) END AS f1,
      CASE WHEN {keep} THEN 0 ELSE tp / (tp + fp) END AS precision,
      CASE WHEN {keep} THEN 0 ELSE tp / (tp + {fn}) END AS recall,
      CASE WHEN tp <> 0 AND ({bad}) THEN 0 ELSE fp / (fp + tn) END AS fpr"""


# known positives: joined rows of the test months' failures
KNOWN = """
counted AS (
  SELECT k.failure_type, CAST(substr(failed_time, 6, 2) AS int) - 5 AS split, count(DISTINCT k.sid) AS positives
  FROM tickets k JOIN log USING (sid) WHERE k.failure_type > 0 AND substr(failed_time, 6, 2) IN ('06', '07', '08')
    AND sid IN (SELECT sid FROM inventory) AND failed_off - t > 300 GROUP BY ALL),
known AS (
  SELECT f.failure_type, s.split, coalesce(positives, 0) AS positives
  FROM (VALUES (1), (2), (3)) f(failure_type) CROSS JOIN (VALUES (1), (2), (3)) s(split)
  LEFT JOIN counted c ON c.failure_type = f.failure_type AND c.split = s.split)"""

ROUND = ", ".join(f"round({c}, 8) AS {c}" for c in evaluate.METRICS)
BEST = f"""
SELECT g.failure_type, g.split, {', '.join(f'round(coalesce({c}, 0), 8) AS {c}' for c in evaluate.METRICS)},
  coalesce(threshold, 0) AS threshold, {', '.join(f'coalesce({c}, -1) AS {c}' for c in ('tp', 'fp', 'fn', 'tn'))}
FROM (SELECT DISTINCT failure_type, split FROM metrics) g LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY failure_type, split ORDER BY f1 DESC, threshold) AS k FROM metrics WHERE f1 > 0) b
  ON b.failure_type = g.failure_type AND b.split = g.split AND k = 1"""

def _group_sql(group):
    columns = ", ".join(f'"{c}"' for c in feature_columns(group))
    return query(f"SELECT failure_type, split, sid, predict_time, {columns}, class FROM labelled", TABLE)


TABLE = features_cte("5d", TEST_MONTHS) + f""",
labelled AS (""" + " UNION ALL ".join(
    f"SELECT {t} AS failure_type, month - 5 AS split, * FROM ({_labelled('features', t, True)})" for t in (1, 2, 3)) + ")"

ORACLE = {
    "l1_train_labels": query("SELECT * FROM train", TRAIN),
    "l2_test_labels": query(" UNION ALL ".join(
        f"SELECT *, {t} AS failure_type, {s} AS split FROM ({_labelled(f'(SELECT * FROM rows WHERE month = {s + 5})', t, True)})"
        for t, s in CASES), ROWS),
    "l3_month_splits": query("""
      SELECT r.*, split, CASE WHEN month = split + 5 THEN 'test' ELSE 'train' END AS role
      FROM rows r JOIN (VALUES (1), (2), (3)) s(split) ON month BETWEEN split AND split + 5""", ROWS),
    "l4_under_sample": query("""
      SELECT sid, predict_time, t_predict, class, failure_type, split FROM (
        SELECT *, row_number() OVER (PARTITION BY failure_type, split, class ORDER BY md5('42-' || CAST(sid AS varchar) || '-' || predict_time)) AS k,
          count(*) FILTER (class = 1) OVER (PARTITION BY failure_type, split) AS positives
        FROM train) WHERE class = 1 OR k <= floor(positives / CAST(0.02 AS double))""", TRAIN),
    "l5_feature_group": _group_sql(2),
    "l5_feature_group_1": _group_sql(1),
    "l5_feature_group_3": _group_sql(3),
    "l5_feature_group_4": _group_sql(4),
    "l6_matrix": query("SELECT failure_type, split, sid, predict_time, CAST(class AS double) AS class, CAST(52 AS bigint) AS n_features, "
                       + " + ".join(f'floor("{c}" + 0.0001)' for c in feature_columns()) + " AS total FROM labelled", TABLE),
    "e1_confusion": query("SELECT * EXCLUDE (threshold) FROM confusion WHERE threshold = 0.5", SCORED + "," + CONFUSION),
    "e2_metrics": query(f"SELECT failure_type, split, tp, fp, fn, tn, {ROUND} FROM (SELECT {_metrics()} FROM confusion "
                        "WHERE threshold = 0.5)", SCORED + "," + CONFUSION),
    "e3_metrics_known": query(
        f"SELECT failure_type, split, positives, tp, fp, fn, tn, {ROUND} FROM (SELECT {_metrics('positives - tp', True)}, positives "
        "FROM confusion JOIN known USING (failure_type, split) WHERE threshold = 0.5)", SCORED + "," + CONFUSION + "," + KNOWN),
    "e4_best_threshold": query(BEST, SCORED + "," + CONFUSION + f", metrics AS (SELECT {_metrics()} FROM confusion)"),
    "e5_best_threshold_known": query(BEST, SCORED + "," + CONFUSION + "," + KNOWN + f""",
      metrics AS (SELECT {_metrics('(positives - tp)', True)} FROM confusion JOIN known USING (failure_type, split))"""),
    "e6_lead_time": query("""
      SELECT g.failure_type, g.split, count(*) FILTER (failed_off - first_predict <= 300) AS n_useless,
        count(*) FILTER (failed_off - first_predict > 300) AS n_useful
      FROM (SELECT DISTINCT failure_type, split FROM scored) g
      LEFT JOIN (SELECT failure_type, split, sid, min(t_predict) AS first_predict FROM scored WHERE pred > 0.5 AND class = 1
        GROUP BY ALL) p ON p.failure_type = g.failure_type AND p.split = g.split
      LEFT JOIN (SELECT sid, failed_off FROM tickets) k ON k.sid = p.sid GROUP BY ALL""", SCORED),
}
