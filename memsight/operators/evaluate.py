"""Server-level evaluation of scored windows.

``scored``: sid, t_predict, class, pred. ``by`` columns (failure type, split, model ...) evaluate many
predictions at once. A server counts once, so it is first reduced to its best scores; every
threshold is then a comparison with these.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from memsight.functions.calendar import lead_class, month_of
from memsight.operators.prepare import typed
from memsight.operators.reports import fill, scaffold

THRESHOLDS = [i / 100 for i in range(100)]
MAX_FPR = 0.01
MIN_FPR = 0.002
METRICS = ["f1", "precision", "recall", "fpr"]


def server_scores(scored: DataFrame, by=()) -> DataFrame:
    """Per server: highest score, highest score of a positive row, class of the last row.

    Rows of the same time (several tickets) are ordered by class."""
    return scored.groupBy(*by, "sid").agg(
        F.max("pred").alias("best"),
        F.max(F.when(F.col("class") == 1, F.col("pred"))).alias("best_true"),
        F.max_by("class", F.struct("t_predict", "class")).alias("last_class"))


def _cells(predicted, hits, positives, servers):
    """tp, fp, fn, tn; fn may be negative if a server's last row is of class 0 and an earlier one is not."""
    return {"tp": hits, "fp": predicted - hits, "fn": positives - hits,
            "tn": servers - predicted - (positives - hits)}


def confusion(scored: DataFrame, threshold: float, by=()) -> DataFrame:
    servers = server_scores(scored, by)
    counts = servers.groupBy(*by).agg(
        F.count_if(F.col("best") > threshold).alias("predicted"),
        F.count_if(F.col("best_true") > threshold).alias("hits"),
        F.count_if(F.col("last_class") > 0).alias("positives"), F.count(F.lit(1)).alias("servers"))
    cells = _cells(*[F.col(c) for c in ("predicted", "hits", "positives", "servers")])
    return counts.select(*by, *[c.alias(name) for name, c in cells.items()])


def with_metrics(cells: DataFrame, known=None) -> DataFrame:
    """Precision, recall, F1 and false-positive rate of tp, fp, fn, tn.

    All zero if the rate is above 0.01 or there are no positives to recall; without true positives only the rate is given. ``known``:
    a column of known positives; recall is then over these (fn = known - tp, tn unchanged) and a
    rate below 0.002 gives zeros too.
    """
    tp, fp, tn = F.col("tp"), F.col("fp"), F.col("tn")
    if known is not None:
        cells = cells.withColumn("fn", F.col(known) - tp)
    fpr = F.try_divide(fp, fp + tn)
    bad = (fpr > MAX_FPR) if known is None else (fpr > MAX_FPR) | (fpr < MIN_FPR)
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + F.col("fn"))
    none, undefined = tp == 0, tp + F.col("fn") == 0
    cells = cells.withColumns({"_p": precision, "_r": recall, "_fpr": fpr, "_bad": bad})
    f1 = F.try_divide(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r"))
    def metric(value):
        return F.when(none | undefined | F.col("_bad"), 0.0).otherwise(value)
    return cells.withColumns({
        "f1": metric(f1), "precision": metric(F.col("_p")), "recall": metric(F.col("_r")),
        "fpr": F.when(none, F.col("_fpr")).when(F.col("_bad"), 0.0).otherwise(F.col("_fpr")),
    }).drop("_p", "_r", "_fpr", "_bad")


def passed(column):
    """How many of the thresholds a score is above: a score passes the first so many."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in THRESHOLDS]), lambda t: column > t))


def sweep(scored: DataFrame, by=()) -> DataFrame:
    """tp, fp, fn, tn at the thresholds 0.00 .. 0.99."""
    servers = server_scores(scored, by).select(
        *by, passed(F.col("best")).alias("k"), F.coalesce(passed(F.col("best_true")), F.lit(-1)).alias("k_true"),
        (F.col("last_class") > 0).cast("long").alias("positive"))
    return sweep_servers(servers, by)


def sweep_servers(servers: DataFrame, by=()) -> DataFrame:
    """As ``sweep``, from a row a server: ``k``, the thresholds its best score passes, ``k_true``, those that its best
    positive row passes (-1 without one), and ``positive``, 1 if its last row is.

    A histogram of k (at most 102 bars a group), summed from the top, gives all hundred rows."""
    by = list(by)

    def bar(k, servers, hits, positive):
        return F.struct(k.cast("int").alias("k"), servers.cast("long").alias("servers"),
                        hits.cast("long").alias("hits"), positive.cast("long").alias("positive"))

    one, zero = F.lit(1), F.lit(0)
    bars = servers.select(*by, F.inline(F.array(
        bar(F.col("k"), one, zero, F.col("positive")), bar(F.col("k_true"), zero, one, zero)))).groupBy(*by, "k").agg(
        *[F.sum(c).alias(c) for c in ("servers", "hits", "positive")])
    totals = bars.groupBy(*by).agg(F.sum("servers").alias("all_servers"), F.sum("positive").alias("positives"))
    frame = totals.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(THRESHOLDS)))).alias("k"))
    full = frame.join(bars.drop("positive"), [*by, "k"], "left").fillna(0, ["servers", "hits"])
    from_top = W.partitionBy(*by).orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0)
    summed = full.withColumns({"predicted": F.sum("servers").over(from_top), "true": F.sum("hits").over(from_top)})
    cells = _cells(*[F.col(c) for c in ("predicted", "true", "positives", "all_servers")])
    return summed.select(*by, ((F.col("k") - 1) / 100).alias("threshold"), *[c.alias(n) for n, c in cells.items()])


def best_threshold(scored: DataFrame, by=(), positives=None) -> DataFrame:
    """The threshold with the highest F1 (the lowest of equals) and its metrics, per group.

    ``positives``: a table (``by`` columns .., positives) of known positives for the second metric.
    Without any F1 above 0 the threshold and the metrics are 0 and the counts NULL.
    """
    return best_cells(sweep(scored, by), by, positives)


def best_cells(cells: DataFrame, by=(), positives=None) -> DataFrame:
    """As ``best_threshold``, from the rows of a sweep."""
    by = list(by)
    if positives is None:
        rows = with_metrics(cells)
    else:
        shared = [c for c in by if c in positives.columns]
        known = positives.select(*shared, F.col("positives").alias("_known"))
        cells = cells.join(F.broadcast(known), shared, "left").fillna(0, ["_known"])
        rows = with_metrics(cells, "_known")
    names = [*METRICS, "tp", "fp", "fn", "tn", "threshold"]
    best = F.max_by(F.struct(*names), F.when(F.col("f1") > 0, F.struct("f1", -F.col("threshold"))))
    picked = rows.groupBy(*by).agg(best.alias("b"))
    return picked.select(*by, *[F.coalesce(F.col(f"b.{c}"), F.lit(0.0)).alias(c) for c in [*METRICS, "threshold"]],
                         *[F.col(f"b.{c}").alias(c) for c in ("tp", "fp", "fn", "tn")])


def known_positives(log, tickets, inventory, splits, window=300) -> DataFrame:
    """(failure_type, split, positives): servers with a failure in the split's test month that has an error more than
    ``window`` seconds before it; a row for each failure type and split, zeros included.

    Each failure counts on its own: a server's first error decides for every one of its tickets."""
    months = {test: split for split, (_, test) in splits.items()}
    month = month_of(F.col("failed_off"))
    failures = typed(tickets).filter(month.isin(list(months))).select("sid", "failure_type", "failed_off")
    first = log.groupBy("sid").agg(F.min("t").alias("first_t")).join(inventory.select("sid").distinct(), "sid", "left_semi")
    early = failures.join(first, "sid").filter(F.col("failed_off") - F.col("first_t") > window)
    split = F.get(F.lit([months.get(m) for m in range(max(months) + 1)]), month)
    counts = early.groupBy("failure_type", split.alias("split")).agg(F.count_distinct("sid").alias("positives"))
    frame = scaffold(log.sparkSession, None, split=sorted(months.values()))
    return fill(counts, frame, ["failure_type", "split"], ["positives"])


def lead_time(scored: DataFrame, tickets: DataFrame, threshold, by=()) -> DataFrame:
    """Of the servers rightly predicted: failures at most five minutes after the first such
    prediction (``n_useless``), and later ones (``n_useful``).

    ``threshold``: a number, or the name of a column of ``scored``. Groups without such a server have zeros."""
    limit = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    first = scored.filter((F.col("pred") > limit) & (F.col("class") == 1)).groupBy(*by, "sid").agg(
        F.min("t_predict").alias("first_predict"))
    hits = first.join(tickets.select("sid", "failed_off"), "sid")
    kind = lead_class(F.col("failed_off") - F.col("first_predict"))
    counts = hits.groupBy(*by).agg(F.count_if(kind == 1).alias("n_useless"), F.count_if(kind == 2).alias("n_useful"))
    if not by:
        return counts
    return fill(counts, scored.select(*by).distinct(), by, ["n_useless", "n_useful"])


def lead_sweep(scored: DataFrame, tickets: DataFrame, by=()) -> DataFrame:
    """``lead_time`` for all hundred thresholds: by, threshold, n_useless, n_useful; a row for each group and threshold at which
    a server is rightly predicted. ``scored``: by, sid, t_predict, class, and ``pred`` or ``k``, the thresholds it passes.

    A server's first right prediction at a threshold is the earliest row that passes at least so many: a running minimum
    from the top over at most a hundred values of k a server. It changes only at these, so every step counts for a
    range of thresholds; a histogram of the ranges is expanded at the end."""
    by = list(by)
    rows = scored if "k" in scored.columns else scored.withColumn("k", passed(F.col("pred")))
    steps = rows.filter((F.col("class") == 1) & (F.col("k") > 0)).groupBy(*by, "sid", "k").agg(F.min("t_predict").alias("t"))
    down = W.partitionBy(*by, "sid").orderBy(F.desc("k"))
    steps = steps.withColumns({"first_predict": F.min("t").over(down.rowsBetween(W.unboundedPreceding, 0)),
                               "low": F.coalesce(F.lead("k").over(down), F.lit(0))})
    hits = steps.join(tickets.select("sid", "failed_off"), "sid")
    kind = lead_class(F.col("failed_off") - F.col("first_predict"))
    ranges = hits.groupBy(*by, "low", "k").agg(F.count_if(kind == 1).alias("n_useless"), F.count_if(kind == 2).alias("n_useful"))
    each = ranges.select(*by, F.explode(F.sequence(F.col("low"), F.col("k") - 1)).alias("_step"), "n_useless", "n_useful")
    return each.groupBy(*by, (F.col("_step") / 100).alias("threshold")).agg(
        F.sum("n_useless").alias("n_useless"), F.sum("n_useful").alias("n_useful"))
