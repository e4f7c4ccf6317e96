"""The feature tables: all groups joined, per frequency and month."""

from pyspark.sql import DataFrame, functions as F

from memsight.constants import FREQUENCIES, LOOKBACK, MIN_ERRORS, RECENT
from memsight.functions.calendar import offset_to_text
from memsight.operators.features import counter_features, feature_columns, statistical_features, with_one_hot
from memsight.operators.rolling import component_features
from memsight.operators.windows import GRID, cell_windows
from memsight.session import stage, staging
from memsight.sources.stores import write_features


def feature_table(log: DataFrame, inventory: DataFrame, freq="5m", months=range(1, 9), min_errors=MIN_ERRORS,
                  recent=RECENT, lookback=LOOKBACK, compat_swap=False, staged=True) -> DataFrame:
    """sid, predict_time, t_predict, month, freq and the 52 features, a row per active window.

    ``freq``: a name of FREQUENCIES. All months are computed together. The log is reduced to
    (cell, window) rows once; ``staged`` writes them to the shared folder, because the three
    feature groups read them separately. The two groups with wide shuffles are written too, one after the other:
    the shuffle files of one are gone when those of the next are made.
    """
    keep = stage if staged else lambda rows: rows
    cells = keep(cell_windows(log, FREQUENCIES[freq], months, recent, lookback))
    components = keep(component_features(cells, FREQUENCIES[freq], lookback, min_errors, staged))
    statistics = keep(statistical_features(cells, compat_swap))
    table = with_one_hot(counter_features(cells).join(components, GRID).join(statistics, GRID), inventory)
    return table.select(
        "sid", offset_to_text(F.col("rb")).alias("predict_time"), F.col("rb").alias("t_predict"),
        F.lit(freq).alias("freq"), "month", *feature_columns())


def generate_features(log, inventory, path, freqs=("5m", "30m", "1h", "5d"), months=(6, 7, 8), **options):
    """Write the feature tables of some frequencies and months to one partitioned store."""
    for freq in freqs:
        with staging(log.sparkSession):
            write_features(stage(feature_table(log, inventory, freq, months, **options)), path)
