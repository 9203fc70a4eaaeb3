"""seriesforge — chart-ready time series on PySpark.

Typed CSV ingestion with quality rules, combining series by full outer join, month / quarter /
year roll-ups, gold tables, imputation of partial years, linear and boosted-tree projections for
one series or many keyed series in one plan, and publishing as a data set plus a JSON descriptor
built from column metadata. Every operator is a DataFrame → DataFrame function on native Spark
expressions (and MLlib for boosted trees).
"""

from .operators.columns import (bounds, column_bounds, column_metadata, with_headers, with_metadata,
                                with_metadata_all)
from .operators.forecast import (GbtForecast, fit_elastic_net, fit_elastic_net_by_key, fit_gbt, fit_trend, forecast_elastic_net,
                                 forecast_gbt, forecast_linear, future_points, load_gbt, rmse, score_elastic_net, score_gbt)
from .operators.impute import calendar_gaps, calendar_gaps_all, impute_year
from .operators.series import (before_filter, between_filter, combine_series, count_where,
                               drop_columns, global_sums, known_until, latest, require_not_null,
                               grain_of, rollup_grains, rollup_series, sorted_series, split_at, split_label, tie_breakers,
                               union_series, with_position, with_total)
from .session import materialize, shared_dir
from .sources.csv import read_series_csv, read_table_csv, write_series_csv
from .sources.publish import chart_descriptor, latest_version, publish_chart, read_chart
from .sources.tables import driver_table, load_table, save_table, table_version
from .sources.versions import ConcurrentSaveError

__all__ = [
    "bounds", "column_bounds", "column_metadata", "with_headers", "with_metadata",
    "with_metadata_all", "fit_elastic_net", "score_elastic_net", "score_gbt", "fit_trend", "forecast_gbt", "forecast_linear", "future_points", "rmse",
    "GbtForecast", "fit_elastic_net_by_key", "fit_gbt", "forecast_elastic_net", "load_gbt", "calendar_gaps", "calendar_gaps_all", "impute_year",
    "grain_of", "rollup_grains", "with_position", "before_filter", "between_filter", "combine_series",
    "drop_columns", "global_sums", "known_until", "latest", "require_not_null", "rollup_series",
    "sorted_series", "split_at", "union_series", "read_series_csv", "read_table_csv",
    "write_series_csv", "chart_descriptor", "latest_version", "publish_chart", "read_chart",
    "driver_table", "load_table", "save_table", "count_where", "split_label",
    "table_version", "ConcurrentSaveError", "tie_breakers", "with_total", "materialize", "shared_dir",
]
