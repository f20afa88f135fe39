"""Data profiling and preparation on Spark DataFrames."""

from tabwright.operators.charts import (
    all_distributions, bar, box, category_bars, chart, distribution, histogram, kde, line,
    regression_line, scatter, violin,
)
from tabwright.operators.columns import (
    add_or_modify_column, cast_column, conditional_column, contains_at, drop_column, drop_nulls,
    filter_rows, rename_column, replace_values, select_columns, text_column,
)
from tabwright.operators.encode import (
    Cleaning, Encoding, auto_clean, binary_encode, encode, encoded_preview, encoding_log, find_pii, fit_clean,
    fit_encoding, one_hot, pii_log, scrub_pii,
)
from tabwright.operators.fitted import apply_fit, load_fit, save_fit
from tabwright.operators.models import (
    classification_report, fit_pca, mse, pca, pca_summary, split_by_key, train_baseline,
)
from tabwright.operators.profile import (
    STANDARD, STRICT, audit_severity, column_metrics, constant_audit, correlation_matrix,
    critical_audit, describe_data, feature_stats, full_audit, measure, missing_audit, profile, scorecard,
    skew_audit, summary_data, type_split,
)
from tabwright.operators.relational import (
    distinct_states, drop_duplicates, group_and_aggregate, join_dataframes, mode, modes, row_count, sample_n,
    sort_data, top_n, unique_count, unique_of, value_counts,
)
from tabwright.operators.states import audit_of, distinct_of, merge_states, profile_state, stats_of
from tabwright.operators.transforms import Fitted, TRANSFORMS, fill_nulls, fit, label_codes, transform
from tabwright.operators.windows import (
    add_lag_lead, add_rank, add_row_number, add_running_total, window_function,
)
from tabwright.sources.demo import generate_sales
from tabwright.sources.files import (
    bad_cell_counts, missing_audit_checked, preview, read_csv, read_csv_checked, read_parquet, schema_info, shape,
    write_csv, write_parquet,
)
from tabwright.sources.layout import buckets_for, read_layout, write_layout
from tabwright.sources.snapshots import (
    Snapshot, append_snapshot, load_snapshot, save_snapshot, transform_snapshot,
)

__all__ = [name for name in dir() if not name.startswith("_")]
