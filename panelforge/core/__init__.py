from panelforge.core.scale import (
    average_rank,
    cut_lineage,
    exact_quantiles,
    day_table,
    join_checked,
    salted_join,
    sorted_index,
    value_positions,
)
from panelforge.core.exprs import (
    clean_nan,
    linear_quantile,
    linear_quantiles,
    safe_div,
    time_order,
    unique_guard,
)

__all__ = [
    "average_rank",
    "clean_nan",
    "cut_lineage",
    "day_table",
    "exact_quantiles",
    "join_checked",
    "linear_quantile",
    "linear_quantiles",
    "safe_div",
    "salted_join",
    "sorted_index",
    "time_order",
    "unique_guard",
    "value_positions",
]
