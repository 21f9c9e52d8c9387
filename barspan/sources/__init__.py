"""Reading and writing bar tables, side series and results."""

from .readers import SIDE_ALIASES, coverage, epoch_rows, map_columns, read_bars, read_side_series, read_table, read_yields, strict_bars
from .sinks import export_wide, read_results, write_json_summary, write_results, write_return_matrix

__all__ = ["SIDE_ALIASES", "coverage", "epoch_rows", "export_wide", "map_columns", "read_bars", "read_results", "read_side_series", "read_table", "read_yields", "strict_bars", "write_json_summary", "write_results", "write_return_matrix"]
