"""Where rows come from and where intermediate tables go."""

from tidemill.sources.tables import by_dataset, read_points, table
from tidemill.sources.sinks import write_matrix_csv, write_points
from tidemill.sources.scratch import clear, materialise, shared_folder

__all__ = ["by_dataset", "clear", "materialise", "read_points", "shared_folder", "table", "write_matrix_csv", "write_points"]
