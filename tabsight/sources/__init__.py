"""Sources and sinks: named parquet tables, CSV/JSON/workbook readers,
prediction writers and the model store."""

from tabsight.sources.tables import TABLES, load_table  # noqa: F401
