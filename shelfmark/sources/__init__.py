from shelfmark.sources.csv_files import read_csv
from shelfmark.sources.folder import discover
from shelfmark.sources.order_tables import raw_orders, raw_people, raw_returns
from shelfmark.sources.rejects import Rejected, Rejects, read_date
from shelfmark.sources.workbook import read_workbooks, sheet_table, sheets

__all__ = [
    "Rejected",
    "Rejects",
    "discover",
    "raw_orders",
    "raw_people",
    "raw_returns",
    "read_csv",
    "read_date",
    "read_workbooks",
    "sheet_table",
    "sheets",
]
