from shelfmark.operators.grouping import Grouping, Lookup, aggregate, aggregate_by_key
from shelfmark.operators.keys import add_dense_key, surrogate_key, unique_rows
from shelfmark.operators.lookup import attach_key, fits_broadcast
from shelfmark.operators.ranking import amount_before, global_rank
from shelfmark.operators.shares import share_of_total
from shelfmark.operators.staging import drop_staged, stage, staging_root
from shelfmark.operators.trends import previous_year

__all__ = [
    "Grouping",
    "Lookup",
    "add_dense_key",
    "aggregate",
    "aggregate_by_key",
    "amount_before",
    "attach_key",
    "drop_staged",
    "fits_broadcast",
    "global_rank",
    "previous_year",
    "share_of_total",
    "stage",
    "staging_root",
    "surrogate_key",
    "unique_rows",
]
