"""Column-level helpers shared by the operators (kinds, quoting, NaN
canonicalisation, deterministic hash order, exact distributed quantiles)."""

from tabsight.functions.columns import (  # noqa: F401
    KINDS, kind_of, columns_of_kind, quote, canonicalize, numeric_value,
    hash_order, sig_round, round_doubles, unpivot_numeric, unpivot_text,
)
from tabsight.functions.quantiles import column_quantiles, exact_quantiles  # noqa: F401
