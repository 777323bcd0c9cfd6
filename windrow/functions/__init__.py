from windrow.functions.identifiers import normalize_uuid
from windrow.functions.instants import millis_in_range, millis_to_ts, ts_to_millis
from windrow.functions.means import incremental_mean
from windrow.functions.validity import is_valid_value

__all__ = [
    "incremental_mean",
    "is_valid_value",
    "millis_in_range",
    "millis_to_ts",
    "normalize_uuid",
    "ts_to_millis",
]
