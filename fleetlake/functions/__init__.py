"""Scalar column functions (P1–P7, P9–P11 of the contract)."""

from fleetlake.functions.naming import (
    export_file_name,
    file_name,
    file_stem,
    has_csv_extension,
    safe_file_name,
    vehicle_id_from_path,
)
from fleetlake.functions.timestamps import (
    hour_bucket,
    iso_text,
    iso_to_timestamp,
    parse_iso_timestamp,
    parse_with_patterns,
)
from fleetlake.functions.tokens import (
    is_blank,
    is_null_token,
    normalise_shift_state,
    nullable_float,
    nullable_float_error,
    nullable_string,
    required_float,
    required_float_reason,
    strip,
    to_double,
)

__all__ = [
    "export_file_name",
    "file_name",
    "file_stem",
    "has_csv_extension",
    "hour_bucket",
    "is_blank",
    "is_null_token",
    "iso_text",
    "iso_to_timestamp",
    "normalise_shift_state",
    "nullable_float",
    "nullable_float_error",
    "nullable_string",
    "parse_iso_timestamp",
    "parse_with_patterns",
    "required_float",
    "required_float_reason",
    "safe_file_name",
    "strip",
    "to_double",
    "vehicle_id_from_path",
]
