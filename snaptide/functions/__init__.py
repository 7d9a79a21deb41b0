from snaptide.functions.scalars import (
    unchanged, seconds_between, velocity, offset_or_null, millis_to_timestamp,
    in_list, quorum_flag,
)

__all__ = ["unchanged", "seconds_between", "velocity", "offset_or_null", "millis_to_timestamp",
           "in_list", "quorum_flag"]
