"""Canonical tables. Nothing is inferred: every reader is given one of these."""

from pyspark.sql import types as T


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_S, _L, _I, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()

ENTRIES = _table(
    ("root_key", _S), ("snapshot_id", _S), ("path", _S), ("path_key", _S), ("parent_key", _S),
    ("name", _S), ("ext", _S), ("is_dir", _B), ("size", _L), ("created_at", _TS),
    ("modified_at", _TS), ("accessed_at", _TS), ("attributes", _I), ("physical_id", _S),
    ("level", _I), ("sha256", _S),
)
# The raw columns a listing export delivers; everything else in ENTRIES is derived.
LISTING = _table(
    ("path", _S), ("is_dir", _B), ("size", _L), ("created_at", _TS), ("modified_at", _TS),
    ("accessed_at", _TS), ("attributes", _I), ("physical_id", _S),
)
FILE_CONTENT = _table(("path_key", _S), ("content", T.BinaryType()))
FILE_TEXT = _table(("path_key", _S), ("text", _S))
SNAPSHOTS = _table(
    ("target_key", _S), ("snapshot_id", _S), ("ts", _TS), ("total_bytes", _L), ("total_files", _L)
)
SNAPSHOT_SUBFOLDERS = _table(("target_key", _S), ("snapshot_id", _S), ("name", _S), ("size", _L))
SCAN_ERRORS = _table(("root_key", _S), ("snapshot_id", _S), ("folder_path", _S), ("error", _S))
FOLDER_ACL = _table(
    ("path_key", _S), ("parent_key", _S), ("folder_name", _S), ("depth", _I),
    ("protected", _B), ("readable", _B),
)
ACES = _table(
    ("path_key", _S), ("ace_order", _I), ("sid", _S), ("account", _S), ("rights", _I),
    ("access_type", _S), ("is_inherited", _B), ("inherit_flags", _I), ("prop_flags", _I),
)
ACL_SNAPSHOTS = _table(
    ("snapshot_id", _S), ("path_key", _S), ("ts", _TS), ("note", _S), ("sddl", _S)
)
MEMBER_OF = _table(("member_sid", _S), ("group_sid", _S))
PRINCIPALS = _table(("sid", _S), ("account", _S), ("domain", _S), ("kind", _S), ("display", _S))
OUS = _table(("dn", _S), ("name", _S))
PLAN_NODES = _table(
    ("plan_id", _S), ("node_id", _S), ("parent_id", _S), ("ord", _I), ("name", _S),
    ("level", _I), ("est_size", _L), ("est_files", _L), ("inherit_acl", _B),
)
PLAN_SOURCES = _table(("plan_id", _S), ("node_id", _S), ("source_path", _S))
PLAN_ACES = _table(
    ("plan_id", _S), ("node_id", _S), ("ace_order", _I), ("account", _S), ("rights", _I),
    ("access_type", _S),
)
COPY_UNITS = _table(("plan_id", _S), ("wave", _I), ("source", _S), ("destination", _S))
LINKS = _table(("file_path", _S), ("part", _S), ("kind", _S), ("target", _S))
IGNORES = _table(("path_key", _S), ("size", _L), ("modified_at", _TS))
DOC_PAGES = _table(("path", _S), ("page_no", _L), ("text", _S))
VOLUMES = _table(("volume", _S), ("total_bytes", _L), ("available_bytes", _L))
