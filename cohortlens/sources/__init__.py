"""Sources and sinks: CSV activity logs, directory snapshots, Parquet tables."""

from .files import (
    ROLE_GLOBS,
    detect_sources,
    load_directory,
    load_events,
    load_log,
    read_snapshots,
)
from .schemas import DEVICE_SCHEMA, HTTP_SCHEMA, LDAP_SCHEMA, LOGON_SCHEMA
from .sinks import read_labelled_users, read_metrics, write_labelled_users, write_metrics

__all__ = [
    "DEVICE_SCHEMA",
    "HTTP_SCHEMA",
    "LDAP_SCHEMA",
    "LOGON_SCHEMA",
    "ROLE_GLOBS",
    "detect_sources",
    "load_directory",
    "load_events",
    "load_log",
    "read_labelled_users",
    "read_metrics",
    "read_snapshots",
    "write_labelled_users",
    "write_metrics",
]
