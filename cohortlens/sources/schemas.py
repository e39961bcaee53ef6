"""Fixed positional schemas of the four CSV sources."""

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


# Column names and order of each source file.
LOGON_SCHEMA = _strings("id", "date", "user", "pc", "activity")
DEVICE_SCHEMA = _strings("id", "date", "user", "pc", "activity")
HTTP_SCHEMA = _strings("id", "date", "user", "pc", "url")
LDAP_SCHEMA = _strings("employee_name", "user_id", "email", "domain", "role")

# The activity logs in one scan: ``last`` is the activity, or the url of the web log.
TAGGED_SCHEMA = _strings("id", "date", "user", "pc", "last")

SCHEMAS = {
    "logon": LOGON_SCHEMA,
    "device": DEVICE_SCHEMA,
    "http": HTTP_SCHEMA,
    "ldap": LDAP_SCHEMA,
}

# Column whose name identifies a header line, per source.
HEADER_KEY = {"logon": "id", "device": "id", "http": "id", "ldap": "employee_name"}
