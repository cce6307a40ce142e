"""Column contracts shared by sources and operators."""

from pyspark.sql import types as T

# Canonical request columns used throughout the library.
REQUEST_COLUMNS = [
    "request_id", "service", "add_ts", "due_ts", "resolved_ts",
    "ward", "lat", "lon", "address",
]

# Column names under which each canonical field appears in the
# yearly request files, in order of preference (names already normalised).
REQUEST_CANDIDATES = {
    "request_id": ["SERVICEREQUESTID", "REQUEST_ID", "OBJECTID"],
    "service": ["SERVICE_TYPE", "REQUESTTYPE", "REQUEST_TYPE", "SERVICECODEDESCRIPTION", "SERVICE_NAME"],
    "add_ts": ["ADDDATE", "CREATED_DATE", "CREATEDDATE", "DATE_CREATED", "REQUESTED_DATE", "REQUESTEDDATE"],
    "due_ts": ["SERVICEDUEDATE", "DUE_DATE"],
    "resolved_ts": ["RESOLUTIONDATE", "CLOSED_DATE", "CLOSEDDATE", "DATE_CLOSED", "RESOLVED_DATE", "RESOLVEDDATE"],
    "ward": ["WARD", "WARD_ID", "WARDID"],
    "lat": ["LATITUDE", "LAT"],
    "lon": ["LONGITUDE", "LON", "LONG"],
    "address": ["STREETADDRESS"],
}

HOURLY_SCHEMA = T.StructType([
    T.StructField("date", T.TimestampType()),
    T.StructField("temperature_2m", T.DoubleType()),
    T.StructField("precipitation", T.DoubleType()),
    T.StructField("snowfall", T.DoubleType()),
])

DAILY_FILE_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("precip_mm", T.DoubleType()),
    T.StructField("precip_hours", T.DoubleType()),
    T.StructField("rain_mm", T.DoubleType()),
    T.StructField("showers_mm", T.DoubleType()),
    T.StructField("snow_cm", T.DoubleType()),
    T.StructField("tmax_c", T.DoubleType()),
    T.StructField("tmin_c", T.DoubleType()),
    T.StructField("rh_max", T.IntegerType()),
    T.StructField("rh_min", T.IntegerType()),
    T.StructField("rh_mean", T.IntegerType()),
])

STATION_SCHEMA = T.StructType([
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("elevation", T.DoubleType()),
    T.StructField("utc_offset_seconds", T.IntegerType()),
    T.StructField("timezone", T.StringType()),
    T.StructField("timezone_abbreviation", T.StringType()),
])

METADATA_SCHEMA = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("ward", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("api_url", T.StringType()),
    T.StructField("start_date", T.StringType()),
    T.StructField("end_date", T.StringType()),
    T.StructField("variables", T.ArrayType(T.StringType())),
    T.StructField("timezone", T.StringType()),
    T.StructField("latitude_source", T.StringType()),
    T.StructField("longitude_source", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("saved_at", T.StringType()),
])

# The four continuous parameter families of the daily feature matrix
# and their default setting.
FEATURE_PARAMS = ["d", "d_p", "l_p", "d_s", "l_s", "d_f", "l_f", "k_AR"]
DEFAULT_PARAMS = {"d": 7, "d_p": 14, "l_p": 5, "d_s": 14, "l_s": 0, "d_f": 14, "l_f": 7, "k_AR": 10}

# Candidate lists of the exhaustive sweep.
PARAM_GRID = {
    "d": [1, 2, 3, 5, 7, 10],
    "d_p": [7, 14, 21, 30], "l_p": [0, 5, 10, 20],
    "d_s": [7, 14, 21, 30], "l_s": [0, 5, 10, 20],
    "d_f": [7, 14, 21, 30], "l_f": [0, 5, 10, 20],
    "k_AR": [5, 10, 15, 20],
}

# Inclusive integer ranges of the random candidate search.
PARAM_RANGES = {
    "d": (1, 10),
    "d_p": (7, 30), "l_p": (0, 20),
    "d_s": (7, 30), "l_s": (0, 20),
    "d_f": (7, 30), "l_f": (0, 20),
    "k_AR": (5, 20),
}

DOW_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]  # Sunday is the reference level
CALENDAR_FEATURES = ["sin_doy", "cos_doy", "is_weekend"] + [f"dow_{d}" for d in DOW_NAMES]
