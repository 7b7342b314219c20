"""Value types of channels, the sample schema and the numeric view of a sample."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Datatype names of the wire format.
NUMERIC = ("bool", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float", "double")
VARIABLE = ("string", "binary")
SUPPORTED = (*NUMERIC, *VARIABLE, "gpslocation")
ALIASES = {"bytearray": "binary"}
REMOVED = ("pair", "triple", "candata", "gpsdata")
CHANNEL_TYPES = ("scalar", "vector", "matrix", "binary")
SPECTRUM_TYPES = ("amplitude", "phase", "power", "realimag")

_SIMPLE = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType(),
    "ulong": T.DecimalType(20, 0),
}


def _schema(text: str) -> T.StructType:
    """Fields from "name type, name type"; no session is needed for it."""
    pairs = (x.split() for x in text.split(","))
    return T.StructType([T.StructField(n, GPS if k == "gps" else _SIMPLE[k]) for n, k in pairs])


GPS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("latitude", "longitude", "altitude")])

SAMPLES = _schema(
    "file string, channel_index int, channel string, datatype string, mode string, block_ord long, sample_ord int, seg_id int, ts_ns long,"
    " v_double double, v_long long, v_ulong ulong, v_bool boolean, v_string string, v_binary binary,"
    " v_gps gps"
)
CHANNELS = _schema(
    "file string, channel_index int, channel string, reference string, channel_type string, datatype string, time_increment_ns long,"
    " size_of_length_value int, mime_type string, spectrum_type string, physical_unit string, physical_dimension string,"
    " display_name string, comment string, supported boolean"
)
FILES = _schema(
    "file string, version int, integrity string, metablock_crc string, compression string, file_size long, header_bytes int, metablock_bytes int,"
    " created_utc string, creator string, reason string, tag string, comment string, namespace_sep string, latitude double, longitude double,"
    " altitude double, trailer_seen boolean, truncated boolean, error string, warnings string"
)
INFOS = _schema("file string, name string, value string, datatype string, unit string")
BLOCKS = _schema(
    "file string, block_ord long, byte_offset long, channel_index int, length long, control int, kind string, multi boolean, n long,"
    " start_ns long, rate_hz double, first_ts long, last_ts long, skip_reason string, crc_ok boolean, payload binary"
)


def numeric(prefix: str = "v_") -> Column:
    """The value of a numeric sample as a double; null for other types."""
    c = lambda n: F.col(prefix + n).cast("double")
    return F.coalesce(c("double"), c("long"), c("ulong"), c("bool"))


def is_numeric(datatype: Column) -> Column:
    return datatype.isin(*NUMERIC)


def loses_precision(datatype: Column) -> Column:
    """64-bit integers do not fit a double."""
    return datatype.isin("int64", "uint64")


def parse_datatype(text: Column) -> Column:
    """Aliases resolved; unknown names are kept as they are."""
    out = text
    for k, v in ALIASES.items():
        out = F.when(text == k, F.lit(v)).otherwise(out)
    return out


def parse_spectrum(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin(*SPECTRUM_TYPES), low).otherwise(F.lit("amplitude"))


def unsigned_to_double(v: Column) -> Column:
    return v.cast("decimal(20,0)").cast("double")


def reinterpret_unsigned(v: Column) -> Column:
    """A long that holds the bits of an unsigned one."""
    return F.when(v < 0, v.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(v.cast("decimal(20,0)")).cast("decimal(20,0)")


def value_as_string(datatype: str = "datatype") -> Column:
    """Any sample as text."""
    gps = F.format_string("lat=%s lon=%s alt=%s", "v_gps.latitude", "v_gps.longitude", "v_gps.altitude")
    return (
        F.when(F.col(datatype) == "gpslocation", gps)
        .when(F.col(datatype) == "binary", F.format_string("<%d bytes>", F.octet_length("v_binary")))
        .when(F.col(datatype) == "string", F.col("v_string"))
        .when(F.col(datatype) == "bool", F.when(F.col("v_bool"), "True").otherwise("False"))
        .otherwise(F.coalesce(F.col("v_long").cast("string"), F.col("v_ulong").cast("string"), F.col("v_double").cast("string")))
    )


def single_axis(datatype: str = "datatype") -> Column:
    """For charts only: latitude of positions, 0 for text and bytes."""
    return F.when(F.col(datatype) == "gpslocation", F.col("v_gps.latitude")).when(F.col(datatype).isin(*VARIABLE), F.lit(0.0)).otherwise(numeric())
