"""Explicit schemas of the engine tables; scan input is never inferred."""

from pyspark.sql import types as T

SCRIPT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("output", T.StringType()),
])

OS_MATCH = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("accuracy", T.StringType()),
])

PORT = T.StructType([
    T.StructField("protocol", T.StringType()),
    T.StructField("port", T.IntegerType()),
    T.StructField("service", T.StringType()),
    T.StructField("service_source", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("extrainfo", T.StringType()),
    T.StructField("service_method", T.StringType()),
    T.StructField("service_confidence", T.StringType()),
    T.StructField("service_ostype", T.StringType()),
    T.StructField("tunnel", T.StringType()),
    T.StructField("state_reason", T.StringType()),
    T.StructField("scripts", T.ArrayType(SCRIPT)),
])

# Columns that unknown-port handling adds to a port.
GUESS_FIELDS = T.StructType([
    T.StructField("original_service", T.StringType()),
    T.StructField("service_guess", T.StringType()),
    T.StructField("device_guess", T.StringType()),
    T.StructField("guess_confidence", T.DoubleType()),
    T.StructField("guess_evidence", T.StringType()),
])

HOST = T.StructType([
    T.StructField("scan_id", T.StringType()),
    T.StructField("ip", T.StringType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("mac", T.StringType()),
    T.StructField("vendor", T.StringType()),
    T.StructField("os_matches", T.ArrayType(OS_MATCH)),
    T.StructField("open_ports", T.ArrayType(PORT)),
])

PORT_OBS = T.StructType(
    HOST.fields[:3] + [T.StructField("pos", T.IntegerType())] + PORT.fields
)


def _attrs(*names):
    return [T.StructField(f"_{name}", T.StringType()) for name in names]


# One <host> element of a scan file; attributes carry the prefix "_".
XML_HOST = T.StructType([
    T.StructField("status", T.StructType(_attrs("state"))),
    T.StructField("address", T.ArrayType(T.StructType(_attrs("addr", "addrtype", "vendor")))),
    T.StructField("hostnames", T.StructType([
        T.StructField("hostname", T.ArrayType(T.StructType(_attrs("name", "type")))),
    ])),
    T.StructField("ports", T.StructType([
        T.StructField("port", T.ArrayType(T.StructType([
            T.StructField("_protocol", T.StringType()),
            T.StructField("_portid", T.IntegerType()),
            T.StructField("state", T.StructType(_attrs("state", "reason"))),
            T.StructField("service", T.StructType(_attrs(
                "name", "product", "version", "extrainfo", "method", "conf", "ostype", "tunnel"))),
            T.StructField("script", T.ArrayType(T.StructType(_attrs("id", "output")))),
        ]))),
    ])),
    T.StructField("os", T.StructType([
        T.StructField("osmatch", T.ArrayType(T.StructType(_attrs("name", "accuracy")))),
    ])),
])
