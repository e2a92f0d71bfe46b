"""Schemas of the records the engine reads and writes."""

from pyspark.sql import types as T

PACKET = T.StructType([
    T.StructField("packet_id", T.LongType()),
    T.StructField("timestamp", T.LongType()),              # microseconds
    T.StructField("protocol", T.StringType()),
    T.StructField("source_address", T.StringType()),
    T.StructField("source_port", T.IntegerType()),
    T.StructField("destination_address", T.StringType()),
    T.StructField("destination_port", T.IntegerType()),
    T.StructField("info", T.MapType(T.StringType(), T.StringType())),
    T.StructField("flags", T.ArrayType(T.StringType())),
    T.StructField("flow_key", T.LongType()),
    T.StructField("l4_key", T.StringType()),
    T.StructField("pair_key", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("length", T.IntegerType()),
])

HISTORY = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("flow_key", T.LongType()),
    T.StructField("l4_key", T.StringType()),
    T.StructField("pair_key", T.StringType()),
    T.StructField("port", T.IntegerType()),
    T.StructField("n_packets", T.LongType()),
    T.StructField("verdict", T.StringType()),
    T.StructField("verdict_ts", T.LongType()),
])

ALERT = T.StructType([
    T.StructField("time", T.LongType()),
    T.StructField("scan_type", T.StringType()),
    T.StructField("attack_type", T.StringType()),
    T.StructField("attacker", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("tools", T.ArrayType(T.StringType())),
    T.StructField("scanned_ports", T.ArrayType(T.IntegerType())),
    T.StructField("chance", T.DoubleType()),
    T.StructField("read", T.BooleanType()),
])

FEATURES = [
    "host_initiated", "data_transfer", "closed_after_open", "threshold_class",
    "neighbour_factor", "open_port_factor", "closed_port_score",
]

TRAINING = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in FEATURES]
    + [T.StructField("label", T.DoubleType())]
)

PORT_INFO = T.StructType([
    T.StructField("port", T.IntegerType()),
    T.StructField("tcp", T.BooleanType()),
    T.StructField("udp", T.BooleanType()),
    T.StructField("sctp", T.BooleanType()),
    T.StructField("description", T.StringType()),
])
