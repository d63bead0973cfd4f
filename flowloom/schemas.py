"""Declared schemas, canonical column orders and fixed category tables."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: field lists, in the published order -----------------------

# Sensor A (flow exporter): the CSV carries no header, fields arrive in this order.
FLOW_FIELDS = [
    "stime", "proto", "saddr", "sport", "daddr", "dport", "state", "ltime",
    "spkts", "dpkts", "sbytes", "dbytes", "sttl", "dttl", "sload", "dload",
    "sloss", "dloss", "sintpkt", "dintpkt", "sjit", "djit", "stcpb", "dtcpb",
    "tcprtt", "synack", "ackdat", "smeansz", "dmeansz", "dur",
]

# Merged flow record.
MERGED_FIELDS = [
    "saddr", "sport", "daddr", "dport", "proto", "state", "dur", "sbytes", "dbytes",
    "sttl", "dttl", "sloss", "dloss", "service", "sload", "dload", "spkts", "dpkts",
    "stcpb", "dtcpb", "smeansz", "dmeansz", "trans_depth", "response_body_len", "sjit",
    "djit", "stime", "ltime", "sintpkt", "dintpkt", "tcprtt", "synack", "ackdat",
    "is_sm_ips_ports", "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd", "ct_srv_src",
    "ct_srv_dst", "ct_dst_ltm", "ct_src_ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm",
    "ct_dst_src_ltm",
]

# Scoring line: position of each value in the comma separated row.
SCORING_FIELDS = FLOW_FIELDS + [
    "ct_state_ttl", "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd",
    "ct_srv_src", "ct_srv_dst", "ct_dst_ltm", "ct_src_ltm",
    "ct_src_dport_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm",
]

# Labelled flow table, 49 columns.
LABELLED_FIELDS = [
    "srcip", "sport", "dstip", "dsport", "proto", "state", "dur", "sbytes", "dbytes",
    "sttl", "dttl", "sloss", "dloss", "service", "sload", "dload", "spkts", "dpkts",
    "swin", "dwin", "stcpb", "dtcpb", "smeansz", "dmeansz", "trans_depth", "response_body_len",
    "sjit", "djit", "stime", "ltime", "sintpkt", "dintpkt", "tcprtt", "synack", "ackdat",
    "is_sm_ips_ports", "ct_state_ttl", "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd",
    "ct_srv_src", "ct_srv_dst", "ct_dst_ltm", "ct_src_ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm",
    "ct_dst_src_ltm", "attack_cat", "label",
]

# Numeric measurements of a flow, in model feature order.
NUMERIC_FIELDS = [
    "sport", "dport", "dur", "sbytes", "dbytes", "sttl", "dttl", "sloss", "dloss",
    "sload", "dload", "spkts", "dpkts", "stcpb", "dtcpb", "smeansz", "dmeansz",
    "sjit", "djit", "stime", "ltime", "sintpkt", "dintpkt", "tcprtt", "synack", "ackdat",
]
PROTOCOL_FEATURES = [
    "trans_depth", "response_body_len",
    "is_sm_ips_ports", "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd",
    "ct_srv_src", "ct_srv_dst", "ct_dst_ltm", "ct_src_ltm",
    "ct_src_dport_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm",
]
CATEGORICAL_FIELDS = ["proto", "state"]

# Balanced table, 32 columns.
BALANCED_FIELDS = [
    "srcip", "sport", "dstip", "dport", "proto", "state", "dur", "sbytes",
    "dbytes", "sttl", "dttl", "sloss", "dloss", "sload", "dload", "spkts",
    "dpkts", "stcpb", "dtcpb", "smeansz", "dmeansz", "sjit", "djit",
    "stime", "ltime", "sintpkt", "dintpkt", "tcprtt", "synack", "ackdat",
    "attack_cat", "label",
]

HTTP_PROFILE_FIELDS = ["trans_depth", "response_body_len", "ct_flw_http_mthd"]
SHORT_FLOW_FEATURES = {"sjit": "spkts", "djit": "dpkts", "sintpkt": "spkts", "dintpkt": "dpkts"}

# --- fixed values: category indexes of the published model -------------------

CLASS_LABELS = ["Normal", "Attack"]
STATE_LABELS = [
    "FIN", "CON", "INT", "REQ", "RST", "ECO", "CLO", "URH",
    "ACC", "PAR", "ECR", "TST", "MAS", "URN", "no", "TXD",
]
PROTO_LABELS = [
    "tcp", "udp", "unas", "arp", "ospf", "sctp", "icmp", "any", "gre", "rsvp",
    "ipv6", "mobile", "pim", "sun-nd", "swipe", "sep", "3pc", "a/n", "aes-sp3-d", "argus",
    "aris", "ax.25", "bbn-rcc", "bna", "br-sat-mon", "cbt", "cftp", "chaos", "compaq-peer", "cphb",
    "cpnx", "crtp", "crudp", "dcn", "ddp", "ddx", "dgp", "egp", "eigrp", "emcon",
    "encap", "etherip", "fc", "fire", "ggp", "gmtp", "hmp", "i-nlsp", "iatp", "ib",
    "idpr", "idpr-cmtp", "idrp", "ifmp", "igp", "il", "ip", "ipcomp", "ipcv", "ipip",
    "iplt", "ipnip", "ippc", "ipv6-frag", "ipv6-no", "ipv6-opts", "ipv6-route", "ipx-n-ip", "irtp", "isis",
    "iso-ip", "iso-tp4", "kryptolan", "l2tp", "larp", "leaf-1", "leaf-2", "merit-inp", "mfe-nsp", "mhrp",
    "micp", "mtp", "mux", "narp", "netblt", "nsfnet-igp", "nvp", "pgm", "pipe", "pnni",
    "pri-enc", "prm", "ptp", "pup", "pvp", "qnx", "rdp", "rvd", "sat-expak", "sat-mon",
    "sccopmce", "scps", "sdrp", "secure-vmtp", "skip", "sm", "smp", "snp", "sprite-rpc", "sps",
    "srp", "st2", "stp", "tcf", "tlsp", "tp++", "trunk-1", "trunk-2", "ttp", "uti",
    "vines", "visa", "vmtp", "vrrp", "wb-expak", "wb-mon", "wsn", "xnet", "xns-idp", "xtp",
    "zero", "igmp", "udt", "rtp", "esp",
]

# --- Spark types -------------------------------------------------------------

_STRING = {"proto", "saddr", "daddr", "state", "srcip", "dstip", "service", "attack_cat"}
_COUNT = {
    "spkts", "dpkts", "sbytes", "dbytes", "sttl", "dttl", "sloss", "dloss", "stcpb", "dtcpb",
    "swin", "dwin", "trans_depth", "response_body_len", "is_sm_ips_ports", "ct_state_ttl",
    "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd", "ct_srv_src", "ct_srv_dst", "ct_dst_ltm",
    "ct_src_ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm",
}


def _type_of(name: str) -> T.DataType:
    if name in _STRING:
        return T.StringType()
    if name in {"sport", "dport", "dsport"} or name in _COUNT:
        return T.LongType()
    if name == "label":
        return T.IntegerType()
    return T.DoubleType()


def struct_of(names, text: bool = False) -> T.StructType:
    """Nullable struct over ``names``; ``text=True`` leaves every field a string."""
    return T.StructType([T.StructField(n, T.StringType() if text else _type_of(n)) for n in names])


FLOW_TEXT_SCHEMA = struct_of(FLOW_FIELDS, text=True)
FLOW_SCHEMA = struct_of(FLOW_FIELDS)
LABELLED_SCHEMA = struct_of(LABELLED_FIELDS)
BALANCED_SCHEMA = struct_of(BALANCED_FIELDS)
SCORING_SCHEMA = struct_of(SCORING_FIELDS)

# Sensor B (protocol logger): superset of the fields read from its three logs.
# The dotted names are renamed at read time (see LOG_RENAMES).
LOG_SCHEMA = T.StructType([
    T.StructField("ts", T.StringType()),
    T.StructField("uid", T.StringType()),
    T.StructField("id.orig_h", T.StringType()),
    T.StructField("id.orig_p", T.StringType()),
    T.StructField("id.resp_h", T.StringType()),
    T.StructField("id.resp_p", T.StringType()),
    T.StructField("proto", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("trans_depth", T.LongType()),
    T.StructField("response_body_len", T.LongType()),
    T.StructField("method", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("password", T.StringType()),
    T.StructField("command", T.StringType()),
])
LOG_RENAMES = {
    "id.orig_h": "orig_h", "id.orig_p": "orig_p",
    "id.resp_h": "resp_h", "id.resp_p": "resp_p",
    "user": "user_name",
}
LOG_KINDS = ["conn", "http", "ftp"]

# Column-name drift between live records and labelled tables.
CANONICAL_NAMES = {"srcip": "saddr", "dstip": "daddr", "dsport": "dport",
                   "Stime": "stime", "Ltime": "ltime"}
