"""Vocabularies and lookup tables.

Every constant in this module is a fixed value: a protocol name, label, address
or fingerprint that results must use literally.
"""

# --- protocols -------------------------------------------------------------
ICMP, TCP, UDP, SCTP, IPV4, IPV6, ARP = "ICMP", "TCP", "UDP", "SCTP", "IPv4", "IPv6", "ARP"
SCTP_INIT, SCTP_INIT_ACK, SCTP_ABORT = "SCTP_INIT", "SCTP_INIT_ACK", "SCTP_ABORT"
PROTOCOLS = [ICMP, TCP, UDP, SCTP, SCTP_INIT, SCTP_INIT_ACK, SCTP_ABORT, IPV4, IPV6, ARP]
INTERNET_PROTOCOLS = [ICMP, ARP, IPV4, IPV6]
CONNECTION_PROTOCOLS = [TCP, SCTP]
TRANSPORT_PROTOCOLS = [TCP, UDP, SCTP]

# --- directions, flags, sentinels -------------------------------------------
INCOME, OUTCOME = "INCOME", "OUTCOME"
UNREACHABLE = "DESTINATION_UNREACHABLE"
NO_PORT = -1
UNKNOWN = "UNKNOWN"
ICMP_L4_KEY, NO_L4_KEY = "ICMP", "NONE"
TCP_INFO_KEYS = ["SEQ", "ACK", "WIN", "WIN_SCALE", "CHECKSUM_CORRECT", "HEADER_LENGTH"]
SCTP_CHUNKS = ["INIT", "INIT_ACK", "ABORT", "DATA", "COOKIE"]

# --- multicast destinations (31 addresses) ----------------------------------
MULTICAST = [
    "224.0.0.0", "224.0.0.1", "224.0.0.2", "224.0.0.4", "224.0.0.5", "224.0.0.6",
    "224.0.0.9", "224.0.0.10", "224.0.0.13", "224.0.0.18", "224.0.0.19", "224.0.0.20",
    "224.0.0.21", "224.0.0.22", "224.0.0.102", "224.0.0.107", "224.0.0.251",
    "224.0.0.252", "224.0.0.253", "224.0.1.1", "224.0.1.22", "224.0.1.35",
    "224.0.1.39", "224.0.1.40", "224.0.1.41", "224.0.1.129", "224.0.1.130",
    "224.0.1.131", "224.0.1.132", "239.255.255.250", "239.255.255.253",
]

# all multicast destinations: RFC 5771 and RFC 4291
MULTICAST_NETWORKS = ["224.0.0.0/4", "ff00::/8"]

# --- verdicts ----------------------------------------------------------------
NETWORK_ALERT = "NetworkScanAlert"
PORT_SCAN_ALERT = "PortScanAlert"
SUSPICIOUS_NETWORK = "SuspiciousNetworkScan"
NULL_SCAN = "TcpNullScanAttack"
ACK_WIN = "AckWinScanAttack"
SUSPICIOUS_ACK_WIN = "SuspiciousAckWinScanAttack"
XMAS = "XmasScanAttack"
MAIMON = "MaimonScanAttack"
SUSPICIOUS_MAIMON = "SuspiciousMaimonScanAttack"
FIN_SCAN = "FinScanAttack"
SUSPICIOUS_FIN = "SuspiciousFinScanAttack"
INIT_CONNECTION = "InitializingConnection"
INIT_AND_DATA = "InitializingConnectionAndDataTransfer"
INIT_FINE = "InitializingRemoveFinePackets"
FINE = "RemoveFinePackets"
PORT_CLOSED = "PortClosed"
NO_DATA = "DidNotSendData"
SEND_DATA = "SendData"
CONTINUE = "ContinueIteration"

SUSPICIOUS_FLAGS = [SUSPICIOUS_FIN, SUSPICIOUS_ACK_WIN, SUSPICIOUS_MAIMON]
DIRECT_ATTACKS = [NULL_SCAN, ACK_WIN, XMAS, MAIMON, FIN_SCAN]
PORT_SCAN_LABELS = [NO_DATA, PORT_CLOSED, *SUSPICIOUS_FLAGS]
OPEN_PORT_LABELS = [SEND_DATA, FINE, NO_DATA]
CLOSED_PORT_LABELS = [PORT_CLOSED, *SUSPICIOUS_FLAGS]
INITIATING_LABELS = [INIT_CONNECTION, INIT_FINE]
SENT_DATA_LABELS = [SEND_DATA, FINE, INIT_FINE]
HISTORY_LABELS = [
    INIT_CONNECTION, INIT_AND_DATA, INIT_FINE, FINE, SEND_DATA,
    SUSPICIOUS_NETWORK, NO_DATA, PORT_CLOSED, *SUSPICIOUS_FLAGS,
]

# --- alert vocabulary -----------------------------------------------------------
NETWORK_SCAN, PORT_SCAN = "NETWORK SCAN", "PORT SCAN"
SYN_OR_CONNECT = "TCP SYN, TCP CONNECT"
DIRECT_ATTACK_TYPE = {
    XMAS: "TCP XMAS",
    NULL_SCAN: "TCP NULL",
    ACK_WIN: "TCP ACK WIN",
    MAIMON: "TCP MAIMON",
    FIN_SCAN: "TCP FIN",
}
SUSPICIOUS_ATTACK_TYPE = {
    SUSPICIOUS_MAIMON: "TCP MAIMON",
    SUSPICIOUS_ACK_WIN: "TCP ACK WIN",
    SUSPICIOUS_FIN: "TCP FIN",
}
PROMOTION = {
    SUSPICIOUS_MAIMON: MAIMON,
    SUSPICIOUS_ACK_WIN: ACK_WIN,
    SUSPICIOUS_FIN: FIN_SCAN,
    PORT_CLOSED: PORT_SCAN_ALERT,
    NO_DATA: PORT_SCAN_ALERT,
}
NETWORK_ATTACK_TYPE = {
    UDP: "UDP", SCTP: "SCTP INIT", IPV4: "IP", IPV6: "IP", ICMP: "ICMP", ARP: "ARP",
}

# --- tool fingerprints ------------------------------------------------------------
NMAP, ANGRY_IP, MASSCAN, ZMAP, EVILSCAN = "NMAP", "Angry IP Scanner", "MASSCAN", "ZMAP", "EVILSCAN"
TOOLS_BY_ATTACK = {
    "TCP SYN": [NMAP, ZMAP, ANGRY_IP, EVILSCAN, MASSCAN],
    "ICMP": [NMAP, ZMAP, ANGRY_IP],
    "IP": [NMAP],
    "ARP": [NMAP],
    "TCP CONNECT": [NMAP, ANGRY_IP],
    "TCP NULL": [NMAP],
    "TCP MAIMON": [NMAP],
    "TCP ACK WIN": [NMAP],
    "TCP ACK": [NMAP],
    "TCP XMAS": [NMAP],
    "UDP": [NMAP, ANGRY_IP, ZMAP],
}
TOOLS_BY_HEADER = {
    "TCP SYN": {32: [ANGRY_IP], 40: [EVILSCAN], 20: [MASSCAN, ZMAP], 24: [NMAP]},
    "TCP CONNECT": {32: [ANGRY_IP], 40: [NMAP], 20: [MASSCAN, ZMAP]},
}
TOOLS_BY_WINDOW = {
    "TCP SYN": {32: [ANGRY_IP], 8192: [EVILSCAN], 65535: [ZMAP], 1024: [NMAP, MASSCAN]},
    "TCP CONNECT": {32: [ANGRY_IP], 29200: [NMAP], 1024: [MASSCAN], 65535: [ZMAP]},
}
TOOLS_BY_LENGTH = {
    UDP: {8: [ANGRY_IP], 29: [ZMAP], 0: [NMAP]},
    ICMP: {56: [ANGRY_IP], 12: [ZMAP], 0: [NMAP]},
}
