"""Detection settings.

The defaults are the corrected behaviour. `Rules.reference()` switches every
known quirk of the original rule set back on, for literal comparison.
"""

from __future__ import annotations

from dataclasses import dataclass

SPECIFIC_FIRST, REFERENCE = "specific_first", "reference"


@dataclass(frozen=True)
class Rules:
    closed_port_threshold: int = 5
    max_gap_us: int = 1000            # longest probe -> reply gap of the two-packet scans
    quiet_us: int = 1_000_000         # suspicious verdicts wait this long for more packets
    alert_score: int = 50
    rule_order: str = SPECIFIC_FIRST  # or "reference": Maimon/FIN rules after the fine-flow rule
    two_packet_ack_win: bool = True   # ACK/WIN rules need exactly two packets
    full_fin_rule: bool = True        # FIN rules check every condition, numeric ACK = SEQ + 1
    half_open_syn: bool = True        # SYN, SYN-ACK, RST counts as TCP SYN
    sctp_closes: bool = True          # a SHUTDOWN chunk closes an SCTP flow
    icmp_pulls_udp: bool = False      # ICMP flows also see the UDP packets of their flow key
    quiet_counts_later_only: bool = True
    tools_by_own_table: bool = True   # CONNECT uses the CONNECT fingerprints
    empty_tools_unknown: bool = True
    sctp_alerts: bool = True
    ip_arp_tools: bool = True
    maimon_fin_alerts: bool = True
    clean_ports: bool = True          # own port only once, never -1
    count_host_data: bool = False     # outgoing data transfers count as sent data
    merge_scope: str = "attacker"     # or "global": SYN/CONNECT label merge of the roll-up

    @staticmethod
    def reference(**changes) -> "Rules":
        literal = dict(
            rule_order=REFERENCE, two_packet_ack_win=False, full_fin_rule=False,
            half_open_syn=False, sctp_closes=False, quiet_counts_later_only=False,
            tools_by_own_table=False, empty_tools_unknown=False, sctp_alerts=False,
            ip_arp_tools=False, maimon_fin_alerts=False, clean_ports=False,
            merge_scope="global",
        )
        return Rules(**{**literal, **changes})
