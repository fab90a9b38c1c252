"""Small rule sets for the named queries, over the actions and events of the test tables."""

from __future__ import annotations

from lakewarden.operators.enforce import Rule
from lakewarden.operators.matching import TechniqueRule, TextRule

# The rule sets that queries and their SQL share.
RULES = [
    Rule("Q1", "mandatory", "snapshot_memory", "hard", scope={"event_type_contains": ["beacon", "macro"], "category_contains": ["command", "malware"]}),
    Rule("Q2", "mandatory", "notify_data_owner", "soft", scope={"command_contains": ["ref", "host_1"]}),
    Rule("Q3", "prohibit_before", "reimage_endpoint", "hard", before="snapshot_memory"),
    Rule("Q4", "prohibit_before", "snapshot_memory", "warning", before="preserve_proxy_logs"),
    Rule("Q5", "prohibit_before", "rejoin_network", "hard", before="revoke_sessions"),
    Rule("Q6", "require_approval", "quarantine_endpoint", "hard"),
    Rule("Q7", "require_approval", "suspend_account", "soft"),
    Rule("Q8", "require_approval", "snapshot_memory", "hard"),
    Rule("Q9", "mandatory", "isolate_everything", "warning", scope={"details_text_contains": ["crabshell"], "severity_contains": ["critical"]}),
]

TECHNIQUES = [
    TechniqueRule("A1", "T9001", "TA01", ["auth", "vpn"], category=["authentication"], source_type=["ad", "vpn"], weights=(0.4, 0.3, 0.2, 0.1), least=0.5),
    TechniqueRule("A2", "T9002", "TA02", ["command", "macro"], command=["crabshell", "bitlift", "-t "], weights=(0.4, 0.3, 0.2, 0.1), least=0.6),
    TechniqueRule("A3", "T9003.001", "TA02", ["macro"], category=["execution", "mail"], least=0.4),
    TechniqueRule("A4", "T9004", "TA03", ["port", "sweep", "dns"], source_type=["ips", "utm", "proxy"], category=["recon"], weights=(0.35, 0.3, 0.25, 0.1), least=0.45),
    TechniqueRule("A5", "T9005", "TA04", ["beacon"], command=["netpeek"], category=["command_control"], source_type=["edr"], weights=(0.6, 0.3, 0.25, 0.1), least=0.8),
]

TEXT_RULES = [
    TextRule("quarantine_endpoint", ["quarantine", "isolat"], priority=2),
    TextRule("suspend_account", ["suspend", "account"], every=True, priority=1),
    TextRule("snapshot_memory", ["snapshot", "memory"], priority=1),
    TextRule("call_owner", ["owner", "countersign"], priority=2),
    TextRule("review_log", ["log", "console"], priority=1),
]

STOP = ["the", "and", "for", "with", "was", "not"]
PRIORITY_WORDS = ["beacon", "crabshell", "macro", "bitlift"]
TERMS = ["netpeek", "handover"]
