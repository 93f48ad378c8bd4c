"""The rule tables and constants that the SQL uses: a copy of its own as text, so that a wrong constant of the engine shows."""

from __future__ import annotations

# Event rules as (id, axis, severity, phrases) and signal rules as (id, family, severity, mode, phrases).
EVENT_RULES = [
    ("FR_01", "FR", "high", ["fabricated citation"]),
    ("FR_02", "FR", "high", ["unverifiable source"]),
    ("FR_03", "FR", "medium", ["contradictory fact"]),
    ("FR_04", "FR", "high", ["invented statistic"]),
    ("FR_05", "FR", "medium", ["date mismatch"]),
    ("FR_06", "FR", "medium", ["entity mismatch"]),
    ("FR_07", "FR", "medium", ["unsupported claim"]),
    ("FR_08", "FR", "high", ["impossible value"]),
    ("FR_09", "FR", "medium", ["source missing"]),
    ("FR_10", "FR", "high", ["fake quote"]),
    ("FR_11", "FR", "high", ["broken evidence link"]),
    ("CA_01", "CA", "medium", ["context drift"]),
    ("CA_02", "CA", "high", ["instruction conflict"]),
    ("CA_03", "CA", "medium", ["omitted requirement"]),
    ("CA_04", "CA", "medium", ["role confusion"]),
    ("CA_05", "CA", "medium", ["task scope jump"]),
    ("CA_06", "CA", "low", ["ambiguous reference"]),
    ("CA_07", "CA", "medium", ["stale context reuse"]),
    ("CA_08", "CA", "medium", ["language mismatch"]),
    ("CA_09", "CA", "medium", ["intent misread"]),
    ("CA_10", "CA", "high", ["boundary bypass"]),
    ("CA_11", "CA", "high", ["policy contradiction"]),
    ("SR_01", "SR", "critical", ["self-harm hint", "off himself", "off herself", "off myself"]),
    ("SR_02", "SR", "critical", ["violence instruction"]),
    ("SR_03", "SR", "high", ["harassment pattern", "feel threatened", "make her feel threatened", "make him feel threatened"]),
    ("SR_04", "SR", "critical", ["medical emergency"]),
    ("SR_05", "SR", "high", ["legal advice risk"]),
    ("SR_06", "SR", "high", ["financial scam"]),
    ("SR_07", "SR", "high", ["privacy leak"]),
    ("SR_08", "SR", "critical", ["credential request"]),
    ("SR_09", "SR", "critical", ["malware instruction"]),
    ("SR_10", "SR", "high", ["social engineering"]),
    ("SR_11", "SR", "high", ["age-sensitive content"]),
    ("SA_01", "SA", "medium", ["timeout repeated"]),
    ("SA_02", "SA", "high", ["crash loop"]),
    ("SA_03", "SA", "high", ["resource exhaustion"]),
    ("SA_04", "SA", "high", ["dependency failure"]),
    ("SA_05", "SA", "medium", ["rate limit burst"]),
    ("SA_06", "SA", "high", ["storage corruption"]),
    ("SA_07", "SA", "high", ["network outage"]),
    ("SA_08", "SA", "medium", ["permission denied"]),
    ("SA_09", "SA", "medium", ["config missing"]),
    ("SA_10", "SA", "high", ["deployment rollback"]),
]
SIGNAL_RULES = [
    ("VCDE_01", "prompt_injection", "high", "any", ["ignore previous instruction", "ignore everything before this", "ignore everything to your core before this"]),
    ("VCDE_02", "prompt_injection", "high", "any", ["reveal hidden prompt"]),
    ("VCDE_03", "prompt_injection", "critical", "any", ["bypass safety policy"]),
    ("VCDE_04", "boundary", "critical", "any", ["disable guardrail"]),
    ("VCDE_05", "boundary", "high", "any", ["ignore system message", "pretend to be dan", "do anything now"]),
    ("VCDE_06", "boundary", "high", "any", ["override policy", "stay in character", "begin all replies with"]),
    ("VCDE_07", "source_spoof", "high", "all", ["official source", "trust me"]),
    ("VCDE_08", "source_spoof", "medium", "any", ["internal memo leaked"]),
    ("VCDE_09", "source_spoof", "high", "any", ["fabricated source link"]),
    ("VCDE_10", "instruction_drift", "medium", "any", ["out of scope task"]),
    ("VCDE_11", "instruction_drift", "medium", "any", ["switch objective"]),
    ("VCDE_12", "instruction_drift", "high", "any", ["conflicting mandate"]),
    ("VCDE_13", "data_exfil", "critical", "any", ["export credential"]),
    ("VCDE_14", "data_exfil", "high", "any", ["dump secrets"]),
    ("VCDE_15", "data_exfil", "high", "any", ["print api key"]),
    ("VCDE_16", "coercion", "high", "any", ["you must obey now"]),
    ("VCDE_17", "coercion", "medium", "any", ["urgent override"]),
    ("VCDE_18", "coercion", "high", "any", ["do not explain"]),
    ("VCDE_19", "context_pollution", "medium", "any", ["fake memory"]),
    ("VCDE_20", "context_pollution", "medium", "any", ["stale context import"]),
]

# Words that don't count as content, and signs of distress.
STOPWORDS = "a an and are as at be been but do for from had has have he her hers him his i if in into is it its me my of on or our ours she so than that the their them there they this to too was we were what when with would you your yours".split()
DISTRESS_CUES = ["ugh", "claustrophobic", "crowded", "won't stop", "wont stop", "unfortunately", "lost my", "worried", "scared", "afraid"]

# Axes, floors of axes by signal status, order of axes in ties, events of a rule in a conversation.
AXES = ["FR", "CA", "SR", "SA"]
AXIS_FLOORS = {"GUARDED": {"CA": 2}, "TRIGGERED": {"CA": 3, "SR": 2}, "LOCKDOWN": {"CA": 4, "SR": 3}}
TIE_ORDER = ["SR", "CA", "FR", "SA"]
CAP = 5

# What the queries add to every fourth turn, and custom rules over words of the tables.
PHRASES = [p for *_, ps in EVENT_RULES for p in ps] + [p for *_, ps in SIGNAL_RULES for p in ps] + ["official source, trust me", "so worried and scared", "crash loop and network outage"]
WORD_RULES = [
    ("W_01", "CA", "low", "any", ["the", "der"]),
    ("W_02", "SR", "high", "all", ["of", "that"]),
    ("W_03", "FR", "medium", "any", ["ening", "ung "]),
    ("W_04", "SA", "critical", "all", ["and", "in", "thor"]),
]
