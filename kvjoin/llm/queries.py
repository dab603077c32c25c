"""The operators' queries and oracles by name."""

from __future__ import annotations

from . import decontaminate, language, license_scan, line_dedup, mixing, near_dedup, quality, substring_dedup, toxicity, warc

QUERIES = {
    "op1_license_scan": license_scan.query,
    "op2_quality_rules": quality.query,
    "op3_near_dedup": near_dedup.query,
    "op4_language_id": language.query,
    "op5_toxicity": toxicity.query,
    "op6_decontaminate": decontaminate.query,
    "op7_mix_sources": mixing.query,
    "op8_line_dedup": line_dedup.query,
    "op9_substring_dedup": substring_dedup.query,
    "op10_warc": warc.query,
}

#: The other queries have models or scores that SQL can't express; tests hold them against brute force.
ORACLES = {
    "op1_license_scan": license_scan.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op7_mix_sources": mixing.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op9_substring_dedup": substring_dedup.ORACLE,
    "op10_warc": warc.ORACLE,
}
