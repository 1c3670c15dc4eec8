"""The registered queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from sparkloom.llm.chat_format import op7_chat_format
from sparkloom.llm.decontaminate import op8_decontaminate
from sparkloom.llm.license_scan import op10_license_scan
from sparkloom.llm.pack_binary import op2_pack_binary
from sparkloom.llm.pii import op9_pii
from sparkloom.llm.quality_classifier import op4_quality_classifier
from sparkloom.llm.quality_rules import op5_quality_rules
from sparkloom.llm.secret_scan import op1_secret_scan
from sparkloom.llm.simhash_dedup import op6_simhash_dedup
from sparkloom.llm.suffix_dedup import op3_suffix_dedup
from sparkloom.llm.sql import ORACLES

QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_pack_binary, op3_suffix_dedup, op4_quality_classifier, op5_quality_rules, op6_simhash_dedup, op7_chat_format, op8_decontaminate, op9_pii, op10_license_scan)}

__all__ = ["ORACLES", "QUERIES"]
