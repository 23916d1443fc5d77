"""Registry of the corpus operators' queries and of the SQL that states their results.

Without SQL: the trained operators (1, 4), the histogram references (9) and label propagation (3), which tests hold
against held-out accuracy, plain counts and the laws of the result.
"""

from __future__ import annotations

from . import chatfmt, decontam, kdtree, langid, mixing, neardup, phrases, quality, rules, runs, sharding, urlfilter, warc

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_warc": warc.op2_warc,
    "op3_sharding": sharding.op3_sharding,
    "op4_quality": quality.op4_quality,
    "op5_chat_format": chatfmt.op5_chat_format,
    "op6_decontamination": decontam.op6_decontamination,
    "op7_url_filter": urlfilter.op7_url_filter,
    "op8_near_duplicates": neardup.op8_near_duplicates,
    "op9_rules": rules.op9_rules,
    "op10_mixing": mixing.op10_mixing,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_top_k": kdtree.op12_top_k,
    "op13_collocations": phrases.op13_collocations,
}
ORACLE = {
    "op2_warc": warc.ORACLE,
    "op5_chat_format": chatfmt.ORACLE,
    "op6_decontamination": decontam.ORACLE,
    "op7_url_filter": urlfilter.ORACLE,
    "op8_near_duplicates": neardup.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op12_top_k": kdtree.ORACLE,
    "op13_collocations": phrases.ORACLE,
}
