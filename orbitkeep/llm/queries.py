"""The queries of this subpackage, and the SQL of those that SQL can express."""

from . import bpe, licenses, linededup, lm, minhash, mixing, qualityrules, rulefit, syncmers, urlfilter

QUERIES = {
    "op1_near_dedup": minhash.query,
    "op2_url_filter": urlfilter.query,
    "op3_fingerprints": syncmers.query,
    "op4_license_scan": licenses.query,
    "op5_bpe": bpe.query,
    "op6_mixing": mixing.query,
    "op7_lm_score": lm.query,
    "op8_line_dedup": linededup.query,
    "op9_quality_rules": qualityrules.query,
    "op10_quality_classifier": rulefit.query,
}

ORACLE_SQL: dict[str, str] = {"op2_url_filter": urlfilter.ORACLE, "op6_mixing": mixing.ORACLE, "op9_quality_rules": qualityrules.ORACLE}
