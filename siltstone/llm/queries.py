"""The queries of this folder, by name, for the driver's catalogue."""

from __future__ import annotations

from siltstone.llm import classifier, licenses, mixing, packing, pii, rules, simhash, token_files, url_filter, winnow


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_mix_sources": mixing.op2_mix_sources,
        "op3_pii_pseudonyms": pii.op3_pii_pseudonyms,
        "op4_simhash_classes": simhash.op4_simhash_classes,
        "op5_token_files": token_files.op5_token_files,
        "op6_rule_ledger": rules.op6_rule_ledger,
        "op7_license_scan": licenses.op7_license_scan,
        "op8_pack_best_fit": packing.op8_pack_best_fit,
        "op9_quality_classifier": classifier.op9_quality_classifier,
        "rule_ablations": rules.rule_ablations,
        "op10_winnow_fingerprints": winnow.op10_winnow_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.SQL, "op2_mix_sources": mixing.SQL, "op6_rule_ledger": rules.SQL, "rule_ablations": rules.ABLATIONS_SQL, "op7_license_scan": licenses.SQL}
