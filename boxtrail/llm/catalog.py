"""Registered queries of this package, and their SQL forms where SQL can express them."""

from __future__ import annotations

from boxtrail.llm import alignment, bagminhash, decontam, langid, licenses, middle, packing, pii, quality, repeats, secrets, sharding, token_counts

QUERIES = {
    f.__name__: f
    for f in (
        token_counts.op1_token_histogram,
        secrets.op2_secret_scan,
        bagminhash.op3_near_duplicates,
        pii.op4_personal_data,
        packing.op5_packing,
        quality.op6_quality_rules,
        langid.op7_language_id,
        sharding.op8_virtual_slots,
        repeats.op9_repeated_strings,
        decontam.op10_benchmark_overlaps,
        licenses.op11_license_scan,
        middle.op12_fill_in_middle,
        alignment.op13_token_alignment,
    )
}
ORACLE: dict[str, str] = {
    "op11_license_scan": licenses.OP11_SQL,
    "op12_fill_in_middle": middle.OP12_SQL,
}
