"""Queries of the pipeline operators and the SQL that checks those that SQL can express."""

from tidemark.llm import alignment, boilerplate, bpe, exactdedup, hardneg, neardup, ngramlm, packing, pii, records, repeats, telephony, toxicity

QUERIES = {
    "op1_token_records": records.records_query,
    "op2_telephony_media": telephony.telephony_query,
    "op3_min_slack_packing": packing.packing_query,
    "op4_chosen_path_neardup": neardup.neardup_query,
    "op5_site_line_dedup": boilerplate.boilerplate_query,
    "op6_bpe_transducer": bpe.bpe_query,
    "op7_checked_pii": pii.pii_query,
    "op8_backoff_lm": ngramlm.lm_query,
    "op9_ordinal_toxicity": toxicity.toxicity_query,
    "op10_stream_exact_dedup": exactdedup.dedup_query,
    "op11_suffix_index_repeats": repeats.repeats_query,
    "op12_lockstep_alignment": alignment.alignment_query,
    "op13_residue_hard_negatives": hardneg.hard_negatives_query,
}

ORACLES: dict[str, str] = {
    "op5_site_line_dedup": boilerplate.SQL,
    "op7_checked_pii": pii.SQL,
    "op10_stream_exact_dedup": exactdedup.SQL,
    "op13_residue_hard_negatives": hardneg.SQL,
}
