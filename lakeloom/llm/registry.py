"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from lakeloom.llm import ann, decontaminate, langid, line_dedup, packing, periodic, pieces, quality, simhash, substring_dedup, suffix_array, warc, whitening

QUERIES = {
    "op1_quality": quality.query,
    "op2_packing": packing.query,
    "op3_line_dedup": line_dedup.query,
    "op4_ann": ann.query,
    "op5_substring_dedup": substring_dedup.query,
    "op6_simhash": simhash.query,
    "op7_suffix_array": suffix_array.query,
    "op8_decontaminate": decontaminate.query,
    "op9_warc": warc.query,
    "op10_langid": langid.query,
    "op11_periodic_runs": periodic.query,
    "op12_pieces": pieces.query,
    "op13_whitening": whitening.query,
}

SQL = {
    "op2_packing": packing.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op5_substring_dedup": substring_dedup.SQL,
    "op7_suffix_array": suffix_array.SQL,
    "op8_decontaminate": decontaminate.SQL,
    "op9_warc": warc.SQL,
}
