"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from tessel.llm import classifier, extraction, leaks, lines, media, mixing, near_dedup, periods, pieces, ranking, rules, secrets, toxicity

QUERIES = {
    "op1_quality_rules": rules.quality_rules,
    "op2_secret_scan": secrets.secret_scan,
    "op3_media_columns": media.media_columns,
    "op4_line_dedup": lines.line_dedup,
    "op5_sentencepiece_codec": pieces.sentencepiece_codec,
    "op6_quality_classifier": classifier.quality_classifier,
    "op7_html_extraction": extraction.html_extraction,
    "op8_source_mix": mixing.mixing,
    "op9_toxicity": toxicity.toxicity,
    "op10_minhash_near_dedup": near_dedup.minhash_near_dedup,
    "op11_period_detection": periods.period_detection,
    "op12_lexical_ranking": ranking.lexical_ranking,
    "op13_decontamination": leaks.decontamination,
}
SQL = {
    "op2_secret_scan": secrets.SQL,
    "op8_source_mix": mixing.SQL,
    "op11_period_detection": periods.SQL,
    "op12_lexical_ranking": ranking.SQL,
    "op13_decontamination": leaks.SQL,
}
