"""The queries of this subpackage by name, with SQL for those that it can express."""

from __future__ import annotations

from tidemark.llm import html, jaccard, language, lines, media, mixing, neighbours, packing, quality, warc

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_quality": quality.op2_quality,
    "op3_ngram_join": jaccard.op3_ngram_join,
    "op4_media": media.op4_media,
    "op5_mixing": mixing.op5_mixing,
    "op6_html": html.op6_html,
    "op7_neighbours": neighbours.op7_neighbours,
    "op8_warc": warc.op8_warc,
    "op9_packing": packing.op9_packing,
    "op10_language": language.op10_language,
}

ORACLES = {
    "op1_line_dedup": lines.ORACLE,
    "op3_ngram_join": jaccard.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op7_neighbours": neighbours.ORACLE,
    "op8_warc": warc.ORACLE,
}
