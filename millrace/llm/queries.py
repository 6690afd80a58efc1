"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, chat, codes, decontam, langid, lines, mixing, neardup, pieces, quality, shards, warc, whitening

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_mix": mixing.op2_mix,
    "op3_decontaminate": decontam.op3_decontaminate,
    "op4_language": langid.op4_language,
    "op5_nearest": ann.op5_nearest,
    "op6_shards": shards.op6_shards,
    "op7_chat": chat.op7_chat,
    "op8_jaccard": neardup.op8_jaccard,
    "op9_lines": lines.op9_lines,
    "op10_quality": quality.op10_quality,
    "op11_whiten": whitening.op11_whiten,
    "op12_pieces": pieces.op12_pieces,
    "op13_codes": codes.op13_codes,
}

ORACLES: dict[str, str] = {
    "op1_warc": warc.OP1_SQL,
    "op7_chat": chat.OP7_SQL,
    "op9_lines": lines.OP9_SQL,
    "op13_codes": codes.OP13_SQL,
}
