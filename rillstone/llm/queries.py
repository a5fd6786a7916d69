"""Registered queries of the training-data operators, and their SQL where SQL can say them."""

from __future__ import annotations

from .byte_bpe import op3_byte_bpe
from .chat_format import OP6_SQL, op6_chat_format
from .decontaminate import OP10_SQL, op10_fm_decontaminate
from .hilbert_shards import OP2_SQL, op2_hilbert_shards
from .importance import op1_importance
from .jaccard_join import OP7_SQL, op7_jaccard_join
from .lang_id import op4_lang_id
from .line_dedup import OP5_SQL, op5_line_dedup
from .quality_forest import op8_quality_forest
from .warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_importance": op1_importance,
    "op2_hilbert_shards": op2_hilbert_shards,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_lang_id": op4_lang_id,
    "op5_line_dedup": op5_line_dedup,
    "op6_chat_format": op6_chat_format,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_quality_forest": op8_quality_forest,
    "op9_warc": op9_warc,
    "op10_fm_decontaminate": op10_fm_decontaminate,
}

ORACLE_SQL = {
    "op2_hilbert_shards": OP2_SQL,
    "op5_line_dedup": OP5_SQL,
    "op6_chat_format": OP6_SQL,
    "op7_jaccard_join": OP7_SQL,
    "op9_warc": OP9_SQL,
    "op10_fm_decontaminate": OP10_SQL,
}
