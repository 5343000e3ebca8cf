"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import avi, bpe, chat, crf, langid, mixing, perplexity, simhash, suffix, warc

QUERIES = {
    "op1_source_mix": mixing.query,
    "op2_language_id": langid.query,
    "op3_avi_mjpeg": avi.query,
    "op4_byte_bpe": bpe.query,
    "op5_perplexity_rules": perplexity.query,
    "op6_simhash": simhash.query,
    "op7_chat_trees": chat.query,
    "op8_line_crf": crf.query,
    "op9_suffix_dedup": suffix.query,
    "op10_warc_index": warc.query,
}

ORACLE_SQL = {
    "op1_source_mix": mixing.SQL,
    "op7_chat_trees": chat.SQL,
}
