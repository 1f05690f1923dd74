"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from cairn.llm.bpe import op8_byte_bpe
from cairn.llm.chat_format import op10_chat_format
from cairn.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from cairn.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from cairn.llm.lm_score import op4_lm_score
from cairn.llm.media import op5_media
from cairn.llm.mixing import OP3_SQL, op3_mixing
from cairn.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from cairn.llm.quality import op9_quality
from cairn.llm.simhash import op7_simhash
from cairn.llm.substring import OP13_SQL, op13_substring_dedup
from cairn.llm.url_filter import op6_url_filter
from cairn.llm.warc import op1_warc_index

QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_index, op2_exact_dedup, op3_mixing, op4_lm_score, op5_media,
        op6_url_filter, op7_simhash, op8_byte_bpe, op9_quality, op10_chat_format,
        op11_prefix_trie, op12_hard_negatives, op13_substring_dedup,
    )
}
ORACLES = {"op2_exact_dedup": OP2_SQL, "op3_mixing": OP3_SQL, "op11_prefix_trie": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_substring_dedup": OP13_SQL}
