"""The registered corpus queries and the SQL that some of them can be held against."""

from __future__ import annotations

from overlap.llm.block_ann import OP9_SQL, op9_block_matrix_ann
from overlap.llm.content_sort import OP5_SQL, op5_content_sort_dedup
from overlap.llm.entropy_mix import op10_entropy_mix
from overlap.llm.kd_shards import op6_kd_shards
from overlap.llm.lang_ftrl import op8_lang_ftrl
from overlap.llm.piece_viterbi import op3_piece_viterbi
from overlap.llm.secret_crf import op12_secret_crf
from overlap.llm.suffix_dedup import op2_suffix_dedup
from overlap.llm.token_align import op11_token_align
from overlap.llm.token_groups import OP4_SQL, op4_token_groups
from overlap.llm.toxic_mil import op7_toxic_mil
from overlap.llm.warc_chain import op1_warc_chain
from overlap.llm.whitening import op13_whitening


def queries() -> dict:
    return {"op1_warc_chain": op1_warc_chain,
            "op2_suffix_dedup": op2_suffix_dedup,
            "op3_piece_viterbi": op3_piece_viterbi,
            "op4_token_groups": op4_token_groups,
            "op5_content_sort_dedup": op5_content_sort_dedup,
            "op6_kd_shards": op6_kd_shards,
            "op7_toxic_mil": op7_toxic_mil,
            "op8_lang_ftrl": op8_lang_ftrl,
            "op9_block_matrix_ann": op9_block_matrix_ann,
            "op10_entropy_mix": op10_entropy_mix,
            "op11_token_align": op11_token_align,
            "op12_secret_crf": op12_secret_crf,
            "op13_whitening": op13_whitening}


def oracle_sql() -> dict[str, str]:
    return {"op4_token_groups": OP4_SQL, "op5_content_sort_dedup": OP5_SQL, "op9_block_matrix_ann": OP9_SQL}
