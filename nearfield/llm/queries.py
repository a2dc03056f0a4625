"""The queries of this subpackage, and DuckDB SQL where SQL can express them on whole tables."""

from __future__ import annotations

from nearfield.llm.licenses import op9_fuzzy_notices
from nearfield.llm.media import op2_gif_media
from nearfield.llm.mixing import OP7_SQL, op7_systematic_mix
from nearfield.llm.near_dup import op6_circulant_minhash
from nearfield.llm.order_minhash import op4_order_minhash
from nearfield.llm.pieces import op3_prefix_table_pieces
from nearfield.llm.sharding import op8_byte_balanced_shards
from nearfield.llm.token_output import op1_huffman_token_ids
from nearfield.llm.toxicity import op5_nnpu_toxicity
from nearfield.llm.warc import OP10_SQL, op10_warc_pages

QUERIES = {
    f.__name__: f
    for f in (
        op1_huffman_token_ids,
        op2_gif_media,
        op3_prefix_table_pieces,
        op4_order_minhash,
        op5_nnpu_toxicity,
        op6_circulant_minhash,
        op7_systematic_mix,
        op8_byte_balanced_shards,
        op9_fuzzy_notices,
        op10_warc_pages,
    )
}

SQL = {"op7_systematic_mix": OP7_SQL, "op10_warc_pages": OP10_SQL}
