"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from .alignment import op13_alignment
from .bpe import op5_bpe
from .chat import OP6_SQL, op6_chat
from .embeddings import OP9_SQL, PLANTED_SQL, op9_embeddings, planted_embeddings
from .fingerprints import op1_fingerprints
from .language import op10_language
from .licenses import op4_licenses
from .mixing import OP2_SQL, op2_mixing
from .packing import op12_packing
from .quality import op3_quality
from .simhash import op7_simhash
from .structure import OP11_SQL, op11_structure
from .token_counts import op8_token_counts


def queries():
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_mixing": op2_mixing,
        "op3_quality": op3_quality,
        "op4_licenses": op4_licenses,
        "op5_bpe": op5_bpe,
        "op6_chat": op6_chat,
        "op7_simhash": op7_simhash,
        "op8_token_counts": op8_token_counts,
        "op9_embeddings": op9_embeddings,
        "planted_embeddings": planted_embeddings,
        "op10_language": op10_language,
        "op11_structure": op11_structure,
        "op12_packing": op12_packing,
        "op13_alignment": op13_alignment,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    own = {"op2_mixing": OP2_SQL, "op6_chat": OP6_SQL, "op9_embeddings": OP9_SQL, "planted_embeddings": PLANTED_SQL, "op11_structure": OP11_SQL}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
