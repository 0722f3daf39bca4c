"""Queries of this subpackage and their SQL."""

from .bpe import op8_bpe
from .embeddings import OP7_SQL, op7_embeddings
from .fill_middle import OP12_SQL, op12_fill_middle
from .media import op3_media
from .mixing import OP1_SQL, op1_mixing
from .ngram_lm import op11_language_model
from .quality import op6_page_quality, op6_quality
from .simhash import op2_simhash
from .suffix_dedup import op4_suffix_dedup
from .token_counts import OP10_SQL, op10_token_counts
from .token_files import op5_token_files
from .toxicity import op9_toxicity
from .vector_codes import OP13_SQL, op13_vector_codes

QUERIES = {
    "op1_mixing": op1_mixing, "op2_simhash": op2_simhash, "op3_media": op3_media, "op4_suffix_dedup": op4_suffix_dedup, "op5_token_files": op5_token_files, "op6_quality": op6_quality,
    "op6_page_quality": op6_page_quality, "op7_embeddings": op7_embeddings, "op8_bpe": op8_bpe, "op9_toxicity": op9_toxicity, "op10_token_counts": op10_token_counts,
    "op11_language_model": op11_language_model, "op12_fill_middle": op12_fill_middle, "op13_vector_codes": op13_vector_codes,
}
ORACLE = {"op1_mixing": OP1_SQL, "op7_embeddings": OP7_SQL, "op10_token_counts": OP10_SQL, "op12_fill_middle": OP12_SQL, "op13_vector_codes": OP13_SQL}
