"""Queries and SQL of this subpackage."""

from .ann import OP1_SQL, op1_block_matrix_knn
from .bpe import op12_byte_bpe
from .ctw import op8_context_tree
from .decontaminate import op10_spaced_seeds
from .jaccard import op2_jaccard_partenum
from .language import op5_language_id
from .packing import op3_retrieval_packing
from .pii import op4_personal_data
from .search import OP13_SQL, op13_bag_search
from .substrings import op7_repeated_passages
from .templates import op9_line_templates
from .urls import op6_url_filter
from .whitening import op11_polarised_whitening

QUERIES = {f.__name__: f for f in (op1_block_matrix_knn, op4_personal_data, op6_url_filter, op7_repeated_passages, op2_jaccard_partenum, op3_retrieval_packing, op5_language_id, op9_line_templates, op10_spaced_seeds, op8_context_tree, op11_polarised_whitening, op12_byte_bpe, op13_bag_search)}
SQL = {"op1_block_matrix_knn": OP1_SQL, "op13_bag_search": OP13_SQL}
