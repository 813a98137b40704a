"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from .html_text import op7_html_density
from .line_rules import OP5_SQL, op5_line_frequency
from .lm_score import op1_nce_scoring
from .mixing import op3_entropy_mix
from .multi_index import op6_multi_index
from .ngram_join import OP10_SQL, op10_ngram_jaccard
from .packing import op4_config_packing
from .quality_gam import op8_quality_gam
from .sort_means import OP12_SQL, op12_sort_means
from .spelling import OP13_SQL, op13_spelling_variants
from .subspace_join import OP11_SQL, op11_subspace_join
from .substring_dedup import OP9_SQL, op9_substring_dedup
from .url_filter import OP2_SQL, op2_url_filter

QUERIES = {f.__name__: f for f in (op1_nce_scoring, op2_url_filter, op3_entropy_mix, op4_config_packing, op5_line_frequency, op6_multi_index, op7_html_density, op8_quality_gam, op9_substring_dedup, op10_ngram_jaccard, op11_subspace_join, op12_sort_means, op13_spelling_variants)}

ORACLES = {"op2_url_filter": OP2_SQL, "op5_line_frequency": OP5_SQL, "op9_substring_dedup": OP9_SQL, "op10_ngram_jaccard": OP10_SQL, "op11_subspace_join": OP11_SQL, "op12_sort_means": OP12_SQL, "op13_spelling_variants": OP13_SQL}
