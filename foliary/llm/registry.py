"""Queries of this folder by name, and the SQL of those that SQL can express."""

from foliary.llm.divergence import OP13_SQL, op13_source_divergence_audit
from foliary.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from foliary.llm.lm_score import op3_lm_scoring
from foliary.llm.ngram_jaccard import op9_ngram_jaccard_join
from foliary.llm.packing import op2_best_fit_packing
from foliary.llm.personal_data import op11_pii
from foliary.llm.pieces import op1_sentencepiece
from foliary.llm.quality import op10_quality_classifier
from foliary.llm.sharding import op5_sharding
from foliary.llm.suffix_dedup import op4_suffix_array_dedup
from foliary.llm.token_files import op7_token_files
from foliary.llm.topk import OP6_SQL, op6_exact_top_k
from foliary.llm.yinyang import OP12_SQL, op12_centroid_clustering

QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_best_fit_packing,
        op3_lm_scoring,
        op4_suffix_array_dedup,
        op5_sharding,
        op6_exact_top_k,
        op7_token_files,
        op8_exact_dedup,
        op9_ngram_jaccard_join,
        op10_quality_classifier,
        op11_pii,
        op12_centroid_clustering,
        op13_source_divergence_audit,
    )
}
ORACLES = {"op6_exact_top_k": OP6_SQL, "op8_exact_dedup": OP8_SQL, "op12_centroid_clustering": OP12_SQL, "op13_source_divergence_audit": OP13_SQL}
