"""The subpackage's queries. SQL can express the last three; the tests hold all against brute force."""

from quarryline.llm.anisotropic import op10_anisotropic_ann
from quarryline.llm.bpe import op8_bpe_round_trip
from quarryline.llm.content_store import op6_content_store
from quarryline.llm.katz import op1_katz_backoff
from quarryline.llm.language_id import op2_language_id
from quarryline.llm.manifest import op13_merkle_manifest
from quarryline.llm.mtree import op5_mtree_topk
from quarryline.llm.ngram_jaccard import op9_ngram_jaccard
from quarryline.llm.oracles import OP11, OP12, OP13
from quarryline.llm.packing import op4_best_fit_packing
from quarryline.llm.quality import op3_quality
from quarryline.llm.quality_rules import op12_quality_rules
from quarryline.llm.spelling import op11_spelling_variants
from quarryline.llm.token_counts import op7_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_katz_backoff, op2_language_id, op3_quality, op4_best_fit_packing, op5_mtree_topk,
        op6_content_store, op7_token_counts, op8_bpe_round_trip, op9_ngram_jaccard, op10_anisotropic_ann,
        op11_spelling_variants, op12_quality_rules, op13_merkle_manifest,
    )
}
ORACLE_SQL: dict[str, str] = {"op11_spelling_variants": OP11, "op12_quality_rules": OP12, "op13_merkle_manifest": OP13}
