"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from engram.llm.ann import op4_ann_graph
from engram.llm.bpe import op9_bpe_roundtrip
from engram.llm.clusters import OP13_SQL, op13_centroids
from engram.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from engram.llm.fixity import OP2_SQL, op2_merkle_fixity
from engram.llm.jaccard_join import op5_jaccard_join
from engram.llm.lang_id import op1_language_id
from engram.llm.mixing import OP7_SQL, op7_mix_sources
from engram.llm.periodic import OP12_SQL, op12_periodic_runs
from engram.llm.pii import op8_pii_anchors
from engram.llm.simhash import op11_simhash
from engram.llm.substring_dedup import op3_substring_dedup
from engram.llm.token_files import op10_token_files

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_merkle_fixity": op2_merkle_fixity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_ann_graph": op4_ann_graph,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_mix_sources": op7_mix_sources,
    "op8_pii_anchors": op8_pii_anchors,
    "op9_bpe_roundtrip": op9_bpe_roundtrip,
    "op10_token_files": op10_token_files,
    "op11_simhash": op11_simhash,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_centroids": op13_centroids,
}
ORACLE_SQL = {"op2_merkle_fixity": OP2_SQL, "op6_exact_dedup": OP6_SQL, "op7_mix_sources": OP7_SQL, "op12_periodic_runs": OP12_SQL, "op13_centroids": OP13_SQL}
