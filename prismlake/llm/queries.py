"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from prismlake.llm import warc
from prismlake.llm.ann import op8_beam_nearest
from prismlake.llm.embed_dedup import op2_near_vectors
from prismlake.llm.langid import op5_language_centroids
from prismlake.llm.mixing import op9_mix_sources
from prismlake.llm.packing import op10_best_fit_packs
from prismlake.llm.pii import op6_personal_spans
from prismlake.llm.repair_ids import op7_repair_ids
from prismlake.llm.sharding import op1_hilbert_shards
from prismlake.llm.simhash import op3_simhash_groups

QUERIES = {
    f.__name__: f
    for f in (op1_hilbert_shards, op2_near_vectors, op3_simhash_groups, warc.op4_warc_round_trip, op5_language_centroids, op6_personal_spans, op7_repair_ids, op8_beam_nearest, op9_mix_sources, op10_best_fit_packs)
}
ORACLES = {"op4_warc_round_trip": warc.ORACLE}
