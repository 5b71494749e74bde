"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import collocations, conversations, extraction, lines, mixing, neardup, neighbours, online_packing, packing, quality, repeats, rollup, sharding


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_token_rollup": rollup.op2_token_rollup,
        "op3_suffix_repeats": repeats.op3_suffix_repeats,
        "op4_rendezvous_shards": sharding.op4_rendezvous_shards,
        "op5_multi_index_neighbours": neighbours.op5_multi_index_neighbours,
        "op6_pack_sequences": packing.op6_pack_sequences,
        "op7_site_spread_lines": lines.op7_site_spread_lines,
        "op8_minhash_neardup": neardup.op8_minhash_neardup,
        "op9_extract_pages": extraction.op9_extract_pages,
        "op10_host_quality": quality.op10_host_quality,
        "op11_sum_of_squares_packing": online_packing.op11_sum_of_squares_packing,
        "op12_pair_naming": collocations.op12_pair_naming,
        "op13_repair_conversations": conversations.op13_repair_conversations,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.OP1_SQL, "op4_rendezvous_shards": sharding.OP4_SQL, "op7_site_spread_lines": lines.OP7_SQL, "op10_host_quality": quality.OP10_SQL, "op12_pair_naming": collocations.OP12_SQL, "op13_repair_conversations": conversations.OP13_SQL}
