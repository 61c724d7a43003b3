"""The registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from .ann import op2_ivf_pq_search
from .decontamination import op5_benchmark_decontamination
from .language_id import op3_language_id
from .line_dedup import op9_line_dedup
from .merkle import op13_merkle_manifest
from .mixing import OP4_SQL, op4_source_mixing
from .near_dedup import op7_simhash_near_dedup
from .oracles import OP11_SQL, OP12_SQL, OP13_SQL
from .periodic_runs import op11_periodic_runs
from .quality import op10_quality_classifier
from .sharding import op8_kd_sharding
from .suffix_dedup import op12_suffix_dedup
from .token_counts import op6_token_counts
from .warc import OP1_SQL, op1_warc_index

QUERIES = {
    "op1_warc_index": op1_warc_index,
    "op2_ivf_pq_search": op2_ivf_pq_search,
    "op3_language_id": op3_language_id,
    "op4_source_mixing": op4_source_mixing,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_kd_sharding": op8_kd_sharding,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_index": OP1_SQL,
    "op4_source_mixing": OP4_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op12_suffix_dedup": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
