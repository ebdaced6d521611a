"""The dealt operators as named queries over the tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseflow.llm.byte_bpe import op13_bpe_encoding_decoding
from caseflow.llm.decontamination import OP8_SQL, op8_benchmark_decontamination
from caseflow.llm.ngram_join import op4_ngram_jaccard_join
from caseflow.llm.packing import op2_best_fit_packing
from caseflow.llm.pii import op5_pii
from caseflow.llm.prefix_trie import OP11_SQL, op11_conversation_prefix_trie
from caseflow.llm.quality_classifier import op9_quality_classifier
from caseflow.llm.quality_rules import op7_quality_rules
from caseflow.llm.secrets import op1_secret_scans
from caseflow.llm.sharding import op6_sharding
from caseflow.llm.suffix_dedup import op3_suffix_array_dedup
from caseflow.llm.toxicity import op10_toxicity
from caseflow.llm.whitening import op12_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scans, op2_best_fit_packing, op3_suffix_array_dedup, op4_ngram_jaccard_join, op5_pii, op6_sharding,
        op7_quality_rules, op8_benchmark_decontamination, op9_quality_classifier, op10_toxicity,
        op11_conversation_prefix_trie, op12_embedding_whitening, op13_bpe_encoding_decoding,
    )
}

SQL: dict[str, str] = {"op8_benchmark_decontamination": OP8_SQL, "op11_conversation_prefix_trie": OP11_SQL}
