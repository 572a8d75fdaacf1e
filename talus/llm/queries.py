"""The training-data queries that ``__spark_entry__`` registers."""

from __future__ import annotations

from talus.llm.ann import op6_nearest_neighbours
from talus.llm.ctw import op3_ctw_score
from talus.llm.decontaminate import op4_decontaminate
from talus.llm.divergence import ORACLE as OP13
from talus.llm.divergence import op13_source_divergence
from talus.llm.htmltext import op9_html_text
from talus.llm.jaccard import op5_jaccard_join
from talus.llm.langid import op10_language_id
from talus.llm.merkle import ORACLE as OP11
from talus.llm.merkle import op11_merkle_manifest
from talus.llm.ordering import op1_training_order
from talus.llm.packing import op8_best_fit_packing
from talus.llm.quality import op7_quality_classifier
from talus.llm.substring import op2_substring_dedup
from talus.llm.warc import ORACLE as OP12
from talus.llm.warc import op12_warc_archive

QUERIES = {
    f.__name__: f
    for f in (
        op1_training_order,
        op2_substring_dedup,
        op3_ctw_score,
        op4_decontaminate,
        op5_jaccard_join,
        op6_nearest_neighbours,
        op7_quality_classifier,
        op8_best_fit_packing,
        op9_html_text,
        op10_language_id,
        op11_merkle_manifest,
        op12_warc_archive,
        op13_source_divergence,
    )
}
#: Query name -> DuckDB SQL, where SQL can express the query.
ORACLES: dict[str, str] = {"op11_merkle_manifest": OP11, "op12_warc_archive": OP12, "op13_source_divergence": OP13}
