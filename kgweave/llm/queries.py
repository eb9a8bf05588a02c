"""The registered queries of this subpackage, and the SQL of those that SQL expresses."""

from __future__ import annotations

from . import exact_dedup, line_dedup, mixing, ngram_join, packing, periodic, quality, rolling, tiff, token_counts, token_records, toxicity, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        packing.op1_best_fit_packing,
        mixing.op2_source_mixing,
        line_dedup.op3_line_dedup,
        ngram_join.op4_ngram_join,
        toxicity.op5_toxicity,
        tiff.op6_tiff_media,
        exact_dedup.op7_exact_dedup,
        token_records.op8_token_records,
        token_counts.op9_token_counts,
        quality.op10_quality_classifier,
        rolling.op11_rolling_features,
        url_filter.op12_url_filters,
        periodic.op13_periodic_runs,
    )
}

SQL = {
    "op2_source_mixing": mixing.OP2_SQL,
    "op4_ngram_join": ngram_join.OP4_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op11_rolling_features": rolling.OP11_SQL,
    "op12_url_filters": url_filter.OP12_SQL,
    "op13_periodic_runs": periodic.OP13_SQL,
}
