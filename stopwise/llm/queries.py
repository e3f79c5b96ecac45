"""The queries of this package by name, and their SQL where SQL can express them."""

from __future__ import annotations

from stopwise.llm import (contamination, jaccard, lines, neighbours, packing, pages, periodic, quality, repair, sharding, substrings, tokencounts,
                          toxicity)

QUERIES = {f.__name__: f for f in (
    pages.op1_nearest_url_differencing,
    packing.op2_best_fit_packing,
    lines.op3_fuzzy_lines,
    neighbours.op4_adaptive_dimension_scan,
    substrings.op7_deep_shallow_dedup,
    sharding.op8_rendezvous_sharding,
    contamination.op5_containment_search,
    toxicity.op6_noisy_channel_toxicity,
    quality.op9_neighbour_voting,
    jaccard.op10_bayesian_jaccard_join,
    repair.op11_survivor_coalescence,
    periodic.op12_lyndon_lce_runs,
    tokencounts.op13_pretoken_counts,
)}

ORACLES: dict[str, str] = {}
