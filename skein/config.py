"""Thresholds and budgets used by the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Every tunable of the engine; pass a modified copy with ``dataclasses.replace``.

    The first block holds fixed values: results depend on them.
    """

    # --- fixed values -----------------------------------------------------
    chars_per_token: int = 4
    chunk_max_chars: int = 2048
    chunk_overlap_chars: int = 256
    seed_count: int = 3
    max_hops: int = 2
    max_neighbors_per_hop: int = 10
    max_total_nodes: int = 50
    dedup_threshold: float = 0.92
    total_budget_tokens: int = 3600
    anchor_budget_tokens: int = 200
    subgraph_budget_tokens: int = 400
    wiki_page_budget_tokens: int = 1000
    seed_chunk_share: float = 0.6
    resolution_top_k: int = 5
    resolution_distance: float = 0.6
    synthesis_budget_tokens: int = 6000
    synthesis_metadata_tokens: int = 500
    synthesis_existing_page_tokens: int = 800
    synthesis_relations_tokens: int = 200
    planner_version: str = "1.0.0"
    planner_confidence_high: float = 0.8
    planner_confidence_low: float = 0.5
    planner_confidence_minimum: float = 0.5
    planner_large_file_bytes: int = 10_485_760
    upload_max_bytes: int = 104_857_600
    page_limit_default: int = 20
    page_limit_max: int = 100
    worker_poll_seconds: int = 2
    worker_max_retries: int = 3
    embedding_dimensions: int = 64

    # --- physical knobs: they change the plan, never the result -----------
    knn_block_rows: int = 20_000
    dedup_block_rows: int = 4_096
    frontier_list_rows: int = 64
    skew_salts: int = 32


DEFAULTS = Settings()
