"""Knobs of the edge store."""

from __future__ import annotations

from dataclasses import dataclass

EDGE_BYTES = 32


@dataclass(frozen=True)
class StoreConfig:
    """Sizes are bytes of edge records; what Parquet makes of them is smaller."""

    memgraph_capacity_bytes: int = 64 << 20
    l0_file_threshold: int = 4
    segment_target_bytes: int = 64 << 20
    min_l0_partition_bytes: int = 4 << 20
    max_l0_segments_per_flush: int = 128
    auto_compaction: bool = False
    graph_aware_l0: bool = False
    l0_ra_range_bucket_size: int = 1 << 20
    l0_ra_min_queries: int = 10
    l0_ra_min_l0_segments: int = 2
    l0_ra_min_score: float = 10.0
