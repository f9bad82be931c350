"""Tunable parameters of a memory store and of the Spark jobs around it."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Limits every store shares.
BUFFER_TOKEN_LIMIT = 1024
CHARS_PER_TOKEN = 4
LINT_EVERY = 3
CHUNK_CHARS = 1024
CHUNK_OVERLAP = 128
PACK_TOKEN_BUDGET = 1024
MAX_AGENT_ROUNDS = 6
NOTE_TYPES = ("event", "decision", "preference", "fact", "goal", "plan")


@dataclass(frozen=True)
class MemoryConfig:
    # retrieval and graph parameters
    damping: float = 0.5
    passage_node_weight: float = 0.05
    linking_top_k: int = 25
    synonymy_threshold: float = 0.8
    synonymy_top_k: int = 10
    max_passages: int = 200
    retrieval_top_k: int = 3
    retrieval_score_ratio: float = 0.2
    retrieval_max_results: int = 10
    ppr_max_iter: int = 100
    ppr_epsilon: float = 1e-6
    # physical parameters: the largest unit of work given to one task
    query_block: int = 512
    item_block: int = 8192
    knn_block: int = 2048
    kernel_max_edges: int = 16_000_000  # edges or passages of a store
    kernel_query_block: int = 32
    heavy_node_edges: int = 500_000  # edges in one row of a graph cut into blocks
    ppr_unroll: int = 4
    ppr_block_edges: int = 1_000_000  # a block of nodes is sized by the edges that end in it, and
    ppr_blocks: int = 8  # a store has no more blocks than these until they are ppr_growth times as large
    ppr_growth: int = 32
    ppr_cells: int = 4_000_000  # nodes of a block times queries of a batch
    fold_block: int = 100_000
    ordinal_group_rows: int = 2_000_000
    ordinal_wide_rows: int = 20_000  # the same for rows that carry whole texts

    def override(self, **changes) -> "MemoryConfig":
        return replace(self, **changes)


DEFAULT = MemoryConfig()
