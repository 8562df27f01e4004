"""Parameters of the engine, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Offline: segmentation, sampling, vocabulary, edges, reachability. Online: planner and execution."""

    token_budget: float = 8192
    delta: float = 0.65
    vocab_size: int = 1024
    rho: int = 50
    frame_interval: float = 4.0
    max_frames_per_event: int = 4
    frame_size: int = 336
    tokens_per_frame: int | None = None  # None: what the model needs for a picture of frame_size
    planner: str = "celf"  # or random
    use_relevance: bool = True
    execution: str = "graph"  # or cot
    lambda_param: float = 1.0
    alpha: float = 0.15
    max_paths: int = 8
    max_path_enum: int = 1000
    edge_construction: str = "index"  # or pairwise
    uniform_word_weight: bool = False
    segmentation: str = "uniform"
    window: float = 5.0
    shot_threshold: float = 0.5
    content_threshold: float = 27.0
    num_chunks: int = 1
    chunk_idx: int = 0
    max_samples: int | None = None
    seed: int = 0
    kmeans_iterations: int = 20
    kmeans_sample: int | None = 100_000  # patches of a video; None: all
    ppr_tolerance: float = 1e-6
    ppr_rounds: int = 200
    attempts: int = 5
    retry_wait: float = 5.0
