"""Parameters of the pipeline; plain values, never executed configuration."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """The defaults of the analysis."""

    bam_max_fragment_length: int = 1000
    bam_max_soft_clipped: int = 8
    fragment_length_max: int = 800
    fragment_length_num_stddevs: float = 6.0
    alignment_threshold: float = 0.1
    chimeric_prior: float = 0.01
    chimeric_threshold: float = 0.1
    readvalid_threshold: float = 0.01
    num_read_samples: int = 100_000
    cluster_readcount_threshold: int = 2
    template_length_min_threshold: int = 40
    mate_score_threshold: float = 60.0
    match_score: int = 2
    mismatch_score: int = -3
    gap_score: int = -4
    min_alignment_log_likelihood: float = -5.0
    cycles_scoremax: float = 4.0
    cycles_visitmax: int = 100_000
    cycles_lambda: float = 2000.0
    seed_length: int = 36
    seed_score: int = 8
    min_anchor: int = 8
    break_end_adjust: int = 5
    insertion_penalty: int = -1
    region_filter_ends: int = 2
    max_predictions: int = 10
    cluster_epsilon: float = 1e-4
    inter_chromosomal_distance: float = 1e9
    dgv_tolerance: int = 500
    truth_tolerance: int = 200
    dec_nt_per_break: float = 2000.0
    inc_nt_per_break: float = 500.0
    cost_resolution: float = 1000.0
