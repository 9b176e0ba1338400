"""Schemas of the tables that pass between stages; chromosomes are always strings."""

from __future__ import annotations

SPANNING = "library_id int, read_id long, read_end int, align_id int, chromosome string, strand string, position long, aligned_length int, mate_length int, mate_score int"
SPLIT = "library_id int, read_id long, read_end int, align_id_1 int, chromosome_1 string, strand_1 string, position_1 long, align_id_2 int, chromosome_2 string, strand_2 string, position_2 long, homology int, inserted string, score int"
CLUSTERS = "cluster_id long, cluster_end int, library_id int, read_id long, read_end int, align_id int"
BREAKPOINTS = "cluster_id long, breakpoint_id int, chromosome_1 string, strand_1 string, position_1 long, chromosome_2 string, strand_2 string, position_2 long, homology int, count int, inserted string, mate_score double"
REALIGNMENTS = "cluster_id long, breakpoint_id int, cluster_end int, library_id int, read_id long, read_end int, align_id int, aligned_length int, template_length int, score int"
SCORE_STATS = "aligned_length int, expon_lda double"
TRUE_SCORES = "aligned_length int, score int"
LIBSTATS = "library_id int, fragment_mean double, fragment_stddev double"
STATS = "type string, key string, value long"
CLUSTER_WEIGHTS = "cluster_id long, weight double"
REGIONS = "chromosome string, start long, end long"
DGV = "id string, chr string, start long, end long"
ALIGNMENTS = "library_id int, read_id long, read_end int, align_id int, chromosome string, strand string, position long, aligned_length int"
