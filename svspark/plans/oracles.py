"""DuckDB SQL of the registered queries, written independently of the DataFrame code."""

from __future__ import annotations

from svspark.plans.views import duck

_STARTS = "case when strand = '+' then position else position - aligned_length + 1 end"
_ENDS = "case when strand = '+' then position + aligned_length - 1 else position end"
_BRK = "e as (select * replace (position_1 % 20000 as position_1, position_2 % 20000 as position_2), mate_score < 20 as flagged from brk)"
_SIDES = "sides as (select prediction_id, flagged, mate_score, 0 as side, chromosome_1 as chromosome, strand_1 as strand, position_1 as position from e union all select prediction_id, flagged, mate_score, 1, chromosome_2, strand_2, position_2 from e)"
_SCORES = "scores as (select cast(floor(l_quantity) + 30 as int) as aligned_length, cast((floor(l_quantity) + 30) * 2 - floor(l_discount * 100) as int) as score from lineitem)"
_FIT = "fit as (select aligned_length, least(coalesce(1.0 / nullif(avg(aligned_length * 2 - score), 0), 1.0), 1.0) as lam from scores group by 1)"
_VOTE = "vote as (select read_id % 97 as cluster_id, position % 50 as pos, cast(aligned_length % 5 as int) as homology, cast(sum(mate_score) as bigint) as score, count(*) as count, max(chromosome) as chromosome, max(strand) as strand from aln group by 1, 2, 3)"
_TYPE = "case when {c1} <> {c2} then 'translocation' when strand_1 = strand_2 then 'inversion' when (case when position_1 < position_2 or (position_1 = position_2 and strand_1 <= strand_2) then strand_1 else strand_2 end) = '+' then 'deletion' else 'duplication' end"
_ENV = f"env as (select read_id % 997 as cluster_id, read_end as cluster_end, max(chromosome) as chromosome, max(strand) as strand, min({_STARTS}) as start, max({_ENDS}) as \"end\" from aln group by 1, 2)"
_NEAR = "near as (select prediction_id, min(least(position - l, r - position)) as distance from (select *, max(case when {f} then position end) over (partition by chromosome, strand order by position range between unbounded preceding and current row) as l, min(case when {f} then position end) over (partition by chromosome, strand order by position range between current row and unbounded following) as r from {t}) group by 1)"
_BEST = "best as (select * from (select *, row_number() over (partition by cluster_id, breakpoint_id, library_id, read_id order by log_likelihood desc, tl1 desc, tl2 desc) as rn from lik) where rn = 1)"
_CHOSEN = f"{_BEST}, sums as (select cluster_id, breakpoint_id, round(sum(log_likelihood), 6) as log_likelihood, max(tl1) as tl1, max(tl2) as tl2 from best group by 1, 2), chosen as (select cluster_id, breakpoint_id, log_likelihood, tl1, tl2 from (select *, row_number() over (partition by cluster_id order by log_likelihood desc, breakpoint_id desc) as rn from sums) where rn = 1 and least(tl1, tl2) >= 40)"


def _rc(s: str) -> str:
    return f"translate(reverse({s}), 'ACTGactg', 'TGACtgac')"


_SOM = (
    "raw as (select prediction_id % 100000000 as pid, library_id, chromosome_1, strand_1, position_1, chromosome_2, strand_2, position_2, " + _TYPE.format(c1="chromosome_1", c2="chromosome_2") + " as type, mate_score as m from e), "
    "b as (select pid as prediction_id, chromosome_1, strand_1, position_1, chromosome_2, strand_2, position_2, type, m, m + 1 as num_reads, m % 7 as num_split, -m / 4.0 as log_likelihood, m * 10 as template_length_min, case when m % 10 = 9 then 'dgv' end as dgv_ids from "
    "(select *, row_number() over (partition by pid order by library_id, chromosome_1, strand_1, position_1, chromosome_2, strand_2, position_2, type, m) as rn from raw) where rn = 1), "
    "germ as (select prediction_id, bool_or(library = 'lib0') as g, count(distinct case when library in ('lib0', 'lib1') then 'p1' else 'p2' end) as np from brklib where num_reads > 0 group by 1), "
    "f as (select b.*, coalesce(np, 0) as np, coalesce(g, false) as germ, (coalesce(g, false) or dgv_ids is not null or coalesce(np, 0) > 1) as filt from b left join germ using (prediction_id)), "
    "fs as (select prediction_id, germ, filt, chromosome_1 as chromosome, strand_1 as strand, position_1 as position from f union all select prediction_id, germ, filt, chromosome_2, strand_2, position_2 from f)"
)
_PASS = "num_reads >= 2 and num_split >= 2 and log_likelihood > -20 and template_length_min > 120 and distance > 50"


def _homology() -> str:
    """Both runs of equal bases by unnesting offsets."""

    def run(a: str, sa: str, pa: str, b: str, sb: str, pb: str, name: str) -> str:
        x = f"substring({a}, cast({pa} + k * {sa} as int), 1)"
        y = f"substring({b}, cast({pb} + (1 - k) * {sb} as int), 1)"
        return (
            f"{name} as (select doc_id, cast(coalesce(min(case when not (xx = yy and xx <> '') then k end), 11) - 1 as int) as h from (select doc_id, k, case when {sa} = 1 then {x} else {_rc(x)} end as xx, "
            f"case when {sb} = -1 then {y} else {_rc(y)} end as yy from s, range(1, 11) t(k)) group by 1)"
        )

    return (
        "s as (select doc_id, seq as q1, " + _rc("seq") + " as q2, case when doc_id % 2 = 0 then 1 else -1 end as d1, case when doc_id % 3 = 0 then 1 else -1 end as d2, 60 as p1, cast(doc_id % 50 + 40 as int) as p2 from seqs), "
        + run("q1", "d1", "p1", "q2", "d2", "p2", "ha") + ", " + run("q2", "d2", "p2", "q1", "d1", "p1", "hb")
        + " select doc_id, ha.h + hb.h as homology, case when least(p1 + d1 * ha.h, p2 - d2 * ha.h) < least(p1 - d1 * hb.h, p2 + d2 * hb.h) then p1 + d1 * ha.h else p1 - d1 * hb.h end as position_1, "
        "case when least(p1 + d1 * ha.h, p2 - d2 * ha.h) < least(p1 - d1 * hb.h, p2 + d2 * hb.h) then p2 - d2 * ha.h else p2 + d2 * hb.h end as position_2 from s join ha using (doc_id) join hb using (doc_id)"
    )


ORACLE_SQL: dict[str, str] = {
    "tabulate_breakpoints": duck("lik", "bp") + ", " + _CHOSEN + ", t as (select cluster_id, round(avg(log_likelihood), 6) as log_likelihood, max(tl1) as template_length_1, max(tl2) as template_length_2, count(*) as num_reads, count(distinct (library_id, tl1, tl2)) as num_unique_reads from lik l where log_likelihood >= -5 and exists (select 1 from chosen c where c.cluster_id = l.cluster_id and c.breakpoint_id = l.breakpoint_id) group by 1) select t.*, least(template_length_1, template_length_2) as template_length_min, " + _TYPE.format(c1="chromosome_1", c2="chromosome_2") + " as type from t join bp using (cluster_id)",
    "library_counts": duck("lik") + "select cluster_id as prediction_id, library_id, count(*) as num_reads, count(distinct (tl1, tl2)) as num_unique_reads from lik group by 1, 2",
    "select_predictions": duck("lik") + ", " + _CHOSEN + " select * from chosen",
    "best_row_per_key": duck("lik") + ", " + _BEST + " select cluster_id, breakpoint_id, library_id, read_id, log_likelihood, tl1, tl2 from best",
    "mate_pairing": duck("aln") + "select a.library_id, count(*) as n_pairs, cast(sum(a.position) as bigint) as sum_1, cast(sum(b.position) as bigint) as sum_2, cast(sum(case when a.chromosome = b.chromosome then 1 else 0 end) as bigint) as same from aln a join aln b on a.library_id = b.library_id and a.read_id = b.read_id and a.read_end = 0 and b.read_end = 1 group by 1",
    "both_ends_mapped": duck("aln") + "select library_id, read_id from aln group by 1, 2 having count(distinct read_end) = 2",
    "discordant_filter": duck("aln").replace("aln as (", "aln as materialized (", 1) + ", plus as materialized (select library_id, read_id, read_end, chromosome, position as p from aln where strand = '+'), minus as materialized (select library_id, read_id, 1 - read_end as read_end, chromosome, position as m from aln where strand = '-'), bad as materialized (select distinct library_id, read_id from plus join minus using (library_id, read_id, read_end, chromosome) where m - p + 1 between 0 and 199999) select library_id, read_id, read_end, align_id, chromosome, strand, position from aln anti join bad using (library_id, read_id)",
    "semi_select": duck("aln") + "select read_id % 997 as cluster_id, count(*) as n from aln where read_id % 997 in (select read_id % 997 from aln where mate_score > 50) group by 1",
    "or_semi_select": duck("aln") + ", k as (select distinct library_id, position, aligned_length from aln where mate_score = 0) select library_id, count(*) as n, cast(sum(position) as bigint) as positions from (select distinct * from aln a where exists (select 1 from k where k.library_id = a.library_id and k.position = a.position) or exists (select 1 from k where k.library_id = a.library_id and k.aligned_length = a.aligned_length)) group by 1",
    "natural_join_select": duck("aln") + "select cluster_id, library_id, count(*) as n, max(position) as last from aln natural join (select distinct read_id % 997 as cluster_id, library_id, read_id from aln) group by 1, 2",
    "span_envelope": duck("aln") + ", " + _ENV + " select * from env",
    "pivot_cluster_ends": duck("aln") + ", " + _ENV + ", p as (select *, case when strand = '+' then \"end\" else start end as position from env) select cluster_id, " + ", ".join(f"max(case when cluster_end = {i} then {c} end) as {c}_{i + 1}" for i in (0, 1) for c in ("chromosome", "strand", "position")) + " from p group by 1",
    "mate_score_mean": duck("aln") + "select cluster_id, avg(m) as mate_score from (select read_id % 997 as cluster_id, max(mate_score) as m from aln group by 1, library_id, read_id) group by 1",
    "split_vote": duck("aln") + ", " + _VOTE + " select * from vote",
    "topn_per_cluster": duck("aln") + ", " + _VOTE + " select cluster_id, pos, homology, score, rank from (select *, row_number() over (partition by cluster_id order by score desc, pos desc, homology desc) as rank from vote) where rank <= 10",
    "mode_consensus": duck("seqs") + ", l as (select doc_id % 37 as k, p, substring(seq, cast(p as int), 1) as letter from seqs, unnest(range(1, length(seq) + 1)) t(p)), c as (select k, p, letter, row_number() over (partition by k, p order by count(*) desc, letter) as rn from l group by 1, 2, 3) select k, string_agg(letter, '' order by p) as consensus from c where rn = 1 group by 1",
    "fragment_stats": "with h as (select l_suppkey % 4 as library_id, floor(l_quantity) as length from lineitem), s as (select library_id, avg(length) as m, stddev_samp(length) as sd from h group by 1) select library_id, round(m, 6) as fragment_mean, round(sd, 6) as fragment_stddev, cast(trunc(m - 6 * sd) as int) as fragment_min, cast(trunc(m + 6 * sd) as int) as fragment_max from s",
    "score_histogram": "with " + _SCORES + " select aligned_length, score, count(*) as freq from scores group by 1, 2",
    "expon_fit": "with " + _SCORES + ", " + _FIT + " select aligned_length, round(lam, 9) as expon_lda from fit",
    "score_cdf_threshold": "with " + _SCORES + ", " + _FIT + ", d as (select aligned_length, 2 * aligned_length - k as score, exp(-lam * k) as x from fit, range(0, 401) t(k) where k <= 4 * aligned_length), r as (select *, sum(x) over (partition by aligned_length order by score desc) / sum(x) over (partition by aligned_length) as share from d) select aligned_length, cast(max(score) + 1 as int) as threshold from r where share > 0.99 group by 1",
    "score_likelihood": "with " + _SCORES + ", " + _FIT + " select aligned_length, score, round(ln(lam) - lam * (2 * aligned_length - score), 6) as log_likelihood, round(-lam * (2 * aligned_length - score), 6) as log_cdf from (select distinct * from scores) join fit using (aligned_length)",
    "posterior": duck("aln") + ", m as (select library_id, read_id, read_end, align_id, max(mate_score) as m from aln group by 1, 2, 3, 4), l as (select *, exp(-m / 20.0) as l, case when read_end = 0 and m % 2 = 0 then exp(-m / 10.0) else 0.0 end as c from m), s as (select *, sum(case when read_end = 0 then l else 0 end) over w as s0, sum(case when read_end = 1 then l else 0 end) over w as s1, sum(case when read_end = 0 then c else 0 end) over w as sc from l window w as (partition by library_id, read_id)) select library_id, read_id, read_end, align_id, round((0.01 * l * case when read_end = 0 then s1 else s0 end + 0.98 * c) / nullif(0.01 * s0 * s1 + 0.98 * sc, 0), 6) as posterior, round(0.99 * sc / nullif(0.01 * s0 * s1 + 0.98 * sc, 0), 6) as posterior_concordant from s",
    "cluster_weights": duck("bp") + "select cluster_id, round(1 + 1e-4 * ln(case when chromosome_1 = chromosome_2 then abs(position_1 - position_2) + 1.0 else 1e9 end), 9) as weight from bp",
    "region_excluded_reads": duck("aln", "regions") + "select library_id, read_id from aln a join regions r on a.chromosome = r.chromosome and a.position between r.start and r.\"end\" group by 1, 2 having count(distinct read_end) >= 2",
    "region_contained": duck("aln", "regions") + "select a.chromosome, count(*) as n, cast(sum(position) as bigint) as starts from aln a join regions r on a.chromosome = r.chromosome and a.position >= r.start and a.position + 3 <= r.\"end\" group by 1",
    "tolerance_interval_join": duck("aln", "regions") + ", i as (select distinct chromosome, position as s, position + aligned_length - 40 as e from aln), h as (select distinct i.s * 1000 + i.e - i.s as prediction_id, r.region_id from i join regions r on i.chromosome = r.chromosome and abs(i.s - r.start) < 500 and abs(i.e - r.\"end\") < 500 and i.s <= r.\"end\" and i.e >= r.start) select prediction_id, string_agg(cast(region_id as varchar), ', ' order by region_id) as dgv_ids from h group by 1",
    "truth_match": duck("brk") + ", " + _BRK + ", " + _SIDES + ", t as (select prediction_id as tid, side as ts, chromosome, strand, position + case when side = 0 then 30 else -20 end as tp from sides where prediction_id % 7 = 0), p as (select s.prediction_id, s.side, t.tid, t.ts, abs(s.position - t.tp) as d from sides s join t on s.chromosome = t.chromosome and s.strand = t.strand and abs(s.position - t.tp) <= 200), h as (select a.prediction_id, a.tid as true_id, min(a.d + b.d) as distance from p a join p b on a.prediction_id = b.prediction_id and a.tid = b.tid and a.side = 0 and b.side = 1 and a.ts <> b.ts group by 1, 2) select prediction_id, true_id, distance from (select *, row_number() over (partition by prediction_id order by distance, true_id) as rn from h) where rn = 1",
    "nearest_feature": duck("brk", "regions") + ", d as (select prediction_id as point_id, region_id as feature_id, greatest(0, r.start - position_1, position_1 - r.\"end\") as distance from brk b join regions r on b.chromosome_1 = r.chromosome) select point_id, feature_id, distance from (select *, row_number() over (partition by point_id order by distance, feature_id) as rn from d) where rn = 1",
    "nearest_filtered_breakend": duck("brk") + ", " + _BRK + ", " + _SIDES + ", " + _NEAR.format(f="flagged", t="sides") + " select * from near",
    "breakpoint_types": duck("brk") + ", " + _BRK + " select prediction_id, " + _TYPE.format(c1="'1'", c2="(case when mate_score % 3 = 0 then '2' else '1' end)") + " as type from e",
    "rearrangement_types": duck("brk") + ", " + _BRK + ", k as (select *, " + _TYPE.format(c1="'1'", c2="'1'") + " as type, abs(position_1 - position_2) as size from e) select prediction_id, case when flagged then 'balanced' when type = 'deletion' and size * 100 <= 1000000 then 'deletion' when type = 'inversion' and size * 100 <= 10000 then 'foldback' when type = 'inversion' and size * 100 <= 1000000 then 'inversion' when type = 'duplication' and size * 100 <= 1000000 then 'duplication' else 'unbalanced' end as rearrangement_type, size from k",
    "somatic_filter": duck("brk", "brklib") + ", " + _BRK + ", " + _SOM + ", " + _NEAR.format(f="filt", t="fs") + " select prediction_id, type, abs(position_1 - position_2) as size, case when type = 'deletion' and abs(position_1 - position_2) <= 1000000 then 'deletion' when type = 'inversion' and abs(position_1 - position_2) <= 10000 then 'foldback' when type = 'inversion' and abs(position_1 - position_2) <= 1000000 then 'inversion' when type = 'duplication' and abs(position_1 - position_2) <= 1000000 then 'duplication' else 'unbalanced' end as rearrangement_type, distance as dist_filtered, cast(np as bigint) as num_patients from f join near using (prediction_id) where not filt and " + _PASS,
    "changepoints": duck("brk", "brklib") + ", " + _BRK + ", " + _SOM + ", " + _NEAR.format(f="germ", t="fs") + ", k as (select * from f join near using (prediction_id) where not germ and " + _PASS + ") select chromosome_1 as chromosome, position_1 as position from k where chromosome_1 in (" + ", ".join(f"'{i}'" for i in [*range(1, 23), "X", "Y"]) + ") union select chromosome_2, position_2 from k where chromosome_2 in (" + ", ".join(f"'{i}'" for i in [*range(1, 23), "X", "Y"]) + ")",
    "library_pivot": duck("brklib") + "select prediction_id, " + ", ".join(f"cast(sum(case when library = 'lib{i}' then num_reads else 0 end) as bigint) as lib{i}_count" for i in range(4)) + " from brklib group by 1",
    "control_filter": duck("brklib") + "select prediction_id, " + ", ".join(f"cast(sum(case when library = 'lib{i}' then num_reads else 0 end) as bigint) as lib{i}_count" for i in (1, 2, 3)) + " from brklib group by 1 having sum(case when library = 'lib0' then num_reads else 0 end) = 0",
    "chrom_pair_shards": duck("brk") + "select least(chromosome_1, chromosome_2) as chromosome_a, greatest(chromosome_1, chromosome_2) as chromosome_b, count(*) as n from brk group by 1, 2",
    "dense_renumber": duck("aln") + "select library_id, cluster_id, dense_rank() over (order by library_id, cluster_id) - 1 as new_id from (select distinct library_id, read_id % 997 as cluster_id from aln)",
    "revcomp": duck("seqs") + f"select doc_id, {_rc('seq')} as rc from seqs",
    "seed_trim": duck("seqs") + f"select doc_id, 0 as read_end, substring(seq, 1, 36) as seed from seqs union all select doc_id, 1, substring({_rc('seq')}, 1, 36) from seqs",
    "break_sequence": duck("seqs") + f"select doc_id, concat(case when doc_id % 2 = 0 then substring(seq, 1, 30) else {_rc('substring(seq, 1, 30)')} end, '[', case when doc_id % 5 = 0 then '' else substring(seq, 61, 3) end, ']', case when doc_id % 3 <> 0 then substring(seq, 31, 30) else {_rc('substring(seq, 31, 30)')} end) as sequence, length(case when doc_id % 5 = 0 then '' else substring(seq, 61, 3) end) as inslen from seqs",
    "microhomology": duck("seqs") + ", " + _homology(),
    "union_shards": duck("aln") + ", u as (select read_id, position from aln where read_id % 2 = 0 union all select read_id, position from aln where read_id % 3 = 0 or read_id % 2 <> 0) select (select count(*) from u) as n_all, (select count(*) from (select distinct * from u)) as n_distinct",
    "name_difference": duck("aln") + "select read_id from aln where strand = '+' except select read_id from aln where strand = '-'",
    "edge_symmetric_difference": duck("aln") + "select chromosome, position from (select distinct chromosome, position, strand from aln) group by 1, 2 having count(*) = 1",
    "read_stats": duck("aln") + "select 'read_count' as type, 'total' as key, count(distinct (library_id, read_id)) as value from aln union all select 'read_length', cast(aligned_length as varchar), count(*) from aln group by 2 union all select 'fragment_length', cast(mate_score + 300 as varchar), count(*) from aln group by 2",
    "reservoir_sample": "select o_orderkey from orders order by md5('2014:' || o_orderkey), o_orderkey limit 500",
    "name_partition": "select cast(case when substring(md5('2013:' || o_orderkey), 1, 1) < '8' then 1 else 2 end as bigint) as part, count(*) as n, cast(sum(o_orderkey) as bigint) as keys from orders group by 1",
    "exact_k_mix": "select name from (select distinct o_orderkey || 'A' as name from orders order by md5('2013:' || name), name limit 300) union all select name from (select distinct p_partkey || 'B' as name from part order by md5('2013:' || name), name limit 200)",
    "roc_points": "with r as (select floor(n_chars / 50) as score, quality = 1 as t from labels join documents using (doc_id)), c as (select cast(score as bigint) as score, sum(case when t then 1 else 0 end) as t, sum(case when t then 0 else 1 end) as f from r group by 1) select score, cast(sum(t) over (order by score desc) as bigint) as n_true, cast(sum(f) over (order by score desc) as bigint) as n_false from c",
    "accuracy_metrics": "with r as (select lang, n_chars > 800 as s, quality = 1 as t from labels join documents using (doc_id)) select lang, round(avg(cast(s as int)), 9) as share, round(sum(cast(s and t as int)) / nullif(sum(cast(t as int)), 0), 9) as sensitivity, round(sum(cast(not s and not t as int)) / nullif(sum(cast(not t as int)), 0), 9) as specificity from r group by 1",
    "coclustering_recall": duck("aln") + ", b as (select read_id, chromosome, count(*) as n from aln group by 1, 2) select (select cast(sum(n * (n - 1) / 2) as bigint) from b) as kept, (select cast(sum(n * (n - 1) / 2) as bigint) from (select sum(n) as n from b group by read_id)) as true_pairs",
    "group_max_broadcast": duck("aln") + "select distinct library_id, read_id, align_id, top from (select *, max(mate_score) over (partition by library_id, read_id) as top from aln) where mate_score = top",
    "segment_edges": duck("brk") + ", " + _BRK + ", " + _SIDES + ", d as (select distinct chromosome, position from sides) select chromosome, start, \"end\", \"end\" - start as length from (select chromosome, position as start, lead(position) over (partition by chromosome order by position) as \"end\" from d) where \"end\" is not null",
    "cluster_size_filter": duck("aln") + "select read_id % 997 as cluster_id, count(*) as n, count(distinct (library_id, read_id)) as n_reads from aln group by 1 having count(*) >= 2 and count(distinct (library_id, read_id)) >= 2",
    "reference_regions": "select cast(p_partkey % 23 + 1 as varchar) as chromosome, count(*) as n, cast(sum(p_partkey * 100 + 1) as bigint) as starts, cast(sum(p_partkey * 100 + p_size) as bigint) as ends from part where p_size % 2 = 0 and p_partkey % 23 + 1 <= 20 group by 1",
    "tabulate_reads": duck("aln") + ", r as (select library_id, read_id, read_end, max(aligned_length) as length from aln group by 1, 2, 3), p as (select distinct library_id, read_id from aln where mate_score < 30) select r.read_id % 997 as cluster_id, r.library_id, r.read_id, r.read_end, r.length, p.read_id is null as filtered from r left join p using (library_id, read_id)",
    "event_windows": "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2",
    "event_mates": "select a.user_id as name, count(*) as n, round(sum(a.value), 4) as v1, round(sum(b.value), 4) as v2 from events a join events b on a.user_id = b.user_id and a.event_type = 'view' and b.event_type = 'click' and b.ts between a.ts - interval 10 minutes and a.ts + interval 10 minutes group by 1",
    "connected_components": duck("aln").replace("with ", "with recursive ", 1) + ", g as (select distinct read_id * 2 as a, position % 200003 * 2 + 1 as b from aln), h as materialized (select a as v, b as w from g union select b, a from g), reach(v, l) using key (v) as (select v, least(v, min(w)) from h group by v union select h.v, min(r.l) from reach r join h on r.v = h.w join recurring.reach o on o.v = h.v where r.l < o.l group by h.v) select v as vertex, l as component from reach",
    "linkage_clusters": duck("brk").replace("with ", "with recursive ", 1) + ", " + _BRK + ", h as (select a.prediction_id as v, b.prediction_id as w from e a join e b on a.chromosome_1 = b.chromosome_1 and abs(a.position_1 - b.position_1) < 300 and abs(a.position_2 - b.position_2) < 300 and power(a.position_1 - b.position_1, 2) + power(a.position_2 - b.position_2, 2) < 90000), reach as (select prediction_id as v, prediction_id as w from e union select reach.v, h.w from reach join h on reach.w = h.v) select v as prediction_id, min(w) as component from reach group by 1",
    "predict_breaks": duck("aln") + f""", sp as (select library_id, read_id, read_end, align_id, max(chromosome) as chromosome, max(strand) as strand, max(position) as position, max(aligned_length) as aligned_length, max(mate_score) as mate_score from aln group by 1, 2, 3, 4),
sc as (select cluster_id, round(avg(m), 6) as mate_score from (select read_id % 997 as cluster_id, max(mate_score) as m from sp group by 1, library_id, read_id) group by 1),
ev as (select read_id % 997 as cluster_id, read_end, max(chromosome) as chromosome, max(strand) as strand, min({_STARTS}) as s, max({_ENDS}) as e from sp group by 1, 2),
ep as (select *, case when strand = '+' then e else s end as position from ev),
z as (select cluster_id, 0 as breakpoint_id, max(case when read_end = 0 then chromosome end) as chromosome_1, max(case when read_end = 0 then strand end) as strand_1, max(case when read_end = 0 then position end) as position_1, max(case when read_end = 1 then chromosome end) as chromosome_2, max(case when read_end = 1 then strand end) as strand_2, max(case when read_end = 1 then position end) as position_2, 0 as homology, 0 as count, '' as inserted from ep group by 1),
c as (select a.read_id % 997 as cluster_id, a.chromosome as chromosome_1, a.strand as strand_1, a.position % 100 as position_1, b.chromosome as chromosome_2, b.strand as strand_2, b.position % 90 as position_2, cast(a.position % 100 % 4 as int) as homology, case when b.position % 90 % 3 = 0 then '' else 'AC' end as inserted, b.mate_score as score from sp a join sp b on a.library_id = b.library_id and a.read_id = b.read_id and a.read_end = 0 and b.read_end = 1),
v as (select cluster_id, max(chromosome_1) as chromosome_1, max(strand_1) as strand_1, position_1, max(chromosome_2) as chromosome_2, max(strand_2) as strand_2, position_2, homology, count(*) as count, max(inserted) as inserted, sum(score) as score, length(inserted) as inslen from c group by cluster_id, position_1, position_2, homology, length(inserted)),
r as (select *, row_number() over (partition by cluster_id order by score desc, position_1 desc, position_2 desc, homology desc, inslen desc) as breakpoint_id from v)
select u.*, sc.mate_score from (select cluster_id, breakpoint_id, chromosome_1, strand_1, position_1, chromosome_2, strand_2, position_2, homology, cast(count as int) as count, inserted from z union all select cluster_id, cast(breakpoint_id as int), chromosome_1, strand_1, position_1, chromosome_2, strand_2, position_2, homology, cast(count as int), inserted from r where breakpoint_id <= 10) u join sc using (cluster_id)""",
}

_HASH = "cast('0x' || substring(md5(concat('2014:', library_id, ':', read_id)), 1, 8) as bigint) / 4294967296.0"
ORACLE_SQL |= {
    "mate_score_filter": duck("aln") + "select read_id % 997 as cluster_id, round(avg(mate_score), 6) as mate_score from aln group by 1 having avg(mate_score) <= 48",
    "chromosome_pair_filter": duck("brk") + "select 'include' as mode, chromosome_1, chromosome_2, count(*) as n from brk where (chromosome_1 = '1' and chromosome_2 = '2') or (chromosome_1 = '2' and chromosome_2 = '1') group by all union all select 'exclude', chromosome_1, chromosome_2, count(*) from brk where not (chromosome_1 in ('1', '2', '3') and chromosome_2 in ('1', '2', '3')) group by all",
    "fragment_subsample": duck("aln") + f", a as (select distinct library_id, read_id, case when chromosome = '1' then 0.1 else 0.5 end as share from aln) select library_id, read_id, cast(share as double) as share from a where {_HASH} < share",
    "length_filter": duck("aln") + ", e as (select library_id, read_id, read_end, max(aligned_length) as b from aln group by all), k as (select library_id, read_id from e group by all having count(*) = 2 and min(b) - 5 >= (select min(floor(l_quantity) + 30) from lineitem where floor(l_quantity) + 30 >= 80)) select library_id, read_id, count(*) as n from aln join k using (library_id, read_id) group by all",
    "discordant_fragments": f"select * from ({ORACLE_SQL['posterior']}) where posterior_concordant < 0.3",
    "likely_alignments": f"with p as (select * from ({ORACLE_SQL['posterior']}) where posterior >= 0.1) select * from p where (library_id, read_id) in (select (library_id, read_id) from p group by library_id, read_id having count(distinct read_end) = 2)",
    "score_filter": f"with t as ({ORACLE_SQL['score_cdf_threshold']}), s as (select cast(floor(l_quantity) + 30 as int) as aligned_length, cast((floor(l_quantity) + 30) * 2 - floor(l_discount * 100) as int) as score from lineitem) select aligned_length, score, count(*) as n from s join t using (aligned_length) where score >= threshold group by all",
    "window_guard": duck("aln") + "select library_id, read_end, cast(sum(case when position % 100 >= 16 and position % 100 <= aligned_length // 2 then mate_score else 0 end) as bigint) as score, cast(sum(mate_score) as bigint) as unguarded from aln group by all",
    "fragment_pairs": duck("aln") + "select a.library_id, a.read_id, count(*) as n from aln a join aln b on a.library_id = b.library_id and a.read_id = b.read_id and a.read_end = 0 and b.read_end = 1 where not (a.chromosome in ('1', '2', '3', '4') and b.chromosome in ('1', '2', '3', '4')) group by all",
    "break_reads": duck("aln", "bp") + ", s as (select library_id, read_id, read_end, align_id, max(position) as position from aln group by all having max(position) % 3 <> 0), r as (select library_id, read_id, read_end, max(aligned_length) as length from aln where mate_score < 70 group by all) select cluster_id, position_1, library_id, read_id, read_end, align_id, position, length from bp join (select distinct read_id % 997 as cluster_id, library_id, read_id, read_end, align_id from aln) c using (cluster_id) join s using (library_id, read_id, read_end, align_id) join r using (library_id, read_id, read_end)",
    "left_neighbours": duck("brk") + ", " + _BRK + ", " + _SIDES + ", n as (select prediction_id * 2 + side as id, chromosome, strand, position, case when strand = '+' then 0 else 1 end as o from sides) select id, case when strand = '+' then last_value(case when strand = '-' then id end ignore nulls) over w else last_value(case when strand = '+' then id end ignore nulls) over w end as \"left\" from n window w as (partition by chromosome order by position, o, id rows between unbounded preceding and 1 preceding)",
    "delaunay_space": duck("brk") + ", " + _BRK + " select prediction_id, position_1 + position_2 + 300 as s, position_1 - position_2 as t from e",
    "annotated_types": duck("brk") + ", " + _BRK + ", k as (select prediction_id, " + _TYPE.format(c1="chromosome_1", c2="chromosome_2") + " as type, abs(position_1 - position_2) as dist, prediction_id // 3 as g from e), z as (select g, count(*) as n, count(distinct type) as kinds, min(type) as one_kind from k group by 1 having count(*) >= 2), "
    "i as (select k.*, case when n = 2 and kinds = 1 and one_kind = 'inversion' then 'inversion' when n = 2 and kinds = 1 and one_kind = 'translocation' then 'reciprocal' when n is not null then 'complex' else '' end as f from k left join z using (g)) "
    "select prediction_id, dist, case when type = 'inversion' then case when dist < 1000 then 'foldback' else 'unbalanced' end else type end as as_coded, "
    "case when type = 'inversion' and f <> 'inversion' and dist < 1000 then 'foldback' when f = 'complex' then 'complex' when type in ('deletion', 'duplication') then type when f = 'reciprocal' then 'reciprocal' when type = 'translocation' then type when f = 'inversion' then 'inversion' else 'unbalanced' end as as_intended from i",
    "truth_table": duck("aln") + ", f as (select distinct chromosome, strand, position from aln where mate_score < 60), t as (select distinct chromosome, strand, position from aln where mate_score > 40) select chromosome, strand, position, case when f.c and t.c then 'both' when f.c then 'found_only' else 'truth_only' end as status from (select *, true as c from f) f full join (select *, true as c from t) t using (chromosome, strand, position)",
}
