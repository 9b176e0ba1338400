"""Genomic-shaped views over the star-schema tables, as one SQL text for Spark and DuckDB.

``{S}`` is the engine's string type.  All arithmetic is exact in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[list[str], str]] = {
    "aln": (
        ["lineitem"],
        """select distinct cast(l_suppkey % 4 as int) as library_id, l_orderkey as read_id, cast(l_linenumber % 2 as int) as read_end, cast(l_linenumber as int) as align_id,
        cast(l_partkey % 23 + 1 as {S}) as chromosome, case when l_returnflag = 'R' then '-' else '+' end as strand, cast(l_partkey * 100 + floor(l_quantity) as bigint) as position,
        cast(50 + floor(l_quantity) as int) as aligned_length, cast(floor(l_discount * 1000) as int) as mate_score from lineitem""",
    ),
    "regions": (["part"], "select p_partkey as region_id, cast(p_partkey % 23 + 1 as {S}) as chromosome, cast(p_partkey * 100 as bigint) as start, cast(p_partkey * 100 + p_size as bigint) as {END} from part"),
    "lik": (
        ["lineitem"],
        """select distinct l_orderkey % 997 as cluster_id, cast(l_linenumber % 3 as int) as breakpoint_id, cast(l_suppkey % 4 as int) as library_id, l_orderkey as read_id,
        -floor(l_extendedprice) / 10000 as log_likelihood, cast(floor(l_quantity) * 10 as int) as tl1, cast(floor(l_discount * 1000) + 40 as int) as tl2 from lineitem""",
    ),
    "bp": (
        ["lineitem"],
        """select distinct l_orderkey % 997 as cluster_id, cast(l_orderkey % 997 % 3 + 1 as {S}) as chromosome_1, case when l_orderkey % 997 % 2 = 0 then '+' else '-' end as strand_1,
        cast(l_orderkey % 997 * 1000 as bigint) as position_1, cast(l_orderkey % 997 * 7 % 3 + 1 as {S}) as chromosome_2, case when l_orderkey % 997 % 5 < 2 then '+' else '-' end as strand_2,
        cast(l_orderkey % 997 * 7919 % 1000003 as bigint) as position_2 from lineitem""",
    ),
    "brk": (
        ["lineitem"],
        """select a.prediction_id, a.library_id, a.chromosome as chromosome_1, a.strand as strand_1, a.position as position_1, b.chromosome as chromosome_2, b.strand as strand_2, b.position as position_2, a.mate_score from
        (select *, library_id * 100000000 + read_id as prediction_id, row_number() over (partition by library_id, read_id order by align_id, position, strand, aligned_length, mate_score, chromosome) as rn from ({aln}) t) a
        join (select *, row_number() over (partition by library_id, read_id order by align_id, position, strand, aligned_length, mate_score, chromosome) as rn from ({aln}) t) b
        on a.library_id = b.library_id and a.read_id = b.read_id and a.rn = 1 and b.rn = 2""",
    ),
    "brklib": (
        ["lineitem"],
        """select read_id as prediction_id, concat('lib', cast(library_id as {S})) as library, count(*) as num_reads, count(distinct concat(cast(position as {S}), strand)) as num_unique_reads
        from ({aln}) t group by read_id, library_id""",
    ),
    "seqs": (
        ["documents"],
        """select doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') as seq from documents where text is not null""",
    ),
}

def _text(name: str, strings: str, end: str) -> str:
    out = VIEWS[name][1]
    for inner in VIEWS:
        if f"{{{inner}}}" in out:
            out = out.replace(f"{{{inner}}}", _text(inner, strings, end))
    return out.replace("{S}", strings).replace("{END}", end)


def duck(*names: str) -> str:
    """A WITH list for DuckDB."""
    return "with " + ", ".join(f'{n} as ({_text(n, "varchar", chr(34) + "end" + chr(34))})' for n in names) + " "


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same view as a DataFrame."""
    text = _text(name, "string", "`end`").replace(", 'g')", ")")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in VIEWS[name][0]}
    for t in tables:
        text = text.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(text, **tables)
