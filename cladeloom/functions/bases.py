"""Column helpers for bases, genomes and edge mutations.

A genome column is a position-sorted ``array<struct<pos,base>>`` of the sites
that differ from the reference; everything here is a built-in expression, so it
stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_sequence(seq, strict: bool = False) -> Column:
    """Upper-case bases.  Unknown characters read as A, or as NULL when strict."""
    up = F.upper(_c(seq))
    if strict:
        return F.when(up.rlike("^[ACGT]*$"), up)
    return F.regexp_replace(up, "[^ACGT]", "A")


def base_code(base) -> Column:
    """A, C, G, T as 0..3; any other character counts as A."""
    b = F.upper(_c(base))
    return F.when(b == "C", 1).when(b == "G", 2).when(b == "T", 3).otherwise(0)


def base_char(code) -> Column:
    return F.substring(F.lit(BASES), _c(code).cast("int") + 1, F.lit(1))


def base_mask(base) -> Column:
    """One-hot form of a base: A=1, C=2, G=4, T=8."""
    b = F.upper(_c(base))
    return F.when(b == "C", 2).when(b == "G", 4).when(b == "T", 8).otherwise(1).cast("bigint")


def ref_base(ref, pos) -> Column:
    return F.substring(_c(ref), pos, F.lit(1))


def genome_from_sequence(seq, ref) -> Column:
    """Sites at which ``seq`` differs from ``ref``, over the shorter length."""
    n = F.least(F.length(_c(seq)), F.length(_c(ref)))
    pairs = F.zip_with(
        F.split(F.substring(_c(seq), F.lit(1), n), ""),
        F.split(F.substring(_c(ref), F.lit(1), n), ""),
        lambda s, r: F.when(s != r, s),
    )
    sites = F.transform(
        pairs, lambda b, i: F.struct((i + 1).cast("int").alias("pos"), b.alias("base"))
    )
    return F.filter(sites, lambda s: s["base"].isNotNull())


def genome_string(cg) -> Column:
    """Canonical text of a genome: ``<12A,40T,>``, ``<>`` when empty."""
    parts = F.transform(
        _c(cg), lambda s: F.concat(s["pos"].cast("string"), s["base"], F.lit(","))
    )
    return F.concat(F.lit("<"), F.array_join(parts, ""), F.lit(">"))


def genome_base(cg, ref, pos) -> Column:
    """Base at a site: the genome's own, else the reference's."""
    own = F.try_element_at(F.map_from_entries(_c(cg)), pos)
    return F.coalesce(own, ref_base(ref, pos))


def sequence_from_genome(cg, ref) -> Column:
    """Full sequence: the reference with the genome's sites put in."""
    m = F.map_from_entries(_c(cg))
    chars = F.transform(
        F.split(_c(ref), ""),
        lambda r, i: F.coalesce(F.try_element_at(m, (i + 1).cast("int")), r),
    )
    return F.array_join(chars, "")


def _by_pos(sites, value: str) -> Column:
    return F.map_from_entries(F.transform(sites, lambda s: F.struct(s["pos"], s[value])))


def apply_mutations(parent_cg, mutations, ref) -> Column:
    """Child genome: parent overlaid with the edge's mutations, reference sites dropped."""
    merged = F.map_zip_with(
        F.map_from_entries(_c(parent_cg)),
        _by_pos(_c(mutations), "mut"),
        lambda _, old, new: F.coalesce(new, old),
    )
    kept = F.map_filter(merged, lambda pos, b: b != ref_base(ref, pos))
    entries = F.transform(
        F.map_entries(kept),
        lambda e: F.struct(e["key"].alias("pos"), e["value"].alias("base")),
    )
    return F.array_sort(entries)


def edge_mutations(parent_cg, child_cg, ref) -> Column:
    """Sites at which the two ends of an edge differ, as (pos, par, mut)."""
    both = F.map_zip_with(
        F.map_from_entries(_c(parent_cg)),
        F.map_from_entries(_c(child_cg)),
        lambda pos, p, c: F.struct(
            pos.alias("pos"),
            F.coalesce(p, ref_base(ref, pos)).alias("par"),
            F.coalesce(c, ref_base(ref, pos)).alias("mut"),
        ),
    )
    return F.array_sort(
        F.filter(F.map_values(both), lambda m: m["par"] != m["mut"])
    )
