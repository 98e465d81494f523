"""Fifteen sites per BIGINT: one-hot base sets packed four bits to a site.

Set algebra on a word works on all fifteen sites at once, ``bit_and`` and
``bit_or`` over the children of a node are plain partial aggregates, and sixty
bits keep every word non-negative.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SITES = 15


def _const(nibble: int, sites: int = SITES) -> Column:
    return F.lit(sum(nibble << (4 * k) for k in range(sites))).cast("bigint")


def pack_word(seq: Column, word: Column) -> Column:
    """Word number ``word`` of an upper-case ACGT string, first site lowest."""
    part = F.substring(seq, word * SITES + 1, F.lit(SITES))
    digits = F.reverse(F.translate(part, "ACGT", "1248"))
    return F.conv(digits, 16, 10).cast("bigint")


def pack_words(seq: Column, n_words: int) -> Column:
    """array<bigint> of the first ``n_words`` words."""
    return F.array(*[pack_word(seq, F.lit(w)) for w in range(n_words)])


def site_bits(mask: Column, site: Column) -> Column:
    """A one-hot base placed at a site of its word."""
    return F.call_function("shiftleft", mask.cast("bigint"), ((site % SITES) * 4).cast("int"))


def _spread(low: Column) -> Column:
    """Every set lowest-bit of a nibble widened to the whole nibble."""
    return low * F.lit(15).cast("bigint")


def _nonempty(w: Column) -> Column:
    """Lowest bit of each nibble that has any bit set."""
    any_bit = reduce(lambda a, k: a.bitwiseOR(F.shiftright(w, k)), (1, 2, 3), w)
    return any_bit.bitwiseAND(_const(1))


def fitch_set(inter: Column, union: Column) -> Column:
    """Intersection where it has a base, else union, site by site."""
    full = _spread(_nonempty(inter))
    return inter.bitwiseOR(union.bitwiseAND(F.bitwise_not(full)))


def empty_sites(inter: Column, union: Column) -> Column:
    """Number of sites whose intersection is empty though the union is not."""
    clash = _nonempty(union).bitwiseAND(F.bitwise_not(_nonempty(inter)))
    return F.bit_count(clash)


def lowest_base(w: Column) -> Column:
    """Lowest base of every site."""
    a = w.bitwiseAND(_const(1))
    c = w.bitwiseAND(_const(2))
    g = w.bitwiseAND(_const(4))
    t = w.bitwiseAND(_const(8))
    c1 = c.bitwiseAND(F.bitwise_not(F.shiftleft(a, 1)))
    g1 = g.bitwiseAND(F.bitwise_not(F.shiftleft(a, 2))).bitwiseAND(F.bitwise_not(F.shiftleft(c, 1)))
    t1 = (
        t.bitwiseAND(F.bitwise_not(F.shiftleft(a, 3)))
        .bitwiseAND(F.bitwise_not(F.shiftleft(c, 2)))
        .bitwiseAND(F.bitwise_not(F.shiftleft(g, 1)))
    )
    return a.bitwiseOR(c1).bitwiseOR(g1).bitwiseOR(t1)


def choose_base(options: Column, preferred: Column) -> Column:
    """Per site: the preferred base where allowed, else the lowest allowed."""
    same = options.bitwiseAND(preferred)
    full = _spread(_nonempty(same))
    return same.bitwiseOR(lowest_base(options).bitwiseAND(F.bitwise_not(full)))


def differing_sites(a: Column, b: Column) -> Column:
    """Number of sites at which two one-hot words differ."""
    return F.bit_count(_nonempty(a.bitwiseXOR(b)))


def site_base(word: Column, site: Column) -> Column:
    """Base letter at a site of a one-hot word."""
    nib = F.call_function("shiftright", word, ((site % SITES) * 4).cast("int")).bitwiseAND(
        F.lit(15).cast("bigint")
    )
    return F.when(nib == 1, "A").when(nib == 2, "C").when(nib == 4, "G").when(nib == 8, "T")
