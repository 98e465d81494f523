"""Genome, Fitch and likelihood queries over sequences derived from keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeloom.functions import bases, kmers
from cladeloom.functions import sitewords as sw
from cladeloom.operators import fitch, likelihood, spr
from cladeloom.plans import tables
from cladeloom.plans.registry import REF, SEQ, query
from cladeloom.runtime import spread

SITES = "sites as (select cast(unnest(range(1, 33)) as int) p)"
CUST = f"""sq as (select c_custkey k, c_nationkey nk, {SEQ.format('c_custkey')} q from customer),
{SITES},
df as (select k, nk, p, substr(q, p, 1) b, substr({REF}, p, 1) r from sq cross join sites)"""
MASK = "case {} when 'A' then 1 when 'C' then 2 when 'G' then 4 else 8 end"
WORDS = 3


def _customers(spark, sf):
    return spread(tables.table(spark, sf, "customer").select("c_custkey", "c_nationkey")).select(
        F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nk"),
        tables.sequence_of(F.col("c_custkey")).alias("q"),
    )


def _orders(spark, sf):
    """Order and customer keys; every order has a sequence of its own."""
    keys = spread(tables.table(spark, sf, "orders").select("o_orderkey", "o_custkey"))
    return keys.select(
        F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ok"),
        tables.sequence_of(F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))).alias("q"),
    )


def _order_edges(spark, sf):
    """Orders with their own sequence ``q`` and their customer's, ``parent_q``.

    Sequences meet, and genomes are made behind the join: an array of sites is
    many times wider than Spark's estimate of it, by which it would collect and
    broadcast every customer's.  For the same reason the keys are merged.
    """
    parent = _customers(spark, sf).select("k", F.col("q").alias("parent_q"))
    return _orders(spark, sf).join(parent.hint("merge"), "k")


def _edge_genomes(spark, sf):
    """Order edges with the genomes at both ends, ``p`` and ``c``."""
    ref = tables.reference()
    return _order_edges(spark, sf).select(
        "k", "ok", "q", bases.genome_from_sequence(F.col("parent_q"), ref).alias("p"),
        bases.genome_from_sequence(F.col("q"), ref).alias("c"),
    )


@query("genome_sites", f"with {CUST} select k, p pos, b base from df where b <> r")
def genome_sites(spark, sf):
    cg = bases.genome_from_sequence(F.col("q"), tables.reference())
    return _customers(spark, sf).select("k", F.inline(cg))


@query(
    "edge_mutation_counts",
    f"""with cs as (select c_custkey k, {SEQ.format('c_custkey')} q from customer),
os as (select o_custkey k, {SEQ.format("'o' || cast(o_orderkey as varchar)")} q from orders), {SITES}
select os.k, count(*) muts, count(distinct os.q) children from os join cs on cs.k = os.k cross join sites where substr(os.q, p, 1) <> substr(cs.q, p, 1) group by 1""",
)
def edge_mutation_counts(spark, sf):
    """Mutations on the customer -> order edges, from the genomes at both ends."""
    edges = _edge_genomes(spark, sf).select(
        "k", "q", bases.edge_mutations("p", "c", tables.reference()).alias("m")
    )
    return edges.groupBy("k").agg(
        F.sum(F.size("m")).cast("bigint").alias("muts"), F.count_distinct("q").alias("children")
    )


@query(
    "mutation_spectrum",
    f"""with cs as (select c_custkey k, {SEQ.format('c_custkey')} q from customer),
os as (select o_custkey k, {SEQ.format("'o' || cast(o_orderkey as varchar)")} q from orders), {SITES}
select substr(cs.q, p, 1) par, substr(os.q, p, 1) mut, count(*) n from os join cs on cs.k = os.k cross join sites where substr(os.q, p, 1) <> substr(cs.q, p, 1) group by 1, 2""",
)
def mutation_spectrum(spark, sf):
    """How often each base turns into each other one on the customer -> order edges."""
    muts = _edge_genomes(spark, sf).select(F.inline(bases.edge_mutations("p", "c", tables.reference())))
    return muts.groupBy("par", "mut").agg(F.count(F.lit(1)).alias("n"))


@query("sequence_roundtrip", f"select c_custkey k, {SEQ.format('c_custkey')} q from customer")
def sequence_roundtrip(spark, sf):
    ref = tables.reference()
    cg = bases.genome_from_sequence(F.col("q"), ref)
    return _customers(spark, sf).select("k", bases.sequence_from_genome(cg, ref).alias("q"))


@query(
    "applied_mutations",
    f"""with {CUST}, os as (select o_orderkey ok, {SEQ.format("'o' || cast(o_orderkey as varchar)")} q from orders)
select ok, count(*) n, sum(p) pos_sum from os cross join sites where substr(q, p, 1) <> substr({REF}, p, 1) group by 1""",
)
def applied_mutations(spark, sf):
    """Order genome rebuilt by applying its edge's mutations to the customer genome."""
    ref = tables.reference()
    built = _edge_genomes(spark, sf).select(
        "ok", bases.apply_mutations("p", bases.edge_mutations("p", "c", ref), ref).alias("cg")
    )
    total = F.aggregate("cg.pos", F.lit(0).cast("bigint"), lambda a, p: a + p)
    return built.select("ok", F.size("cg").cast("bigint").alias("n"), total.alias("pos_sum"))


COARSE = "c_custkey % 97"
GENOMES = f"""sq as (select c_nationkey nk, c_custkey k, {SEQ.format(COARSE)} q from customer), {SITES},
gs as (select k, p, substr(q, p, 1) b from sq cross join sites where substr(q, p, 1) <> substr({REF}, p, 1)),
g as (select nk, sq.k, '<' || coalesce(string_agg(cast(p as varchar) || b || ',', '' order by p), '') || '>' cg from sq left join gs on gs.k = sq.k group by 1, 2)"""


def _coarse_leaves(spark, sf):
    """Customers as leaves of their nation's star, ninety-seven sequences in all."""
    rows = spread(tables.table(spark, sf, "customer").select("c_custkey", "c_nationkey")).select(
        F.col("c_nationkey").cast("string").alias("dag_id"), F.col("c_custkey").alias("node_id"),
        tables.sequence_of(F.col("c_custkey") % 97).alias("q"),
    )
    return rows.withColumn("cg", bases.genome_from_sequence(F.col("q"), tables.reference()))


@query(
    "genome_ids",
    f"""with {GENOMES}
select nk, cg id, count(*) n, min(k) first from g group by 1, 2""",
)
def genome_ids(spark, sf):
    """Leaf ids from whole genomes: how many leaves of a nation start with each, and which has the bare one."""
    from cladeloom.operators.genomes import name_leaves
    from cladeloom.schema import HistoryDag

    leaves = _coarse_leaves(spark, sf).select(
        "dag_id", "node_id", F.lit("leaf").alias("kind"), F.lit("").alias("sample_id"), "cg"
    )
    named = name_leaves(HistoryDag(leaves, None, None)).nodes
    number = F.coalesce(F.expr("try_cast(nullif(split_part(sample_id, '#', 2), '') as bigint)"), F.lit(0))
    ids = named.select("dag_id", "node_id", F.substring_index("sample_id", "#", 1).alias("id"), number.alias("number"))
    by_id = ids.groupBy("dag_id", "id").agg(
        F.count(F.lit(1)).alias("n"), F.min("node_id").alias("first"), F.max("number").alias("last"),
        F.count_distinct("number").alias("numbers"),
    )
    whole = (F.col("last") == F.col("n") - 1) & (F.col("numbers") == F.col("n"))
    return by_id.select(
        F.col("dag_id").cast("int").alias("nk"), "id",
        F.when(whole, F.col("n")).otherwise(F.raise_error(F.lit("numbers are not gapless")).cast("bigint")).alias("n"), "first",
    )


@query(
    "variable_sites",
    f"with {CUST} select nk, p, count(distinct b) bases from df group by 1, 2 having count(distinct b) > 1",
)
def variable_sites(spark, sf):
    """Sites of each nation at which its customers differ, from packed words."""
    words = _words(_customers(spark, sf), "nk").groupBy("nk", "word").agg(F.bit_or("bits").alias("seen"))
    per_site = _per_site(words, "nk", ["seen"])
    return per_site.select("nk", "p", F.bit_count("seen").cast("bigint").alias("bases")).where("bases > 1")


def _words(df, *keep):
    """One row per (row, word): three fifteen-site words of the 32 letters."""
    packed = F.posexplode(sw.pack_words(F.col("q"), WORDS)).alias("word", "bits")
    return df.select(*keep, packed)


def _per_site(df, key, cols):
    """Words back to one row per site 1..32."""
    site = F.explode(F.sequence(F.lit(0), F.lit(sw.SITES - 1))).alias("s")
    nib = [
        F.call_function("shiftright", F.col(c), F.col("s") * 4).bitwiseAND(F.lit(15).cast("bigint")).cast("int").alias(c)
        for c in cols
    ]
    flat = df.select(key, "word", *cols, site)
    return flat.select(key, (F.col("word") * sw.SITES + F.col("s") + 1).alias("p"), *nib).where(
        F.col("p") <= tables.SEQ_LEN
    )


@query(
    "star_fitch",
    f"""with {CUST}, m as (select nk, p, {MASK.format('b')} m from df)
select nk, p, cast(bit_and(m) as int) inter, cast(bit_or(m) as int) uni,
       cast(case when bit_and(m) = 0 then bit_or(m) else bit_and(m) end as int) fset, case when bit_and(m) = 0 then 1 else 0 end cost from m group by 1, 2""",
)
def star_fitch(spark, sf):
    """Fitch sets of every nation over its customers, fifteen sites per word."""
    words = _words(_customers(spark, sf), "nk").groupBy("nk", "word").agg(
        F.bit_and("bits").alias("inter"), F.bit_or("bits").alias("uni")
    )
    sets = words.withColumn("fset", sw.fitch_set(F.col("inter"), F.col("uni")))
    return _per_site(sets, "nk", ["inter", "uni", "fset"]).withColumn(
        "cost", F.when(F.col("inter") == 0, 1).otherwise(0)
    )


def _geo_tree(spark, sf) -> fitch.Tree:
    region = tables.table(spark, sf, "region").select(
        F.concat(F.lit("r"), F.col("r_regionkey")).alias("node_id"), F.lit("w").alias("parent_id"),
        F.lit(1).alias("depth"),
    )
    nation = tables.table(spark, sf, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey")).alias("node_id"),
        F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent_id"), F.lit(2).alias("depth"),
    )
    cust = tables.table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("node_id"),
        F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent_id"), F.lit(3).alias("depth"),
    )
    root = region.groupBy(F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_children")).select(
        "node_id", F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), "n_children"
    )
    body = region.unionByName(nation).unionByName(cust)
    size = body.groupBy(F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_children"))
    body = body.join(size, "node_id", "left").na.fill(0, ["n_children"])
    return fitch.Tree(body.unionByName(root), 3, ())


def _leaf_words(df, id_col):
    ref = sw.pack_words(tables.reference(), WORDS)
    return df.select(F.col(id_col).alias("node_id"), F.posexplode(sw.pack_words(F.col("q"), WORDS)).alias("word", "bits")).select(
        "node_id", "word", "bits", ref[F.col("word")].alias("ref")
    )


LOW = "case when {0} & 1 > 0 then 1 when {0} & 2 > 0 then 2 when {0} & 4 > 0 then 4 else 8 end"


@query(
    "geo_fitch_assignment",
    f"""with {CUST}, m as (select nk, p, {MASK.format('b')} m from df),
n1 as (select nk, p, case when bit_and(m) = 0 then bit_or(m) else bit_and(m) end s from m group by 1, 2),
r1 as (select n_regionkey rk, p, case when bit_and(s) = 0 then bit_or(s) else bit_and(s) end s from n1 join nation on n_nationkey = nk group by 1, 2),
w1 as (select p, case when bit_and(s) = 0 then bit_or(s) else bit_and(s) end s, {MASK.format(f"substr({REF}, p, 1)")} ref from r1 group by 1),
wa as (select p, ref, case when s & ref > 0 then ref else {LOW.format('s')} end a from w1),
ra as (select rk, r1.p, ref, case when s & a > 0 then a else {LOW.format('s')} end a from r1 join wa on wa.p = r1.p),
na as (select nk, n1.p, ref, case when s & a > 0 then a else {LOW.format('s')} end a from n1 join nation on n_nationkey = nk join ra on ra.rk = n_regionkey and ra.p = n1.p),
al as (select 'w' node_id, p, ref, a from wa union all select 'r' || rk, p, ref, a from ra union all select 'n' || nk, p, ref, a from na)
select node_id, p, a from al""",
)
def geo_fitch(spark, sf):
    """Bases chosen for world, regions and nations."""
    cust = _customers(spark, sf).withColumn("node_id", F.concat(F.lit("c"), F.col("k")))
    sets = fitch.sets_up(_geo_tree(spark, sf), _leaf_words(cust, "node_id"), dense=True)
    out = fitch.assign_down(sets)
    return _per_site(out, "node_id", ["bits"]).select("node_id", "p", F.col("bits").alias("a"))


def heap_tree_and_words(spark, sf):
    nodes, depth = tables.heap_tree(spark, sf)
    heap = _customers(spark, sf).select((F.col("k") + 1).alias("node_id"), "q")
    tips = nodes.where("n_children = 0").select("node_id")
    return fitch.Tree(nodes, depth, ()), _leaf_words(heap.join(tips, "node_id"), "node_id")


def heap_sets(spark, sf):
    tree, leaves = heap_tree_and_words(spark, sf)
    return tree, fitch.sets_up(tree, leaves, dense=True)


def _heap_sql(top: int = 17):
    """Level-by-level Fitch sets of the heap tree, deepest level first."""
    out = []
    for d in range(top, -1, -1):
        tips = f"select i, p, m from tip where d = {d}"
        if d == top:
            out.append(f"l{d} as (select i, p, m, 0 cost from ({tips}))")
            continue
        out.append(
            f"l{d} as (select i, p, m, 0 cost from ({tips}) union all "
            f"select i // 2, p, case when bit_and(m) = 0 then bit_or(m) else bit_and(m) end, "
            f"case when bit_and(m) = 0 and count(*) > 1 then 1 else 0 end from l{d + 1} group by 1, 2)"
        )
    return ",\n".join(out)


HEAP = f"""{SITES}, mx as (select max(c_custkey) + 1 n from customer),
h as (select c_custkey + 1 i, {SEQ.format('c_custkey')} q from customer),
tip as (select i, cast(floor(log2(i)) as int) d, p, {MASK.format('substr(q, p, 1)')} m from h cross join mx cross join sites where 2 * i > n),
{_heap_sql()}"""


def _heap_down_sql(top: int = 17):
    out = []
    for d in range(top):
        ref = MASK.format(f"substr({REF}, l.p, 1)")
        want = ref if d == 0 else "u.a"
        up = "" if d == 0 else f" join a{d - 1} u on u.i = l.i // 2 and u.p = l.p"
        pick = f"case when l.m & {want} > 0 then {want} else {LOW.format('l.m')} end"
        out.append(f"a{d} as (select l.i, l.p, {pick} a from l{d} l{up} where l.i * 2 <= (select n from mx))")
    return ",\n".join(out)


@query(
    "heap_fitch_assignment",
    f"with {HEAP}, {_heap_down_sql()} select i, p, a from ("
    + " union all ".join(f"select i, p, a from a{d}" for d in range(17))
    + f") where a <> {MASK.format(f'substr({REF}, p, 1)')}",
)
def heap_fitch_assignment(spark, sf):
    """Bases chosen for the inner nodes of the heap tree, where they differ from the reference."""
    _, sets = heap_sets(spark, sf)
    out = fitch.assign_down(sets)
    return _per_site(out, "node_id", ["bits", "ref"]).where("bits <> ref").select(
        F.col("node_id").alias("i"), "p", F.col("bits").alias("a")
    )


@query(
    "heap_fitch_cost",
    f"with {HEAP} "
    + " union all ".join(
        f"select {d} depth, count(*) // 32 nodes, cast(sum(cost) as bigint) cost from l{d} where i * 2 <= (select n from mx) having count(*) > 0"
        for d in range(17)
    ),
)
def heap_fitch_cost(spark, sf):
    """Fitch cost of the customer heap tree per depth."""
    tree, sets = heap_sets(spark, sf)
    rows = sets.inner.groupBy("node_id").agg(F.sum("cost").alias("cost"))
    depth = (F.length(F.bin("node_id")) - 1).cast("int")
    return rows.groupBy(depth.alias("depth")).agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("cost").alias("cost")
    )


@query(
    "heap_root_state",
    f"with {HEAP} select p, cast(m as int) fset from l0",
)
def heap_root_state(spark, sf):
    _, sets = heap_sets(spark, sf)
    root = sets.inner_parts[-1].where("node_id = 1")
    return _per_site(root, "node_id", ["set"]).select("p", F.col("set").alias("fset"))


@query(
    "condensed_leaves",
    f"""with s as (select c_nationkey nk, c_custkey k, {SEQ.format(COARSE)} q from customer)
select nk, min(k) keeper, count(*) copies from s group by nk, q""",
)
def condensed_leaves(spark, sf):
    """Sibling leaves with equal genomes: the one kept searchable and its copies."""
    leaves = _coarse_leaves(spark, sf).select("dag_id", F.col("node_id").alias("k"), "q")
    parent = F.col("dag_id").cast("bigint")
    link = leaves.select("dag_id", F.col("k").alias("node_id"), (-1 - parent).alias("parent_id"), F.lit(0).alias("n_children"))
    root = link.select("dag_id", F.col("parent_id").alias("node_id")).distinct().select(
        "*", F.lit(None).cast("bigint").alias("parent_id"), F.lit(1).alias("n_children")
    )
    packed = F.posexplode(sw.pack_words(F.col("q"), WORDS)).alias("word", "bits")
    words = leaves.select("dag_id", F.col("k").alias("node_id"), packed)
    tree = fitch.Tree(link.unionByName(root), 1, ("dag_id",))
    kept = spr.searchable(spr.TreeIndex(tree, words, None)).select("dag_id", F.col("node_id").alias("keeper"))
    copies = leaves.groupBy("dag_id", "q").agg(F.count(F.lit(1)).alias("copies"))
    genome = leaves.withColumnRenamed("k", "keeper")
    return kept.join(genome, ["dag_id", "keeper"]).join(copies, ["dag_id", "q"]).select(
        F.col("dag_id").cast("int").alias("nk"), "keeper", "copies"
    )


@query(
    "ancestor_counts",
    """with h as (select c_custkey + 1 i from customer), s as (select unnest(range(1, 4)) u)
select i >> u anc, u up, count(*) n from h cross join s where i >> u > 0 group by 1, 2""",
)
def ancestor_counts(spark, sf):
    """Descendants of every heap node one, two and three levels down."""
    from cladeloom.operators.levels import ancestors
    from cladeloom.schema import HistoryDag

    nodes, _ = tables.heap_tree(spark, sf)
    edges = nodes.where("parent_id is not null").select(
        F.lit("h").alias("dag_id"), "parent_id", F.col("node_id").alias("child_id")
    )
    up = ancestors(HistoryDag(None, edges, None), max_up=3)
    return up.groupBy(F.col("ancestor_id").alias("anc"), "up").agg(F.count(F.lit(1)).alias("n"))


@query(
    "lowest_common_ancestors",
    """with h as (select c_custkey + 1 i from customer where c_custkey + 2 <= (select max(c_custkey) + 1 from customer)), s as (select unnest(range(0, 20)) u), v as (select unnest(range(0, 20)) u)
select i a, i + 1 b, max(i >> s.u) lca from h cross join s join v on (i >> s.u) = ((i + 1) >> v.u) where i >> s.u > 0 group by 1, 2""",
)
def lowest_common_ancestors(spark, sf):
    """Lowest common ancestor of every pair of neighbouring customers in the heap tree."""
    from cladeloom.operators.levels import lca
    from cladeloom.runtime import cut
    from cladeloom.schema import HistoryDag

    raw, _ = tables.heap_tree(spark, sf)
    nodes = raw.select(F.lit("h").alias("dag_id"), "node_id", "parent_id")
    edges = cut(
        nodes.where("parent_id is not null").select("dag_id", "parent_id", F.col("node_id").alias("child_id"))
    )
    last = nodes.agg(F.max("node_id").alias("m"))
    pairs = nodes.join(last, F.col("node_id") < F.col("m")).select(
        "dag_id", F.col("node_id").alias("a_id"), (F.col("node_id") + 1).alias("b_id")
    )
    dag = HistoryDag(nodes.select("dag_id", "node_id"), edges, None)
    return lca(dag, pairs).select(
        F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("lca_id").alias("lca")
    )


@query(
    "kmer_counts",
    f"""with sq as (select 'NN' || {SEQ.format('c_custkey')} || 'NN' q from customer), {SITES},
w as (select substr(q, p, 5) w from sq cross join sites)
select case when contains(w, 'N') then 1024 else list_reduce(list_transform(range(1, 6), lambda i: instr('ACGT', substr(w, cast(i as bigint), 1)) - 1), lambda a, b: a * 4 + b) end kmer, count(*) n from w group by 1""",
)
def kmer_counts(spark, sf):
    """How often each five-letter context occurs; windows past the ends count as 1024."""
    idx = F.explode(kmers.kmer_indices(F.col("q"), 5)).alias("kmer")
    return _customers(spark, sf).select(idx).groupBy(F.col("kmer").cast("bigint").alias("kmer")).agg(
        F.count(F.lit(1)).alias("n")
    )


def closed_form_table(spark):
    """A k = 3 context table by formula: rates and substitution odds of 65 contexts."""
    kmer = spark.range(65).select(F.col("id").cast("int").alias("kmer"))
    odds = F.array(*[(F.lit(1.0) + (F.col("kmer") + j) % 4) / 10.0 for j in range(4)])
    return kmer.select("kmer", (F.lit(0.5) + F.col("kmer") % 7 / 10.0).alias("rate"), odds.alias("csp"))


@query(
    "edge_log_likelihood",
    f"""with cs as (select c_custkey k, {SEQ.format('c_custkey')} q from customer),
os as (select o_orderkey ok, o_custkey k, {SEQ.format("'o' || cast(o_orderkey as varchar)")} q from orders), {SITES},
x as (select ok, substr(cs.q, p, 1) a, substr(os.q, p, 1) b, substr('N' || cs.q || 'N', p, 3) w from os join cs on cs.k = os.k cross join sites),
y as (select ok, a, b, case when contains(w, 'N') then 64 else (instr('ACGT', substr(w, 1, 1)) - 1) * 16 + (instr('ACGT', substr(w, 2, 1)) - 1) * 4 + instr('ACGT', substr(w, 3, 1)) - 1 end m from x),
z as (select ok, a <> b mut, cast(0.5 + m % 7 / 10.0 as double) rate, cast((1.0 + (m + instr('ACGT', b) - 1) % 4) / 10.0 as double) csp from y),
t as (select ok, count(*) filter (where mut) n, sum(rate) tot, coalesce(sum(ln(rate * csp)) filter (where mut), 0) logs from z group by 1)
select ok, round(case when n = 0 then 0 else n * ln(n / tot) - n + logs end, 4) loglik from t""",
)
def edge_log_likelihood(spark, sf):
    """Poisson context log-likelihood of every customer -> order edge."""
    pairs = _order_edges(spark, sf).withColumnsRenamed({"q": "child_seq", "parent_q": "parent_seq"})
    scored = likelihood.kmer_table_loglik(pairs, closed_form_table(spark), 3, tables.SEQ_LEN)
    return pairs.join(scored, ["parent_seq", "child_seq"], "left").select(
        "ok", F.round(F.coalesce("loglik", F.lit(0.0)), 4).alias("loglik")
    )
