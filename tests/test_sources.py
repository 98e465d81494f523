import gzip

import pytest
from pyspark.sql import functions as F

from cladeloom.operators import genomes, validate
from cladeloom.sources import build, fasta, newick, proto, vcf
from tests import graphs as g


def test_fasta(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_bytes(b"> s1 \r\nac gt\r\nAC\r\n>s2\nTT\tA\n>s1\nGGG\n")
    got = fasta.read_fasta(spark, str(p)).select("name", "sequence").collect()
    assert [tuple(r) for r in got] == [("s1", "ACGTAC"), ("s2", "TTA"), ("s1", "GGG")]
    last = {r["name"]: r["sequence"] for r in fasta.last_by_name(fasta.read_fasta(spark, str(p))).collect()}
    assert last == {"s1": "GGG", "s2": "TTA"}
    raw = tmp_path / "ref.txt"
    raw.write_text("ac g\nt\n")
    assert fasta.read_reference(spark, str(raw)) == "ACGT"
    assert fasta.read_reference(spark, str(p)) == "ACGTAC"


def test_newick_rows():
    rows = {r[0]: r[1:] for r in newick.newick_rows(" ((A:1e-05,B:0.5)x:2,\nC);")}
    assert rows[0][:3] == (2, "A", 1e-05) and rows[1][:4] == (2, "B", 0.5, 1)
    assert rows[2][:3] == (4, "x", 2.0) and rows[3][:2] == (4, "C") and rows[4][0] is None
    assert [r[0] for r in newick.newick_rows("((A,B),C);")] == [4, 2, 0, 1, 3]


@pytest.fixture(scope="module")
def three(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("three")
    (d / "s.fa").write_text(">A\nAAAA\n>B\nAACA\n>C\nTTAA\n")
    (d / "t.nwk").write_text("((A,B),\nC);\n")
    return build.from_fasta_newick(spark, str(d / "s.fa"), str(d / "t.nwk"), "AAAA")


def test_build_and_newick_out(spark, three, tmp_path):
    kinds = {r["kind"]: r["count"] for r in three.nodes.groupBy("kind").count().collect()}
    assert kinds == {"ua": 1, "inner": 2, "leaf": 3} and three.edges.count() == 5
    leaf = {r["sample_id"]: [(s["pos"], s["base"]) for s in r["cg"]]
            for r in three.nodes.where("kind = 'leaf'").collect()}
    assert leaf == {"A": [], "B": [(3, "C")], "C": [(1, "T"), (2, "T")]}
    assert newick.to_newick(three).first()["newick"] == "((A,B),C);"
    assert validate.edge_checks(three).count() == 0


def test_vcf(spark, three, tmp_path):
    p = tmp_path / "v.vcf"
    p.write_text(
        "##meta\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\n"
        "1\t2\t.\tA\tG,T\t.\t.\t.\tGT\t2|1\t./.\n1\t3\t.\tAC\tA\t.\t.\t.\tGT\t1\t1\n1\t4\t.\tA\tC\t.\t.\t.\tGT\t0\t1/0\n"
    )
    got = {r["sample_id"]: [(s["pos"], s["base"]) for s in r["cg"]] for r in vcf.read_vcf(spark, str(p), "AAAA").collect()}
    assert got == {"A": [(2, "T")], "B": [(4, "C")]}
    out = vcf.overlay_genomes(three, vcf.read_vcf(spark, str(p), "AAAA"))
    leaf = {r["sample_id"]: [(s["pos"], s["base"]) for s in r["cg"]] for r in out.nodes.where("kind = 'leaf'").collect()}
    assert leaf == {"A": [(2, "T")], "B": [(3, "C"), (4, "C")], "C": [(1, "T"), (2, "T")]}


def _shape(dag):
    text = {(r["dag_id"], r["node_id"]): (r["kind"], r["sample_id"], tuple((s["pos"], s["base"]) for s in r["cg"]))
            for r in dag.nodes.collect()}
    return sorted(
        (str(text[e["dag_id"], e["parent_id"]]), str(text[e["dag_id"], e["child_id"]]), e["clade_index"],
         round(e["edge_weight"], 3), str([tuple(m) for m in e["mutations"]]))
        for e in dag.edges.collect()
    )


def test_proto_roundtrip(spark, tmp_path):
    dag = g.build(spark, {"w": g.WEIGHTED})
    for compress in (False, True):
        folder = str(tmp_path / f"pb{compress}")
        proto.write_dag(dag, folder, compress)
        back = proto.read_dag(spark, folder, by_folder=True)
        assert _shape(back) == _shape(dag)


def test_several_dags_in_one_sink(spark, tmp_path):
    dag = g.build(spark, {"w/1": g.WEIGHTED, "six": g.SIX_A})
    for compress in (False, True):
        folder = str(tmp_path / ("two.pb.gz" if compress else "two.pb"))
        proto.write_dag(dag, folder, compress)
        back = proto.read_dag(spark, folder)
        assert back.refs.count() == 2 and back.nodes.where("kind = 'ua'").count() == 2
        assert _shape(back) == _shape(dag)


def test_parsimony_tree(spark, tmp_path):
    def mut(pos, par, to):
        return proto._enc(1, pos) + proto._enc(3, par) + proto._enc(4, proto._enc_varint(to))

    def muts(*ms):
        return proto._enc(2, b"".join(proto._enc(1, m) for m in ms))

    body = proto._enc(1, b"((A,N1),C);")
    body += muts() + muts(mut(1, 0, 1)) + muts() + muts(mut(2, 0, 2)) + muts(mut(4, 0, 3))
    body += proto._enc(3, proto._enc(1, b"N1") + proto._enc(2, b"x") + proto._enc(2, b"y") + proto._enc(2, b"z"))
    p = tmp_path / "m.pb.gz"
    p.write_bytes(gzip.compress(body))
    dag = proto.read_parsimony(spark, str(p), "AAAA")
    leaf = {r["sample_id"]: [(s["pos"], s["base"]) for s in r["cg"]] for r in dag.nodes.where("kind = 'leaf'").collect()}
    assert leaf == {"A": [(1, "C")], "x": [(1, "C"), (2, "G")], "y": [(1, "C"), (2, "G")],
                    "z": [(1, "C"), (2, "G")], "C": [(4, "T")]}
    assert validate.edge_checks(dag).count() == 0


def test_leaf_names(spark):
    twin = ("AAAA", {1: "AAAA", 2: "CAAA", 3: "CAAA", 4: "AATA"}, g.arcs("0>1.0 1>2.0 1>3.1 1>4.2"), {2: "", 3: "", 4: "k"})
    dag = g.build(spark, {"t": twin})
    got = sorted(r["sample_id"] for r in genomes.name_leaves(dag).nodes.where("kind = 'leaf'").collect())
    assert got == ["<1C,>", "<1C,>#1", "k"]
    forced = sorted(r["sample_id"] for r in genomes.name_leaves(dag, True).nodes.where("kind = 'leaf'").collect())
    assert forced == ["<1C,>", "<1C,>", "<3T,>"]


def test_vcf_call_of_the_reference_base_resets_a_leaf(spark):
    """Calls against another reference may say that a leaf has the DAG's own base."""
    dag = g.build(spark, {"d": ("AAAA", {1: "AAAA", 2: "CAGA", 3: "CATA"}, g.arcs("0>1.0 1>2.0 1>3.1"), {2: "s2", 3: "s3"})})
    calls = spark.createDataFrame([("f", 1, "s2", 1, "A"), ("f", 2, "s2", 4, "T"), ("f", 3, "s3", 1, "C")], "path string, at int, sample string, pos int, base string")
    out = vcf.overlay_genomes(dag, vcf.sample_genomes(calls, F.lit("GAAA")))
    got = {r.sample_id: [(s.pos, s.base) for s in r.cg] for r in out.nodes.where("kind = 'leaf'").collect()}
    assert got == {"s2": [(3, "G"), (4, "T")], "s3": [(1, "C"), (3, "T")]}
    muts = {r.child_id: [(m["pos"], m["par"], m["mut"]) for m in r.mutations] for r in out.edges.where("parent_id = 1").collect()}
    assert muts[2] == [(3, "A", "G"), (4, "A", "T")]


def test_newick_batches(spark):
    """Rows of a batch equal those of its texts one by one; what hangs beside the last node is left out; no pandas on the way."""
    texts = [f"((p{i}:{i}.5,b)x,\n c);" for i in range(40)] + ["(a,b)", "a,b:2;", "((a)b,c:-1e2)d;x", "(,)q:1:2;"]
    df = spark.createDataFrame([(f"t{i}", t) for i, t in enumerate(texts)], "dag_id string, newick string").coalesce(1)
    parsed = newick.parse_newick(df)
    assert "MapInPandas" not in parsed._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in parsed.collect())
    assert got == sorted((f"t{i}", *row) for i, t in enumerate(texts) for row in newick.newick_rows(t))
    assert [r[1:] for r in got if r[0] == "t41"] == [(1, None, "b", 2.0, 0, 0)]
