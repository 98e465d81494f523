import pytest
from pyspark.sql import functions as F

from cladeloom.operators import dp, levels, semiring as sr
from cladeloom.plans import jobs
from cladeloom.schema import HistoryDag
from cladeloom.sources import build, fasta, newick
from cladeloom.streaming import merge_log


def test_build_report_and_stream(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "s.fa").write_text(">A\nAAAA\n>B\nAACA\n>C\nTTAA\n")
    (tmp_path / "ref.txt").write_text("AAAA\n")
    (tmp_path / "in" / "1-r.treefile").write_text("((A,B),C);")
    (tmp_path / "in" / "2-r.treefile").write_text("((A,C),B);")
    (tmp_path / "in" / "notes.txt").write_text("skip me")
    common = ["--fasta", str(tmp_path / "s.fa"), "--newick", str(tmp_path / "in"), "--pattern", "*-r.treefile",
              "--reference", str(tmp_path / "ref.txt")]
    out = str(tmp_path / "out")
    jobs.main(["build", *common, "--output", out])
    dag = HistoryDag.read(spark, out)
    assert dag.nodes.where("kind = 'leaf'").count() == 3
    assert dp.below(levels.rank_edges(dag), sr.TreeCount()).top.first()["n"] == 2
    jobs.main(["report", "--parquet", out, "--edge-penalties", "parsimony", "--output", str(tmp_path / "p.pb")])
    assert "zero" in capsys.readouterr().out
    with pytest.raises(ValueError):
        jobs.main(["report", "--parquet", out, "--trim", "parsimony", "--sample", "parsimony"])
    seqs = fasta.last_by_name(fasta.read_fasta(spark, str(tmp_path / "s.fa")))
    (tmp_path / "in" / "notes.txt").unlink()
    q = merge_log.follow_newick(spark, str(tmp_path / "in"), seqs, "AAAA", str(tmp_path / "log")).option(
        "checkpointLocation", str(tmp_path / "ck")
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    streamed = merge_log.current(spark, str(tmp_path / "log"))
    key = lambda d: sorted((r["parent_id"], r["child_id"]) for r in d.edges.collect())
    assert key(streamed) == key(dag)
