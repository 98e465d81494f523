import io
import math
import pickle
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeloom.operators import likelihood, models
from cladeloom.plans.sequence_queries import closed_form_table
from cladeloom.sources.models import read_pth, read_yaml
from tests import graphs as g


def test_poisson_closed_forms():
    quarter = np.full((5, 4), 0.25)
    rates = np.array([1, 1, 2, 1, 1.0])
    p, c = np.array([0, 1, 2, 3, 0]), np.array([0, 1, 3, 3, 0])
    assert models.poisson_loglik(rates, quarter, p, p) == 0
    want = math.log(0.5) + math.log(1 / 6) - 1
    assert models.poisson_loglik(rates, quarter, p, c) == pytest.approx(want)
    assert models.poisson_loglik(np.array([2.0]), np.array([[0, 0.5, 0, 0]]), np.array([0]), np.array([1])) == pytest.approx(math.log(0.5) - 1)
    assert math.isfinite(models.poisson_loglik(np.array([2.0]), np.zeros((1, 4)), np.array([0]), np.array([1])))
    for bad in (0.0, float("nan")):
        with pytest.raises(ValueError):
            models.poisson_loglik(np.array([bad, 1, 2, 1, 1]), quarter, p, c)


def test_kmer_encoding():
    idx, codes = models.encode("AAAAATTTTTN", 5, 11)
    assert idx[2] == 0 and idx[7] == 1023 and idx[0] == 1024 and idx[10] == 1024 and codes[10] == 4


def test_yaml():
    got = read_yaml("a: 1 # note\nb:\n  c: x\nd: {}\n")
    assert got == {"a": "1", "b.c": "x"}
    for bad in ("\ta: 1", " a: 1", "a", "a: 1\na: 2"):
        with pytest.raises(ValueError):
            read_yaml(bad)


class _Ref:
    def __init__(self, key, n):
        self.key, self.n = key, n


def write_pth(path, tensors):
    """A minimal archive in the layout the reader expects."""
    buf = io.BytesIO()

    class P(pickle._Pickler):
        def persistent_id(self, obj):
            return None

        def save_global_name(self, module, name):
            self.write(b"c" + module.encode() + b"\n" + name.encode() + b"\n")

    p = P(buf, 2)
    p.write(b"\x80\x02")
    p.save_global_name("collections", "OrderedDict")
    p.write(b")R(")
    for i, (name, arr) in enumerate(tensors.items()):
        p.save(name)
        p.save_global_name("torch._utils", "_rebuild_tensor_v2")
        p.write(b"(")
        p.write(b"(")
        p.save("storage")
        p.save_global_name("torch", "FloatStorage")
        p.save(str(i))
        p.save("cpu")
        p.save(arr.size)
        p.write(b"tQ")
        p.save(0)
        p.save(tuple(arr.shape))
        p.save(tuple(int(s // arr.itemsize) for s in arr.strides))
        p.save(False)
        p.write(b"tR")
    p.write(b"u.")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("m/data.pkl", buf.getvalue())
        z.writestr("m/byteorder", "little")
        for i, arr in enumerate(tensors.values()):
            z.writestr(f"m/data/{i}", arr.astype("<f4").tobytes())


def test_pth(tmp_path):
    a = np.arange(6, dtype=np.float32).reshape(2, 3)
    write_pth(tmp_path / "x.pth", {"w": a, "b": a[0]})
    got = read_pth(str(tmp_path / "x.pth"))
    assert (got["w"] == a).all() and (got["b"] == a[0]).all()
    evil = io.BytesIO()
    pickle.dump(print, evil)
    with zipfile.ZipFile(tmp_path / "y.pth", "w") as z:
        z.writestr("m/data.pkl", evil.getvalue())
        z.writestr("m/byteorder", "little")
    with pytest.raises(pickle.UnpicklingError):
        read_pth(str(tmp_path / "y.pth"))


def test_table_and_net_agree_with_numpy(spark, tmp_path):
    rng = np.random.default_rng(1)
    seqs = ["".join(rng.choice(list("ACGT"), 20)) for _ in range(4)]
    pairs = [(a, b) for a in seqs[:2] for b in seqs]
    df = spark.createDataFrame(pairs, "parent_seq string, child_seq string")
    log_rates, logits = rng.normal(size=(1025, 1)), rng.normal(size=(1025, 4))
    table = models.KmerModel(models.kmer_table(spark, log_rates, logits), 5, 500, 0.1)
    got = {(r["parent_seq"], r["child_seq"]): r["loglik"] for r in table.loglik(df).collect()}
    for a, b in pairs:
        if a == b:
            continue
        idx, codes = models.encode(a, 5, 20)
        odds = logits[idx].copy()
        odds[np.arange(20), codes] += models.MASK
        want = models.poisson_loglik(np.exp(log_rates[idx, 0] + 0.1), models.softmax_rows(odds), codes, models.encode(b, 5, 20)[1])
        assert got[a, b] == pytest.approx(want)
    shapes = {"kmer_embedding.weight": (65, 7), "conv.weight": (16, 7, 9), "conv.bias": (16,)}
    w = {pre + n: rng.normal(size=s).astype(np.float32) * 0.1 for pre in ("", "r_", "s_") for n, s in shapes.items()}
    for pre, n in (("", 1), ("r_", 1), ("s_", 4)):
        w[f"{pre}linear.weight"] = rng.normal(size=(n, 16)).astype(np.float32) * 0.1
        w[f"{pre}linear.bias"] = rng.normal(size=n).astype(np.float32)
    write_pth(tmp_path / "net-libtorch.pth", w)
    (tmp_path / "net.yml").write_text(
        "encoder_parameters:\n  kmer_length: 3\n  site_count: 500\nmodel_class: IndepRSCNNModel\n"
    )
    net = models.load_model(spark, str(tmp_path / "net"))
    scored = {(r["parent_seq"], r["child_seq"]): r["loglik"] for r in net.loglik(df).collect()}
    assert len(scored) == sum(a != b for a, b in pairs) and all(math.isfinite(v) for v in scored.values())
    a, b = next(p for p in pairs if p[0] != p[1])
    rates, csp = net.forward(a)
    assert rates.shape == (500,) and csp.shape == (500, 4)
    _, codes = models.encode(a, 3, 500)
    assert (csp[np.arange(20), codes] < 1e-12).all()
    assert scored[a, b] == pytest.approx(models.poisson_loglik(rates, csp, codes, models.encode(b, 3, 500)[1]))
    # all sequences in one pass, against the convolution written out site by site
    many = net.forward_all([p for p, _ in pairs] * 12)
    assert len(many) == 12 * len(pairs)
    for (p, _), (rates, csp, codes) in zip(pairs, many):
        kmers, want_codes = models.encode(p, 3, 500)
        wide = np.pad(w["kmer_embedding.weight"][kmers], ((4, 4), (0, 0)))
        conv = w["conv.weight"]
        plain = np.array([(wide[i : i + 9].T * conv).sum(axis=(1, 2)) for i in range(500)]) + w["conv.bias"]
        assert net._features("", kmers[None])[0] == pytest.approx(np.maximum(plain, 0), abs=1e-5)
        assert (codes == want_codes).all() and csp.sum(axis=1) == pytest.approx(1)


def test_edge_nll_skips_unchanged_and_root(spark):
    ref = "ACGTACGTACGTACGTACGT"
    seqs = {1: ref, 2: "T" + ref[1:], 3: ref[:11] + "C" + ref[12:], 4: "T" + ref[1:], 5: "TCGC" + ref[4:],
            6: ref[:11] + "C" + ref[12:], 7: ref[:11] + "C" + ref[12:16] + "C" + ref[17:]}
    tree = (ref, seqs, g.arcs("0>1.0 1>2.0 1>3.1 2>4.0 2>5.1 3>6.0 3>7.1"), {n: f"L{n}" for n in range(4, 8)})
    dag = g.build(spark, {"t": tree})
    table = spark.range(65).select(F.col("id").cast("int").alias("kmer"), F.lit(1.0).alias("rate"),
                                   F.array(*[F.lit(0.25)] * 4).alias("csp"))
    model = models.KmerModel(table, 3, 500)
    nll = {r["edge_id"]: r["nll"] for r in likelihood.edge_nll(dag, model.loglik).collect()}
    one = -(math.log(1 / 20) - 1 + math.log(0.25))
    assert [nll[i] for i in range(7)] == pytest.approx([0, one, one, 0, one, 0, one])
    assert likelihood.dag_nll(likelihood.edge_nll(dag, model.loglik)).first()["nll"] == pytest.approx(4 * one)


def test_table_model_site_by_site(spark):
    """Uneven lengths, both cases, unknown letters and a gap in the table, by formula; one row per pair, no row per site."""
    table = closed_form_table(spark).where("kmer <> 27")
    known = {r["kmer"]: r for r in table.collect()}
    pairs = [("ACGTACGTTA", "ACGAACGTTC"), ("acgtac", "ACGTCCGG"), ("ANCGT", "ANCCT"), ("GT", "GTAA"), ("TTTTTTTTT", "CTTTATT")]
    df = spark.createDataFrame(pairs, "parent_seq string, child_seq string")
    scored = likelihood.kmer_table_loglik(df, table, 3, 8)
    assert "Generate" not in scored._jdf.queryExecution().executedPlan().toString()
    got = {(r["parent_seq"], r["child_seq"]): r["loglik"] for r in scored.collect()}
    for p, c in pairs:
        n, total, logs = 0, 0.0, 0.0
        whole = "N" + p.upper() + "N"
        for i in range(min(len(p), len(c), 8)):
            w = whole[i : i + 3]
            kmer = 64 if set(w) - set("ACGT") else sum("ACGT".index(b) * 4 ** (2 - j) for j, b in enumerate(w))
            if kmer not in known:
                continue
            total += known[kmer]["rate"]
            if p[i].upper() != c[i].upper():
                n += 1
                logs += math.log(known[kmer]["rate"] * known[kmer]["csp"]["ACGT".index(c[i].upper())])
        if p[:8] != c[:8]:
            assert got.pop((p, c)) == pytest.approx(n * math.log(n / total) - n + logs if n else 0.0)
    assert not got
    with pytest.raises(Exception, match="unknown base"):
        likelihood.kmer_table_loglik(spark.createDataFrame([("ACG", "ANG")], df.schema), table, 3, 8).collect()
