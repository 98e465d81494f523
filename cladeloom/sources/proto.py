"""History-DAG and parsimony-tree protobuf files.

Files are decoded in tasks, one file per row.  Only the few fields below are
read; unknown fields are skipped.  Because protobuf messages concatenate, the
writer lets every task emit its own part: the parts of a folder, read in any
order, are one valid message, and the reader accepts the folder.
"""

from __future__ import annotations

import gzip
import struct
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeloom.functions.bases import BASES
from cladeloom.operators.genomes import name_leaves, recompute_genomes
from cladeloom.runtime import cut, materialise
from cladeloom.schema import GENOME, MUTATIONS, HistoryDag
from cladeloom.sources.build import topology
from cladeloom.sources.newick import newick_rows

# Field numbers of the two message families.
DAG_EDGES, DAG_NAMES, DAG_REF_ID, DAG_REF_SEQ = 1, 2, 3, 4
EDGE_ID, EDGE_PARENT, EDGE_CLADE, EDGE_CHILD, EDGE_MUTS, EDGE_WEIGHT = 1, 2, 3, 4, 5, 6
MUT_POS, MUT_PAR, MUT_MUT = 1, 2, 3
MAT_NEWICK, MAT_MUTS, MAT_CONDENSED = 1, 2, 3
MAT_POS, MAT_PAR, MAT_MUT = 1, 3, 4

MUT_SQL = "array<struct<pos:int,par:string,mut:string>>"
EDGE_ROWS = (
    "path string, edge_id bigint, parent_id bigint, child_id bigint, clade_index int, "
    f"mutations {MUT_SQL}, edge_weight double, name_id bigint, name string, reference_seq string"
)


def _varint(buf: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = buf[i]
        i += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, i
        shift += 7


def fields(buf: bytes):
    """(number, value) of every field; bytes for length-delimited ones."""
    i = 0
    while i < len(buf):
        tag, i = _varint(buf, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(buf, i)
        elif kind == 2:
            size, i = _varint(buf, i)
            value, i = buf[i : i + size], i + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, i = buf[i : i + size], i + size
        else:
            raise ValueError(f"unsupported wire type {kind}")
        yield tag >> 3, value


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _first(value) -> int:
    """First element of a repeated integer, packed or not."""
    return _varint(value, 0)[0] if isinstance(value, bytes) else value


def _mutation(buf: bytes, pos: int, par: int, mut: int) -> dict:
    out, seen = {"pos": 0, "par": "A", "mut": "A"}, False
    for n, v in fields(buf):
        if n == pos:
            out["pos"] = v
        elif n == par:
            out["par"] = BASES[v]
        elif n == mut and not seen and v != b"":
            out["mut"], seen = BASES[_first(v)], True
    return out


def unpack(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def _dag_rows(path: str, content: bytes):
    for n, v in fields(unpack(content)):
        if n == DAG_EDGES:
            e = {"edge_id": 0, "parent_id": 0, "child_id": 0, "clade_index": 0, "edge_weight": 0.0}
            muts = []
            for m, x in fields(v):
                if m == EDGE_ID:
                    e["edge_id"] = _signed(x)
                elif m == EDGE_PARENT:
                    e["parent_id"] = _signed(x)
                elif m == EDGE_CLADE:
                    e["clade_index"] = x
                elif m == EDGE_CHILD:
                    e["child_id"] = _signed(x)
                elif m == EDGE_MUTS:
                    muts.append(_mutation(x, MUT_POS, MUT_PAR, MUT_MUT))
                elif m == EDGE_WEIGHT:
                    e["edge_weight"] = struct.unpack("<f", x)[0]
            yield {"path": path, **e, "mutations": sorted(muts, key=lambda d: d["pos"])}
        elif n == DAG_NAMES:
            row = {"path": path, "name_id": 0, "name": None}
            for m, x in fields(v):
                if m == 1:
                    row["name_id"] = _signed(x)
                elif m == 2 and row["name"] is None:
                    row["name"] = x.decode()
            yield row
        elif n == DAG_REF_SEQ:
            yield {"path": path, "reference_seq": v.decode()}


def _decode(files: DataFrame, rows_of, schema: str) -> DataFrame:
    names = files.sparkSession.createDataFrame([], schema).columns
    arrow_schema = files.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(arrow_schema)
        for batch in batches:
            for row in batch.to_pylist():
                chunk = []
                for out in rows_of(row["path"], row["content"]):
                    chunk.append({c: out.get(c) for c in names})
                    if len(chunk) == 10000:
                        yield pa.RecordBatch.from_pylist(chunk, target)
                        chunk = []
                if chunk:
                    yield pa.RecordBatch.from_pylist(chunk, target)

    return files.select("path", "content").mapInArrow(run, schema)


def read_dag(spark: SparkSession, paths, by_folder: bool = False) -> HistoryDag:
    """DAG files as one container; ``dag_id`` is the file, or its folder for parts.

    Parts in a folder named like a file (``x.pb``), as ``write_dag`` makes them,
    are known as such; ``by_folder`` takes the files of any folder as parts.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).where(F.col("length") > 0)
    raw = cut(_decode(files, _dag_rows, EDGE_ROWS), "proto")
    parts = F.lit(True) if by_folder else F.col("path").rlike(r"\.pb(\.gz)?(/dag-[^/]*)?/part-[^/]*$")
    dag_id = F.when(parts, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.col("path"))
    raw = raw.withColumn("dag_id", dag_id)
    edges = raw.where(F.col("parent_id").isNotNull()).select(
        "dag_id", "edge_id", "parent_id", "child_id", "clade_index", "mutations", "edge_weight"
    )
    names = raw.where(F.col("name").isNotNull()).select(
        "dag_id", F.col("name_id").alias("node_id"), F.col("name").alias("sample_id")
    )
    heads = edges.select("dag_id", F.col("parent_id").alias("node_id"), F.lit(True).alias("head")).distinct()
    kids = edges.select("dag_id", F.col("child_id").alias("node_id"), F.lit(True).alias("kid")).distinct()
    nodes = heads.join(kids, ["dag_id", "node_id"], "full_outer").join(names, ["dag_id", "node_id"], "left")
    roots = nodes.where(F.col("kid").isNull()).groupBy("dag_id").agg(F.count(F.lit(1)).alias("n_roots"))
    kind = (
        F.when(F.col("kid").isNull(), "ua")
        .when(F.col("sample_id").isNotNull() | F.col("head").isNull(), "leaf").otherwise("inner")
    )
    one_root = F.when(F.col("n_roots") == 1, kind).otherwise(
        F.raise_error(F.lit("a DAG must have exactly one root"))
    )
    nodes = nodes.join(roots, "dag_id").select(
        "dag_id", "node_id", one_root.alias("kind"), "sample_id", F.array().cast(GENOME).alias("cg")
    )
    refs = raw.where(F.col("reference_seq").isNotNull()).groupBy("dag_id").agg(
        F.lit("").alias("reference_id"), F.max("reference_seq").alias("reference_seq")
    )
    dag = HistoryDag(cut(nodes, "nodes"), cut(edges, "edges"), cut(refs, "refs"))
    return name_leaves(recompute_genomes(dag))


MAT_ROWS = (
    "dag_id string, node_id bigint, parent_id bigint, label string, clade_index int, "
    f"mutations {MUT_SQL}, condensed string, leaves array<string>"
)


def _mat_rows(path: str, content: bytes):
    newick, lists = "", []
    for n, v in fields(unpack(content)):
        if n == MAT_NEWICK:
            newick = v.decode()
        elif n == MAT_MUTS:
            lists.append([_mutation(x, MAT_POS, MAT_PAR, MAT_MUT) for m, x in fields(v) if m == 1])
        elif n == MAT_CONDENSED:
            got = list(fields(v))
            yield {
                "dag_id": path, "condensed": next((x.decode() for m, x in got if m == 1), ""),
                "leaves": [x.decode() for m, x in got if m == 2],
            }
    for node, parent, label, _, clade, order in newick_rows(newick):
        muts = lists[order] if order < len(lists) else []
        yield {
            "dag_id": path, "node_id": node, "parent_id": parent, "label": label,
            "clade_index": clade, "mutations": sorted(muts, key=lambda d: d["pos"]),
        }


def read_parsimony(spark: SparkSession, paths, reference: str, as_alternatives: bool = False) -> HistoryDag:
    """Parsimony trees: topology, mutations in preorder, condensed leaves expanded.

    Every expanded leaf becomes a sibling in a clade of its own; with
    ``as_alternatives`` all share the clade of the condensed leaf.
    """
    files = spark.read.format("binaryFile").load(paths)
    raw = cut(_decode(files, _mat_rows, MAT_ROWS), "parsimony")
    tree = raw.where(F.col("node_id").isNotNull())
    dag = topology(tree.select("dag_id", "node_id", "parent_id", "label", "clade_index"), reference)
    muts = tree.select("dag_id", F.col("node_id").alias("child_id"), F.col("mutations").alias("m"))
    edges = dag.edges.join(muts, ["dag_id", "child_id"]).withColumn("mutations", F.col("m")).drop("m")
    groups = raw.where(F.col("condensed").isNotNull()).select(
        "dag_id", F.col("condensed").alias("sample_id"), "leaves"
    ).where(F.size("leaves") > 0)
    hit = dag.nodes.where("kind = 'leaf'").join(groups, ["dag_id", "sample_id"]).select(
        "dag_id", "node_id", "leaves"
    )
    size = edges.groupBy("dag_id", "parent_id").agg((F.max("clade_index") + 1).alias("next"))
    home = hit.join(edges.withColumnRenamed("child_id", "node_id"), ["dag_id", "node_id"]).join(
        size, ["dag_id", "parent_id"]
    )
    from pyspark.sql import Window

    earlier = Window.partitionBy("dag_id", "parent_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    home = home.withColumn("offset", F.coalesce(F.sum(F.size("leaves") - 1).over(earlier), F.lit(0)))
    top = tree.groupBy("dag_id").agg((F.max("node_id") + 1).alias("top"))
    spread = Window.partitionBy("dag_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    ids = hit.withColumn("start", F.coalesce(F.sum(F.size("leaves") - 1).over(spread), F.lit(0))).select(
        "dag_id", "node_id", "start"
    )
    extra = home.join(ids, ["dag_id", "node_id"]).join(top, "dag_id").select(
        "*", F.posexplode(F.slice("leaves", F.lit(2), F.greatest(F.size("leaves") - 1, F.lit(0)))).alias("j", "leaf")
    )
    new_id = (F.col("top") + F.col("start") + F.col("j")).cast("bigint")
    clade = F.col("clade_index") if as_alternatives else (F.col("next") + F.col("offset") + F.col("j")).cast("int")
    new_edges = extra.select(
        "dag_id", new_id.alias("edge_id"), "parent_id", new_id.alias("child_id"),
        clade.alias("clade_index"), "mutations", "edge_weight",
    )
    new_nodes = extra.select(
        "dag_id", new_id.alias("node_id"), F.lit("leaf").alias("kind"), F.col("leaf").alias("sample_id"),
        F.array().cast(GENOME).alias("cg"),
    )
    renamed = dag.nodes.join(hit.select("dag_id", "node_id", F.col("leaves")[0].alias("first")), ["dag_id", "node_id"], "left").withColumn(
        "sample_id", F.coalesce("first", "sample_id")
    ).select(*dag.nodes.columns)
    full = HistoryDag(
        renamed.unionByName(new_nodes),
        edges.select(*new_edges.columns).unionByName(new_edges),
        dag.refs,
    )
    return name_leaves(recompute_genomes(materialise(full, "parsimony")))


def _enc_varint(v: int) -> bytes:
    v &= (1 << 64) - 1
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


def _enc(number: int, value) -> bytes:
    """One field; proto3 leaves zero scalars out."""
    if isinstance(value, bytes):
        return _enc_varint(number << 3 | 2) + _enc_varint(len(value)) + value
    return _enc_varint(number << 3) + _enc_varint(value) if value else b""


def _encode_edge(r: dict) -> bytes:
    body = _enc(EDGE_ID, r["edge_id"]) + _enc(EDGE_PARENT, r["parent_id"])
    body += _enc(EDGE_CLADE, r["clade_index"]) + _enc(EDGE_CHILD, r["child_id"])
    for m in r["mutations"] or []:
        mut = _enc(MUT_POS, m["pos"]) + _enc(MUT_PAR, BASES.index(m["par"]))
        mut += _enc(MUT_MUT, _enc_varint(BASES.index(m["mut"])))
        body += _enc(EDGE_MUTS, mut)
    if r["edge_weight"]:
        body += _enc_varint(EDGE_WEIGHT << 3 | 5) + struct.pack("<f", r["edge_weight"])
    return _enc(DAG_EDGES, body)


def dense_ids(nodes: DataFrame) -> DataFrame:
    """(dag_id, node_id, id): 0 for pseudo-roots, 1.. for the rest, without one big sort task."""
    rest = nodes.where("kind <> 'ua'").select("dag_id", "node_id")
    placed = cut(
        rest.select("*", F.spark_partition_id().alias("p"), (F.monotonically_increasing_id() % (1 << 33)).alias("i")),
        "ids",
    )
    # One row per partition: a bounded prefix sum.
    from pyspark.sql import Window

    starts = placed.groupBy("p").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "start", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    numbered = placed.join(starts, "p").select("dag_id", "node_id", (F.col("start") + F.col("i") + 1).alias("id"))
    uas = nodes.where("kind = 'ua'").select("dag_id", "node_id", F.lit(0).cast("bigint").alias("id"))
    return numbered.unionByName(uas)


def encoded_rows(dag: HistoryDag, scores: DataFrame | None = None) -> DataFrame:
    """(dag_id, bytes): every row is a fragment of the DAG's message.

    ``scores`` (dag_id, edge_id, score) replaces the edge weights.
    """
    ids = cut(dense_ids(dag.nodes), "dense")
    parent = ids.withColumnsRenamed({"node_id": "parent_id", "id": "pid"})
    child = ids.withColumnsRenamed({"node_id": "child_id", "id": "cid"})
    edges = dag.edges
    if scores is not None:
        edges = edges.join(scores, ["dag_id", "edge_id"], "left").withColumn(
            "edge_weight", F.coalesce("score", "edge_weight")
        ).drop("score")
    none = F.lit(None)
    rows = (
        edges.join(parent, ["dag_id", "parent_id"]).join(child, ["dag_id", "child_id"])
        .select("dag_id", F.lit("edge").alias("what"), F.col("cid").alias("edge_id"), F.col("pid").alias("parent_id"),
                F.col("cid").alias("child_id"), "clade_index", "mutations", F.col("edge_weight").cast("double").alias("edge_weight"),
                none.cast("string").alias("text"))
    )
    names = dag.nodes.join(ids, ["dag_id", "node_id"]).select(
        "dag_id", F.lit("name").alias("what"), F.col("id").alias("edge_id"), none.cast("bigint").alias("parent_id"),
        none.cast("bigint").alias("child_id"), none.cast("int").alias("clade_index"),
        none.cast(MUTATIONS).alias("mutations"), none.cast("double").alias("edge_weight"),
        F.when(F.col("kind") == "leaf", F.col("sample_id")).alias("text"),
    )
    refs = dag.refs.select(
        "dag_id", F.lit("ref").alias("what"), none.cast("bigint").alias("edge_id"), none.cast("bigint").alias("parent_id"),
        none.cast("bigint").alias("child_id"), none.cast("int").alias("clade_index"),
        none.cast(MUTATIONS).alias("mutations"), none.cast("double").alias("edge_weight"),
        F.col("reference_seq").alias("text"),
    )

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["what"] == "edge":
                    out.append(_encode_edge(r))
                elif r["what"] == "name":
                    label = _enc(2, r["text"].encode()) if r["text"] else b""
                    out.append(_enc(DAG_NAMES, _enc(1, r["edge_id"]) + label))
                else:
                    out.append(_enc(DAG_REF_SEQ, r["text"].encode()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r for r in batch.column("dag_id").to_pylist()]), pa.array(out, pa.binary())],
                names=["dag_id", "bytes"],
            )

    return rows.unionByName(names).unionByName(refs).mapInArrow(run, "dag_id string, bytes binary")


def write_dag(dag: HistoryDag, folder: str, compress: bool = False, scores: DataFrame | None = None) -> None:
    """Part files ``<folder>/part-NNNNN.pb[.gz]``, or a folder ``dag-<id>`` each for several DAGs.

    ``folder`` is a path or address that Arrow's file systems reach from every
    task (a shared mount, HDFS, an object store).  A part appears under its name
    when it is whole and a rerun task replaces it, so a lost executor does no harm.
    """
    several = dag.refs.select("dag_id").distinct().limit(2).count() > 1
    suffix = ".pb.gz" if compress else ".pb"

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        ctx = TaskContext.get()
        held, size = {}, 0
        for batch in batches:
            for dag_id, b in zip(batch.column("dag_id").to_pylist(), batch.column("bytes").to_pylist()):
                where = f"{base}/dag-{quote(dag_id, safe='')}" if several else base
                if where not in held:
                    store.create_dir(where, recursive=True)
                    stream = store.open_output_stream(f"{where}/.part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}", compression=None)
                    held[where] = (stream, gzip.GzipFile(fileobj=stream, mode="wb") if compress else stream)
                held[where][1].write(b)
                size += len(b)
        for where, (stream, out) in held.items():
            out.close()
            stream.close()
            store.move(f"{where}/.part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}", f"{where}/part-{ctx.partitionId():05d}{suffix}")
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64())], names=["size"])

    # Written from a materialised table in the DAGs' order, so a rerun task sees
    # the same rows and holds few files open.
    rows = cut(encoded_rows(dag, scores), "encoded").select("dag_id", "bytes")
    if several:
        rows = rows.sortWithinPartitions("dag_id")
    rows.mapInArrow(run, "size bigint").agg(F.sum("size")).collect()
