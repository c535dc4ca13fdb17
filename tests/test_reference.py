"""The library's operators: DuckDB on the same tables, hand-checked cases, invariants, planted truth."""

import glob
import io
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lumenfold import queries as Q
from lumenfold.functions import metadata as M, peaks as P, vectors as V
from lumenfold.operators import decompose, encode, evaluate, filters, pivot, retrieve, score, simulate
from lumenfold.plans import workflows
from lumenfold.sources import cache, matrices, readers, runs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(Q.SQL))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    a, b = Q.QUERIES[name](spark, SF).toPandas(), con.execute(Q.SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    for c in cols:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_entry_and_keys(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def peaks(spark, *lists):
    return spark.createDataFrame([(i, [{"mz": float(m), "intensity": float(x)} for m, x in p]) for i, p in enumerate(lists)], "id long, peaks array<struct<mz:double,intensity:double>>")


def test_peaks_are_dealt_into_tasks_of_bounded_size(spark, monkeypatch):
    """More rows than the session's shuffle partitions should hold: more tasks, the same peaks."""
    few = sorted(Q.merge_peaks(spark, SF).collect())
    monkeypatch.setattr(Q, "ROWS", 500)
    assert Q.peak_rows(spark, SF).rdd.getNumPartitions() == -(-Q.table(spark, SF, "lineitem").count() // 500) > 4
    assert sorted(Q.merge_peaks(spark, SF).collect()) == few


def test_merge_and_chain(spark):
    rows = spark.createDataFrame([(1, 0, 0.5, 100.0, 100.0), (1, 0, 0.5, 200.0, 50.0), (1, 1, 0.5, 100.005, 40.0)], "id long, component int, weight double, mz double, intensity double")
    got = sorted(tuple(r)[1:] for r in simulate.merge_peaks(rows, "id").collect())
    assert got == [pytest.approx((100.0025, 1000.0)), pytest.approx((200.0, 250.0))]
    rows = spark.createDataFrame([(1, 100.0, 1.0), (1, 100.008, 1.0), (1, 100.016, 1.0)], "id long, mz double, intensity double")
    assert [r.mz for r in simulate.chain(rows, "id").collect()] == [pytest.approx(100.008)]


def test_edges_of_bins_and_tokens(spark):
    df = peaks(spark, [(100.1, 1), (100.5, 1), (101.5, 1)])
    assert encode.binned(df, "id", clean=False).agg(F.min("bin")).first()[0] == 1000
    assert df.select(F.transform("peaks", lambda p: P.token_ids(p.mz))).first()[0] == [100, 100, 102]


def test_metadata_in_containers(spark):
    """Order of places and names, nested lists, broken JSON, quotes, bytes, missing containers; one with null as its value."""
    get = lambda rows, schema, *names, **how: [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).transform(lambda d: d.select(M.metadata_value(d, *names, **how))).collect()]
    texts = ['{"a": [["x"]], "b": 1}', '{"a": [], "b": 2.5}', '{"a": null, "b": true}', "{broken", None, '{"metadata": {"b": "in"}}', "[1]", '{"b": {"c": 1}}']
    assert get([(t,) for t in texts], "metadata string", "a", "b") == ["x", "2.5", "true", None, None, "in", None, '{"c":1}']
    assert get([("top", {"a": "map"}), (None, {"a": "map"}), (None, {}), (None, None)], "b string, obs map<string,string>", "a", "b") == ["top", "map", None, None]
    assert get([({"metadata": {"a": "deep"}},), ({"metadata": {}},)], "item map<string,map<string,string>>", "a") == ["deep", None]
    assert get([([bytearray(b"p\xffos")],), ([],), (None,)], "`od.d` array<binary>", "od.d") == ["pos", None, None]
    assert get([('{"it\'s": 1, "say \\"x\\"": 2}',)], "metadata string", "it's") == ["1"]
    assert get([((7, ("n",)),)], "obs struct<z:int,metadata:struct<a:string>>", "a", "z") == ["7"]  # a container's own fields before its metadata's
    assert get([(1,)], "other int", "a") == [None]
    with pytest.raises(ValueError):
        get([("{}",)], "metadata string", "both'\"")


def test_ion_modes(spark):
    c = F.lit("[M-H2O+H]+")
    got = spark.range(1).select(M.infer_ion_mode(c, legacy=True), M.infer_ion_mode(c), M.normalize_ion_mode(F.lit("-1"), True), M.normalize_ion_mode(F.lit("-1")), M.normalize_ion_mode(F.lit("esi-"))).first()
    assert list(got) == ["negative", "positive", "positive", "negative", "negative"]


def test_normalized_ion_modes(spark):
    row = lambda legacy: list(spark.range(1).select(*[M.normalize_ion_mode(F.lit(x), legacy).alias(str(k)) for k, x in enumerate(("ESI pos", "esi+ms", "mode neg", "n/a", "inf", "0", "-1", -1, 2.0, 0))]).first())
    assert row(False) == ["positive", "positive", "negative", None, None, None, "negative", "negative", "positive", None]
    assert row(True) == ["positive", "positive", "negative", None, None, None, "positive", "negative", "positive", None]


def test_empty_and_invalid_peaks(spark):
    df = peaks(spark, [], [(0, 5), (10, 0), (float("nan"), 1), (20, float("inf"))], [(5, 4), (7, 4), (6, 4)])
    clean, modes = df.select(P.clean_peaks(F.col("peaks"), 2).alias("p")).collect(), [df.select(P.scale(F.col("peaks"), m)).count() for m in ("max", "sum", "sqrt", "log1p", "none")]
    assert [[(x.mz, x.intensity) for x in r.p] for r in clean] == [[], [], [(5.0, 1.0), (6.0, 1.0)]] and modes == [3] * 5
    masks = df.select(P.padding_mask(P.valid_peaks(F.col("peaks")), 4).alias("m")).collect()
    assert masks[0].m == [False, True, True, True] and masks[2].m == [False, False, False, True]
    assert df.select(P.padded(P.pack(F.col("peaks"), 4), 4).alias("x")).collect()[2].x.mz == [5.0, 6.0, 7.0, 0.0]


def test_zero_and_bad_vectors(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, [float("nan"), 1.0])], "id long, embedding array<double>")
    assert df.select(V.unit(F.col("embedding")).alias("u")).collect()[0].u == [0.0, 0.0]
    with pytest.raises(ValueError):
        V.require_usable(df)
    top = retrieve.topk_cosine(df.withColumnRenamed("id", "query_index"), df.withColumnRenamed("id", "library_index"), 9).collect()
    assert {r.query_index for r in top} == {0, 1} and len(top) == 4


def test_topk_forms_agree_at_any_partitioning_and_with_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    q, lib = df.withColumnRenamed("id", "query_index"), df.withColumnRenamed("id", "library_index")
    forms = [retrieve.topk_cosine(q.repartition(p), lib.repartition(7 - p), 5, s, block=40) for p, s in ((1, "block"), (5, "partitioned"), (3, "auto"))]
    got = [sorted(tuple(r) for r in f.collect()) for f in forms]
    assert got[0] == got[1] == got[2]
    x = np.array([r[1] for r in rows])
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    s = np.round(u @ u.T, 12)
    for i, k, j, _ in got[0]:
        assert np.lexsort((np.arange(150), -s[i]))[k - 1] == j
    assert retrieve.topk_cosine(q, lib.limit(0), 5).count() == 0 and retrieve.topk_cosine(q.limit(0), lib, 5).count() == 0


@pytest.mark.parametrize(("n", "k"), [(900, 7), (300, 299), (40, 100)])
def test_products_in_chunks_give_the_best_of_all(monkeypatch, n, k):
    """Many equal vectors, so that ties stand across chunks; lists stay far below all products."""
    monkeypatch.setattr(retrieve, "CHUNK", 64)
    x = retrieve._matrix(list(np.tile(np.random.default_rng(1).normal(size=(30, 5)), (30, 1))[:n]))
    ids = np.arange(n) * 2
    got, want = retrieve._best(x[:20], ids[:20], x, ids, k), retrieve._best_of(np.round(x[:20] @ x.T, 12), ids[:20], ids, k)
    assert got[["query_index", "library_index"]].to_numpy().tolist() == want[["query_index", "library_index"]].to_numpy().tolist()


def test_blocks_grow_with_the_table(spark, monkeypatch):
    """A vector's copies are bounded by SIDE until blocks are full; a library that is not broadcast gives the same rows."""
    assert [retrieve.blocks(n, 200) for n in (0, 200, 201, 2_000, 200_000, 240_000, 1_000_000)] == [1, 1, 2, 10, 12, 12, 50]
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(60)], "id long, embedding array<double>")
    q, lib = df.withColumnRenamed("id", "query_index"), df.withColumnRenamed("id", "library_index")
    whole = sorted(retrieve.topk_cosine(q, lib, 5, "block").collect())
    monkeypatch.setattr(retrieve, "LIMIT", 8)
    assert sorted(retrieve.topk_cosine(q, lib, 5, "block", block=20).collect()) == whole


@pytest.mark.parametrize(
    ("n", "conf", "mcs", "atoms", "exact", "want", "level"),
    [(10, None, 6, 8, 0, 0.5425, "Medium"), (10, None, 4, 8, 0, 0.2050, "Low"), (10, 0.8, 10, 10, 1, 0.94, "High"), (10, 0.5, 3, 0, 0, 0.5, "Medium"), (10, 0.9, 0, 10, 0, 0.0, "Low"), (None, None, None, 10, 0, 0.0, "Low")],
)
def test_backbone_confidence(spark, n, conf, mcs, atoms, exact, want, level):
    c = spark.createDataFrame([("m", 1, 0, 5, 1, 0.9, "S" if exact else "T", atoms)], "method string, query_index long, cluster long, library_index long, rank long, similarity double, candidate_scaffold string, candidate_scaffold_atoms long")
    rows = [] if n is None else [("m", 1, 0, "", "S", n, 0.0, 0.0, conf, mcs, 0, False)]
    from lumenfold.schemas import EVIDENCE

    r = score.backbone_confidence(c, spark.createDataFrame(rows, EVIDENCE)).first()
    assert (round(r.backbone_confidence, 4), r.confidence_level, r.passes) == (want, level, want >= 0.4)
    assert score.recommend(score.backbone_confidence(c, score.no_evidence(c))).count() == 0
    assert score.backbone_confidence(c, None).first().reason == "cluster_size_only_no_mcs"


def test_accuracy_case(spark):
    r = evaluate.accuracy(spark.createDataFrame([(2, 2), (2, 3), (3, 3), (3, None)], "true_component_count long, predicted_component_count long")).first()
    assert (r.n_eval, round(r.overall_accuracy, 6), r.accuracy_true_2, r.accuracy_true_3) == (3, 0.666667, 0.5, 1.0)


def test_planted_decomposition():
    rng = np.random.default_rng(4)
    assert decompose.precursor_groups(np.concatenate([rng.normal(m, 0.01, 12) for m in (100, 150, 300)])) == 3
    assert decompose.precursor_groups(np.array([5.0])) == 1 and decompose.precursor_groups(np.full(9, 7.0)) == 1
    scores = np.concatenate([np.linspace(0.95, 0.9, 30), np.linspace(0.5, 0.45, 40)])
    assert decompose.adaptive_k(scores) == (30, 2)
    assert decompose.adaptive_k(np.full(50, 0.9))[0] == 50 and decompose.adaptive_k(np.array([0.9]))[0] == 1
    x = np.array([[1, 0], [0, 1], [1, 0.01], [0.01, 1], [1, 0.02]])
    assert decompose.clusters(x, 2).tolist() == [0, 1, 0, 1, 0] and decompose.clusters(x, 9).tolist() == [0, 1, 2, 3, 4]
    assert len(decompose.clusters(np.zeros((0, 2)), 3)) == 0


def library(spark):
    return Q.with_precursor(spark, SF).select(F.col("id").alias("library_index"), "precursor_mz", "peaks", F.lit(1).cast("long").alias("charge"), F.concat(F.lit("k"), F.col("id") % 50).alias("inchikey"), F.concat(F.lit("C"), "id").alias("smiles"), F.lit("n").alias("name"), F.lit("a").alias("adduct"), F.size("peaks").alias("num_peaks"))


def test_simulation_is_the_same_at_any_partitioning(spark):
    lib = library(spark)
    a, b = ({r.query_index: r for r in simulate.simulate(lib.repartition(p), 30, 30).collect()} for p in (1, 6))
    assert a == b and len(a) == 60
    for i, r in a.items():
        k = 2 if i < 30 else 3
        assert r.component_count == k == len(set(r.source_index)) == len(set(r.inchikey.split(" | "))) and math.isclose(sum(r.mixing_weights), 1) and min(r.mixing_weights) >= 0.05
        assert r.dia_window_lower <= min(r.precursor_mz_list) and max(r.precursor_mz_list) < r.dia_window_upper and max(p.intensity for p in r.peaks) == 1000
        assert r.chimera_id == f"chimera_{'AB' if k == 2 else 'ABC'}_{i:06d}"


def test_draws_have_distinct_keys_or_are_left_out(spark):
    """Window 1 has one key, window 2 two keys of unequal share, window 3 members without keys."""
    rows = [(1, i, "A") for i in range(1, 5)] + [(2, i, "A") for i in range(1, 8)] + [(2, 8, "B")] + [(3, i, "") for i in range(1, 4)]
    lib = spark.createDataFrame(rows, "window_id long, place long, inchikey string")
    drawn: dict[int, list] = {}
    for r in simulate.draw(lib, 60, 60).collect():
        drawn.setdefault(r.query_index, []).append(r)
    assert {(x[0].window_id, x[0].kind) for x in drawn.values()} == {(2, "AB"), (3, "AB"), (3, "ABC")}
    key = {(w, p): k or p for w, p, k in rows}
    assert all(len({key[r.window_id, r.place] for r in x}) == len(x) == (2 if i < 60 else 3) for i, x in drawn.items())
    assert all(len({r.window_id for r in x}) == 1 and math.isclose(sum(r.weight for r in x), 1) for x in drawn.values())


def test_every_mixture_is_drawn_beside_windows_of_one_key(spark):
    rows = [(1, i, "A") for i in range(1, 9)] + [(2, i, k) for i, k in enumerate("AAAB", 1)] + [(3, i, k) for i, k in enumerate("ABC", 1)]
    frame = lambda x: spark.createDataFrame(x, "window_id long, place long, inchikey string")
    key = {(w, p): k for w, p, k in rows}
    drawn: dict[int, list] = {}
    for r in simulate.draw(frame(rows), 40, 40).collect():
        drawn.setdefault(r.query_index, []).append(key[r.window_id, r.place])
    assert set(drawn) == set(range(80)) and all(len(x) == len(set(x)) == (2 if i < 40 else 3) for i, x in drawn.items())
    with pytest.raises(Exception, match="distinct keys"):
        simulate.draw(frame(rows[:12]), 2, 2).collect()


def test_mixtures_are_drawn_in_several_tasks(spark, monkeypatch):
    """a join's few bytes are merged into one task, which then drew all mixtures."""
    plans, write = [], simulate.settled
    monkeypatch.setattr(simulate, "settled", lambda df: plans.append(df._jdf.queryExecution().toString()) or write(df))
    lib = spark.createDataFrame([(w, i, f"k{i}") for w in range(3) for i in range(1, 6)], "window_id long, place long, inchikey string")
    assert simulate.draw(lib, 3_000, 3_000).select("query_index").distinct().count() == 6_000
    assert "REPARTITION_BY_NUM" in plans[0] and ", 3), REPARTITION_BY_NUM" in plans[0]


def test_registered_simulation_has_production_numbers(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(simulate, "simulate", lambda rows, *n: asked.append(n))
    Q.QUERIES["simulated_mixtures"](spark, SF)
    assert asked == [(100_000, 100_000)]


def test_places_number_every_member_once(spark):
    df = spark.range(1000).select(F.col("id").alias("library_index"), (F.col("id") % 3).alias("window_id"))
    for r in simulate.places(df, 16).groupBy("window_id").agg(F.array_sort(F.collect_list("place")).alias("p")).collect():
        assert r.p == list(range(1, len(r.p) + 1)) and len(r.p) in (333, 334)


def test_npy_npz_and_pairs(spark, tmp_path):
    np.save(tmp_path / "library_binned.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    np.savez(tmp_path / "q.other.npz", embedding=np.ones((2, 1, 2)), method="binned", precursor_mz=[1.0, 2.0], smiles=["C", "O"])
    rows = {(r.method, r.query_index): r for r in readers.read_embeddings(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [("binned", i) for i in range(5)]  # one numbering over both files
    got = readers.read_embeddings(spark, str(tmp_path)).where("smiles is not null").orderBy("query_index").collect()
    assert [(r.method, r.precursor_mz, r.smiles, list(r.embedding)) for r in got] == [("binned", 1.0, "C", [1.0, 1.0]), ("binned", 2.0, "O", [1.0, 1.0])]


def test_mzml(spark, tmp_path):
    import base64
    import zlib

    def array(values, kind, packed):
        raw = np.array(values, "<f8").tobytes()
        return f'<binaryDataArray><cvParam accession="MS:1000523"/><cvParam accession="{kind}"/>{"<cvParam accession=" + chr(34) + "MS:1000574" + chr(34) + "/>" if packed else ""}<binary>{base64.b64encode(zlib.compress(raw) if packed else raw).decode()}</binary></binaryDataArray>'

    spectrum = lambda i, level, mz, x: f'<spectrum index="{i}" id="scan={i}"><cvParam accession="MS:1000511" value="{level}"/><cvParam accession="MS:1000130"/><selectedIon><cvParam accession="MS:1000744" value="{100 + i}"/></selectedIon>{array(mz, "MS:1000514", i % 2)}{array(x, "MS:1000515", i % 2)}</spectrum>'
    (tmp_path / "a.mzML").write_text("<mzML xmlns='http://psi.hupo.org/ms/mzml'>" + spectrum(0, 1, [50.5], [1]) + spectrum(1, 2, [60.25, 70], [5, 0]) + spectrum(2, 2, [], []) + "</mzML>")
    rows = filters.run_spectra(readers.read_mzml(spark, str(tmp_path / "a.mzML"))).collect()
    assert [(r.scan_id, r.precursor_mz, r.ionmode, [(p.mz, p.intensity) for p in r.peaks]) for r in rows] == [("scan=1", 101.0, "positive", [(60.25, 5.0)])]
    assert workflows.encode_run(spark, str(tmp_path / "a.mzML")).collect()[0].bin == 10


def test_workflows_and_cache(spark, tmp_path):
    library(spark).write.parquet(f"{tmp_path}/lib")
    made = workflows.encode_library(spark, f"{tmp_path}/lib", f"{tmp_path}/cache", size=1.0)
    again = workflows.encode_library(spark, f"{tmp_path}/lib", f"{tmp_path}/cache", size=1.0)
    other = workflows.encode_library(spark, f"{tmp_path}/lib", f"{tmp_path}/cache", size=2.0)
    assert made.inputFiles() == again.inputFiles() != other.inputFiles()
    assert cache.load_json(spark, made.inputFiles()[0].rsplit("/", 1)[0] + "_meta.json")["encoder"] == "binned"
    lib = Q.vectors(spark, SF, "library_index").withColumn("precursor_mz", 100 + 50 * F.col("label"))
    truth = Q.vectors(spark, SF, "query_index").select("query_index", F.lit(2).alias("component_count"))
    out = workflows.run_retrieval(spark, Q.vectors(spark, SF, "query_index"), lib, f"{tmp_path}/out", truth, config=workflows.RetrievalConfig(query_limit=20))
    assert set(out) == {"neighbors", "predictions", "accuracy"} and spark.read.parquet(out["predictions"]).count() == 20


def test_streaming_search(spark, tmp_path):
    from lumenfold.streaming.search import search_stream

    q = Q.vectors(spark, SF, "query_index").select("query_index", "embedding")
    q.limit(30).write.parquet(f"{tmp_path}/in")
    lib = Q.vectors(spark, SF, "library_index")
    search_stream(spark.readStream.schema(q.schema).parquet(f"{tmp_path}/in"), lib, f"file://{tmp_path}/out", f"{tmp_path}/cp", 3).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 90


def test_word_vectors_are_weighted_means(spark):
    """Against a loop: repeated, unknown and null words, null vectors, weights that count for nothing; dealt in any way."""
    rng, nan, inf = np.random.default_rng(5), float("nan"), float("inf")
    model = {f"w{k}": rng.normal(size=7).tolist() for k in range(30)} | {"none": None}
    rows = [(int(d), f"w{k}", float(x)) for d, k, x in zip(rng.integers(0, 40, 900), rng.integers(0, 35, 900), rng.random(900), strict=True)]
    rows += [(1, "w1", x) for x in (None, nan, inf, -inf, 0.0, -2.0)] + [(2, None, 1.0), (2, "none", 1.0), (90, "w1", 0.0), (91, "unknown", 1.0), (92, "none", 1.0), (93, "w2", 4.0)]
    vectors = spark.createDataFrame(list(model.items()), "word string, vector array<double>")
    docs = spark.createDataFrame(rows, "id int, word string, weight double")
    sums = {}
    for d, w, x in rows:
        if model.get(w) is not None and x is not None and 0 < x < inf:
            sums[d] = sums.get(d, 0) + x**0.5 * np.array(model[w])
    for tasks in (1, 7):
        got = {r.id: r.embedding for r in encode.word_vectors(docs.repartition(tasks), vectors, "id").collect()}
        assert got.keys() == sums.keys() and not got.keys() & {90, 91, 92}
        for d, v in sums.items():
            assert np.allclose(got[d], v / np.linalg.norm(v), atol=1e-12)
    assert encode.word_vectors(docs.limit(0), vectors, "id").count() == encode.word_vectors(docs, vectors.limit(0), "id").count() == 0


def test_word_vectors_by_shards(spark):
    """F8: small shards and blocks, a word with two vectors, a null key, a document in each shard; no vector is copied to a line."""
    rng = np.random.default_rng(6)
    model = [(f"w{k}", rng.normal(size=5).tolist()) for k in range(40)] + [("w3", [9.0, 0.0, 1.0, 0.0, 0.0])]
    rows = [(int(d), f"w{k}", float(x)) for d, k, x in zip(rng.integers(0, 50, 600), rng.integers(0, 45, 600), rng.random(600), strict=True)]
    rows += [(None, f"w{k}", 1.0) for k in range(40)] + [(77, f"w{k}", 2.0) for k in range(45) for _ in range(3)]
    sums = {}
    for d, w, x in rows:
        for word, v in model:
            if word == w:
                sums[d] = sums.get(d, 0) + x**0.5 * np.array(v)
    docs, vectors = spark.createDataFrame(rows, "id int, word string, weight double"), spark.createDataFrame(model, "word string, vector array<float>")
    for most in (1, 400, encode.MATRIX):
        made = encode.word_vectors(docs, vectors, "id", most=most)
        got = made.collect()
        assert len(got) == len(sums) and all(np.allclose(r.embedding, sums[r.id] / np.linalg.norm(sums[r.id]), atol=1e-6) for r in got)
    assert "ObjectHashAggregate" not in made._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="sizes"):
        encode.word_vectors(docs, vectors.union(spark.createDataFrame([("w44", [1.0])], vectors.schema)), "id")


def test_word_vectors_train_and_fall_back(spark):
    docs = encode.documents(Q.spectra(spark, SF).limit(20), "id", 0)
    model = encode.train_word_vectors(docs, "id", size=4, window=5, epochs=1)
    both = docs.withColumn("ion_mode", F.when(F.col("id") % 2 == 0, "negative"))
    assert encode.by_mode(both, {"positive": model}, "id").count() == docs.select("id").distinct().count()


def test_external_encoder_and_registry(spark):
    df = peaks(spark, [(1, 2)], [(3, 4)])
    encode.register("Mean", lambda s, key, **k: encode.external(s, key, lambda: lambda b: [[len(p), 1.0] for p in b["peaks"]], ("peaks",)))
    assert encode.encode("mean", df, "id").count() == 2
    with pytest.raises(ValueError):
        encode.encode("nothing", df, "id")
    with pytest.raises(ImportError):
        readers.read_h5(spark, "x.h5")
    with pytest.raises(ImportError):
        score.scaffolds(df)


def test_numbers_of_io():
    assert readers.library_path({"data": {"h5_path": "x"}}) == "x" and V.dense_gb(100_000, 20_000) == pytest.approx(7.45, abs=0.01)
    with pytest.raises(ValueError):
        np.load(io.BytesIO(b"\x80\x04}."), allow_pickle=False)


def test_path_keys_first_precursor_and_changed_files(spark, tmp_path):
    for key in ("source_path", "mona_hdf5_path", "mona_path", "library_path", "lib_path"):
        assert readers.library_path({key: "/x"}) == readers.library_path({"library": {key: "/x"}}) == "/x"
    param = lambda a, v: f'<cvParam accession="{a}" value="{v}"/>'
    ions = "".join(f"<precursor><selectedIon>{param('MS:1000744', v)}</selectedIon></precursor>" for v in (500.1, 300.2))
    (scan,) = readers.parse_mzml(f'<run><spectrum index="0" id="s">{param("MS:1000511", 2)}{ions}</spectrum></run>'.encode())
    assert scan["precursor_mz"] == 500.1 and scan["ms_level"] == 2
    (tmp_path / "a.bin").write_bytes(b"one")
    os.utime(tmp_path / "a.bin", (1, 1))
    old = cache.snapshot(spark, str(tmp_path))
    (tmp_path / "a.bin").write_bytes(b"two")
    assert cache.snapshot(spark, str(tmp_path)) != old
    df = spark.createDataFrame([(1, [3.0, 4.0])], "id long, DREAMS_EMBEDDING array<double>")
    assert [round(x, 6) for x in encode.stored(df, "id").first().embedding] == [0.6, 0.8]


def test_peak_columns_in_any_form(spark, tmp_path):
    rows = [(1, [[5.0, 7.0, 0.0], [1.0, 2.0, 0.0]], 300.0), (2, None, 310.0)]
    df = spark.createDataFrame(rows, "id long, Spectrum array<array<double>>, precursor_mz double")
    got = {r.id: r.peaks for r in readers.with_peaks(df).collect()}
    assert [tuple(p) for p in got[1]] == [(5.0, 1.0), (7.0, 2.0), (0.0, 0.0)] and got[2] is None
    pairs = spark.createDataFrame([(1, [[5.0, 1.0], [6.0, 2.0], [7.0, 3.0]])], "id long, mz_intensity array<array<double>>")
    assert [tuple(p) for p in readers.with_peaks(pairs).first().peaks] == [(5.0, 1.0), (6.0, 2.0), (7.0, 3.0)]
    for bad in (spark.range(1), spark.range(1).withColumn("peaks", F.array(F.lit(1.0)))):
        with pytest.raises(ValueError):
            readers.with_peaks(bad)
    df.withColumn("DreaMS_embedding", F.array(F.lit(1.0))).write.parquet(f"{tmp_path}/lib")
    lib, column = readers.load_library(spark, {"mona": {"source_path": f"{tmp_path}/lib"}})
    assert column == "DreaMS_embedding" and lib.count() == 2 and readers.resolve(spark, df) is df
    assert readers.resolve(spark, type("Table", (), {"path": f"{tmp_path}/lib"})()).count() == readers.resolve(spark, tmp_path / "lib").count() == 2
    with pytest.raises(TypeError):
        readers.resolve(spark, 3)


def test_dataset_columns_keep_types_and_dimensions():
    kinds = [(np.zeros(2, "i8"), "bigint"), (np.zeros((2, 3), "f4"), "array<float>"), (np.zeros(2), "double"), (np.array([b"a\xff", b"b"]), "string"), (np.array([["x", "y"]], object), "array<string>")]
    assert [readers.column_type(v.dtype, v.ndim) for v, _ in kinds] == [k for _, k in kinds]
    assert readers.column_values(kinds[3][0]) == ["a", "b"] and readers.column_values(kinds[4][0]) == [["x", "y"]] and readers.column_values(kinds[1][0]) == [[0.0] * 3] * 2


def test_parameter_groups_of_runs():
    param = lambda a, v="": f'<cvParam accession="{a}" value="{v}"/>'
    group = f'<referenceableParamGroupList><referenceableParamGroup id="g">{param("MS:1000511", 2)}{param("MS:1000129")}</referenceableParamGroup></referenceableParamGroupList>'
    (scan,) = readers.parse_mzml(f'<mzML>{group}<run><spectrum index="4" id="s"><referenceableParamGroupRef ref="g"/></spectrum></run></mzML>'.encode())
    assert (scan["scan_index"], scan["ms_level"], scan["ionmode"], scan["peaks"]) == (4, 2, "negative", [])


def test_padded_tokens_of_invalid_spectra(spark):
    df = peaks(spark, [(60, 1), (60.2, 2), (70, 4)], [(10, 1)], [], [(80, 1)])
    kept = {r.id: (r.token, r.intensity) for r in P.padded_tokens(df, "id", 3).collect()}
    assert kept == {0: ([60, 70, 0], [0.5, 1.0, 0.0]), 1: ([0, 0, 0], [0.0] * 3), 2: ([0, 0, 0], [0.0] * 3), 3: ([80, 0, 0], [1.0, 0.0, 0.0])}
    assert {r.id for r in P.padded_tokens(df, "id", 3, min_peaks=2, skip_invalid=True).collect()} == {0}
    assert P.padded_tokens(df.where("id = 0"), "id", 2, order="intensity").first().token == [70, 60]
    empty = {r.id: r.mask for r in P.raw_masked_inputs(df, "id", 2).collect()}
    assert empty[2] == [True, True] and empty[3] == [False, True]


def test_model_encoders_fall_back_to_single_rows_and_zeros(spark):
    def load():
        def model(rows):
            if len(rows) > 1:
                raise RuntimeError("no batches")
            n = int((np.asarray(rows.iloc[0, 1]) > 0).sum())
            if n == 1:
                raise RuntimeError("too few")
            return [[float("nan"), 1.0] if n == 0 else [[3.0, 4.0], [3.0, 4.0]]]

        return model

    df = peaks(spark, [(60, 1), (70, 2)], [(60, 1)], []).withColumn("precursor_mz", F.lit(300.0))
    for name in ("msbert", "specemb"):
        got = {r.id: [round(x, 6) for x in r.embedding] for r in encode.encode(name, df, "id", load=load, size=2).collect()}
        assert got == {0: [0.6, 0.8], 1: [0.0, 0.0], 2: [0.0, 0.0]}
    record = lambda: lambda rows: [[float(len(p)), float(m == "unknown")] for p, m in zip(rows["peaks"], rows["ionmode"], strict=True)]
    assert encode.encode("ms2deepscore", df, "id", load=record, size=2).count() == 3
    assert set(encode.ENCODERS) >= {"dreams", "spec2vec", "ms2deepscore", "binned", "neutral_loss_binned", "msbert", "specemb"}


def test_spec2vec_gives_every_spectrum_a_vector(spark):
    df = peaks(spark, [(60, 1), (70, 2)], [(61, 1)], []).withColumn("ion_mode", F.when(F.col("id") == 1, "negative"))
    model = spark.createDataFrame([("peak@60", [3.0, 4.0])], "word string, vector array<double>")
    got = {r.id: [round(x, 6) for x in r.embedding] for r in encode.encode("spec2vec", df, "id", models={"positive": model}, decimals=0).collect()}
    assert got == {0: [0.6, 0.8], 1: [0.0, 0.0], 2: [0.0, 0.0]}
    assert encode.spec2vec(df.where("id = 2"), "id", size=3).first().embedding == [0.0] * 3
    assert encode.spec2vec(df, "id", decimals=0, size=3, window=2, epochs=1).count() == 3


def test_sparse_topk_by_blocks_with_a_bin_of_all(spark):
    rng = np.random.default_rng(5)
    x = np.where(rng.random((60, 40)) < 0.1, rng.random((60, 40)), 0.0)
    x[:55, 0], x[55:] = 1.0, 0.0
    rows = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*x.nonzero(), strict=True)], "key long, bin long, value double")
    keys = spark.range(60)
    got = retrieve.topk_sparse(rows.withColumnRenamed("key", "query_index"), rows.withColumnRenamed("key", "library_index"), 7, keys.withColumnRenamed("id", "query_index"), keys.withColumnRenamed("id", "library_index"), block=13)
    got, s = sorted(tuple(r) for r in got.collect()), np.round(x @ x.T, 12)
    assert len(got) == 60 * 7
    for i, k, j, v in got:
        assert np.lexsort((np.arange(60), -s[i]))[k - 1] == j and v == pytest.approx(s[i, j], abs=1e-9)


def test_sparse_blocks_grow_and_their_queries_come_in_batches(spark, monkeypatch):
    """Of 60 vectors in blocks of 2 a side has 5 blocks, not 30, and the rows are those of one block."""
    rows = spark.range(60).select("id", F.explode(F.sequence(F.lit(0), F.col("id") % 7)).alias("bin")).withColumn("value", 1.0 + F.col("bin") * F.col("id") % 5)
    q, lib = rows.withColumnRenamed("id", "query_index"), rows.withColumnRenamed("id", "library_index")
    whole = sorted(retrieve.topk_sparse(q, lib, 4, block=100).collect())
    monkeypatch.setattr(retrieve, "SPARSE_QUERIES", 5)
    assert sorted(retrieve.topk_sparse(q, lib, 4, block=2).collect()) == whole
    assert [retrieve.blocks(n, 2_000, retrieve.SPARSE, retrieve.SPARSE_SIDE) for n in (1_000, 20_000, 360_000)] == [1, 5, 45]


def test_groups_of_many_lists_are_those_of_each():
    lists = [np.array(v) for v in ([], [5.0], [1.0, 1.0], [1.0] * 6 + [50.0] * 6, [float("nan"), 2.0, 90.0, 90.01], list(np.arange(30) * 7.0))]
    together = decompose.groups_of(lists, block=4)
    assert list(together) == [decompose.precursor_groups(v) for v in lists] and together[3] == 2 and list(together[:3]) == [1, 1, 1]


def test_candidates_can_be_kept_whole(spark):
    lib = Q.vectors(spark, SF, "library_index").limit(60).withColumn("precursor_mz", F.lit(None).cast("double"))
    topk = retrieve.topk_cosine(Q.vectors(spark, SF, "query_index").limit(3), lib, 50)
    got = decompose.decompose(topk, lib, adaptive=False).groupBy("query_index").agg(F.count("*").alias("n"), F.max("adaptive_k").alias("k"), F.max("cluster").alias("c")).collect()
    assert [(r.n, r.k, r.c) for r in got] == [(50, 50, 0)] * 3
    assert decompose.decompose(topk.limit(0), lib).count() == 0


def test_cached_search_saved_runs_and_evaluation_of_methods(spark, tmp_path):
    for side in ("q", "lib"):
        (tmp_path / side).mkdir()
    np.save(tmp_path / "q" / "a.binned.npy", np.eye(3, dtype=np.float32))
    np.save(tmp_path / "lib" / "library_binned.npy", np.eye(3, dtype=np.float32))
    search = lambda: workflows.cached_topk(spark, f"{tmp_path}/q", f"{tmp_path}/lib", f"{tmp_path}/cache", workflows.RetrievalConfig(k=1))
    assert sorted((r.query_index, r.library_index) for r in search().collect()) == [(0, 0), (1, 1), (2, 2)]
    before = sorted(os.listdir(tmp_path / "cache"))
    assert search().count() == 3 and sorted(os.listdir(tmp_path / "cache")) == before
    np.save(tmp_path / "lib" / "library_binned.npy", np.eye(3, dtype=np.float32)[::-1].copy())
    os.utime(tmp_path / "lib" / "library_binned.npy", (5, 5))
    assert sorted((r.query_index, r.library_index) for r in search().collect()) == [(0, 2), (1, 1), (2, 0)]
    rows = spark.createDataFrame([(1, 2, 2), (2, 3, 2)], "query_index long, predicted_component_count long, true_component_count long")
    rows.write.parquet(f"{tmp_path}/p")
    got = workflows.evaluate_methods(spark, {"b": f"{tmp_path}/p", "a": f"{tmp_path}/p"}, str(tmp_path / "out")).orderBy("method").collect()
    assert [(r.method, r.overall_accuracy, r.total_true_2) for r in got] == [("a", 0.5, 2), ("b", 0.5, 2)]
    scans = spark.createDataFrame([(0, "s0", 300.0, None), (1, "s1", 310.0, "positive")], "scan_index long, scan_id string, precursor_mz double, ionmode string")
    saved = workflows.save_run(spark, spark.createDataFrame([(1, [1.0])], "scan_index long, embedding array<float>"), scans, f"{tmp_path}/run", {"source": "x"})
    assert [(r.scan_id, r.precursor_mz, r.ionmode) for r in saved.collect()] == [("s1", 310.0, "positive")] and cache.load_json(spark, f"{tmp_path}/run_meta.json") == {"source": "x"}


def test_bytes_that_are_no_text_go(spark):
    assert spark.range(1).select(M.decoded(F.unhex(F.lit("61FF62")))).first()[0] == "ab"


def test_matrices_by_ranges_of_rows(spark, tmp_path):
    """Ranges, row and column order, bundles and numbering over all files; what is no matrix is refused."""
    rng = np.random.default_rng(3)
    parts = [rng.normal(size=(n, 3)).astype(np.float32) for n in (7, 0, 1, 5000, 4)]
    np.save(tmp_path / "a.npy", parts[0])
    np.save(tmp_path / "b.npy", parts[1])
    np.save(tmp_path / "c.npy", parts[2][None].astype(np.float64))
    np.savez_compressed(tmp_path / "d.npz", embeddings=parts[3], name=[f"n{i}" for i in range(5000)])
    np.save(tmp_path / "e.npy", np.asfortranarray(parts[4]))
    (tmp_path / "notes.txt").write_text("x")
    spark.dataSource.register(matrices.Matrices)
    rows = spark.read.format("lumenfold_matrices").option("bytes", 24).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() >= 4 + 1 + 1 + 1  # two rows of 12 bytes each
    got = sorted(rows.collect(), key=lambda r: r.row)
    assert [r.row for r in got] == list(range(5012)) and np.allclose(np.stack([r.embedding for r in got]), np.concatenate(parts))
    assert [r.name for r in got[8:5008]] == [f"n{i}" for i in range(5000)] and got[0].name is None
    for name, bad in (("f.npy", np.array([{}])), ("f.npy", np.zeros(3)), ("f.npy", np.zeros((2, 2, 2)))):
        folder = tmp_path / f"bad{bad.ndim}{bad.dtype.kind}"
        folder.mkdir()
        np.save(folder / name, bad)
        with pytest.raises(Exception, match="refused|no matrix"):
            readers.read_embeddings(spark, str(folder)).collect()


def test_searches_over_several_files_keep_all_vectors(spark, tmp_path):
    for side in ("q", "lib"):
        (tmp_path / side).mkdir()
    for k in range(2):
        np.save(tmp_path / "q" / f"part{k}.binned.npy", np.eye(4, dtype=np.float32)[2 * k : 2 * k + 2])
        np.save(tmp_path / "lib" / f"library_{k}.npy", np.eye(4, dtype=np.float32)[::-1][2 * k : 2 * k + 2])
    got = workflows.cached_topk(spark, f"{tmp_path}/q", f"{tmp_path}/lib", f"{tmp_path}/cache", workflows.RetrievalConfig(k=1)).collect()
    assert sorted((r.query_index, r.library_index) for r in got) == [(0, 3), (1, 2), (2, 1), (3, 0)]


def test_written_matrices_are_read_back(spark, tmp_path):
    df = spark.range(25).select((F.col("id") / 10).cast("int").alias("file"), F.col("id").alias("number"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    assert sorted(r.n for r in matrices.write_matrices(df.repartition(4), f"{tmp_path}/m").collect()) == [5, 10, 10]
    got = readers.read_embeddings(spark, f"{tmp_path}/m", "library_index").orderBy("library_index").collect()
    assert [list(r.embedding) for r in got] == [[float(i), 1.0] for i in range(25)]


def clustered(spark, seed=2):
    """Twelve tight clusters of 80, 300 copies of one vector, zero vectors, and what has no place."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8)) * 5
    x = [(centres[i % 12] + rng.normal(size=8) * 0.15).tolist() for i in range(960)] + [centres[0].tolist()] * 300 + [[0.0] * 8] * 3
    rows = [(i, v) for i, v in enumerate(x)] + [(2000, None), (2001, [float("nan")] * 8)]
    return spark.createDataFrame(rows, "library_index long, embedding array<double>").repartition(5)


@pytest.mark.parametrize(("k", "pivots", "block"), [(1, None, 20_000), (7, 40, 64), (350, None, 50), (5000, 9, 20_000)])
def test_pivot_search_is_exact(spark, k, pivots, block):
    lib = clustered(spark)
    queries = lib.where("library_index % 37 = 0 or library_index in (1000, 1261, 1262, 2000, 2001)").withColumnRenamed("library_index", "query_index")
    want = {tuple(r) for r in retrieve.topk_cosine(queries, lib, k).collect()}
    rows, visits = pivot.PivotIndex(lib, pivots, block).search(queries, k)
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == len(want) and set(got) == want
    seen = {r.query_index: r.vectors for r in visits.collect()}
    assert all(seen[q] >= min(k, 1263) for q in seen) and len(seen) == len({w[0] for w in want})
    if k == 7:  # a query of a tight cluster leaves most vectors alone
        assert np.median(list(seen.values())) < 0.5 * 1263


def test_pivot_search_copies_queries_by_part(spark):
    """without structure a query visits most cells, but is written once and meets at most SIDE parts; double queries keep their digits in a single library."""
    x = np.random.default_rng(3).normal(size=(3000, 6))
    lib = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "library_index long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:40] + 1e-9)], "query_index long, embedding array<double>")
    index = pivot.PivotIndex(lib, 60, 200)
    visits = index._visits(queries.withColumn("least", F.lit(-1.0)), 4, True).collect()
    assert len(visits) == 40 and min(r.cells for r in visits) > 50
    assert all(len(set(r.parts)) == len(r.parts) <= 15 and sum(b.bit_count() for v in r.bits for b in v) >= r.cells for r in visits)
    want = {tuple(r) for r in retrieve.topk_cosine(queries, lib, 4).collect()}
    for block in (200, None):
        assert {tuple(r) for r in pivot.topk_pivot(queries, lib, 4, 60, block).collect()} == want
    assert index._blocks(3000) == 15 and pivot.PivotIndex(lib)._blocks(100_000) == pivot.SIDE


def test_pivot_search_of_nothing(spark):
    lib = clustered(spark)
    queries = lib.withColumnRenamed("library_index", "query_index")
    assert pivot.topk_pivot(queries, lib.limit(0), 3).collect() == [] and pivot.topk_pivot(queries.limit(0), lib, 3).collect() == []
    with pytest.raises(ValueError, match="sizes"):
        pivot.topk_pivot(spark.createDataFrame([(1, [1.0, 2.0])], "query_index long, embedding array<double>"), lib, 3)


def test_positions_of_csv_rows(spark, tmp_path):
    """Many splits of a large file, small files that share a task, blank lines, quoted values and no header."""
    (tmp_path / "m").mkdir()
    want = []
    for name, n in (("b.csv", 4000), ("a.csv", 3), ("c.csv", 1), ("d.csv", 0)):
        lines = [f"{name}{i},\"x, {i}\"" for i in range(n)]
        (tmp_path / "m" / name).write_text("name,note\n" + "\n\n".join(lines) + "\n")
        want.append((name, lines))
    want = [line.split(",")[0] for _, lines in sorted(want) for line in lines]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = readers.read_positional(spark, f"{tmp_path}/m").collect()
        plain = readers.read_positional(spark, f"{tmp_path}/m/a.csv", header=False).orderBy("position").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.name for r in sorted(rows, key=lambda r: r.position)] == want and sorted(r.position for r in rows) == list(range(len(want)))
    assert [r.position for r in plain] == [0, 1, 2, 3] and plain[0]["_c0"] == "name"
    lib = spark.createDataFrame([(0, [1.0]), (len(want), [2.0])], "library_index long, embedding array<double>")
    assert [(r.library_index, r.name) for r in readers.join_positional(lib, spark.createDataFrame([tuple(r) for r in rows], "name string, note string, position long")).orderBy("library_index").collect()] == [(0, want[0]), (len(want), None)]


def test_unknown_weight_modes_are_refused():
    rng = np.random.default_rng(1)
    assert simulate.weights(2, rng, "equal") == [0.5, 0.5] and abs(sum(simulate.weights(3, rng, "uniform")) - 1) < 1e-12
    with pytest.raises(ValueError, match="unknown"):
        simulate.weights(2, rng, "normal")


def test_summaries_tell_what_is_not_finite(spark):
    """The refusing side: NaN, infinity and null count against the share and have no norm; all zeros are refused."""
    rows = [(1, [3.0, 4.0]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    r = V.summary(df).first()
    assert (r.n_rows, r.finite_ratio, r.min_norm, r.mean_norm, r.max_norm) == (4, 0.5, 0.0, 2.5, 5.0)
    for bad, said in ((df, "2 rows are not finite"), (df.where("id = 4"), "all vectors are zero")):
        with pytest.raises(ValueError, match=said):
            V.require_usable(bad)
    assert V.require_usable(df.where("id in (1, 4)")).count() == 2


def test_runs_in_pieces_equal_whole_runs(spark, tmp_path):
    rows = spark.range(60).select(F.lit(0).alias("file"), F.col("id").alias("number"), F.when(F.col("id") % 3 > 0, F.col("id") + 0.5).alias("precursor_mz"), F.expr("transform(sequence(1, int(id) % 5 + 1), i -> struct(double(i * 10) as mz, double(i) as intensity))").alias("peaks"))
    assert [r.n for r in runs.write_runs(rows, str(tmp_path)).collect()] == [60]
    values = lambda df: [(r.scan_index, r.scan_id, r.ms_level, str(r.precursor_mz), r.ionmode, r.peaks) for r in df.orderBy("scan_index").collect()]
    whole = values(readers.read_mzml(spark, str(tmp_path)))
    assert len(whole) == 60 and whole[4][5] == [(10.0 * i, 1.0 * i) for i in range(1, 6)] and whole[3][3] == "None"
    for size in (1_000, 7_777, 1 << 20):
        pieces = readers.read_mzml_pieces(spark, str(tmp_path), size)
        assert values(pieces) == whole
        assert (pieces.rdd.getNumPartitions() > 10) == (size < 2_000)


def test_many_ranges_share_tasks(spark, tmp_path):
    """Ranges far smaller than their number asks for: tasks stay bounded and all rows come, in files of one range and of many."""
    rows = spark.range(4_000).select(F.floor(F.col("id") / 40).alias("file"), F.col("id").alias("number"), F.lit(100.5).alias("precursor_mz"), F.expr("array(struct(double(id + 1) as mz, 1.0D as intensity))").alias("peaks"))
    assert runs.write_runs(rows, str(tmp_path / "r")).count() == 100
    held = readers.read_mzml_pieces(spark, str(tmp_path / "r"), 1_000)
    assert held.rdd.getNumPartitions() <= 256
    assert sorted(r.m for r in held.select(F.col("peaks")[0].mz.alias("m")).collect()) == [float(k + 1) for k in range(4_000)]
    for name, some in (("one", rows.where("file = 0").select(F.lit(0).alias("file"), F.explode(F.sequence(F.col("number") * 100, F.col("number") * 100 + 99)).alias("number"))), ("many", spark.range(400).select(F.col("id").alias("file"), F.col("id").alias("number")))):
        matrices.write_matrices(some.withColumn("embedding", F.array(F.col("number").cast("float"))), str(tmp_path / name)).count()
        spark.dataSource.register(matrices.Matrices)
        held = spark.read.format("lumenfold_matrices").option("bytes", 40).load(str(tmp_path / name))
        assert held.rdd.getNumPartitions() <= 256
        assert sorted((r.row, r.x) for r in held.select("row", F.col("embedding")[0].alias("x")).collect()) == [(k, float(k)) for k in range(some.count())]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_pieces_begin_once_in_any_range(size):
    held = [b'<spectrum index="0" id="a > b"/>', b"<p:spectrum\n id='/>'><x/></p:spectrum >", b'<spectrum id="' + b"y" * 900 + b'"><binary>' + b"A" * 3000 + b"</binary></spectrum>"]
    text = b'<mzML><spectrumList count="3">' + b"\n".join(held) + b'</spectrumList></mzML><index name="spectrum"></index>'
    found = [p for low in range(0, len(text), size) for p in runs.pieces(io.BytesIO(text), low, min(len(text), low + size), 300)]
    assert found == held
    with pytest.raises(ValueError, match="inside a spectrum"):
        list(runs.pieces(io.BytesIO(text[:200]), 0, 200))


def test_head_of_a_run_gives_groups_names_and_encoding():
    text = '<?xml version="1.0" encoding="ISO-8859-1"?><p:mzML xmlns:p="u"><p:referenceableParamGroup id="g"><p:cvParam accession="MS:1000129"/></p:referenceableParamGroup><p:run><p:spectrum id="\xe9"/>'
    groups, begin = runs.head(io.BytesIO(text.encode("latin-1")))
    assert groups == {"g": [("MS:1000129", None)]}
    piece = begin + '<p:spectrum id="\xe9"><p:referenceableParamGroupRef ref="g"/></p:spectrum>'.encode("latin-1") + b"</piece>"
    row = runs.spectrum(runs.ET.fromstring(piece)[0], groups)
    assert row["scan_id"] == "\xe9" and row["ionmode"] == "negative"
    with pytest.raises(ValueError, match="UTF-16"):
        runs.head(io.BytesIO(text.replace("ISO-8859-1", "UTF-16").encode("utf-16")))


def plain_groups(v, most=20, floor=1e-3):
    """EM by its definition, one list and one component at a time, every number of groups tried."""
    v, found, best = np.sort(v), 1, np.inf
    for k in range(1, min(most, len(np.unique(v))) + 1):
        at = (np.arange(k) + 0.5) / k * (len(v) - 1)
        mean, var, share = np.interp(at, np.arange(len(v)), v), np.full(k, max(v.var() / k**2, floor)), np.full(k, 1 / k)
        for _ in range(100):
            logs = np.log(share) - 0.5 * np.log(2 * np.pi * var) - 0.5 * (v[:, None] - mean) ** 2 / var
            like = np.logaddexp.reduce(logs, axis=1)
            r = np.exp(logs - like[:, None])
            mass = r.sum(axis=0) + 1e-9
            new = (r * v[:, None]).sum(axis=0) / mass
            var, share = np.maximum((r * (v[:, None] - new) ** 2).sum(axis=0) / mass, floor), mass / mass.sum()
            mean, off = new, np.abs(new - mean).max()
            if off < 1e-6:
                break
        bic = -2 * like.sum() + (3 * k - 1) * np.log(len(v))
        assert like.sum() <= decompose._most_likely(*np.unique(v, return_counts=True), floor) + 1e-6
        found, best = (k, bic) if bic < best - 1e-9 else (found, best)
    return found


def test_groups_that_leave_early_are_those_of_every_number_tried():
    rng = np.random.default_rng(8)
    lists = [np.round(rng.normal(rng.choice(rng.random(int(rng.integers(1, 6))) * 200, int(rng.integers(2, 60))), rng.choice([0.0, 0.02, 0.3])), 3) for _ in range(40)]
    assert decompose.groups_of(lists, block=16).tolist() == [plain_groups(v) for v in lists]


def test_a_task_of_queries_ends_with_their_whole_lists(spark, monkeypatch):
    """Queries in blocks which a library in packs passes: brute force's rows with ties, repeated and null keys; no window merges partial lists."""
    for name, value in {"PACK": 512, "STEP": 7, "QUERIES": 5, "PAIRS": 11}.items():
        monkeypatch.setattr(retrieve, name, value)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(60, 4)), np.tile(rng.normal(size=(1, 4)), (30, 1))])
    ids = [None, *range(1, 80), *range(70, 80)]
    for kind in ("float", "double"):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], f"id long, embedding array<{kind}>").repartition(3)
        held = np.array([r.embedding for r in df.collect()]), [r.id for r in df.collect()]
        u = held[0] / np.sqrt((held[0] ** 2).sum(axis=1, keepdims=True))
        for k in (3, 10, 500):
            got = retrieve.topk_cosine(df.withColumnRenamed("id", "query_index"), df.withColumnRenamed("id", "library_index"), k, "partitioned", block=20)
            want = []
            for q in set(held[1]):
                pairs = sorted(((-round(float(u[i] @ u[j]), 12), -1 if held[1][j] is None else held[1][j]) for i in range(90) if held[1][i] == q for j in range(90)))
                want += [(q, n, None if j < 0 else j, round(-s, 9)) for n, (s, j) in enumerate(pairs[:k], 1)]
            order = lambda r: (r[0] is None, r[0] or 0, r[1])
            rows = sorted(((r.query_index, r.rank, r.library_index, round(r.similarity, 9)) for r in got.collect()), key=order)
            assert rows == sorted(want, key=order)
        assert "Window" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("k", [1, 6, 40, 500])
def test_library_shown_in_packs_gives_the_best_of_all(monkeypatch, k):
    for name, value in {"STEP": 7, "QUERIES": 5, "PAIRS": 11}.items():
        monkeypatch.setattr(retrieve, name, value)
    rng = np.random.default_rng(k)
    x = retrieve._unit(np.concatenate([np.tile(rng.normal(size=(20, 5)), (8, 1)), rng.normal(size=(40, 5)), np.zeros((3, 5))]).astype(np.float32))
    ids, search = rng.permutation(len(x)), retrieve.Nearest(x[:23], k)
    for at in range(0, len(x), 16):
        search.show(x[at : at + 16], ids[at : at + 16])
    row, lib, sim = (np.concatenate(v) for v in zip(*search.found(), strict=True))
    s = retrieve._products_of(x, x, np.repeat(np.arange(23), len(x)), np.tile(np.arange(len(x)), 23)).reshape(23, -1)
    for i in range(23):
        best = np.lexsort((ids, -s[i]))[:k]
        assert lib[row == i].tolist() == ids[best].tolist() and sim[row == i].tolist() == s[i, best].tolist()


def test_kept_candidates_need_no_vectors_and_are_those_of_decompose(spark, monkeypatch):
    """Queries over batches of a few rows; what is counted of each is what one query's functions say."""
    monkeypatch.setattr(decompose, "ROWS", 150)
    rng = np.random.default_rng(9)
    lib = spark.createDataFrame([(i, float(100 + 50 * (i % 5)), rng.normal(size=6).tolist()) for i in range(90)], "library_index long, precursor_mz double, embedding array<double>")
    topk = retrieve.topk_cosine(lib.select(F.col("library_index").alias("query_index"), "embedding").limit(25), lib, 60)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
        rows = decompose.decompose(topk, lib, "m", k_min=5).collect()
        one = {r.query_index: r for r in decompose.kept(topk, lib.drop("embedding"), k_min=5).collect()}
        few = {r.query_index: r.adaptive_k for r in decompose.kept(topk, lib.drop("embedding"), k_min=5, groups=False).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    found, x = {}, {r.library_index: r.embedding for r in lib.collect()}
    for r in topk.collect():
        found.setdefault(r.query_index, []).append((r.rank, r.library_index, r.similarity))
    assert len(found) == len(one) == len(few) == 25
    for q, listed in found.items():
        listed = sorted(listed)
        k, m = decompose.adaptive_k(np.array([s for _, _, s in listed]), k_min=5, k_max=60)
        n = plain_groups(np.array([100 + 50 * (i % 5) for _, i, _ in listed[:k]], float))
        labels = decompose.clusters(np.array([x[i] for _, i, _ in listed[:k]]), n)
        mine = sorted((r for r in rows if r.query_index == q), key=lambda r: r.rank)
        assert [(r.rank, r.library_index, r.similarity, r.cluster) for r in mine] == [(*c, g) for c, g in zip(listed[:k], labels.tolist(), strict=True)]
        assert {(r.method, r.adaptive_k, r.original_knn_k, r.selected_segments, r.estimated_n_precursor_groups) for r in mine} == {("m", k, 60, m, n)}
        assert (one[q].adaptive_k, one[q].original_knn_k, one[q].selected_segments, one[q].estimated_n_precursor_groups, few[q]) == (k, 60, m, n, k)


@pytest.mark.parametrize("name", ["adaptive_k_summary", "component_predictions"])
def test_what_needs_no_clusters_makes_none(spark, name):
    """The rows are those of the whole neighbours, and one pass of Python less reads them."""
    made = {"adaptive_k_summary": decompose.summarize_k, "component_predictions": lambda n: evaluate.predictions(n, Q.vectors(spark, SF, "query_index").select("query_index", F.lit(2).cast("long").alias("component_count")))}
    rows = Q.neighbors(spark, SF)
    want = made[name](rows)
    got = Q.QUERIES[name](spark, SF)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    passes = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert passes(got) == passes(rows) - 1
    if name == "adaptive_k_summary":
        assert "estimated_n_precursor_groups" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_sparse_copies_grow_with_values_held_not_with_small_blocks():
    """360,000 vectors of 470 values: 10 blocks and 4 slices, so 14 copies of a side; before, 45 blocks a side."""
    n = 360_000
    assert retrieve.sparse_deal(n, 470 * n, 470 * n, 2_000) == (10, 4)
    assert [retrieve.sparse_deal(v, 470 * v, 470 * v, 2_000) for v in (0, 1_000, 5_500, 60_000)] == [(1, 1), (1, 1), (6, 1), (10, 1)]


def test_sparse_packs_of_many_bins_signs_and_repeated_entries(spark, monkeypatch):
    """Several blocks, slices and packs, more bins than are dense at once, entries that repeat, a null key: brute force's rows."""
    for name, value in {"SPARSE_QUERIES": 9, "ENTRIES": 700, "SPARSE_HELD": 900, "SPARSE_SLICE": 1_500}.items():
        monkeypatch.setattr(retrieve, name, value)
    rng = np.random.default_rng(12)
    bins, values = rng.integers(0, 5_000, (40, 120)), rng.normal(size=(40, 120)) * 10.0 ** rng.integers(-3, 4, (40, 1))
    bins[0], bins[1:20, :30], bins[20:22] = np.arange(4_800, 4_920), np.arange(30), -bins[20:22] - 1
    dense = np.zeros((40, 10_001))
    for i in range(40):
        np.add.at(dense[i], bins[i] + 5_001, values[i])
    ids = [None, *range(1, 40)]
    rows = spark.createDataFrame([(ids[i], int(b), float(v)) for i in range(40) for b, v in zip(bins[i], values[i], strict=True)], "key long, bin long, value double")
    q, lib = rows.withColumnRenamed("key", "query_index"), rows.withColumnRenamed("key", "library_index")
    s = dense @ dense.T
    for k in (4, 60):
        got = {}
        for r in retrieve.topk_sparse(q, lib, k, block=9).collect():
            got.setdefault(r.query_index, {})[r.rank] = (r.library_index, r.similarity)
        assert len(got) == 40
        for i in range(40):
            best = np.lexsort((np.arange(40), -np.round(s[i], 12)))[:k]
            mine = [got[ids[i]][n] for n in range(1, len(best) + 1)]
            assert [j for j, _ in mine] == [ids[j] for j in best]
            assert [v for _, v in mine] == pytest.approx(s[i, best].tolist(), rel=1e-9, abs=1e-9)


def test_invariants_copy_no_rows_for_distinct_counts(spark):
    rows = Q.neighbor_invariants(spark, SF)
    assert "Expand" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert all(r.k_ok and r.ranks_ok and r.order_ok and r.clusters_ok and r.itself_first for r in rows.collect())
