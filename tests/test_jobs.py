"""The two jobs on copies: growing input, repeated batches, reruns, awkward rows and the command line."""

import logging
import math
import os
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from jobs import passage_search, topk_growth
from lumenfold.operators import retrieve

ROOT = Path(__file__).resolve().parent.parent


def vectors(n, start=0):
    return [(i, [math.sin(1.7 * i * (j + 1)) for j in range(6)]) for i in range(start, start + n)]


def write(spark, rows, path):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.mode("append").parquet(path)


def from_scratch(spark, rows, k):
    df = spark.createDataFrame(rows, "library_index long, embedding array<float>")
    queries = df.where("library_index % 10 = 0").withColumnRenamed("library_index", "query_index")
    return {tuple(r) for r in retrieve.topk_cosine(queries, df.where("library_index % 10 <> 0"), k).collect()}


def grow(spark, tmp, **more):
    settings = {"k": 4, "query_filter": "vec_id % 10 = 0", "library_filter": "vec_id % 10 <> 0"} | more
    return topk_growth.run(spark, f"{tmp}/queries", f"{tmp}/library", f"{tmp}/out", **settings)


def test_growing_library(spark, tmp_path, caplog):
    """The second run reads the new file only, and its result is that of a search over everything."""
    caplog.set_level(logging.INFO)
    old, new = vectors(60), vectors(35, 60)
    write(spark, old, f"{tmp_path}/queries")
    write(spark, old[:30], f"{tmp_path}/library")
    write(spark, old[30:], f"{tmp_path}/library")
    assert {tuple(r) for r in grow(spark, tmp_path, files_per_batch=1).collect()} == from_scratch(spark, old, 4)
    assert "read 60 new rows" in caplog.text and "in 2 batches" in caplog.text
    caplog.clear()
    # also a vector that is here already, one that isn't finite and none
    write(spark, [*new, old[11], (201, [float("nan")] * 6), (202, None)], f"{tmp_path}/library")
    got = {tuple(r) for r in grow(spark, tmp_path).collect()}
    want = {r for r in from_scratch(spark, old + [r for r in new if r[0] % 10], 4)}
    assert got == want and "read 38 new rows" in caplog.text
    caplog.clear()
    assert {tuple(r) for r in grow(spark, tmp_path).collect()} == want and "read 0 new rows" in caplog.text
    assert len(list((tmp_path / "out" / "topk").glob("version=*"))) == 3


def test_repeated_batch_writes_the_same_version(spark, tmp_path):
    """As after a failure between the write and its commit."""
    rows = vectors(50)
    write(spark, rows, f"{tmp_path}/queries")
    write(spark, rows[:25], f"{tmp_path}/library")
    grow(spark, tmp_path)
    write(spark, rows[25:], f"{tmp_path}/library")
    want = {tuple(r) for r in grow(spark, tmp_path).collect()}
    for name in ("1", ".1.crc"):
        (tmp_path / "out" / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    assert {tuple(r) for r in grow(spark, tmp_path).collect()} == want == from_scratch(spark, rows, 4)
    assert len(list((tmp_path / "out" / "topk").glob("version=*"))) == 2


def test_library_without_vectors(spark, tmp_path):
    write(spark, vectors(11), f"{tmp_path}/queries")
    write(spark, [], f"{tmp_path}/library")
    assert grow(spark, tmp_path).collect() == []


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_passages(spark, tmp_path):
    texts = [None, "", " \t", "a b c", "A  b\nc", "a b c d e f g", "x y z", "a", "b a b a", "ＷＩＤＥ naïve a", "c " * 3000 + "b", "q a b c"]
    docs = [(i, t, [None, "", "en", "de"][i % 4], "extra") for i, t in enumerate(texts)]
    passages = [(0, "a b c"), (1, "A a b"), (2, None), (3, ""), (4, "unseen"), (5, "x z naïve")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, rank string").repartition(3).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{tmp_path}/p")
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    count = lambda t: Counter(WORDS.findall((t or "").translate(low)))
    norm = lambda c: math.sqrt(sum(n * n for n in c.values()))
    want = set()
    for item, p in passages:
        found = []
        for i, t, lang, _ in docs:
            a, b = count(p), count(t)
            if dot := sum(n * b[w] for w, n in a.items()):
                found.append((-round(dot / norm(a) / norm(b), 12), i, lang or ""))
        want |= {(item, k + 1, i, round(-s, 6), lang) for k, (s, i, lang) in enumerate(sorted(found)[:5]) if -s >= 0.1}
    for _ in range(2):  # a rerun writes the same
        got = passage_search.run(spark, f"{tmp_path}/d", f"{tmp_path}/p", f"{tmp_path}/out").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {p.name for p in (tmp_path / "out" / "matches").glob("lang=*")} == {"lang=en", "lang=de", "lang=__HIVE_DEFAULT_PARTITION__"}


def test_vectors_are_counted_in_their_rows(spark):
    """no shuffle and no sorted words; only the six white-space characters part words, only A-Z are lowered."""
    texts = {1: "B a\x0bA\tb  c", 2: "a\x1ca a\u00a0a \u0130 \u00c4 a\x85", 3: "", 4: None, 5: " \r\n\x0c "}
    rows = spark.createDataFrame(list(texts.items()), "id int, text string")
    names = ["a", "b", "a\x1ca", "a\u00a0a", "\u0130", "\u00c4", "a\x85"]
    vocabulary = spark.createDataFrame([(w, i) for i, w in enumerate(names)], "word string, bin long")
    made = passage_search.vectors(rows, vocabulary, "id")
    got = {(r.id, names[r.bin]): r.value for r in made.collect()}
    want = {(1, "a"): 2 / 3, (1, "b"): 2 / 3} | {(2, w): 1 / math.sqrt(5) for w in names[2:]}
    assert got.keys() == want.keys() and all(math.isclose(got[k], v) for k, v in want.items())
    assert "Exchange hashpartitioning(id" not in made._jdf.queryExecution().toString()


def test_norms_of_long_texts_are_summed_once(spark, tmp_path):
    """Time grows with a text's words, not with their square."""
    import time

    spark.createDataFrame([(1, " ".join(f"w{i % 9000}" for i in range(60_000)), "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string").write.parquet(f"{tmp_path}/p")
    began = time.perf_counter()
    passage_search.run(spark, f"{tmp_path}/d", f"{tmp_path}/p", f"{tmp_path}/out", least=0.0)
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("name", ["topk_growth", "passage_search"])
def test_command_line_and_config(spark, tmp_path, name):
    """The committed config files hold all settings' names; the job runs as a command."""
    import json

    settings = json.loads((ROOT / "jobs" / f"{name}.json").read_text())
    module = {"topk_growth": topk_growth, "passage_search": passage_search}[name]
    assert set(settings) == set(module.DEFAULTS)
    if name == "topk_growth":
        write(spark, vectors(30), f"{tmp_path}/v")
        command = ["--queries", f"{tmp_path}/v", "--library", f"{tmp_path}/v", "--out", f"{tmp_path}/out"]
        done = subprocess.run([sys.executable, "-m", f"jobs.{name}", f"jobs/{name}.json", *command], cwd=ROOT, capture_output=True, text=True, timeout=240, env=os.environ | {"PYTHONPATH": str(ROOT)})
        assert done.returncode == 0, done.stderr[-2000:]
        assert "read 30 new rows" in done.stderr
        assert {tuple(r)[:4] for r in topk_growth.latest(spark, f"{tmp_path}/out").collect()} == from_scratch(spark, vectors(30), 10)
