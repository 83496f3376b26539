"""Solvers, guards, files, clients and the command line."""

import json
import os
import time

import numpy as np
import pytest

from mentionforge import cli, shared
from mentionforge.config import Cooccurrence, Pipeline, Spectral, TopPairs
from mentionforge.functions import rows
from mentionforge.operators import cooccurrence, eigen, linking, pairs, scoring, spectral
from mentionforge.plans.pipeline import Run
from mentionforge.sources import readers
from mentionforge.telemetry import Sampler


def sparse(n, seed, per=6):
    rng = np.random.default_rng(seed)
    a = np.zeros((n, n))
    i, j = rng.integers(0, n, (2, per * n))
    a[i, j] = rng.random(per * n)
    a = np.maximum(a, a.T)
    a[np.arange(8), np.arange(8)] = 12.0 - np.arange(8)
    a[np.arange(8, 14), np.arange(8, 14)] = -14.0 + np.arange(6)
    return a


@pytest.mark.parametrize("which", ["LA", "SA", "LM"])
def test_block_krylov(spark, tmp_path, monkeypatch, which):
    monkeypatch.setattr(eigen, "WIDTH", 64)
    monkeypatch.setattr(eigen, "FAN", 3)
    a = sparse(200, 2)
    i, j = np.nonzero(a)
    m = spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j)], "i long, j long, v double")
    values, vectors = eigen.block_krylov(m, 200, 3, f"file://{tmp_path}", which, tol=1e-6, ncv=50)
    exact, full = np.linalg.eigh(a)
    best = eigen.chosen(exact, 3, which)
    assert np.allclose(values, exact[best], atol=1e-6)
    got = np.array([r.x for r in vectors.orderBy("idx").collect()])
    assert np.allclose(np.abs(got.T @ full[:, best]), np.eye(3), atol=1e-4)


def test_spectral_guards(spark):
    m = spark.createDataFrame([(0, 5, 1.0)], "i long, j long, v double")
    with pytest.raises(ValueError, match="square"):
        spectral.top_eigenpairs(m, 3, 1)
    values, vectors = spectral.top_eigenpairs(m.limit(0), 0, 4)
    assert len(values) == 0 and vectors.count() == 0
    vocab = spark.createDataFrame([(0, "a"), (7, "b")], "idx long, token string")
    with pytest.raises(ValueError, match="tokens"):
        spectral.embeddings(m.limit(0), vocab, Spectral(k=1))


def test_spectral_files(spark, tmp_path):
    m = spark.createDataFrame([(0, 1, 2.0), (1, 2, 1.0)], "i long, j long, v double")
    vocab = spark.createDataFrame([(k, f"t{k}") for k in range(3)], "idx long, token string")
    out = spectral.embeddings(m, vocab, Spectral(k=2, save_matrix=True), f"file://{tmp_path}/s")
    assert out.count() == 3 and spark.read.parquet(f"file://{tmp_path}/s/processed").count() == 4
    assert json.loads(spark.read.text(f"file://{tmp_path}/s/meta").first()[0])["k"] == 2
    assert spark.read.parquet(f"file://{tmp_path}/s/eigenvalues").count() == 2


def test_strict_runs(spark, tmp_path):
    empty = spark.createDataFrame([], "a long")
    assert Run(spark, f"file://{tmp_path}").written("x", lambda: empty).count() == 0
    run = Run(spark, f"file://{tmp_path}", Pipeline(strict=True))
    with pytest.raises(ValueError, match="nothing left: x"):
        run.written("x", lambda: empty)
    assert [r.stage for r in run.report().collect()] == ["x"]


def test_row_numbers(spark, tmp_path):
    df = spark.range(0, 1000, 1, 7).selectExpr("id as v")
    for folder in (None, f"file://{tmp_path}/rows"):
        got = rows.with_row_id(df, folder=folder).collect()
        assert sorted((r.v, r.id) for r in got) == [(k, k + 1) for k in range(1000)]
    assert rows.with_row_id(df.limit(0)).count() == 0


def test_line_numbers_of_split_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text("".join(f"{name}{k}\n" for k in range(1, 2001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = readers.lines(spark, f"file://{tmp_path}").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 4000 and all(r.value == f"{r.file[-1]}{r.line_no}" for r in got)


def test_vectors_with_holes(spark):
    rows_ = [(0, "A", "PRESENT", [1.0, None]), (1, "B", "PRESENT", [float("nan"), 1.0]), (2, "C", "PRESENT", None), (3, "D", "PRESENT", [1.0]), (4, "E", "PRESENT", [2.0, float("inf")]), (5, "F", "PRESENT", [])]
    df = spark.createDataFrame(rows_, "row_id long, cui string, status string, embedding array<double>")
    got = {(r.a_cui, r.b_cui): r.cosine_similarity for r in pairs.top_pairs(df, TopPairs()).collect()}
    assert got == {("A", "B"): 0.0, ("B", "A"): 0.0, ("A", "E"): 1.0, ("E", "A"): 1.0, ("B", "E"): 0.0, ("E", "B"): 0.0}
    q, d = (df.select(df.cui.alias(c), df.embedding.alias("vector")) for c in ("query", "term"))
    found = {(r.query, r.term): r.score for r in linking.nearest_terms(q, d, 9).collect()}
    assert found[("D", "D")] == 1.0 and len(found) == 10 and found[("A", "E")] == 2.0
    assert linking.cell_terms(q, d.limit(0), 3).count() == 0


def test_hot_cells(spark, monkeypatch):
    """Blocks on both sides of a cell give what exact search gives where all cells are probed."""
    monkeypatch.setattr(linking, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 4))
    d = spark.createDataFrame([(f"t{k:03}", v) for k, v in enumerate(x.tolist())], "term string, vector array<double>")
    q = spark.createDataFrame([(f"q{k:03}", v) for k, v in enumerate(x[:50].tolist())], "query string, vector array<double>")
    key = lambda df: sorted((r.query, r["rank"], r.term) for r in df.collect())
    assert key(linking.cell_terms(q, d, 5, cells=3, probes=3)) == key(linking.nearest_terms(q, d, 5))


def test_cached_vectors(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def make():
        encode = linking.ngram_encoder(16)

        def run(texts):
            made.add(len(texts))
            return encode(texts)

        return run

    df = spark.createDataFrame([("a b",), ("c",)], "term string")
    one = linking.cached(df, "term", make, "x", f"file://{tmp_path}").count()
    first = made.value
    assert one == 2 and linking.cached(df.orderBy("term"), "term", make, "x", f"file://{tmp_path}").count() == 2 and made.value == first
    linking.cached(df.limit(1), "term", make, "x", f"file://{tmp_path}")
    linking.cached(df, "term", make, "y", f"file://{tmp_path}")
    assert made.value > first and len(os.listdir(tmp_path)) == 3


def test_shared(spark, tmp_path):
    assert shared.resolved("a/b", "/x") == "/x/a/b" and shared.resolved("/a", "/x") == "/a" and shared.resolved("hdfs://n/a", "/x") == "hdfs://n/a"
    assert shared.run_folder("/o/", {"JOB_ID": "7"}) == "/o/run-7" and shared.run_folder("/o", {}).startswith("/o/run-2")
    (tmp_path / "k").write_text("abc\r\n")
    assert shared.secret("K", str(tmp_path / "k"), {}) == "abc" and shared.secret("K", None, {"K": "v"}) == "v"
    with pytest.raises(KeyError):
        shared.secret("K", None, {})
    with pytest.raises(FileNotFoundError):
        shared.needed(spark, str(tmp_path / "none"))
    assert shared.files(spark, str(tmp_path), "*") == ["k"] and shared.work_folder(spark).startswith(shared.base_folder(spark))


def test_sampler(tmp_path):
    path = str(tmp_path / "t.csv")
    with Sampler(path, 0.01, lambda: (1.5, 40)):
        time.sleep(0.1)
    got = open(path, encoding="utf-8").read().splitlines()
    assert got[0] == "time,util,mem_used,power,temp" and len(got) > 2 and got[1].endswith("1.5,40")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "d.txt").write_text("C1||aspirin||Drug\nC2||fever||Sign\n")
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a.csv").write_text("entity\nAspirin\n\"\"\n")
    base = ["--base", str(tmp_path)]
    link = [*base, "link", "--dictionary", "d.txt"]
    assert cli.main([*link, "--input", "in/a.csv", "--output", "one"], spark) == 0
    assert [r.umls_top_cui for r in readers.delimited(spark, str(tmp_path / "one")).collect() if r.entity] == ["C1"]
    assert cli.main([*link, "--folder", "in", "--output", "out", "--skip-existing"], spark) == 0 and os.path.isdir(tmp_path / "out" / "a.normalized.csv")
    assert cli.main([*link, "--input", "none.csv", "--output", "x"], spark) == 2
    assert cli.main([*link, "--input", "in/a.csv", "--text", "nope", "--output", "x"], spark) == 1
    side = ",".join(scoring.SIDES)
    (tmp_path / "p.csv").write_text(f"pair_id,{side}\n10,C1,aspirin,D,PRESENT,C2,fever,D,PRESENT\n2,C1,aspirin,D,PRESENT,C1,aspirin,D,ABSENT\n")
    assert cli.main([*base, "score", "--input", "p.csv", "--output", "s", "--audit", "audit"], spark) == 0
    assert {(r.pair_id, r.relationship_score) for r in readers.delimited(spark, str(tmp_path / "s" / "table.csv")).collect()} == {("10", "40"), ("2", "50")}
    assert spark.read.text(str(tmp_path / "audit")).count() == 2
    assert cli.main([*base, "score", "--input", "p.csv", "--output", "s", "--key-name", "NO_SUCH_KEY"], spark) == 2
    assert "NO_SUCH_KEY" in capsys.readouterr().err


def test_command_line_run(spark, tmp_path, capsys):
    (tmp_path / "d.txt").write_text("C1||aspirin||Drug\nC2||fever||Sign\nC3||cough||Sign\n")
    item = lambda w: {"phrase": w, "body_location": None, "semantic_type": "s", "modifier": None, "purpose": None, "assertion_status": "present"}
    words = [("aspirin", "fever"), ("aspirin", "cough"), ("fever", "cough"), ("aspirin", "fever", "cough")]
    lines = [json.dumps({"key": f"{k}-1-1", "response": json.dumps([item(w) for w in words[k % 4]])}) for k in range(60)]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    args = ["--base", str(tmp_path), "run", "--input", "log.jsonl", "--dictionary", "d.txt", "--output", "runs", "--telemetry", str(tmp_path / "t.csv"), "--save-matrix", "--strict"]
    assert cli.main([*args, "--k", "2"], spark) in (0, 1)
    told = capsys.readouterr()
    if not told.err:
        folder = told.out.strip()
        assert readers.delimited(spark, f"{folder}/labelled.csv").count() > 0 and spark.read.json(f"{folder}/resources").count() > 5
    else:
        assert "nothing left" in told.err
    assert os.path.getsize(tmp_path / "t.csv") > 0
    assert cooccurrence.checked(spark.range(1), "x").count() == 1 and Cooccurrence().wanted() == ()
