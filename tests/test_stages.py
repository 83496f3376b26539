import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mentionforge.config import Cooccurrence, Labels, Scoring, Spectral, TopPairs
from mentionforge.functions import columns as C
from mentionforge.functions.rows import require, require_unique, with_row_id
from mentionforge.operators import align, cooccurrence, discretize, enrich, flatten, labels, linking, pairs, scoring, spectral
from mentionforge.sources import readers, writers


def test_flatten(spark):
    item = lambda **k: k
    rows = [
        json.dumps({"key": "175-1-2", "response": json.dumps([item(phrase="a", n=1), item(phrase="b")])}),
        "  ",
        "{bad",
        json.dumps({"key": "1-2"}),
        json.dumps({"key": "1-2", "response": json.dumps([item(phrase="c")])}),
        json.dumps({"key": "1-1-1", "response": "[]"}),
        json.dumps({"key": "9-8-7", "response": json.dumps([{"key": "4-5-6", "z": True}])}),
        json.dumps({"key": "9-8-7", "response": [1]}),
    ]
    lines = spark.createDataFrame([(r,) for r in rows], "value string")
    got = flatten.mentions(lines).collect()
    assert sorted((r.key, r.patient_id, r.message_id) for r in got) == [("1-2", None, None), ("175-1-2", "175", "2"), ("175-1-2", "175", "2"), ("4-5-6", "4", "6")]
    assert {r.value for r in flatten.bad_records(lines).collect()} == {rows[2], rows[3], rows[7]}
    assert flatten.discovered(flatten.mentions(lines)) == ["n", "z"]
    wide = flatten.widened(flatten.mentions(lines), ["n", "z"])
    assert {r.n for r in wide.collect()} == {None, "1"}


def test_texts_and_tokens(spark):
    df = spark.createDataFrame([(" chest pain ", "left arm"), (None, "knee"), ("  ", None)], "p string, b string")
    assert [r[0] for r in df.select(C.entity_text(F.col("p"), F.col("b"))).collect()] == ["chest pain left arm", "knee", ""]
    df = spark.createDataFrame([("C1||HISTORY",), ("C1|X",), ("C1",), ("C1||A||B",), (None,)], "t string")
    assert [tuple(r) for r in df.select(*C.token_parts(F.col("t"))).collect()] == [("C1", "HISTORY"), ("C1", "X"), ("C1", ""), ("C1", "A||B"), (None, "")]
    df = spark.createDataFrame([("175-1-2",), ("1-2",), ("1-2-3-4",), ("1--2",), (None,)], "k string")
    assert [tuple(r) for r in df.select(*C.key_parts(F.col("k"))).collect()] == [("175", "1", "2"), (None,) * 3, (None,) * 3, ("1", "", "2"), (None,) * 3]
    words = ["Family History", "FAMILY-HISTORY", "UNCERTAIN", "negative", "", None, "denied"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(C.assertion(F.col("w"))).collect()] == ["family_history", "family_history", "possible", "unknown", "unknown", "unknown", "absent"]


def test_discretize(spark):
    rows = [("C1", "present")] * 2 + [("C1", "absent"), ("C2", "present"), ("C2", "possible"), ("C2", "hypothetical")] + [("C3", "Present")] * 5 + [(None, "present")] * 3
    df = spark.createDataFrame([("p", *r) for r in rows], "patient_id string, umls_top_cui string, assertion_status string")
    out = discretize.supported(discretize.mapped(df), 2).collect()
    assert len(out) == 6 and {r.umls_top_cui for r in out} == {"C1", "C2"}
    assert discretize.mapped(df, normalise=True).count() == len(rows)


def _patients(spark):
    rows = [("P1", "A"), ("P1", "B"), ("P2", "A"), ("P2", "B"), ("P3", "A"), ("P3", "C"), ("P4", "C"), ("P4", "D"), ("P4", "D"), (None, "A")]
    return spark.createDataFrame([(p, c, " present ") for p, c in rows], "patient_id string, umls_top_cui string, assertion_status_norm string")


def test_ppmi(spark):
    toks = cooccurrence.tokens(_patients(spark))
    vocab = cooccurrence.vocabulary(toks)
    assert [(r.cui, r.patient_count) for r in vocab.orderBy("idx").collect()] == [("A", 3), ("B", 2), ("C", 2), ("D", 1)]
    counted = cooccurrence.pair_counts(toks, vocab)
    got = {(r.i, r.j): round(r.v, 6) for r in cooccurrence.ppmi(counted).collect()}
    assert got == {(0, 1): 0.980829, (0, 2): 0.287682, (2, 3): 1.386294}
    two = cooccurrence.ppmi(cooccurrence.pair_counts(toks, vocab, Cooccurrence(min_cooccur=2))).collect()
    assert [(r.i, r.j, round(r.v, 6)) for r in two] == [(0, 1, 0.693147)]
    capped = cooccurrence.tokens(_patients(spark), Cooccurrence(cap=1))
    assert sorted(r.cui for r in capped.collect()) == ["A", "A", "A", "C"]
    with pytest.raises(ValueError):
        cooccurrence.checked(cooccurrence.pair_counts(capped, cooccurrence.vocabulary(capped)), "pairs")
    assert Cooccurrence.parse_statuses("all, x") == () and Cooccurrence.parse_statuses(" present") == ("PRESENT",)


@pytest.mark.parametrize("limit", [3000, 1])
def test_spectral(spark, limit):
    toks = cooccurrence.tokens(_patients(spark))
    vocab = cooccurrence.vocabulary(toks)
    m = cooccurrence.symmetric(cooccurrence.ppmi(cooccurrence.pair_counts(toks, vocab)), "v")
    values, vectors = spectral.top_eigenpairs(spectral.prepared(m), 4, 2, Spectral(driver_limit=limit))
    assert np.allclose(values, [1.440848, 0.943693], atol=1e-5)
    e = np.array([r.embedding for r in spectral.scaled(values, vectors).orderBy("idx").collect()])
    assert np.allclose((e @ e.T)[0], [0.504186, 0.490415, 0.143841, 0.083624], atol=1e-5)


def test_top_pairs(spark):
    rows = [(0, "C1", "PRESENT", [1.0, 0.0]), (1, "C2", "", [1.0, 1.0]), (2, "C1", "ABSENT", [2.0, 0.0]), (3, "C3", "ABSENT", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "row_id long, cui string, status string, embedding array<double>")
    got = sorted((r.config, r.a_cui, r.b_cui, round(r.cosine_similarity, 4)) for r in pairs.top_pairs(df, TopPairs(top_pp=2, top_other=1)).collect())
    assert got[0][0] == "ABSENT~ABSENT" and got[0][3] == 0.0
    assert got[1:] == [("ABSENT~PRESENT", "C1", "C1", 1.0), ("PRESENT~ABSENT", "C1", "C1", 1.0), ("PRESENT~PRESENT", "C1", "C2", 0.7071), ("PRESENT~PRESENT", "C2", "C1", 0.7071)]


def test_linking(spark, tmp_path):
    (tmp_path / "d.txt").write_text("C1||x||T\nbad||line\nC2||x||T\nC3||diabetes mellitus||D\nC4||aspirin||P\n")
    terms = linking.last_wins(readers.dictionary_lines(spark, str(tmp_path / "d.txt")))
    assert {(r.term, r.cui) for r in terms.collect()} == {("x", "C2"), ("diabetes mellitus", "C3"), ("aspirin", "C4")}
    df = spark.createDataFrame([(1, " Aspirin"), (2, ""), (3, None), (4, "diabetes mellitis"), (5, "qqqq")], "id long, entity string")
    got = {r.id: r for r in linking.link(df, terms).collect()}
    assert got[1].umls_top_cui == "C4" and got[1].umls_top_confidence == 1.0 and not got[1].umls_below_threshold_warning
    assert got[4].umls_top_cui == "C3" and got[5].umls_below_threshold_warning
    assert got[2].umls_candidates == got[3].umls_candidates == "[]" and got[2].umls_top_cui is None
    with pytest.raises(KeyError):
        linking.link(df, terms, text="missing")


def test_align(spark):
    left = spark.createDataFrame([(1, "p"), (2, "q")], "id long, patient_id string")
    assert align.by_id(left, spark.createDataFrame([(1, "C")], "id long, umls_top_cui string")).collect()[0].patient_id == "p"
    with pytest.raises(Exception, match="not unique"):
        align.by_id(left, spark.createDataFrame([(1, "C"), (1, "D")], "id long, umls_top_cui string")).collect()
    assert [r.id for r in with_row_id(spark.range(10).toDF("x").repartition(3)).orderBy("id").collect()] == list(range(1, 11))
    with pytest.raises(ValueError, match="missing"):
        require(left, "nope")
    assert require_unique(left, "id").count() == 2


def test_codebook(spark):
    rows = [(1, "C1", "a", "t", ".5"), (2, "C1 ", "b", "t", ".9"), (3, "C1", "c", "t", "bad"), (4, "C2", "d", "t", "1"), (5, "C2", "e", "t", "1")]
    df = spark.createDataFrame(rows, "row_id long, umls_top_cui string, umls_top_term string, umls_top_semantic_type string, umls_top_confidence string")
    assert {(r.cui, r.term) for r in enrich.codebook(df).collect()} == {("C1", "b"), ("C2", "d")}
    assert {(r.cui, r.term) for r in enrich.codebook(df.drop("umls_top_confidence")).collect()} == {("C1", "a"), ("C2", "d")}


def test_scoring(spark):
    waits, tries = [], []

    def flaky(request):
        tries.append(1)
        if len(tries) < 3:
            raise scoring.Retryable("busy")
        return "{}"

    assert scoring.called(flaky, {}, Scoring(), waits.append) == ("{}", "", "") and len(waits) == 2 and waits[1] > waits[0]
    assert scoring.called(lambda r: 1 / 0, {}, Scoring(), waits.append)[1] == "ZeroDivisionError"
    row = {c: "x" for c in scoring.SIDES} | {"pair_id": " "}
    df = scoring.records(spark.createDataFrame([row]))
    assert df.collect()[0].pair_id == "p000001"
    body = json.loads(scoring.batch_requests(df).collect()[0].value)
    assert body["body"]["response_format"]["type"] == "json_schema" and body["custom_id"] == "p000001"
    out = scoring.scored(df).collect()[0]
    assert out.status == "ok" and out.linking_conditions == "x" and json.loads(scoring.audit(scoring.scored(df)).collect()[0].value)["pair_id"] == "p000001"
    with pytest.raises(Exception, match="blank"):
        scoring.records(spark.createDataFrame([row | {"a_cui": " "}])).collect()


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("10", "50", "60", "85", "90", "", "x")], "relationship_score string")
    tag = lambda cfg: [r.relationship_label_cutoff for r in labels.labelled(df, cfg).collect()]
    assert tag(Labels()) == ["negative", "negative", "uncertain", "positive", "positive", "uncertain", "uncertain"]
    assert tag(Labels(null_scores="reference"))[-2:] == ["positive", "positive"]
    assert tag(Labels(mode="binary", threshold=60)) == ["negative", "negative", "positive", "positive", "positive", None, None]
    s = labels.summary(df).collect()[0]
    assert (s["count"], s["mean"], round(s["std"], 6), s.p25, s["median"], s.p75) == (5, 59.0, 32.093613, 50.0, 60.0, 85.0)
    with pytest.raises(ValueError):
        labels.labelled(df, Labels(low=9, high=9))
    assert math.isclose(sum(r.percent for r in labels.distribution(labels.labelled(df)).collect()), 100)


def test_files(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    (tmp_path / "t.csv").write_text('﻿id,a\n007,"x ""y"""\n1,NA\n', encoding="utf-8")
    df = readers.delimited(spark, path)
    assert df.columns[0] == "id" and {tuple(r) for r in df.collect()} == {("007", 'x "y"'), ("1", "NA")}
    assert readers.separator("a.TSV") == "\t" and readers.sniffed("a;b;c,d") == ";"
    assert readers.encoding_of(b"\xff") == "ISO-8859-1"
    assert readers.tables(spark, str(tmp_path)).count() == 2
    v = spark.createDataFrame([(1, [0.5, 1.5])], "i long, embedding array<double>")
    assert writers.gathered(writers.wide(v, "embedding", 2)).collect()[0].embedding == [0.5, 1.5]
    writers.delimited(v.select("i"), str(tmp_path / "o"))
    writers.json_lines(v, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_spectral_settings(spark):
    m = spark.createDataFrame([(0, 0, 5.0), (0, 1, 2.0), (1, 2, 0.5)], "i long, j long, v double")
    got = {(r.i, r.j): r.v for r in spectral.prepared(m, Spectral(threshold=1.0)).collect()}
    assert got == {(0, 1): 1.0, (1, 0): 1.0}


def test_encoder_takes_whole_texts():
    a, b = linking.ngram_encoder()(["x" * 200 + " left", "x" * 200 + " right"])
    assert not np.allclose(a, b) and np.allclose(*linking.ngram_encoder(longest=200)(["x" * 200 + " left", "x" * 200 + " right"]))
