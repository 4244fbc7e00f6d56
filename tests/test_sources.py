import json

import pytest
from pyspark.sql import functions as F

from manylabel import params
from manylabel.operators import metrics
from manylabel.plans import pipeline
from manylabel.sources import svmlight
from manylabel.sources.model import Model


def parsed(spark, *lines, **k):
    d = svmlight.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), **k)
    return [(r["labels"], [(f["fid"], round(f["val"], 4)) for f in r["features"]]) for r in d.collect()]


@pytest.mark.parametrize(
    "line, want",
    [
        ("32,50,87 1:1.9 23:0.48 79:0.63", [([32, 50, 87], [(1, 1.9), (23, 0.48), (79, 0.63)])]),
        ("14146 101938 30938", []),
        ("", []),
        ("   ", []),
        ("7  1:0.5   2:0.25 ", [([7], [(1, 0.5), (2, 0.25)])]),
        ("7\t1:0.5\r", [([7], [(1, 0.5)])]),
        ("1,,2 3:1", [([1, 2], [(3, 1.0)])]),
        (",5 3:1", [([5], [(3, 1.0)])]),
        (", 3:1", []),
        ("5,5 3:1 3:2", [([5, 5], [(3, 1.0), (3, 2.0)])]),
        ("7 5:1 2:1", [([7], [(5, 1.0), (2, 1.0)])]),
        ("x 3:1", []),
        ("7 1:x 2:1", []),
        (" 1:0.5 2:0.3", []),
        ("7 1:0.5 9", [([7], [(1, 0.5)])]),
        (None, []),
    ],
)
def test_line_grammar(spark, line, want):
    assert parsed(spark, line) == want


def test_unlabelled_rows_can_stay(spark):
    assert parsed(spark, " 1:0.5", "2:1 3:1", keep_unlabelled=True) == [([], [(1, 0.5)]), ([], [(2, 1.0), (3, 1.0)])]


def test_settings(tmp_path):
    f = tmp_path / "s.json"
    f.write_text(json.dumps({"emb_size": 20.0, "lambda": 2, "train_file": "a", "other": []}))
    p = params.override(params.from_json(str(f)), ["num_nn=5", "", "nothing=1", "num_nn=6", "train_file=b"])
    assert (p.emb_size, p.lam, p.num_nn, p.train_file, p.num_learner) == (20, 2.0, 6, "b", 15)
    with pytest.raises(ValueError):
        params.override(p, ["num_nn"])
    f.write_text('{"emb_size": "x"}')
    with pytest.raises(ValueError):
        params.from_json(str(f))
    f.write_text("[]")
    with pytest.raises(ValueError):
        params.from_json(str(f))


def test_golden_metrics(spark):
    """Four rows: true and predicted labels, one without predictions."""
    true = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 2), (2, 3), (2, 4), (3, 5)], "row_id long, label int")
    pred = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (0, 3, 7), (1, 1, 1), (1, 2, 3), (2, 1, 2)], "row_id long, rank int, label int")
    train = spark.createDataFrame([(1,), (1,), (1,), (2,), (2,), (3,), (7,)], "label int")
    w, unseen = metrics.propensities(train, 4)
    val = lambda d: [round(r["value"], 6) for r in d.orderBy("k").collect()]
    assert val(metrics.precision_at_k(pred, true, true)) == [0.5, 0.5, 0.333333, 0.25, 0.2]
    assert val(metrics.ndcg_at_k(pred, true, true)) == [0.5, 0.561019, 0.525052, 0.525052, 0.525052]
    assert val(metrics.psp_at_k(pred, true, w, unseen)) == [0.62624, 0.770964, 0.646849, 0.646849, 0.646849]
    assert val(metrics.psndcg_at_k(pred, true, w, unseen)) == [0.62624, 0.719628, 0.679333, 0.679333, 0.679333]


def test_train_save_load_predict(spark, tmp_path):
    text = [f"{i % 3} {10 * (i % 3) + j}:1 {10 * (i % 3) + (j + i) % 7}:0.5" for i in range(60) for j in (i % 5,)]
    (tmp_path / "train.txt").write_text("60 40 3\n" + "\n".join(text) + "\n")
    rows = svmlight.read_dataset(spark, str(tmp_path / "train.txt"))
    assert [r["row_id"] for r in rows.orderBy("row_id").collect()] == list(range(60))
    p = params.Params(emb_size=8, num_learner=2, num_nn=4, cls_type=0, cls_iter=2, emb_iter=2, cluster_rows=20, num_edge=10)
    pipeline.train(svmlight.features_of(rows), svmlight.labels_of(rows), p).save(str(tmp_path / "model"))
    model = Model.load(spark, str(tmp_path / "model"), 2)
    for pred_type in (0, 1):
        found = pipeline.predict(model, svmlight.features_of(rows), params.override(p, [f"pred_type={pred_type}"]))
        best = {r["query_id"]: r["label"] for r in found.where("rank = 1").collect()}
        assert sum(best.get(i) == i % 3 for i in range(60)) >= 55


def test_loading_the_first_learners_reads_no_other_folder(spark, tmp_path):
    e = spark.range(60).select((F.col("id") % 6).cast("int").alias("learner"), F.lit(0).alias("cluster"), F.col("id").alias("row_id"), F.array(F.lit(1.0)).alias("emb"))
    w = e.select("learner", F.lit(0).alias("k"), F.col("row_id").cast("int").alias("fid"), F.lit(1.0).alias("w"))
    labels = spark.range(3).select(F.col("id").alias("row_id"), F.lit(1).alias("label"))
    Model(labels, w, e, w.select("learner", F.lit(0).alias("cluster"), "fid", F.array("w").alias("w")), e).save(str(tmp_path / "m"))
    m = Model.load(spark, str(tmp_path / "m"), 2)
    for d in (m.clusters, m.assignments, m.projections, m.embeddings):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(learner" in plan and "(learner" in plan.split("PartitionFilters")[1].split("]")[0] and "< 2" in plan
        read = {r[0].split("learner=")[1].split("/")[0] for r in d.select(F.input_file_name()).distinct().collect()}
        assert read == {"0", "1"} and d.count() == 20
    assert m.labels.count() == 3 and m.index is None


def test_sizes_of_all_parts(spark):
    from manylabel.sources import model

    w = spark.createDataFrame([(0, 0, 1, 2.0), (0, 1, 2, 0.0), (0, 1, 1, 3.0)], "learner int, k int, fid int, w double")
    emb = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "row_id long, emb array<double>")
    proj = spark.createDataFrame([(0, 0, 1, [1.0, 0.0]), (0, 1, 2, [1.0, 1.0])], "learner int, cluster int, fid int, w array<double>")
    index = spark.createDataFrame([(1, [2, 3]), (2, [1]), (3, [])], "row_id long, edges array<long>")
    nodes = spark.createDataFrame([(1, 8), (2, 5), (3, 3)], "node long, n long")
    got = {r["part"]: (r["n_values"], round(r["density"], 4)) for r in model.sizes(w, emb, proj, index, nodes).collect()}
    assert got == {"clusters": (2, 0.5), "embeddings": (4, 1.0), "projections": (3, 0.375), "index": (3, 0.5), "tree": (3, 0.375)}


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    lines = [f"{i} {i % 9}:1" if i % 3 else "not a row" for i in range(5000)]
    (tmp_path / "d.txt").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = svmlight.read_dataset(spark, str(tmp_path / "d.txt"))
        assert rows.rdd.getNumPartitions() > 1
        got = {r["row_id"]: r["labels"] for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == dict(enumerate([i] for i in range(5000) if i % 3))


def test_malformed_results(spark):
    d = spark.createDataFrame([("1,2\t1:0.5,x:1,3:y",), ("1,q\t2:1",), ("alone",), ("a b c",), (None,)], "value string")
    got = [(r["labels"], r["preds"] and [(p["label"], p["score"]) for p in r["preds"]]) for r in svmlight.parse_results(d).collect()]
    assert got == [([1, 2], [(1, 0.5)]), ([1], [(2, 1.0)]), (None, None), (None, None), (None, None)]


def test_command_line(spark, tmp_path, capsys):
    rows = [f"{i % 3} {10 * (i % 3) + i % 5}:1 {10 * (i % 3) + (i + i % 5) % 7}:0.5" for i in range(60)]
    (tmp_path / "train.txt").write_text("\n".join(rows))
    given = {"emb_size": 8, "num_learner": 1, "num_nn": 4, "cls_type": 0, "emb_iter": 2, "num_edge": 10}
    (tmp_path / "s.json").write_text(json.dumps({**given, "train_file": str(tmp_path / "train.txt"), "predict_file": str(tmp_path / "train.txt"), "model_file": str(tmp_path / "model"), "result_file": str(tmp_path / "out")}))
    settings = str(tmp_path / "s.json")
    assert pipeline.main(["train", settings]) == 0
    model = Model.load(spark, str(tmp_path / "model"))
    assert model.index is not None and model.index.count() == 60  # stored, so that a search need not build it
    assert pipeline.main(["predict", settings, "pred_type=1"]) == 0
    assert pipeline.main(["score", str(tmp_path / "out")]) == 0
    out = capsys.readouterr().out
    assert "#samples=60" in out and float(out.split("P@1=")[1].split()[0]) > 0.9
    (tmp_path / "two.txt").write_text("1\t2:1.0,1:9.0\n3\t3:1.0\n")
    for extra, want in (([], 1.0), (["--ordered"], 0.5)):
        assert pipeline.main(["score", *extra, str(tmp_path / "two.txt")]) == 0
        assert f"P@1={want:.6f}" in capsys.readouterr().out
    assert pipeline.main(["score", str(tmp_path / "two.txt"), str(tmp_path / "train.txt"), "0.55", "1.5"]) == 0
    assert "PSP@1=" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        pipeline.main(["other", settings])


def test_a_line_is_parsed_once(spark):
    """The filter on what a line holds stays above its parsing, so no line is split and cast twice."""
    lines = spark.createDataFrame([(1, "3,4 1:2.5 7:1"), (2, "x 1:2"), (3, "5"), (4, "6 2:1\r\n")], "row_id long, value string")
    d = svmlight.parse_lines(lines)
    assert [(r["row_id"], r["labels"], [tuple(f) for f in r["features"]]) for r in d.orderBy("row_id").collect()] == [(1, [3, 4], [(1, 2.5), (7, 1.0)]), (4, [6], [(2, 1.0)])]
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1
