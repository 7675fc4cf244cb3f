"""The models in the score: cross-fitted, free of ids, saved and read by version, equal in batch and stream."""

import pytest
from pyspark.sql import functions as F

from lurewatch.operators import evaluate as EV
from lurewatch.operators import intent as IN
from lurewatch.plans.scoring import score_by, scored_rows
from lurewatch.plans.views import view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def mail(spark):
    return view(spark, SF, "messages").cache()


@pytest.fixture(scope="module")
def rows(mail):
    return scored_rows(mail)


@pytest.fixture(scope="module")
def model(rows):
    return IN.fit_intent(rows)


def probabilities(model, rows):
    return {r["message_id"]: r["p"] for r in model.predict(rows).collect()}


def test_held_out_rows_are_ranked_well(model, rows):
    """Every probability comes from models of the other folds."""
    told = model.predict(rows).join(rows.select("message_id", F.col("label").alias("y")), "message_id")
    assert EV.roc_auc(told.select("y", "p")).first()["auc"] > 0.97
    assert told.agg(F.avg(F.pow(F.col("p") - F.col("y"), 2))).first()[0] < 0.08


def test_a_fold_is_scored_by_models_that_never_saw_it(rows, model):
    """Turning the labels of a fold around changes nothing in that fold's own weights."""
    turned = IN.fit_intent(rows.withColumn("label", F.when(F.col("fold") == 2, 1 - F.col("label")).otherwise(F.col("label"))))
    own = [{tuple(r) for r in m.weights.where("fold = 2").collect()} for m in (model, turned)]
    assert own[0] == own[1] and own[0]
    other = [{tuple(r) for r in m.weights.where("fold = 1").collect()} for m in (model, turned)]
    assert other[0] != other[1]


def test_ids_play_no_part(spark, mail, rows, model):
    before = probabilities(model, rows)
    shifted = scored_rows(mail.withColumn("message_id", F.lit(10_000) - F.col("message_id")))
    after = probabilities(IN.fit_intent(shifted), shifted)
    assert {10_000 - i: p for i, p in before.items()} == after


def test_copies_share_a_fold(mail, rows):
    again = scored_rows(mail.withColumn("message_id", F.col("message_id") + 1000))
    pair = rows.join(again.select((F.col("message_id") - 1000).alias("message_id"), F.col("fold").alias("other")), "message_id")
    assert pair.where("fold <> other").isEmpty()


def test_save_and_load_by_version(spark, model, rows, tmp_path):
    with pytest.raises(FileNotFoundError):
        IN.IntentModel.load(spark, f"{tmp_path}/m")
    model.save(f"{tmp_path}/m", 3)
    IN.IntentModel(model.weights.limit(0), model.abc, model.knots).save(f"{tmp_path}/m", 12)
    (tmp_path / "m" / "v=13" / "weights").mkdir(parents=True)  # a version that was never finished
    assert probabilities(IN.IntentModel.load(spark, f"{tmp_path}/m", 3), rows) == probabilities(model, rows)
    assert IN.IntentModel.load(spark, f"{tmp_path}/m").weights.count() == 0


def test_score_follows_the_mail_and_the_model(mail, model):
    some = mail.where("message_id < 40")
    turned = some.withColumn("message_id", F.lit(39) - F.col("message_id"))
    a, b = ({r["message_id"]: (r["p_model"], r["severity"], r["verdict"]) for r in score_by(m, model).collect()} for m in (some, turned))
    assert {39 - i: v for i, v in a.items()} == b and len({v[0] for v in a.values()}) > 5


def test_odd_rows(spark, rows, model):
    """No label of one kind, no marks, an empty table."""
    one = IN.fit_intent(rows.where("label = 1"))
    assert all(0 <= p <= 1 for p in probabilities(one, rows).values())
    bare = rows.limit(3).withColumn("words", F.expr("CAST(array() AS array<string>)")).withColumn("shape", F.col("words"))
    assert all(0 <= p <= 1 for p in probabilities(model, bare).values())
    assert model.predict(rows.limit(0)).count() == 0 and IN.fit_intent(rows.limit(0)).predict(rows.limit(0)).count() == 0


def test_vector_classifier(rows):
    from lurewatch.operators import scoring as SC
    voted = SC.with_vote_result(SC.with_votes(rows))
    told = IN.predict_vectors(rows, *IN.fit_vectors(voted))
    assert told.count() == rows.count() and told.where("clf_p < 0.2 OR clf_p > 1").isEmpty()
    sure = voted.where(F.col("rule_vector").isin(*IN.VECTORS) & (F.col("rule_confidence") >= 0.5) & (F.col("label") == 1)).select("message_id", "rule_vector")
    assert sure.join(told, "message_id").agg(F.avg((F.col("rule_vector") == F.col("clf_vector")).cast("double"))).first()[0] > 0.8
