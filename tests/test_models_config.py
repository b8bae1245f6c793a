"""The boosting rounds of job and queries."""
from spreadforge.config import JobConfig, ModelConfig
from spreadforge.plans import catalog


def test_job_and_queries_boost_fifty_rounds():
    assert JobConfig().model.max_iter == ModelConfig().max_iter == catalog.QUERY_MODEL.max_iter >= 50


def small_market(spark, rows=400):
    from pyspark.sql import functions as F
    return spark.range(rows).select(F.col("id").alias("idx"), F.expr("timestamp'2024-01-01' + make_interval(0,0,0,0,0,30*id)").alias("ts"),
                                   (F.sin("id") + F.col("id") % 3 - 1).alias("spr_IDA1_DAM"), (F.col("id") % 3).cast("double").alias("PriceDAM"),
                                   F.sin("id").alias("wave_DAM"))


def test_fit_score_grows_every_published_round(spark, monkeypatch):
    from dataclasses import replace

    from spreadforge.config import MODEL_PARAMS, TransitionSpec
    from spreadforge.operators import models as M
    spec = TransitionSpec("DAM→IDA1", "spr_IDA1_DAM", ("_DAM", "PRICEDAM"), ())
    monkeypatch.setattr(M, "usable_transitions", lambda *a: [spec])
    fits = M.run_models(small_market(spark), replace(catalog.QUERY_MODEL, burn_in=10))
    assert MODEL_PARAMS["n_estimators"] == 800
    for model in (fits[0].clf, fits[0].reg):
        assert len(model.trees) == 800
    assert fits[0].scored.count() == 78 and all(0 <= r.p_up <= 1 for r in fits[0].scored.collect())


def grown(monkeypatch):
    """One transition, and the models that the booster has grown."""
    from spreadforge.config import TransitionSpec
    from spreadforge.operators import boost as B
    from spreadforge.operators import models as M
    fit, models = B.fit, []
    monkeypatch.setattr(M, "usable_transitions", lambda *a: [TransitionSpec("DAM→IDA1", "spr_IDA1_DAM", ("_DAM", "PRICEDAM"), ())])
    monkeypatch.setattr(B, "fit", lambda binned, pool, s: models.extend(pool) or fit(binned, pool, s))
    return models


def test_pipeline_job_grows_every_published_round(spark, monkeypatch):
    """The two models of the split and those of five folds; the job is left once they are scored."""
    from spreadforge.plans import job

    class Scored(Exception):
        pass

    def stop(fits):
        raise Scored

    models = grown(monkeypatch)
    monkeypatch.setattr(catalog, "market_panel", lambda *a: small_market(spark, 1100))
    monkeypatch.setattr(job, "build_features", lambda raw: raw)
    monkeypatch.setattr(job.M, "scored_union", stop)
    try:
        catalog.q_pipeline_job(spark, "")
    except Scored:
        pass
    assert [m.target for m in models].count("size") == 1 and [len(m.trees) for m in models] == [800] * 7


def test_walk_forward_cv_grows_every_published_round(spark, monkeypatch):
    models = grown(monkeypatch)
    monkeypatch.setattr(catalog, "_wide_ckpt", lambda *a: small_market(spark, 1100))
    rows = catalog.q_walk_forward_cv(spark, "").collect()
    assert [len(m.trees) for m in models] == [800] * 5
    assert sorted((r.fold, r.n_test) for r in rows) == [(k, 428 // 6) for k in range(5)] and all(r.acc_ok and r.summary_ok for r in rows)
