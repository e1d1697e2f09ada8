"""Registered queries take all arms, folds, repeats and rules."""

import pytest

from offerflow.operators import effects, quotas, selection
from offerflow.plans import models
from offerflow.plans import quotas as quota_plans
from offerflow.plans.catalog import CATALOG, Inputs
from offerflow.plans.scores import ARMS

SF = "/root/testdata/sf0.001"


def test_effects_of_all_arms(spark):
    t = Inputs(spark, SF)
    rows = {r["arm"]: r["n"] for r in CATALOG["dml_effect"].run(t).collect()}
    sizes = {r["treatment"]: r["count"] for r in models.people(t).groupBy("treatment").count().collect()}
    assert rows == {a: sizes[a] + sizes["control"] for a in ARMS}
    assert CATALOG["propensity"].run(t).columns == ["uid", *[f"p_{a}" for a in ARMS]]
    assert [c for c in CATALOG["x_learner"].run(t).columns if c != "uid"] == [f"ite_{a}" for a in ARMS]


@pytest.mark.parametrize("module, name, plan, want", [
    (effects, "propensity", models.propensity, {"folds": 5}), (effects, "dml_effect", models.dml_effect, {"folds": 5}),
    (selection, "null_importance", models.null_importance, {"k": 10})])
def test_folds_and_repeats(spark, monkeypatch, module, name, plan, want):
    seen = {}
    monkeypatch.setattr(module, name, lambda *args, **more: seen.update(more))
    plan(Inputs(spark, SF))
    assert {k: seen.get(k) for k in want} == want


def test_groups_take_rules(spark, monkeypatch):
    seen = []
    real = quotas.allocate_groups

    def spy(*args, **more):
        seen.append(args[6] if len(args) > 6 else more.get("rules"))
        return real(*args, **more)

    monkeypatch.setattr(quotas, "allocate_groups", spy)
    t = Inputs(spark, SF)
    got = quota_plans.allocate_groups(t).collect()
    assert seen == [quota_plans.RULES]
    assert len(got) == quota_plans.eligible(quota_plans.ruled_users(t)).count()
