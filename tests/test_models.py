"""The model queries' folds, on the smallest tables."""

import ast

from granary.operators import models
from granary.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_walk_forward_scores_all_folds(spark):
    got = catalogue.QUERIES["ml_walk_forward"](spark, SF).where("model = 'quantile_forest'").collect()
    assert sorted(r.fold_id for r in got) == [1, 2, 3, 4, 5]


def test_search_pools_folds_3_and_5(spark):
    rows = catalogue._learnable(spark, SF)
    for r in catalogue.QUERIES["ml_search"](spark, SF).collect():
        forest = models.quantile_forest(catalogue.ML_FEATURES, "target", **dict(ast.literal_eval(r.params)))
        results = models.run_walk_forward(rows, forest, catalogue.V.CUTOFF, "target", (3, 5))
        want = models.metrics.pooled(results).where("model = 'model'").first().pinball
        assert r.error == "" and abs(r.pinball - want) <= 1e-9 * want


def test_recurrent_network_scores_all_folds(spark):
    got = catalogue.QUERIES["ml_recurrent"](spark, SF).where("model = 'recurrent'").collect()
    assert sorted(r.fold_id for r in got) == [1, 2, 3, 4, 5] and all(r.pinball > 0 for r in got)
