"""Training runs: versions, matrices, the best of several."""

import random

from tidewell.operators import training
from tidewell.storage import shared_dir


def test_runs_are_kept_once_and_chosen(spark):
    pick = random.Random(2)
    rows = [(i, i % 3, [pick.gauss(4 * (i % 3 == k), 1) for k in range(3)]) for i in range(300)] + [(900, None, [1.0, 0.0, 0.0]), (901, 1, None)]
    schema = "id long, label int, v array<double>"
    good = training.train(spark.createDataFrame(rows, schema), "id", "label", "v")
    again = training.train(spark.createDataFrame(rows[::-1], schema).repartition(7), "id", "label", "v")
    assert good.version == again.version and good.metrics.first().accuracy > 0.9
    assert sum(r.n for r in good.confusion.collect()) == good.metrics.first().n_held
    assert good.metrics.first().n_held + good.metrics.first().n_train == 300
    noise = [(i, pick.randrange(3), v) for i, _, v in rows[:300]]
    bad = training.train(spark.createDataFrame(noise, schema), "id", "label", "v")
    kept = training.Runs(spark, f"{shared_dir(spark)}/runs-{random.random()}")
    assert kept.best() is None
    assert [kept.save(r) for r in (bad, good, again)] == [True, True, False]
    assert kept.best() == good.version and kept.read(good.version).count() == 3
    assert sorted(map(tuple, kept.read(bad.version, "confusion").collect())) == sorted(map(tuple, bad.confusion.collect()))
