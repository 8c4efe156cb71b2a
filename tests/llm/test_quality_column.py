"""The score's expression doesn't grow with the number of rules: the driver plans and compiles it."""

import math
import random

import numpy as np
from ledgerloom.llm.quality import STATISTICS, Rule, RuleEnsemble
from pyspark.sql import functions as F


def ensemble(rules):
    rng = random.Random(rules)
    bounds = lambda: (rng.randrange(len(STATISTICS)), *rng.choice([(rng.random(), math.inf), (-math.inf, rng.random()), (0.2, 0.9)]))
    return RuleEnsemble(-0.25, tuple((rng.uniform(-1, 1), Rule(tuple(bounds() for _ in range(rng.randint(1, 3))))) for _ in range(rules)))


def test_scores_are_those_of_the_rules_and_the_plan_keeps_its_size(spark):
    x = np.random.default_rng(5).random((200, len(STATISTICS)))
    x[0], x[1] = 0, 1
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, v array<double>")
    nodes = {}
    for n in (0, 1, 20, 200):
        model = ensemble(n)
        scored = df.select("i", model.column(F.col("v")).alias("score"))
        got = [r.score for r in scored.orderBy("i").collect()]
        np.testing.assert_allclose(got, model.scores(x), rtol=1e-14)
        nodes[n] = scored._jdf.queryExecution().analyzed().expressions().apply(1).collectLeaves().size()
    assert nodes[200] == nodes[20] < 50
