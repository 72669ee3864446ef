"""Components: right roots, and short texts of plans in the driver."""

import random

from verifold.llm import components, storage


def brute(edges):
    least = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def test_components_and_what_the_driver_keeps(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 130)] + [(0, i) for i in range(200, 240)] + [(rng.randrange(400, 480), rng.randrange(400, 480)) for _ in range(60)] + [(7, 7)]
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    found = storage.save(components.connected(spark.createDataFrame(edges, "a long, b long")), "roots").df
    assert sorted((r.node, r.root) for r in found.collect()) == sorted(brute([e for e in edges if e[0] != e[1]]).items())
    kept = store.executionsList(before, 1000)
    written = []
    for i in range(kept.size()):
        text = kept.apply(i).physicalPlanDescription()
        written += [len(text)] if "InsertIntoHadoopFsRelationCommand" in text else []
    # Without the bound the longest had 28,660 characters.
    assert len(written) > 5 and max(written) < 4200
