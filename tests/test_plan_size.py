import os

import pytest

from docloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["cross_previews", "snippet_files", "markdown_inventory", "inventory_texts"])
def test_hits_are_found_once(spark, name):
    """Hits that each use found anew made plans of 134 exchanges and 285 explodes for cross_previews, under which the driver ran out of memory."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 40 and plan.count("Generate") <= 12
