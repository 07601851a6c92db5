"""Plans over a table that is one small file."""

import pytest

from quernstone.plans import ingestion as plans


@pytest.mark.parametrize("name", ["triplet_parse", "json_repair"])
def test_model_outputs_are_dealt_to_all_cores(spark, tmp_path, name):
    spark.createDataFrame([(k, f"Customer#{k}", "BUILDING") for k in range(64)], "c_custkey long, c_name string, c_mktsegment string").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    out = plans.QUERIES[name](spark, str(tmp_path))
    assert f"Repartition {spark.sparkContext.defaultParallelism}, true" in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() > 0
