import os

import pytest
from pyspark.sql import functions as F

from talus.plans import factory
from talus.sources.tables import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def statuses(spark, inputs):
    return {(r.node, r.check_name): (r.status, r.downstream) for r in factory.run_evidence(spark, inputs)[1].collect()}


def test_dataflow_passes_and_stops(spark):
    inputs = {n: table(spark, DATA, n) for n in factory.INPUTS}
    good = statuses(spark, inputs)
    assert len(good) == 8 and set(good.values()) == {("passed", "go_on")}
    lost = statuses(spark, inputs | {"raw_doc_asset": inputs["raw_doc_asset"].withColumn("manifest_id", F.lit(None).cast("string"))})
    assert lost["seed_manifests", "not_empty"] == ("failed", "stop") and lost["document_chunks", "unique"] == ("skipped", "stop") and lost["index_report", "dimensions"][0] == "skipped"
    other = statuses(spark, inputs | {"parsed_section": inputs["parsed_section"].withColumn("source_id", F.lit("unknown"))})
    assert other["raw_doc_assets", "unique"][0] == "passed" and other["parsed_sections", "not_empty"][0] == "failed" and other["chunk_checks", "anchored"][0] == "skipped"
