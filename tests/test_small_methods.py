"""Many sheets of formulas run in methods that HotSpot compiles."""

from tidemark.operators import proposals
from tidemark.sources import adapters

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def test_judged_proposals_limit_the_size_of_methods(spark):
    lines = adapters.proposals(spark, "/root/testdata/sf0.001")
    before = spark.conf.get(LIMIT)
    try:
        for query in (proposals.judged, proposals.option_roi):
            spark.conf.unset(LIMIT)
            query(lines)
            assert int(spark.conf.get(LIMIT)) == 8000
            spark.conf.set(LIMIT, "20000")  # one that was chosen stays
            query(lines)
            assert int(spark.conf.get(LIMIT)) == 20_000
    finally:
        spark.conf.set(LIMIT, before)
