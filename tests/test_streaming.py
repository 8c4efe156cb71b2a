from ledgerloom.operators.classify import classify
from ledgerloom.plans.bridge import orders_ledger
from ledgerloom.streaming import LEDGER_SCHEMA, classified_stream

SMALL = "/root/testdata/sf0.001"


def test_stream_classifies_as_a_batch(spark, tmp_path):
    names = [x.split()[0] for x in LEDGER_SCHEMA.split(", ")]
    rows = orders_ledger(spark, SMALL).select(*names)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    query = (
        classified_stream(spark, str(tmp_path / "in")).select("id", "category", "revenue_status").writeStream.format("memory")
        .queryName("classified").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    want = classify(rows).select("id", "category", "revenue_status")
    assert sorted(map(tuple, spark.table("classified").collect())) == sorted(map(tuple, want.collect()))
