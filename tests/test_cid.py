from pyspark.sql import functions as F

from loomgraph.functions.cid import cid, cid_to_uri, uri_to_cid


def test_golden_vectors(spark):
    rows = spark.createDataFrame([("",), ("abc",), (None,)], "t string").select(cid(F.col("t")).alias("c")).collect()
    assert [r.c for r in rows] == [
        "bafkreihdwdcefgh4dqkjv67uzcmw7ojee6xedzdetojuzjevtenxquvyku",
        "bafkreif2pall7dybz7vecqka3zo24irdwabwdi4wc55jznaq75q7eaavvu",
        None,
    ]


def test_uri_round_trip(spark):
    r = spark.range(1).select(uri_to_cid(cid_to_uri(F.lit("bx"))).alias("a"), uri_to_cid(F.lit("http://x")).alias("b")).first()
    assert (r.a, r.b) == ("bx", "http://x")
