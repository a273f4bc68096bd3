"""Views that must give all of their members and pairs."""

from hashlib import sha256

import pandas as pd

from driftwell.operators import ledger
from driftwell.plans import views


def test_a_key_s_digest_is_of_all_members_in_order_across_batches():
    rows = [("a", 1.0, 2), ("a", 2.0, 1), ("a", 10.0, 3), ("b", None, 1), ("b", 7.0, 1)]
    batches = [pd.DataFrame(rows[i : i + 2], columns=["topic", "conv_id", "n"]) for i in range(0, len(rows), 2)]
    got = [tuple(r) for b in ledger.ordered_digests(iter(batches)) for r in b.itertuples(index=False)]
    assert got == [("a", 3, sha256(b"1,2,10").hexdigest(), 6), ("b", 1, sha256(b"7").hexdigest(), 2)]


def test_all_pages_of_a_path_are_paired(spark, tmp_path):
    spark.createDataFrame([(i, f"http://h{i}.org/x/y") for i in range(4)] + [(9, "http://h.org/z")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(tuple(r) for r in views.path_join(spark, str(tmp_path)).collect()) == [(a, b) for a in range(4) for b in range(a + 1, 4)]


def test_no_link_between_different_customers_is_lost(spark, tmp_path):
    """2 and 3 share a signal with each other as well as with the first of their group."""
    rows = [(1, "A", 100.0, 5), (2, "A", 200.0, 5), (3, "A", 300.0, 5), (4, "A", 300.0, 5), (5, "B", 200.0, 6), (6, None, 200.0, 5)]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string, c_acctbal double, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = sorted(tuple(r) for r in views.signal_pairs(spark, str(tmp_path)).collect())
    assert got == [(1, 2, 1), (1, 3, 1), (2, 3, 1), (2, 5, 1), (3, 4, 3)]
