import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1", "check_s", "check_l"])
def test_blocked_sites_go_and_clean_ones_stay(spark, size):
    rows = queries.op3_urls(spark, f"/root/testdata/{size}")
    bad = F.col("host").rlike("casino-win|free-bets|ads-track|spam-farm|cheap-pills|adult-x")
    got = {(r.bad, r.keep): r["count"] for r in rows.where("host is not null").groupBy(bad.alias("bad"), "keep").count().collect()}
    assert set(got) == {(True, False), (False, True)} and got[True, False] > 0, got
    if size == "sf0.1":
        assert rows.where("trust > 0").count() > 0 and rows.where("distrust > 0").count() > 0


def test_linkers_match_the_sql(spark, tmp_path):
    pages = [(1, "http://m.spam-farm.org/", ""), (2, "http://a.net/", '<a href="http://spam-farm.com/">s</a><a href="http://b.net/">b</a><a href="/own">o</a>'), (3, "http://b.net/", '<a href="http://a.net/">a</a>'), (4, "http://c.net/", '<a href="http://d.net/">d</a>')]
    pages += [(5, "http://blog.tionsh.org/", '<a href="http://a.net/">a</a><a href="http://e.net/">e</a>'), (6, None, "x"), (7, "http://e.net/", None), (8, "http://www.b.net/", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op3_urls(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()["op3_urls"]).fetchall()
    assert sorted(tuple(r) for r in got.select("page_id", "host", "trust", "distrust", "keep").collect()) == sorted(want)
    assert {r[0] for r in want if not r[4]} == {1, 2, 3, 6, 8}
