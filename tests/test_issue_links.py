import duckdb
from oracle import TABLES, differences

import __spark_entry__
from tidewake.plans import facts

SF = "/root/testdata/sf0.001"


def test_acknowledged_counts_issues_by_all_their_requests(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    pairs = con.execute("SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey)").fetchone()[0]
    assert facts.linked_issues(spark, SF).agg({"prs_count": "sum"}).first()[0] == pairs
    sql = __spark_entry__.oracle_sql()["j08_jira_acknowledged"]
    assert "l_quantity >= 40" not in sql
    assert differences(__spark_entry__.queries()["j08_jira_acknowledged"](spark, SF), sql, SF) == []
