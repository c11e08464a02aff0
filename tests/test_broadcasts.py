"""Tables that grow with the recordings aren't gathered on the driver."""

from burrow.operators import session_rows


def test_nearest_files_are_joined_without_broadcasts(spark):
    wanted = spark.createDataFrame([("/d/p/v", f"s{k}", "/d/p") for k in range(9)], "folder string, stem string, project string")
    files = spark.createDataFrame([(f"/d/p/{'v' if k % 2 else 'else'}/s{k}.tsv",) for k in range(8)], "path string")
    found = session_rows.nearest_file(wanted, files)
    rows = {r["stem"]: (r["found"], r["tier"]) for r in found.collect()}
    assert rows["s1"] == ("/d/p/v/s1.tsv", 0) and rows["s2"] == ("/d/p/else/s2.tsv", 9) and rows["s8"] == (None, None)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
