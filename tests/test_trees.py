"""Dependency trees: parents and depths from indentation."""

from factloom.sources import extract

TREE = """[INFO] Scanning for projects...
[INFO] com.q:root:jar:1.0
[INFO] +- com.q:a:jar:1:compile
[INFO] |  +- org.x:b:jar:2:runtime
[INFO] |  |  \\- org.x:c:jar:3
[INFO] |  \\- org.x:d:jar:4:test
[INFO] \\- com.q:e:jar:5:compile
[INFO]    \\- org.x:c:jar:3:compile
[INFO] BUILD SUCCESS
com.q:other:pom:9
\\- org.x:z:jar:1:compile
"""


def test_parents_and_depths(spark):
    files = spark.createDataFrame([("s", "m/tree.txt", TREE), ("s", "n/tree.txt", TREE.replace("\n", "\r\n")), ("s", "empty", None)], "service_id string, path string, text string")
    got = {(r.artifact_id, r.line): (r.depth, r.parent, r.scope) for r in extract.dependency_tree(files).filter("path = 'm/tree.txt'").collect()}
    assert got == {
        ("root", 1): (0, None, "compile"), ("a", 2): (1, "com.q:root:1.0", "compile"), ("b", 3): (2, "com.q:a:1", "runtime"), ("c", 4): (3, "org.x:b:2", "compile"), ("d", 5): (2, "com.q:a:1", "test"),
        ("e", 6): (1, "com.q:root:1.0", "compile"), ("c", 7): (2, "com.q:e:5", "compile"), ("other", 9): (0, None, "compile"), ("z", 10): (1, "com.q:other:9", "compile"),
    }
    assert extract.dependency_tree(files).count() == 18
    flat = [(r.path, r.to_artifact, r.scope, r.transitive) for r in extract.tree_dependencies(files).collect()]
    assert sorted(flat) == sorted(("m/tree.txt", a, s, True) for a, s in [("a", "compile"), ("b", "runtime"), ("c", "compile"), ("d", "test"), ("e", "compile"), ("z", "compile")])


def test_trees_made_from_one_row_group_are_read_by_many_tasks(spark, monkeypatch):
    from factloom.plans import source_queries
    from factloom.sources import extract

    seen, tree = [], extract.dependency_tree
    monkeypatch.setattr(extract, "dependency_tree", lambda files: seen.append(files) or tree(files))
    source_queries.i26_dependency_trees(spark, "/root/testdata/sf0.001")
    assert seen[0].rdd.getNumPartitions() >= 16
