import threading

from textloom.llm import scratch


def exists(spark, path):
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(spark._jsc.hadoopConfiguration()).exists(named)


def test_staged_and_cleared(spark):
    before = scratch.held()
    df = scratch.staged(spark.range(5), "t")
    (path,) = scratch.held() - before
    assert df.count() == 5 and path.startswith(scratch.shared_dir(spark))
    assert scratch.clear(spark) >= 1 and not scratch.held()
    assert not exists(spark, path)
    assert scratch.staged(spark.range(0), "empty").count() == 0


def test_scopes_leave_other_threads_alone(spark):
    other = []
    with scratch.scope() as made:
        scratch.staged(spark.range(1), "a")
        t = threading.Thread(target=lambda: other.append(scratch.new_path(spark, "other")))
        t.start()
        t.join()
        with scratch.scope() as inner:
            scratch.staged(spark.range(1), "b")
        assert len(inner) == 1
    assert len(made) == 2 and other[0] not in made
    kept = scratch.held()
    assert scratch.clear(spark, only=frozenset(made)) == 2 and scratch.held() == kept - frozenset(made)
    assert not any(exists(spark, p) for p in made)
