import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def graph(spark):
    """Builds nodes and edges from short lists: ids or (id, path), and (src, dst[, kind, how])."""
    from graphloft import schemas

    def build(nodes, edges):
        n = []
        for x in nodes:
            i, path = x if isinstance(x, tuple) else (x, f"src/f{x}.rs")
            n.append((i, "r", path, f"m::s{i}", "function", i, i + 1, f"pub fn s{i}()"))
        e = [(x[0], x[1], x[2] if len(x) > 2 else "CALLS_EXACT", 1.0, None, x[3] if len(x) > 3 else None) for x in edges]
        return schemas.GraphTables(spark.createDataFrame(n, schemas.NODES), spark.createDataFrame(e, schemas.EDGES))

    return build
