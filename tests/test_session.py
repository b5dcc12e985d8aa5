import os
from concurrent.futures import ThreadPoolExecutor

from hearlog.session import at_once, durable, shared_folder, temporary_tables


def tables(spark):
    folder = shared_folder(spark).removeprefix("file:")
    return {name for name in os.listdir(folder) if name.startswith("hearlog-")}


def test_blocks_nest(spark):
    before = tables(spark)
    with temporary_tables(spark):
        with temporary_tables(spark):
            pass
        durable(spark.range(3))
        with temporary_tables(spark):
            durable(spark.range(4))
            assert len(tables(spark) - before) == 2
        assert len(tables(spark) - before) == 1
    assert tables(spark) == before


def test_threads_do_not_share_blocks(spark):
    before = tables(spark)

    def inside(n):
        with temporary_tables(spark):
            durable(spark.range(n + 1))
            return True

    with temporary_tables(spark):
        kept = durable(spark.range(7))
        with ThreadPoolExecutor(4) as pool:
            assert all(pool.map(inside, range(8)))
        assert kept.count() == 7
        at_once(spark, [lambda: durable(spark.range(2)) for _ in range(4)], 2)
    assert tables(spark) == before
