from __future__ import annotations

from plumbline.session import shared_dir, ship


def test_the_shared_folder_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert spark.range(3).checkpoint().count() == 3


def test_shipping_is_done_once(spark):
    ship(spark)
    ship(spark)
    assert spark.range(1).rdd.map(lambda _: __import__("plumbline").__version__).collect()
