"""Queries against their SQL on lattices far longer than those of the test tables."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loopwise.operators import places
from loopwise.sources import tiles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """Rows 0 to 30 of the lattice, and rows 10,000 to 10,030, whose columns' ways
    share their ids with those of the next columns in the first rows."""
    at = tmp_path_factory.mktemp("far")
    old = spark.read.parquet(f"{SF}/customer.parquet").where("c_custkey = 0").drop("c_custkey")
    low = spark.range(31 * 40).select(F.col("id").alias("c_custkey"))
    low.union(low.select(F.col("c_custkey") + 400_000)).crossJoin(old).write.parquet(f"{at}/customer.parquet")
    for name in ("supplier", "nation", "region"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    return str(at)


def as_sql(name, d, got):
    """Rows of a query and of its SQL, each with its number."""
    con = duckdb.connect()
    for t in ("customer", "supplier", "nation", "region"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    for t in ("orders", "lineitem", "part"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rows = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rows.description]
    return Counter(map(tuple, got.select(*[f"`{c}`" for c in names]).collect())), Counter(rows.fetchall())


@pytest.mark.parametrize("name", ["element_tiles", "network_edges", "network_stats", "nearby_roads", "place_search", "region_elements"])
def test_ways_in_several_columns(spark, far, name):
    got, wanted = as_sql(name, far, entry.queries()[name](spark, far))
    assert got == wanted


def test_breaks_of_ways(spark):
    """A break is no segment, in tiles, packs and named roads; a point that isn't
    known drops its way."""
    kind = "type string, id long, ordinal long, tags map<string,string>, lat double, lon double, nodes array<long>, geometry array<struct<lat:double,lon:double>>, bounds struct<minlat:double,minlon:double,maxlat:double,maxlon:double>"
    ends = [(36.01, 129.31), (36.02, 129.31), None, (38.01, 129.31), (38.02, 129.31)]
    tags = {"highway": "footway", "name": "x"}
    rows = spark.createDataFrame([("way", 1, 1, tags, None, None, [1, 2, None, 3, 4], ends, None), ("way", 2, 2, tags, None, None, [1, 2, 9, 3, 4], ends, None)], kind)
    assert sorted(r.ty for r in tiles.in_tiles(tiles.relevant(rows)).collect()) == [720, 760]
    back = tiles.decoded(tiles.packed(tiles.relevant(rows).drop("area"))).first()
    assert back.nodes == [1, 2, None, 3, 4] and [p and (p.lat, p.lon) for p in back.geometry] == ends
    assert tuple(back.bounds) == (36.01, 129.31, 38.02, 129.31)
    roads = places.named_roads(rows).groupBy((F.col("road_seq") / (1 << 20)).cast("int").alias("w")).agg(F.count("*").alias("n")).collect()
    assert sorted(map(tuple, roads)) == [(1, 2), (2, 3)]
    bad = spark.createDataFrame([("way", 1, 1, {}, None, None, [5, None, 1], [1, 2, 3, 4, 5, 6], None)], tiles.PACKED)
    with pytest.raises(Exception, match="large"):
        tiles.decoded(bad).collect()


def test_pixels_of_all_customers(spark, tmp_path):
    old = spark.read.parquet(f"{SF}/customer.parquet").where("c_custkey = 0").drop("c_custkey")
    keys = [0, 299, 300, 899_999, 5_399_999]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").crossJoin(old).write.parquet(f"{tmp_path}/customer.parquet")
    got = entry.queries()["terrain_pixels"](spark, str(tmp_path)).collect()
    assert sorted((r.c_custkey, r.ix, r.iy) for r in got) == [(k, k % 300, k // 300) for k in keys]
