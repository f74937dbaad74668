"""Neighbour links of odd radii: a link between two fingerprints that each have a smaller neighbour of their own."""

from gridlark.llm import simhash

from .test_duplicates import union


def test_odd_radius_loses_no_link(spark):
    values = [0b0100, 0b1001, 0b1100, 0b1101]
    edges = [(values.index(a), values.index(b)) for a, b in simhash.neighbour_links(spark.createDataFrame([(v,) for v in values], "fp long"), 1).collect()]
    assert all((values[a] ^ values[b]).bit_count() <= 1 for a, b in edges) and union(4, edges) == [0] * 4
