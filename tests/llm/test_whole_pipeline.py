"""SimHash links are complete or refused."""

import pytest

from titrelake.llm import simhash


def test_links_refuse_a_radius_beyond_their_reach(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), radius=4)
