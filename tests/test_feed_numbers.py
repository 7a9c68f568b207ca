"""Row numbers of feeds have a room of their own, and nothing may leave it."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vacancia.sources.common import explode_items, union_feeds


def test_numbers_within_their_room_are_kept(rows):
    feeds = [rows("seq long", (0,), ((1 << 58) - 1,)), rows("seq long", (0,), (None,))]
    got = {r.seq for r in union_feeds(feeds).collect()}
    assert got == {0, (1 << 58) - 1, 1 << 58, None}
    last = (1 << 34) - 1
    exploded = explode_items(rows("seq long", (last,)), F.array(F.lit("a"), F.lit("b")))
    assert [r.seq for r in exploded.orderBy("seq").collect()] == [last << 24, (last << 24) + 1]


@pytest.mark.parametrize("seq", [-1, 1 << 58])
def test_numbers_of_another_feed_stop_the_run(rows, seq):
    with pytest.raises(PySparkException, match="must be from 0"):
        union_feeds([rows("seq long", (seq,)), rows("seq long", (0,))]).select("seq").collect()


def test_payload_numbers_of_another_feed_stop_the_run(rows):
    with pytest.raises(PySparkException, match="must be from 0"):
        explode_items(rows("seq long", (1 << 34,)), F.array(F.lit("a"))).select("seq").collect()


def test_too_many_feeds(rows):
    with pytest.raises(ValueError, match="33 feeds"):
        union_feeds([rows("seq long", (0,))] * 33)
