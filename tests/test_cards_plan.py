"""Cards are parsed once a row: no filter or second use copies the search for prices."""

import pytest

from marketlens.functions.parse import MONEY
from marketlens.operators import keys

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", [keys.q_product_cards, keys.q_card_prices])
def test_prices_are_searched_once(spark, query):
    plan = query(spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(MONEY) == 2  # in the prices, and in the name, which is a line without one
