"""Write checks of the row policies, form by form."""

import pytest

from larkspur.operators import policy

CASES = [
    ("follows", "follower_id long, followee_id long", [(1, 2), (1, 1), (2, 1), (None, 1)], [(1, 2)]),
    ("message_requests", "requester_id long, recipient_id long", [(1, 2), (1, 1), (2, 1)], [(1, 2)]),
    ("referrals", "referrer_id long, referred_id long", [(2, 1), (1, 1), (1, 2)], [(2, 1)]),
    ("conversations", "id long, created_by long", [(7, 1), (8, 2), (9, None)], [(7, 1)]),
    ("conversation_participants", "conversation_id long, user_id long", [(7, 2), (8, 1)], [(7, 2), (8, 1)]),
    ("hashtags", "tag string, user_id long", [("a", None), ("b", 2)], [("a", None), ("b", 2)]),
    ("post_likes", "post_id long, user_id long", [(5, 1), (5, 2)], [(5, 1)]),
    ("messages", "conversation_id long, sender_id long", [(7, 1), (8, 1), (7, 2)], [(7, 1)]),
]


@pytest.mark.parametrize(("table", "schema", "rows", "allowed"), CASES)
def test_only_allowed_rows_are_written(spark, table, schema, rows, allowed):
    members = spark.createDataFrame([(7, 1), (7, 2), (8, 2)], "conversation_id long, user_id long")
    df = spark.createDataFrame(rows, schema)
    key = lambda found: sorted(map(tuple, found), key=repr)
    assert key(policy.insertable(df, table, 1, members).select(*df.columns).collect()) == key(allowed)
    assert policy.insertable(df, table, None, members).isEmpty()
    assert policy.insertable(df, "messages", 1).isEmpty() if table == "messages" else True
