"""Schemas of payloads, corpus and index."""

from __future__ import annotations

PAYLOAD = (
    "id string, "
    "transaction struct<amount:double,installments:double,requested_at:string>, "
    "customer struct<avg_amount:double,tx_count_24h:double,known_merchants:array<string>>, "
    "merchant struct<id:string,mcc:string,avg_amount:double>, "
    "terminal struct<is_online:boolean,card_present:boolean,km_from_home:double>, "
    "last_transaction struct<timestamp:string,km_from_current:double>"
)
CORPUS = "vector array<double>, label string"
#: A transaction's fields, typed, with defaults for what is missing.
REQUEST = (
    "amount", "installments", "requested_ts", "customer_avg", "tx_count_24h", "known_merchants", "merchant_id", "mcc",
    "merchant_avg", "is_online", "card_present", "km_from_home", "has_last", "last_ts", "km_from_last",
)
