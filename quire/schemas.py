"""Declared schemas, as DDL text."""

LINE_ITEM = "struct<description:string,quantity:double,unit_price:double,total:double>"

GROUND_TRUTH = (
    "sample_id bigint, document_type string, field string, kind string, expected_text string, expected_number double"
)
