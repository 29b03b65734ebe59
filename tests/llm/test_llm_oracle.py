import pytest
from conftest import MEDIUM
from oracle import connect, differences

from plumbline.llm.queries import ORACLE_SQL, QUERIES

# Learned models, sampled or packed tokens, byte windows: held against brute force elsewhere.
WITHOUT_SQL = {"pipeline", "op3_suffix_dedup", "op4_sentencepiece", "op5_language_id", "op6_repair_ids", "op8_lm_score", "op12_byte_bpe"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, MEDIUM), connect(MEDIUM), ORACLE_SQL[name]) == []


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLE_SQL) == WITHOUT_SQL
