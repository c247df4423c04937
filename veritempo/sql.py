"""The SQL of all queries."""

from veritempo import oracle, oracle_claims, oracle_concepts, oracle_questions, oracle_rules, oracle_users, oracle_writes

ORACLE_SQL: dict[str, str] = oracle.ORACLE_SQL | oracle_users.SQL | oracle_rules.SQL | oracle_writes.SQL | oracle_claims.SQL | oracle_concepts.SQL | oracle_questions.SQL
