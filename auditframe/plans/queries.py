"""All named queries over the test tables: importing their modules registers them."""

from auditframe.plans import choice_queries, contract_queries, metric_queries, model_queries, relational_queries, statistic_queries, structure_queries, study_queries, vector_queries  # noqa: F401
from auditframe.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
