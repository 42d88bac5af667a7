"""All registered queries of the library and their SQL."""

from . import q_board, q_calendar, q_clinical, q_curation, q_evaluation, q_extract, q_features, q_lags, q_ledgers, q_models, q_sources, q_streaming  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
