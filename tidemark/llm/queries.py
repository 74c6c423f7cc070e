"""Registry of this subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..scratch import importable
from .decontaminate import OP2_SQL, op2_decontaminate
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .html_text import op9_html_text
from .jaccard_join import OP5_SQL, op5_jaccard_join
from .language_id import op8_language_id
from .mixing import OP4_SQL, op4_mixing
from .pii import op1_pii
from .secrets import op7_secrets
from .substring_dedup import OP3_SQL, op3_substring_dedup
from .suffix_dedup import op10_suffix_dedup

def _ready(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return query(spark, sf_dir)

    return run


_ALL = {
    "op1_pii": op1_pii,
    "op2_decontaminate": op2_decontaminate,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_mixing": op4_mixing,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_secrets": op7_secrets,
    "op8_language_id": op8_language_id,
    "op9_html_text": op9_html_text,
    "op10_suffix_dedup": op10_suffix_dedup,
}

QUERIES = {name: _ready(query) for name, query in _ALL.items()}

ORACLE_SQL = {
    "op2_decontaminate": OP2_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op4_mixing": OP4_SQL,
    "op5_jaccard_join": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
}
