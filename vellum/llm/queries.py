"""The subpackage's queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import mixing, near_dedup, url_filters, warc
from .media_ogg import op10_media
from .mixing import op8_mixing
from .near_dedup import op2_near_dedup
from .quality_gam import op3_quality
from .quality_rules import op4_quality_rules
from .secrets_scan import op1_secrets
from .sentencepiece_table import op7_sentencepiece
from .toxicity import op5_toxicity
from .url_filters import mined_url_rules, op9_url_filters
from .warc import op6_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secrets,
        op2_near_dedup,
        op3_quality,
        op4_quality_rules,
        op5_toxicity,
        op6_warc,
        op7_sentencepiece,
        op8_mixing,
        op9_url_filters,
        op10_media,
        mined_url_rules,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_near_dedup": near_dedup.ORACLE_SQL,
    "op6_warc": warc.ORACLE_SQL,
    "op8_mixing": mixing.ORACLE_SQL,
    "op9_url_filters": url_filters.ORACLE_SQL,
    "mined_url_rules": url_filters.TELLING_SQL,
}
