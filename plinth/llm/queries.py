"""The registered queries of this subpackage and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ballmeans, chat, exact, merkle, warc
from .ann import op7_nearest
from .decontam import op1_decontamination
from .langid import op9_language_id
from .licenses import op10_license_scan
from .mix import op5_source_mix
from .neardup import op4_near_duplicates
from .pack import op8_token_packing
from .repeats import op2_repeated_strings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_repeated_strings": op2_repeated_strings,
    "op3_warc": warc.op3_warc,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_source_mix": op5_source_mix,
    "op6_chat_format": chat.op6_chat_format,
    "op7_nearest": op7_nearest,
    "op8_token_packing": op8_token_packing,
    "op9_language_id": op9_language_id,
    "op10_license_scan": op10_license_scan,
    "op11_ball_kmeans": ballmeans.op11_ball_kmeans,
    "op12_exact_dedup": exact.op12_exact_dedup,
    "op13_merkle": merkle.op13_merkle,
}

ORACLES: dict[str, str] = {
    "op3_warc": warc.ORACLE,
    "op6_chat_format": chat.ORACLE,
    "op11_ball_kmeans": ballmeans.ORACLE,
    "op12_exact_dedup": exact.ORACLE,
    "op13_merkle": merkle.ORACLE,
}
