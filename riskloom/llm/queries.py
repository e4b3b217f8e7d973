"""The queries of this folder and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP4_SQL, op4_chat
from .decontaminate import op10_decontaminate
from .audit import OP12_SQL, op12_audit
from .linededup import op8_line_dedup
from .packing import op7_packing
from .pieces import op11_pieces
from .simhash import op5_simhash
from .substrings import op6_substrings
from .topk import OP1_SQL, op1_topk
from .toxicity import op9_toxicity
from .trie import op13_trie
from .urlfilter import op3_urlfilter
from .warc import OP2_SQL, op2_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_warc": op2_warc,
    "op3_urlfilter": op3_urlfilter,
    "op4_chat": op4_chat,
    "op5_simhash": op5_simhash,
    "op6_substrings": op6_substrings,
    "op7_packing": op7_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_decontaminate": op10_decontaminate,
    "op11_pieces": op11_pieces,
    "op12_audit": op12_audit,
    "op13_trie": op13_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk": OP1_SQL,
    "op2_warc": OP2_SQL,
    "op4_chat": OP4_SQL,
    "op12_audit": OP12_SQL,
}
