"""Queries of this subpackage for __spark_entry__, and their SQL where SQL can express them."""

from __future__ import annotations

from veristrata.llm.chat import OP6_SQL, op6_chat
from veristrata.llm.dac import op10_dac
from veristrata.llm.decontaminate import op2_decontaminate
from veristrata.llm.jaccard import OP7_SQL, op7_jaccard
from veristrata.llm.langid import op3_langid
from veristrata.llm.lm import op1_lm
from veristrata.llm.media import op8_flac
from veristrata.llm.merkle import OP13_SQL, op13_merkle
from veristrata.llm.packing import op4_packing
from veristrata.llm.substring import OP5_SQL, op5_substring
from veristrata.llm.suffix import OP9_SQL, op9_suffix
from veristrata.llm.urls import op11_urls
from veristrata.llm.vectors import OP12_SQL, op12_vectors

QUERIES = {
    "op1_lm": op1_lm,
    "op2_decontaminate": op2_decontaminate,
    "op3_langid": op3_langid,
    "op4_packing": op4_packing,
    "op5_substring": op5_substring,
    "op6_chat": op6_chat,
    "op7_jaccard": op7_jaccard,
    "op8_flac": op8_flac,
    "op9_suffix": op9_suffix,
    "op10_dac": op10_dac,
    "op11_urls": op11_urls,
    "op12_vectors": op12_vectors,
    "op13_merkle": op13_merkle,
}
SQL = {"op5_substring": OP5_SQL, "op6_chat": OP6_SQL, "op7_jaccard": OP7_SQL, "op9_suffix": OP9_SQL, "op12_vectors": OP12_SQL, "op13_merkle": OP13_SQL}
