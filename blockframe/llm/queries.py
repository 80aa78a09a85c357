"""Registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .archives import OP6_SQL, op6_warc
from .chat import op9_chat
from .decontamination import OP10_SQL, op10_decontamination
from .fertility import op3_fertility
from .language import op4_language
from .packing import op5_packing
from .recurrent import op2_recurrent
from .simhash import op8_simhash
from .substrings import OP7_SQL, op7_substrings
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_recurrent": op2_recurrent,
    "op3_fertility": op3_fertility,
    "op4_language": op4_language,
    "op5_packing": op5_packing,
    "op6_warc": op6_warc,
    "op7_substrings": op7_substrings,
    "op8_simhash": op8_simhash,
    "op9_chat": op9_chat,
    "op10_decontamination": op10_decontamination,
}

ORACLE_SQL: dict[str, str] = {"op6_warc": OP6_SQL, "op7_substrings": OP7_SQL, "op10_decontamination": OP10_SQL}
