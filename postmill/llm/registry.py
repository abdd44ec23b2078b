"""Queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from .chat import op10_chat
from .decontamination import OP5_SQL, op5_decontamination
from .dual_tree import OP13_SQL, op13_dual_tree
from .html_text import op8_html
from .language_id import op7_language_id
from .lexical_search import OP12_SQL, op12_lexical_search
from .merkle import op9_merkle
from .mixing import OP4_SQL, op4_mixing
from .ngram_lm import op2_lm
from .simhash import op1_simhash
from .substring_dedup import OP6_SQL, op6_substring_dedup
from .token_counts import op11_token_counts
from .url_filter import op3_url_filter

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_lm": op2_lm,
    "op3_url_filter": op3_url_filter,
    "op4_mixing": op4_mixing,
    "op5_decontamination": op5_decontamination,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_language_id": op7_language_id,
    "op8_html": op8_html,
    "op9_merkle": op9_merkle,
    "op10_chat": op10_chat,
    "op11_token_counts": op11_token_counts,
    "op12_lexical_search": op12_lexical_search,
    "op13_dual_tree": op13_dual_tree,
}
#: The others have none: SQL can't express them or is too slow on whole tables; tests hold them against brute force.
SQL = {"op4_mixing": OP4_SQL, "op5_decontamination": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op12_lexical_search": OP12_SQL, "op13_dual_tree": OP13_SQL}
