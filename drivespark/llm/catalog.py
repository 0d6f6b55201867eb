"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from .queries_bpe import op13_byte_bpe
from .queries_decontaminate import OP6_SQL, op6_decontaminate
from .queries_labels import op3_quality, op10_toxicity
from .queries_lexical import OP12_SQL, op12_lexical
from .queries_licenses import OP1_SQL, op1_licenses
from .queries_lm import op2_lm
from .queries_mixing import OP4_SQL, op4_mix
from .queries_neighbours import op9_neighbours
from .queries_repeats import OP8_SQL, op5_suffixes, op8_substrings
from .queries_resampling import OP11_SQL, op11_resample
from .queries_simhash import op7_simhash

QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_lm": op2_lm,
    "op3_quality": op3_quality,
    "op4_mix": op4_mix,
    "op5_suffixes": op5_suffixes,
    "op6_decontaminate": op6_decontaminate,
    "op7_simhash": op7_simhash,
    "op8_substrings": op8_substrings,
    "op9_neighbours": op9_neighbours,
    "op10_toxicity": op10_toxicity,
    "op11_resample": op11_resample,
    "op12_lexical": op12_lexical,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLES = {"op1_licenses": OP1_SQL, "op4_mix": OP4_SQL, "op6_decontaminate": OP6_SQL, "op8_substrings": OP8_SQL, "op11_resample": OP11_SQL, "op12_lexical": OP12_SQL}
