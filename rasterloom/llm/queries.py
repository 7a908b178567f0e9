"""The queries of this subpackage and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from .ctw import op10_lm_ctw
from .fingerprints import op4_document_fingerprints
from .line_dedup import OP3_SQL, op3_line_dedup
from .ngram_jaccard import op2_ngram_jaccard_join
from .nn_descent import op6_nn_descent
from .packing import op7_best_fit_packing
from .secrets import op1_secret_scan
from .sentencepiece_viterbi import op9_sentencepiece
from .toxicity import op5_toxicity
from .warc import op8_warc_round_trip


def queries() -> dict:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_line_dedup": op3_line_dedup,
        "op4_document_fingerprints": op4_document_fingerprints,
        "op5_toxicity": op5_toxicity,
        "op6_nn_descent": op6_nn_descent,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_warc_round_trip": op8_warc_round_trip,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_lm_ctw": op10_lm_ctw,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL}
