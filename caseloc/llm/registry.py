"""Queries of the corpus operators. Tokenizers, hashes of shingles, trained models
and packing are outside SQL; there, tests compare with brute force."""

from __future__ import annotations

from .decontaminate import op6_decontaminate
from .jaccard_join import OP12_SQL, op12_jaccard_join
from .langid import op10_langid
from .packing import op4_packing
from .pii import op2_pii
from .quality import op9_quality
from .runs import OP11_SQL, op11_runs
from .secret_scan import op8_secret_scan
from .simhash import op3_simhash
from .sketch import op7_sketch
from .token_store import op1_token_store
from .toxicity import op5_toxicity
from .trie import OP13_SQL, op13_trie


def queries() -> dict:
    return {
        run.__name__: run
        for run in (
            op1_token_store,
            op2_pii,
            op3_simhash,
            op4_packing,
            op5_toxicity,
            op6_decontaminate,
            op7_sketch,
            op8_secret_scan,
            op9_quality,
            op10_langid,
            op11_runs,
            op12_jaccard_join,
            op13_trie,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_runs": OP11_SQL, "op12_jaccard_join": OP12_SQL, "op13_trie": OP13_SQL}
