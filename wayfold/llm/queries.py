"""The queries opN_<name> of the training-data operators."""

from __future__ import annotations

from .decontam import op7_seeded_decontamination
from .fixity import op5_merkle_fixity
from .htmltree import op9_tree_model_html
from .langid import op8_word_backoff_language
from .oggmedia import op2_ogg_media
from .omh import op6_order_minhash
from .packing import op1_best_fit_packing
from .pii import op10_anchor_pii
from .resampling import op11_crc_resampling
from .secrets import op4_secret_scan
from .tokencount import op3_token_counts
from .toxicity import op12_crf_toxicity
from .whitening import op13_lanczos_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_ogg_media,
        op3_token_counts,
        op4_secret_scan,
        op5_merkle_fixity,
        op6_order_minhash,
        op7_seeded_decontamination,
        op8_word_backoff_language,
        op9_tree_model_html,
        op10_anchor_pii,
        op11_crc_resampling,
        op12_crf_toxicity,
        op13_lanczos_whitening,
    )
}

#: None of these can be put as SQL (tokenizers, checksums, models, iteration); tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {}
