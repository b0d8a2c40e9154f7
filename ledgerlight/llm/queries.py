"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontamination import op10_latent_decontamination
from .jaccard_join import op9_jaccard_join
from .license_scan import op7_license_scan
from .mixing import op4_entropy_mixing
from .quality_rules import op3_quality_rules
from .sharding import op5_extendible_hashing
from .sql import QUALITY, REPUTATION
from .substring_dedup import op2_suffix_dedup
from .token_files import op8_token_files
from .url_reputation import op1_url_reputation
from .warc_bundles import op6_warc_bundles

QUERIES = {
    f.__name__: f
    for f in (op1_url_reputation, op2_suffix_dedup, op3_quality_rules, op4_entropy_mixing, op5_extendible_hashing, op6_warc_bundles, op7_license_scan, op8_token_files, op9_jaccard_join, op10_latent_decontamination)
}
ORACLE_SQL: dict[str, str] = {"op1_url_reputation": REPUTATION, "op3_quality_rules": QUALITY}
