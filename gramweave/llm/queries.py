"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .ann import op2_nearest_neighbours
from .collocations import ORACLE as COLLOCATION_ORACLE
from .collocations import op13_collocations
from .filter_audit import ORACLE as AUDIT_ORACLE
from .filter_audit import op12_filter_audit
from .fingerprints import op6_fingerprints
from .html_extract import op8_html_extraction
from .jaccard_join import ORACLE as JACCARD_ORACLE
from .jaccard_join import op9_jaccard_join
from .language_id import op4_language_id
from .license_scan import ORACLE as LICENSE_ORACLE
from .license_scan import op11_license_scans
from .packing import op7_best_fit_packing
from .secret_scan import ORACLE as SECRET_ORACLE
from .secret_scan import op10_secret_scans
from .token_files import op1_token_files
from .weak_quality import op3_quality_classifier
from .word_shuffle import op5_word_shuffle

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_language_id": op4_language_id,
    "op5_word_shuffle": op5_word_shuffle,
    "op6_fingerprints": op6_fingerprints,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_html_extraction": op8_html_extraction,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_secret_scans": op10_secret_scans,
    "op11_license_scans": op11_license_scans,
    "op12_filter_audit": op12_filter_audit,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op9_jaccard_join": JACCARD_ORACLE,
    "op10_secret_scans": SECRET_ORACLE,
    "op11_license_scans": LICENSE_ORACLE,
    "op12_filter_audit": AUDIT_ORACLE,
    "op13_collocations": COLLOCATION_ORACLE,
}
