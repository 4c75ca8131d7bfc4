"""Queries of this subpackage, by name, and their SQL where SQL expresses them."""

from bitweft.llm import exact_dedup, line_dedup, url_filter
from bitweft.llm.bpe import op6_bpe_roundtrip
from bitweft.llm.decontaminate import op10_decontaminate
from bitweft.llm.exact_dedup import op2_exact_dedup
from bitweft.llm.html_extract import op7_html_extract
from bitweft.llm.licenses import op1_license_scan
from bitweft.llm.line_dedup import op8_line_dedup
from bitweft.llm.near_dedup import op5_near_dedup
from bitweft.llm.quality import op9_quality_classifier
from bitweft.llm.secrets import op4_secret_scan
from bitweft.llm.url_filter import op3_url_filter

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_exact_dedup, op3_url_filter, op4_secret_scan, op5_near_dedup, op6_bpe_roundtrip, op7_html_extract, op8_line_dedup, op9_quality_classifier, op10_decontaminate)}

ORACLES = {"op2_exact_dedup": exact_dedup.SQL, "op3_url_filter": url_filter.SQL, "op8_line_dedup": line_dedup.SQL}
