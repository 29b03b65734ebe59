"""Column functions; the distributed median is in ``plumbline.functions.median``."""

from plumbline.functions.formatting import fmt_bytes, fmt_fixed, fmt_pct_change, pct_change
from plumbline.functions.hashing import mixed_bucket, row_salt

__all__ = [
    "fmt_bytes",
    "fmt_fixed",
    "fmt_pct_change",
    "mixed_bucket",
    "pct_change",
    "row_salt",
]
