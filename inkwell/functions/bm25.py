"""The BM25 score of one term in one document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1 = 1.2
B = 0.75


def term_score(tf: Column, df: Column, doc_len: Column, n_docs: Column, avg_len: Column) -> Column:
    """``idf * (k1 + 1) tf / (K + tf)``; the idf is not clamped, so a term of most documents counts negatively."""
    idf = F.log((n_docs - df + 0.5) / (df + 0.5))
    k = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * doc_len / avg_len)
    return idf * (F.lit(K1 + 1) * tf / (k + tf))
