"""Query 11: all embeddings whitened. Eigenvectors have no SQL form; tests compare with a dense decomposition."""

from __future__ import annotations

from evalspark.llm import whitening
from evalspark.llm.registry import query, table


@query("op11_jacobi_davidson_whitening")
def op11_jacobi_davidson_whitening(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings"))
