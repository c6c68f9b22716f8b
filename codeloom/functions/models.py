"""Plug any embedding model into V2 with ``predict_batch_udf``.

``make_fn`` is called once per Python worker and returns a function mapping a
NumPy array of texts to a 2-D float array (one row per text); batches travel as
Arrow.  The built-in default model (hashed bag of words) needs no Python at all
(:func:`codeloom.operators.vectors.hash_embed`)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql.types import ArrayType, FloatType


def model_embedder(make_fn, dim: int, batch_size: int = 256):
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(make_fn, return_type=ArrayType(FloatType()), batch_size=batch_size)

    def embed(text: Column) -> Column:
        return udf(text)
    embed.dim = dim
    return embed
