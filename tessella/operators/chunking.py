"""Documents cut into chunks by the first separator that cuts them at all."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import approx_tokens
from ..schema import int_value, with_value

# Separators in order, sources that are never cut, and the most characters of a chunk.
SEPARATORS = ("\n\n", "\n", "\t", ". ", " ")
WHOLE_SOURCES = ("bookmark", "pin")
MOST_CHARS = 4000


def _tokens(text: str) -> int:
    return max(len(text.split()), len(text) // 4)


def _packed(parts: list[str], sep: str, most: int, overlap: int) -> list[str]:
    out, held = [], ""
    for part in parts:
        longer = held + sep + part if held else part
        if not held or _tokens(longer) <= most:
            held = longer
            continue
        if done := held.strip():
            out.append(done)
        tail = held.split()
        held = (" ".join(tail[-overlap:]) + sep + part).strip() if 0 < overlap < len(tail) else part
    if done := held.strip():
        out.append(done)
    return out


def split_text(text: str, most: int = 512, overlap: int = 64) -> list[str]:
    """Chunk texts of a text above `most` tokens; each chunk but the first begins with the last `overlap` words of the
    one before if that had more.  Overlap can make a chunk larger than `most`, as can a part without separator."""
    if overlap >= most:
        raise ValueError("the overlap must be smaller than the chunk")
    pieces = next((p for sep in SEPARATORS if sep in text and len(p := _packed(text.split(sep), sep, most, overlap)) > 1), None)
    if pieces is None:
        w = text.split()
        pieces = [" ".join(w[i:i + most]) for i in range(0, len(w), most - overlap)]
    return [p[i:i + MOST_CHARS] for p in pieces for i in range(0, len(p), MOST_CHARS)]


def _texts(content: Column, most: int, overlap: int) -> Column:
    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, most, overlap))

    return run(content)


def chunk_documents(docs: DataFrame, most: int = 512, overlap: int = 64) -> DataFrame:
    """(id, doc_id, content, title, source, metadata, chunk_idx); chunk ids are the document's with the index.

    Null content is one chunk with null content.  Only documents above the limit pass through Python."""
    if overlap >= most:
        raise ValueError("the overlap must be smaller than the chunk")
    whole = F.coalesce(F.col("source").isin(*WHOLE_SOURCES), F.lit(False)) | (approx_tokens(F.col("content")) <= most)
    cols = ("id", "source", "title", "metadata")
    small = docs.where(whole).select(*cols, "content", F.lit(0).alias("chunk_idx"))
    large = docs.where(~whole).select(*cols, F.posexplode(_texts(F.col("content"), most, overlap)).alias("chunk_idx", "content"))
    return small.unionByName(large).select(
        F.concat_ws(":", "id", "chunk_idx").alias("id"), F.col("id").alias("doc_id"), "content", "title", "source",
        with_value(F.col("metadata"), "chunk_idx", int_value(F.col("chunk_idx"))).alias("metadata"), "chunk_idx",
    )


def word_windows(c: Column, most: int, overlap: int) -> Column:
    """Windows of `most` words that step by `most - overlap`: the fallback of `split_text` as a column."""
    from ..functions.text import words

    w = words(c, lower=False)
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(most - overlap)))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(most)), " "))
