"""Chunks that end at sentences."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 600, 120


def pieces(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[str]:
    """Pieces every ``size - overlap`` characters, cut back to a new line or full stop past their middle: the rule for one text."""
    for at in range(0, max(len(text), 1), size - overlap):
        piece = text[at : at + size]
        if at + size < len(text):
            cut = max(piece.rfind("\n"), piece.rfind(". ") + 1)
            piece = piece[:cut] if cut > size // 2 else piece
        if piece.strip():
            yield piece.strip()


def chunks_of(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """The same as an expression: array of the pieces of a text."""
    n = F.length(text)

    def cut(at: Column) -> Column:
        piece = F.substring(text, at + 1, F.lit(size))
        back = F.reverse(piece)
        line, stop = F.instr(back, F.lit("\n")), F.instr(back, F.lit(" ."))
        last = F.greatest(F.when(line > 0, F.length(piece) - line).otherwise(-1), F.when(stop > 0, F.length(piece) - stop).otherwise(0))
        whole = F.when((at + size < n) & (last > size // 2), F.substring(piece, F.lit(1), last)).otherwise(piece)
        return F.regexp_replace(whole, "^\\s+|\\s+$", "")

    starts = F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1, F.lit(size - overlap))
    return F.filter(F.transform(starts, cut), lambda p: p != "")


def chunk_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, chunk_index, chunk."""
    return df.select(key, F.posexplode(chunks_of(F.coalesce(text, F.lit("")))).alias("chunk_index", "chunk"))
