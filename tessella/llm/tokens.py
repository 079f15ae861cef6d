"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries, where no piece of the vocabulary and no rule of the tokenizer can
reach across, so that the counts of the parts add up to the count of the text.  Parts that are not in
a worker's bounded table of counts are encoded by the library in batches of about ``BATCH_BYTES``.
Whether a vocabulary has such boundaries is read from its pieces, or of a tokenizers file from its steps; if
not, whole texts are encoded.

A null text counts as an empty one: no bytes, no tokens.  Repeated rows are counted each by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._util import slim

BATCH_BYTES = 1 << 20
#: Parts whose counts a worker remembers; the table is emptied when full.
REMEMBERED = 1_200_000
_MARK = "▁"
_SPACE = re.compile("(?<=[^ ]) ")


class SentencePieceCounter:
    """Counts of a sentencepiece model, without begin, end or added tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.sp.is_control(i) or self.sp.is_byte(i) or self.sp.is_unknown(i))]
        probe = "a  \u212b\ufb01 b\u3000c\tD\n e"
        as_is = self.sp.decode(self.sp.encode(probe)) == probe and self.sp.encode("a", out_type=str)[0][0] == _MARK
        #: Cuts at spaces and new lines are safe: no piece has a mark after another character or a new line.
        self.safe = as_is and not any(_MARK in p.lstrip(_MARK) or "\n" in p for p in plain)
        self.known: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        """Parts whose counts add up.

        A cut is made at a space after another character, which is the mark that the library puts before
        the next part, and before each new line, which such a part keeps; an empty part is a mark alone.
        """
        text = text.replace(_MARK, " ")
        if "  " in text:
            lines = [_SPACE.split(line) for line in text.split("\n")]
        else:
            lines = [line.split(" ") for line in text.split("\n")]
            for line in lines:
                if line[0] == "" and len(line) > 1:  # the line begins with a space
                    line[:2] = [" " + line[1]]
        for line in lines[1:]:
            line[0] = "\n" + line[0]
        return [part for line in lines for part in line]

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if not self.safe:
            return [n for batch in by_bytes(texts) for n in map(len, self.sp.encode(batch, num_threads=1))]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        parts = [self.split(t) if t else [] for t in texts]
        new = list({p for ps in parts for p in ps} - known.keys())
        for batch in by_bytes(new):
            for part, ids in zip(batch, self.sp.encode(batch, num_threads=1), strict=True):
                # the mark before a new line is not in the text; a lone mark is not encoded by itself
                known[part] = len(ids) - (part[:1] == "\n") if part else 1
        return [sum(map(known.__getitem__, ps)) for ps in parts]


class HuggingCounter:
    """Counts of a tokenizers file; long texts are cut before a single space and an ASCII letter.

    They are if the file's own steps split there and the parts' counts add up on probes; else whole texts are encoded.
    """

    LONG = 1 << 16
    PROBES = ("ab cd", "The quick brown fox Jumps", "x1 y", "wort Über zu", "foo() bar", "a b c d e", "end. Next one")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        #: With strings of special tokens in the text, the cut could fall inside one of them.
        self.special = [x.content for x in self.t.get_added_tokens_decoder().values()]
        self.safe = all(map(self._adds_up, self.PROBES))

    def _adds_up(self, text: str) -> bool:
        steps = self.t.pre_tokenizer
        if steps is None or self.t.normalizer is not None:
            return False
        starts = {span[0] for _, span in steps.pre_tokenize_str(text)}
        cuts = [m.start() for m in re.finditer(r"(?<=[a-z]) (?=[A-Za-z])", text)]
        size = lambda x: len(self.t.encode(x, add_special_tokens=False).ids)
        return all(c in starts and size(text) == size(text[:c]) + size(text[c:]) for c in cuts)

    def split(self, text: str) -> list[str]:
        if len(text) <= self.LONG or not self.safe or any(s in text for s in self.special):
            return [text]
        out, at = [], 0
        while len(text) - at > self.LONG:
            cut = re.compile(r"(?<=[a-z]) (?=[A-Za-z])").search(text, at + self.LONG // 2)
            if not cut:
                break
            out.append(text[at : cut.start()])
            at = cut.start()
        return [*out, text[at:]]

    def counts(self, texts: list[str]) -> list[int]:
        parts = [self.split(t) for t in texts]
        flat = [p for ps in parts for p in ps]
        lengths: list[int] = []
        for batch in by_bytes(flat):
            lengths += [len(e.ids) for e in self.t.encode_batch(batch, add_special_tokens=False)]
        it = iter(lengths)
        return [sum(next(it) for _ in ps) for ps in parts]


def by_bytes(texts: Iterable[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Consecutive batches of about ``limit`` bytes of UTF-8."""
    batch: list[str] = []
    size = 0
    for t in texts:
        n = len(t) if t.isascii() else len(t.encode())
        if batch and size + n > limit:
            yield batch
            batch, size = [], 0
        batch.append(t)
        size += n
    if batch:
        yield batch


_counters: dict[str, SentencePieceCounter | HuggingCounter] = {}


def counter(path: str) -> SentencePieceCounter | HuggingCounter:
    """One counter for each file and worker."""
    if path not in _counters:
        _counters[path] = (SentencePieceCounter if path.endswith(".model") else HuggingCounter)(path)
    return _counters[path]


def count_tokens(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of every row.  No shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.llm._text import slices

        count = counter(tokenizer)
        for batch in batches:
            for part in slices(batch, "t"):
                texts = [t or "" for t in part.column("t").to_pylist()]
                n = count.counts(texts)
                size = pa.compute.cast(pa.compute.binary_length(part.column("t").fill_null("")), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("k"), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["k", "n_bytes", "n_tokens", "over_limit"])

    out = slim(df).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("k", key)
