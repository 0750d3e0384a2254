"""Token counts with a whole-token shortcut.

Which strings of the vocabulary encode alone as one token is proved once per
worker, with the library itself. Texts fall into pre-tokens at places that no
merge can cross; those that are such a string count 1 at once, only the rest is
merged by the library, and its count remembered.

Defined cases: a null or empty text has no bytes and no tokens; repeated rows are
counted each for itself; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from skyweft.llm.common import map_slices, prepare

REMEMBERED = 200_000
MARK = "▁"


class PieceCounter:
    """Number of tokens of a sentencepiece model.

    The space mark and the line feed are the barriers. That they are is proved
    from the vocabulary: no entry has a mark after another character, and none
    has a line feed. Where a vocabulary does not allow it, texts are encoded whole.
    """

    #: Pre-tokens: a line feed, or spaces and what follows them.
    _parts = re.compile("\n| *[^ \n]+| +").findall

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        barrier = self.library.encode("\n a\n", out_type=str)
        self.splits = (
            not any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
            and self.library.encode("\n") == [*self.library.encode("\n ")[:2]]
            and barrier.count(MARK + "a") == 1
        )
        self.whole = {"\n": 1} if self.splits else {}
        for piece in pieces if self.splits else ():
            text = piece.replace(MARK, " ")
            if "\n" not in text and self._merged(text) == 1:
                self.whole[text] = 1
        self.counts = dict(self.whole)

    def _merged(self, text: str) -> int:
        """Tokens of ``text`` inside a longer one: a line feed keeps it apart from the leading mark."""
        return len(self.library.encode("\n" + text)) - 2

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.library.encode(text))
        counts, total = self.counts, 0
        for part in self._parts(" " + text.replace(MARK, " ")):
            n = counts.get(part)
            if n is None:
                n = self._merged(part)
                if len(counts) >= REMEMBERED:
                    counts = self.counts = dict(self.whole)
                counts[part] = n
            total += n
        return total


class FileCounter:
    """Number of tokens of a ``tokenizers`` file, merged by its own tokenizer where it has no shortcut."""

    def __init__(self, path: str):
        from skyweft.llm.tokens import tokenizer

        self.encoder = tokenizer(path)

    def count(self, text: str) -> int:
        return len(self.encoder.ids(text))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter | FileCounter:
    return PieceCounter(path) if path.endswith(".model") else FileCounter(path)


def _counted(batch: pa.RecordBatch, path: str, limit: int) -> pa.RecordBatch:
    count = counter(path).count
    texts = batch.column(1).to_pylist()
    n_tokens = [count(text or "") for text in texts]
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            pa.array([len((text or "").encode()) for text in texts], pa.int64()),
            pa.array(n_tokens, pa.int64()),
            pa.array([n > limit for n in n_tokens], pa.bool_()),
        ],
        names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
    )


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text; no shuffle."""
    prepare(docs.sparkSession)
    return map_slices(
        docs.select("doc_id", "text"), lambda batch: _counted(batch, model_path, limit),
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
    )
