"""Token ids of byte-level BPE vocabularies."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa

# Fixed value: the public pre-tokenisation pattern of byte-level BPE vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters outside plain Latin text, on whose Unicode class two regular expression engines might differ.
_UNUSUAL = re.compile("[^\t\n\r -~\xa1-ɏ]").search
LONGEST_PLAIN = 1_000_000


def byte_of_symbol() -> dict[str, int]:
    """The printable stand-in of every byte: itself where printable, else the next free code point from 256."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokenizer:
    """Ids of a ``tokenizers`` file, with special strings inside texts handled as that library does.

    Where the file's merges come in the order of their ids and the text is plain
    Latin, ranks give the same ids several times faster; everything else goes
    through the library itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.ranked = self._ranked(described)

    @staticmethod
    def _ranked(described: dict):
        model, added = described["model"], described["added_tokens"]
        vocabulary = model["vocab"]
        splitter = described["pre_tokenizer"] or {}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        plain = (
            model["type"] == "BPE" and described["normalizer"] is None and splitter.get("type") == "ByteLevel"
            and splitter.get("use_regex") and not splitter.get("add_prefix_space")
            and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)
            and all(vocabulary.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))
        )
        if not plain:
            return None
        import tiktoken

        special = {a["content"]: a["id"] for a in added}
        symbols = byte_of_symbol()
        ranks = {bytes(symbols[c] for c in piece): i for piece, i in vocabulary.items() if piece not in special}
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if self.ranked is None or len(text) > LONGEST_PLAIN or _UNUSUAL(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.asarray(self.ranked.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids binary"


def pieces_of(batch: pa.RecordBatch, path: str, capacity: int, end_id: int) -> pa.RecordBatch:
    """Token pieces of (doc_id, text) rows: ids, then ``end_id``, cut so that only the first piece may be short."""
    encoder = tokenizer(path)
    rows: list[tuple] = []
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        ids = np.append(encoder.ids(text or ""), np.uint32(end_id)).astype("<u4")
        first = len(ids) % capacity or min(len(ids), capacity)
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        rows += [(doc_id, n, a, b - a, ids[a:b].tobytes()) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "piece", "start", "length", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
