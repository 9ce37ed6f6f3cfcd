"""Token ids of whole texts by a public byte-level BPE vocabulary, and token counts of text sections (operator 4)."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.shared import ship, tidied

VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: how a byte-level BPE vocabulary with `use_regex` cuts texts before it merges.
CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The first byte in UTF-8 of characters from U+0180. Which of those are letters depends on a library's Unicode version.
FAR = 0xC6


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it is visible, else the next one from U+0100."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Encodes whole texts with the vocabulary of a file of `tokenizers`.

    Where the file holds a plain byte-level BPE whose merges make its ids in
    order, a merge's rank is the id it makes, and `tiktoken` merges by these
    ranks several times faster to the same ids (`ranked`). Texts with
    characters from U+0180, on whose classes the two libraries may differ, and
    all texts with any other vocabulary are encoded by `tokenizers` itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.ranked, self.lengths = None, None
        if ranks := self._ranks(json.loads(self.model.to_str())):
            import tiktoken

            self.ranked = tiktoken.Encoding("ranked", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})
            self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)  # bytes of text that each id stands for
            self.lengths[list(ranks.values())] = [len(t) for t in ranks]

    @staticmethod
    def _ranks(spec: dict) -> dict[bytes, int] | None:
        """Each token's bytes and its id, if ids are ranks of merges over bytes."""
        cut, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not spec["normalizer"] and not spec["post_processor"]
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if not plain or model["type"] != "BPE" or any(model.get(k) for k in odd):
            return None
        made = [model["vocab"][a + b] for a, b in model["merges"]]
        if made != sorted({*made}) or len(model["vocab"]) != len(made) + 256:
            return None
        byte = byte_of()
        return {bytes(byte[c] for c in t): i for t, i in model["vocab"].items()}

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text; none for null or empty."""
        for t in texts:
            if not t:
                yield np.zeros(0, np.uint32)
            elif self.ranked and (t.isascii() or np.frombuffer(t.encode(), np.uint8).max() < FAR):
                yield np.asarray(self.ranked.encode_ordinary(t), np.uint32)
            else:
                yield np.asarray(self.model.encode(t, add_special_tokens=False).ids, np.uint32)

    def ends(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Byte offset in a text of the end of each of its tokens. What a vocabulary drops counts with the token behind it."""
        if self.lengths is not None:
            return np.cumsum(self.lengths[ids])
        stops = np.array([b for _, b in self.model.encode(text, add_special_tokens=False).offsets], np.int64)
        first = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80)  # first bytes of the characters
        ends = np.append(first, len(text.encode()))[stops]
        return np.maximum.accumulate(ends) if len(ends) else ends


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def line_starts(raw: bytes) -> np.ndarray:
    """Byte offsets at which the lines of a text start; a line holds its own line feed."""
    b = np.frombuffer(raw, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(b == 10) + 1])
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(raw) else starts


def allot(token_end: np.ndarray, section_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the section each token goes to, and whether it crosses a boundary.

    Token spans and section spans both cover the bytes without gaps. A token
    goes to the section that holds most of its bytes, on a tie to the first.
    """
    start = np.concatenate([[0], token_end[:-1]])
    first = np.searchsorted(section_end, start, "right")
    last = np.searchsorted(section_end, token_end, "left")
    crosses = last > first
    best = first.copy()
    for i in np.flatnonzero(crosses):
        ends = np.minimum(section_end[first[i] : last[i] + 1], token_end[i])
        best[i] = first[i] + int(np.argmax(np.diff(np.concatenate([[start[i]], ends]))))
    return best, crosses


def section_tokens(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Tokens of each section (line) of each text, every text encoded once and whole.

    One row for each section: the key, section (from 0), start and stop in
    characters, n_tokens allotted to it and n_crossing, how many of those span
    a boundary. A token that spans one goes to the section with most of its
    bytes, on a tie to the earlier. The n_tokens of a text add up to its token
    count. Null and empty texts have one section of no tokens; repeated rows
    count each for themselves; other columns are left out, whatever their
    names; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches):
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
            texts = batch.column(1).to_pylist()
            for row, (t, ids) in enumerate(zip(texts, encoder(path).encode_all(texts))):
                raw = (t or "").encode()
                starts = line_starts(raw)
                ends = np.append(starts[1:], len(raw))
                chars = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)])
                n = len(starts)
                if raw:
                    where, crosses = allot(encoder(path).ends(t, ids), ends)
                    counts, crossed = np.bincount(where, minlength=n), np.bincount(where[crosses], minlength=n)
                else:
                    counts = crossed = np.zeros(n, np.int64)
                for c, v in zip(cols, (np.full(n, row), np.arange(n), chars[starts], chars[ends], counts, crossed)):
                    c.append(v)
            if cols[0]:
                row, *rest = (np.concatenate(c).astype(np.int64) for c in cols)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *map(pa.array, rest)], names=["k", "section", "start", "stop", "n_tokens", "n_crossing"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(tidied(run), f"k {kind}, section long, start long, stop long, n_tokens long, n_crossing long")
    return out.withColumnRenamed("k", key)


def op4_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
