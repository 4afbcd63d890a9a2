"""Subword ids from a tokenizer file, in Arrow batches; the file's path is a parameter and every worker loads it once.

An encoding takes about 100 bytes a token, and a batch may hold 10,000 texts. So texts are encoded in slices of some hundred kilobytes, each sent
back before the next begins, and a worker's memory doesn't depend on the batch. A longer text is a slice of its own.

Byte-level BPE by the expression of ``ByteLevel`` (``_cuttable``) is done by pieces: a text is cut where no token goes on and none looks across, equal pieces are
encoded once, and a long text is encoded in parts. The ids are those of the whole text. Other tokenizers get whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a slice; a single text may be longer.
SLICE = 1 << 18
#: Pieces whose ids a worker keeps, some 200 bytes each.
KEPT = 1 << 17
#: White space behind a letter or digit, where a long text may be cut.
_CUT = re.compile(r"(?<=[^\W_])[ \n]")
#: ASCII and Latin-1 letters, which are letters in every version of Unicode.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Pieces of a text without other white space (``_ODD``): cut before white space, and behind these letters before ASCII that is neither a letter nor an apostrophe.
_PIECES = re.compile(rf"[\t\n\r ]*(?:[{_LETTERS}]+(?![^\t\n\r -&(-@[-`{{-~])|[^\t\n\r ]+)|[\t\n\r ]+")
_ODD = re.compile(r"[^\S\t\n\r ]")
#: A piece that is one word to the tokenizer.
_WORD = re.compile(rf" ?[{_LETTERS}]+")
#: The letter that stands for each byte in byte-level BPE: its own, if that can be printed, or one from 256 on.
_BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


def _cuttable(tokenizer: str) -> bool:
    """Whether a tokenizer, as JSON, gives a text the ids of its pieces: byte-level BPE by its own expression, with no chance in it and nothing that acts on the whole text before."""
    spec = json.loads(tokenizer)
    how, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = how.get("type") == "ByteLevel" and how.get("use_regex", True) and not how.get("add_prefix_space", True)
    return plain and spec.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout") and all(t["special"] for t in spec.get("added_tokens") or [])


def _parts(text: str) -> Iterator[str]:
    """A text, cut at the first cut after each SLICE characters."""
    start = 0
    while len(text) - start > SLICE and (cut := _CUT.search(text, start + SLICE)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _slices(texts: pd.Series) -> Iterator[list[str | None]]:
    """The texts in order, in runs of SLICE characters at most; a longer text is a run of its own."""
    run, size = [], 0
    for text in texts:
        n = 0 if text is None else len(text)
        if run and size + n > SLICE:
            yield run
            run, size = [], 0
        run.append(text)
        size += n
    if run:
        yield run


def _by_pieces(model, whole: Callable[[list[str]], list[np.ndarray]]) -> Callable[[list[str]], list[np.ndarray]]:
    """``whole``, for a cuttable tokenizer. Pieces are kept until there are KEPT of them, and dropped when most of a slice are others."""
    kept: dict[str, bytes] = {}
    bpe = model.model

    def short(texts: list[str]) -> list[np.ndarray]:
        cut = [None if _ODD.search(t) else _PIECES.findall(t) for t in texts]
        new = set(chain.from_iterable(c for c in cut if c)).difference(kept)
        words = {p for p in new if _WORD.fullmatch(p)}
        found = {p: array("i", [t.id for t in bpe.tokenize(p.encode().decode("latin-1").translate(_BYTES))]).tobytes() for p in words}
        others = list(new - words)
        found |= {p: ids.tobytes() for p, ids in zip(others, whole(others))}
        kept.update(found)
        odd = iter(whole([t for t, c in zip(texts, cut) if c is None]))
        out = [next(odd) if c is None else np.frombuffer(b"".join(map(kept.__getitem__, c)), np.int32) for c in cut]
        if len(kept) > KEPT:
            if 2 * len(found) > sum(len(c) for c in cut if c):
                kept.clear()
            else:
                for p in found:
                    del kept[p]
        return out

    def run(texts: list[str]) -> list[np.ndarray]:
        if len(texts) == 1 and len(texts[0]) > SLICE:
            return [np.concatenate([short([part])[0] for part in _parts(texts[0])])]
        return short(texts)

    return run


@lru_cache(maxsize=4)
def _load(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [np.array(x, np.int32) for x in model.encode(texts)], lambda ids: [model.id_to_piece(i) for i in ids]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True  # the strings of special tokens in a text are ordinary text
    model.no_truncation()
    model.no_padding()

    def whole(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in model.encode_batch_fast(texts, add_special_tokens=False)]

    return _by_pieces(model, whole) if _cuttable(model.to_str()) else whole, lambda ids: [model.id_to_token(i) for i in ids]


def _encoded(path: str, texts: pd.Series) -> Iterator[list[np.ndarray | None]]:
    """The ids of each text, slice by slice."""
    encode, _ = _load(path)
    for run in _slices(texts):
        yield [None if t is None else ids for t, ids in zip(run, encode(["" if t is None else t for t in run]))]


def subword_ids(path: str, bos: int | None = None) -> Callable[[Column], Column]:
    """A column function from text to array<int>; whole texts, never truncated. Null gives null."""
    head = np.array([] if bos is None else [bos], np.int32)

    @F.pandas_udf("array<int>")
    def run(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for block in blocks:
            for ids in _encoded(path, block):
                yield pd.Series([None if x is None else np.concatenate([head, x]) for x in ids], dtype=object)

    return run


def pieces(path: str) -> Callable[[Column], Column]:
    """A column function from ids to the tokenizer's pieces."""

    @F.pandas_udf("array<string>")
    def run(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        _, decode = _load(path)
        for block in blocks:
            yield block.map(lambda ids: None if ids is None else decode([int(i) for i in ids]))

    return run
