"""Token counts by the whole-token shortcut, and the encoder that the token-ID output shares.

Offline, every vocabulary string is put through the merges: those that come out as one token are proved whole.
A pre-token of a text that is proved whole counts one at once; only the others are merged, each distinct one
once while the bounded memo holds it.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, tune, worker_memory
from .pretokens import byte_letters, make_split

BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def check_settings(path: str) -> None:
    """Raises if a file asks for what ByteBpe does not do: another model or split, a normalizer, or special strings that take
    the space around them."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    model, split = said["model"], said.get("pre_tokenizer") or {}
    wrong = {
        "model": model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "normalizer": said.get("normalizer") is not None,
        "pre_tokenizer": split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True),
        "added_tokens": any(t.get(k) for t in said.get("added_tokens", ()) for k in ("lstrip", "rstrip", "single_word")),
    }
    if any(wrong.values()):
        raise ValueError(f"{path}: these settings are not supported: {', '.join(k for k, v in wrong.items() if v)}")


class ByteBpe:
    """The ids that a byte-level BPE file of the tokenizers library gives a text, without added special tokens;
    special strings inside a text become their ids, as is the library's default."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        check_settings(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.letters = dict(enumerate(map(byte_letters().__getitem__, range(256))))
        self.split = make_split(BYTE_LEVEL_PATTERN)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        names = sorted(self.special, key=len, reverse=True)
        self.find_special = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else lambda text: [text]

    def merge(self, word: str) -> list[int]:
        """The ids of one pre-token, by the merges."""
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]

    def pieces(self, text: str) -> Iterator[tuple[list[str] | None, int]]:
        """The text as runs of pre-tokens and the ids of special strings, in order.  Texts with characters from
        U+0100 on are split by the library itself, whose Unicode tables decide there."""
        for k, part in enumerate(self.find_special(text)):
            if k % 2:
                yield None, self.special[part]
            elif part:
                if part.isascii() or max(part) < "Ā":
                    yield self.split(part), 0
                else:
                    spans = self.library.pre_tokenizer.pre_tokenize_str(part)
                    yield [part[a:b] for _, (a, b) in spans], 0

    def whole_tokens(self) -> dict[str, int]:
        """The vocabulary strings that are proved to encode alone as one token, with their ids."""
        back = {letter: byte for byte, letter in self.letters.items()}
        found = {}
        for name, token_id in self.library.get_vocab(with_added_tokens=False).items():
            try:
                word = bytes(map(back.__getitem__, name)).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if [t.id for t in self.model.tokenize(name)] == [token_id]:
                found[word] = token_id
        return found


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row (``id_col``, n_bytes, n_tokens, over_limit) for each row of ``docs``.

    ``path`` is a byte-level BPE file of the tokenizers library, or a sentencepiece model (which has no merges
    to skip and is asked for each text).  A null text is empty and has no tokens; repeated rows and null ids come
    back as they are; other columns are left out.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = path.endswith(".model")
    whole = None if pieces else docs.sparkSession.sparkContext.broadcast(dict.fromkeys(ByteBpe(path).whole_tokens(), 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if pieces:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)

            def tokens(text: str) -> int:
                return len(model.encode(text, num_threads=1))
        else:
            bpe = ByteBpe(path)
            sizes = Memo(lambda word: len(bpe.merge(word)), seed=whole.value)

            def tokens(text: str) -> int:
                return sum(1 if run is None else sum(map(sizes.__getitem__, run)) for run, _ in bpe.pieces(text))

        for batch in batches:
            found = [x or "" for x in batch.column(1).to_pylist()]
            n_bytes = pa.array([len(x.encode()) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(map(tokens, found), pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def id_encoder(path: str):
    """text -> its ids as one little-endian uint32 array.  Words are merged once while a bounded memo holds them, which the
    tasks of a worker share."""
    shared = worker_memory()
    if ("words", path) not in shared:
        bpe = ByteBpe(path)
        shared["words", path] = bpe, Memo(lambda word: struct.pack(f"<{len(ids := bpe.merge(word))}I", *ids), 600_000)
    bpe, words = shared["words", path]

    def encode(text: str) -> np.ndarray:
        runs = [struct.pack("<I", i) if run is None else b"".join(map(words.__getitem__, run)) for run, i in bpe.pieces(text)]
        return np.frombuffer(b"".join(runs), "<u4")

    return encode
