"""Token ids of whole texts by a tokenizers file: by a merge loop over the file's vocabulary where that gives the library's ids."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, tidy, trim


def _byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write a printable byte as its Latin-1 character and the others as those from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_OF = {c: bytes([b]) for b, c in ({b: chr(b) for b in range(256)} | _byte_characters()).items()}

# Fixed values of the two families of files: the pattern of byte-level pre-tokenizers, and what a word file does to a text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_NORMAL = ["NFC", r"Replace \s+", "Lowercase"]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

#: Texts on which the merge loop must give the library's ids, beside every token of the file; else the library does all.
PROOF = (
    "It's a test, isn't it? Yes!! 12 345.6 foo_bar (baz) <a href=\"x\">", "Déjà  vu\n\nÜber\tÇa   va \r\n fin ", "\nfirst line\nsecond line.\nThird%%% line###", " lead, trail ",
    "日本語 текст عربى ΕΛΛΗΝΙΚΆΣ 😀 e\u0301te\u0301 \xa0nbsp\u3000wide", "we'll they're I'm you'd he's '' 'quoted' don't.stop", "<|endoftext|> <|startoftext|> a\x1cb\x85c", "...!?!... --- *** https://x.y/z?a=1&b=2 UPPER lower MiXed", "",
)
#: A run of white space on which the merge loop's pattern could run out of stack.
SPACES = 20_000
BLANK = re.compile(rf"\s{{{SPACES}}}")
#: What keeps a text from the word files' merge loop: characters that a normal form, case or the library's white space
#: could treat in a way of their own.
SPECIAL = re.compile("[^\\x00-\\x1b\\x20-\\u012f\\u0131-\\u024f]")
#: The parts of a word that isn't of letters alone, in ASCII; and the letters up to U+024F (fixed values).
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[!-/:-@\[-`{{-~]+")


class TextCoder:
    """Encodes texts by a tokenizers file.

    The library itself finds a byte-pair file's ids slowly. Where the file is of a known family (byte-level, or words with
    an end mark, ids in order of the merges), tiktoken's merge loop runs over the file's own vocabulary: on all texts of a
    byte-level file, and on the texts of a word file that are Latin letters, ASCII digits and ASCII marks. All other texts,
    runs of 20,000 blanks, and files that break PROOF go to the library. Special tokens' strings are ordinary text.
    Ids have 16 bits; a larger vocabulary raises ValueError."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path}: over 65,536 ids")
        self.tokenizer.encode_special_tokens = True
        self.merge, self.words = None, False
        with open(path, encoding="utf-8") as f:
            self._prepare(json.load(f))
        proof = [*PROOF, " ".join(t.replace(WORD_END, "").replace("Ġ", " ") for t in self.tokenizer.get_vocab())]
        if self.merge and self.encode(proof) != self.library(proof):
            self.merge = None

    def _prepare(self, file: dict) -> None:
        import tiktoken

        model = file["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            return
        before, normal = file["pre_tokenizer"] or {}, file["normalizer"]
        end = model.get("end_of_word_suffix") or ""
        if before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not normal and not end:
            pattern = BYTE_LEVEL
        elif end == WORD_END and before.get("type") == "Sequence" and normal and normal.get("type") == "Sequence":
            done = [x["type"] + (" " + x["pattern"].get("Regex", "") if "pattern" in x else "") for x in normal["normalizers"]]
            split, *rest = before["pretokenizers"]
            if done != WORD_NORMAL or split.get("pattern") != {"Regex": WORD_PATTERN} or [x["type"] for x in rest] != ["ByteLevel"]:
                return
            pattern, self.words = "[^ ]+ ", True  # a word's end mark is the space after it
        else:
            return
        vocabulary, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        first = 512 if end else 256
        if any(vocabulary.get(a + b) != first + i for i, (a, b) in enumerate(merges)):
            return
        ranks = {}
        for token, i in vocabulary.items():
            if i < first + len(merges):
                mark = end and token.endswith(end)
                ranks[b"".join(BYTE_OF[c] for c in (token.removesuffix(end) if mark else token)) + (b" " if mark else b"")] = i
        self.merge = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 16-bit integers."""
        out, left = [], []
        for i, text in enumerate(texts):
            plain = text if self.merge and (len(text) < SPACES or not BLANK.search(text)) else None
            if plain and self.words:
                plain = spaced(plain)
            if plain is None:
                left.append(i)
                out.append(b"")
            else:
                out.append(array("H", self.merge(plain)).tobytes())
        for i, ids in zip(left, self.library([texts[i] for i in left]), strict=True):
            out[i] = ids
        return out


def spaced(text: str) -> str | None:
    """The parts that a word file cuts a text into, in lower case and each with a space after it; None where the text has
    characters besides Latin letters, ASCII digits and ASCII marks."""
    if SPECIAL.search(text):
        return None
    words = text.lower().split()
    for i, w in enumerate(words):
        if not w.isalpha():
            parts = PARTS.findall(w)
            if sum(map(len, parts)) != len(w):
                return None
            words[i] = " ".join(parts)
    words.append("")
    return " ".join(words)


_coders: dict[str, TextCoder] = {}


def coder(path: str) -> TextCoder:
    if path not in _coders:
        _coders[path] = TextCoder(path)
    return _coders[path]


_pack = zstandard.ZstdCompressor(level=1)


def pack_ids(raw: bytes) -> bytes:
    return _pack.compress(raw)


def unpack_ids(z: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(z), "<u2")


def token_rows(docs: DataFrame, path: str, end: int, keep: list[str], text: str = "text", release: bool = False) -> DataFrame:
    """keep..., h, n, z: the ids of each text with `end` after them, as packed unsigned 16-bit integers; n counts them,
    h is a hash of the text that orders repeated keys. The vocabulary has at most 65,536 ids, or a ValueError is raised.

    Null or empty text: `end` alone. Very long texts are encoded whole, alone in their slice. Repeated rows and null keys:
    a row each. Empty table: no rows. Columns that aren't kept are ignored, whatever their names. release: a worker drops
    the tokenizer after each task, for jobs in which workers of other stages wait beside it."""
    small_batches(docs.sparkSession)
    tail = np.array([end], "<u2").tobytes()
    kinds = dict(docs.dtypes)
    own = [f"_{i}" for i in range(len(keep))]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for big in batches:
            for b in slices(big, "t", 1 << 20):
                ids = [x + tail for x in c.encode([x or "" for x in b.column("t").to_pylist()])]
                n = pa.array([len(x) // 2 for x in ids], pa.int64())
                yield pa.record_batch([*[b.column(k) for k in own], b.column("h"), n, pa.array([pack_ids(x) for x in ids], pa.binary())], [*own, "h", "n", "z"])
        if release:
            _coders.clear()
            del c
            trim()

    schema = ", ".join(f"{o} {kinds[k]}" for o, k in zip(own, keep, strict=True)) + ", h long, n long, z binary"
    rows = docs.select(*[F.col(k).alias(o) for o, k in zip(own, keep, strict=True)], F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t")).mapInArrow(tidy(encoded), schema)
    return rows.select(*[F.col(o).alias(k) for o, k in zip(own, keep, strict=True)], "h", "n", "z")
