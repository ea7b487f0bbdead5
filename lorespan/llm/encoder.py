"""Token ids of whole texts, exactly as the tokenizers or sentencepiece library gives them, at a few times its speed.

A byte-pair tokenizer never merges across the pieces into which its pattern cuts a text. A text is therefore cut at some
places where such a pattern always cuts, equal parts are encoded once per worker, and the results are joined. Parts that
are plain words of Latin letters are merged by tiktoken with the ranks of the same vocabulary; all other parts, and all
texts for which a cut could matter, go through the library itself.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import lru_cache

#: The piece patterns of the two families of byte-pair tokenizers for which cutting is known to be exact.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
SPACES = " \t\n\r\f\v"
#: Signs between which and a letter the patterns always cut (the apostrophe is not one).
SIGNS = r"\.,!\?%&\*\$#;:\|"
#: Parts kept by each worker before it starts anew; some 100 MB.
MEMO_PARTS = 500_000

_ODD_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: Beyond these, lower case can depend on neighbours or change what is a letter; such texts are lower-cased by the library alone.
_BEYOND_LATIN = re.compile("[^\\x00-\\u012f\\u0131-\\u024f]")


def _byte_chars() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the rest follows from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class _Memo(dict):
    """Parts and their ids; a part that is not there is encoded first."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, part: str) -> bytes:
        out = self[part] = self.make(part)
        return out


class Encoder:
    """encode(texts) gives little-endian unsigned 32-bit ids as bytes. Special strings in texts are handled as the library's default."""

    def __init__(self, path: str):
        self.memo = _Memo(self._part)
        self.kind = "plain"
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.n_vocab = self.pieces.get_piece_size()
            return
        from tokenizers import Tokenizer

        self.pieces = None
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.n_vocab = self.library.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            return
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not model.get("end_of_word_suffix"):
            self.kind, suffix = "space_prefix", ""
            self.cut = re.compile(rf" ?[{LETTERS}]+(?=[{SPACES}{SIGNS}]|\Z)|\n(?=[{LETTERS}])|[{SPACES}]*[^{SPACES}]+|[{SPACES}]+").findall
            self.word = re.compile(rf" ?[{LETTERS}]+").fullmatch
        elif (
            model.get("end_of_word_suffix") == "</w>"
            and [p.get("type") for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and pre["pretokenizers"][0]["pattern"].get("Regex") == WORD_PATTERN
            and [n.get("type") for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        ):
            self.kind, suffix = "word_end", "</w>"
            self.cut = re.compile(rf"[{LETTERS}]+(?=[{SPACES}{SIGNS}]|\Z)|[^{SPACES}]+").findall
            self.word = re.compile(rf"[{LETTERS}]+").fullmatch
        else:
            return
        import tiktoken

        # No UTF-8 text holds byte 255, so it can stand for the suffix; id order is merge order in both families.
        chars = _byte_chars()
        ranks = {}
        for token, i in model["vocab"].items():
            ended = bool(suffix) and token.endswith(suffix)
            body = token[: -len(suffix)] if ended else token
            if all(c in chars for c in body):
                ranks[bytes(chars[c] for c in body) + b"\xff" * ended] = i
        for a in (t["content"] for t in spec.get("added_tokens", [])):
            ranks.pop(a.encode(), None)
        self.end = b"\xff" if suffix else b""
        self.merge = getattr(tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}), "_encode_single_piece", None)
        if self.merge is None:  # it is no public name: without it, the library encodes whole texts
            self.kind = "plain"

    def _library(self, texts: list[str]) -> list[bytes]:
        if self.pieces is not None:
            return [_packed(x) for x in self.pieces.encode(texts, num_threads=1)]
        return [_packed(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, text: str) -> list[str] | None:
        if self.kind == "plain" or _ODD_SPACE.search(text):
            return None
        if self.kind == "word_end" and not _BEYOND_LATIN.search(text):
            text = text.lower()
        return self.cut(text)

    def _part(self, part: str) -> bytes:
        if self.word(part) and (not self.end or part == part.lower()):
            return _packed(self.merge(part.encode() + self.end))
        return self._library([part])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self._parts(t) for t in texts]
        whole = [t for t, p in zip(texts, parts, strict=True) if p is None]
        rest = iter(self._library(whole)) if whole else iter(())
        if len(self.memo) > MEMO_PARTS:
            self.memo.clear()
        ids = self.memo.__getitem__
        return [next(rest) if p is None else b"".join(map(ids, p)) for p in parts]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process, so that its memo serves all of the worker's tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    return Encoder(path)


def batches(texts: list[str], limit: int = 1_000_000):
    """Slices of texts with about limit characters each, or one longer text."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield texts[start:]
