"""Token ids of whole texts, and their pre-tokens.

A byte-level BPE of the ``tokenizers`` JSON format is read into a Rust BPE table; other files go to
their own library.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex

#: The split pattern of byte-level BPE pre-tokenisation. Fixed value.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _byte_level(path: str):
    """A tiktoken encoding of a plain byte-level BPE file, or None if it is of another kind."""
    if not path.endswith(".json"):
        return None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    extra = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    stripped = any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
    if not plain or stripped or spec.get("normalizer") or model.get("type") != "BPE" or model.get("ignore_merges"):
        return None
    import tiktoken

    byte_of = _byte_alphabet()
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in extra}
    merged = sorted((i, t) for t, i in model["vocab"].items() if len(t) > 1 and t not in extra)
    if [t for _, t in merged] != ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]:
        return None  # ids must follow the merge order
    return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=extra)


class Encoder:
    """Ids of whole texts, and the pre-tokens that a text falls into.

    The Rust BPE table and the split pattern stand in for the library where both agree on every
    character of a text (each character is tried once); other texts go to the library itself.
    """

    def __init__(self, path: str):
        self._bpe = _byte_level(path)
        self._alike: dict[str, bool] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._whole = lambda text: np.asarray(model.encode(text, num_threads=1))
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self._whole = lambda text: np.asarray(model.encode(text, add_special_tokens=False).ids)
            self._split = model.pre_tokenizer
        if self._bpe is not None:
            special = sorted(self._bpe.special_tokens_set, key=len, reverse=True)
            self._special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
            self._pattern = regex.compile(BYTE_LEVEL_PATTERN)

    def _known(self, text: str) -> bool:
        """Whether the library splits and encodes all characters of ``text`` as the pattern and the table do."""
        if text.isascii():
            return True
        chars = set(text)
        for c in chars - self._alike.keys():
            probe = f"a{c}1{c}!{c} a {c}"
            widths = [z - a for _, (a, z) in self._split.pre_tokenize_str(probe)]
            self._alike[c] = widths == list(map(len, self._pattern.findall(probe))) and list(self._whole(probe)) == self._bpe.encode_ordinary(probe)
        return all(map(self._alike.__getitem__, chars))

    def ids(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        ids = self._bpe.encode_to_numpy(text, allowed_special="all") if self._bpe is not None and self._known(text) else self._whole(text)
        return ids.astype("<u4").tobytes()

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens and special strings of ``text`` in order: what is encoded on its own. For tokenizers of other kinds, the whole text."""
        if self._bpe is None:
            return [text] if text else []
        found: list[str] = []
        for part in self._special.split(text) if self._special is not None else [text]:
            if part in self._bpe.special_tokens_set:
                found.append(part)
            elif self._known(part):
                found += self._pattern.findall(part)
            else:
                found += [part[a:z] for _, (a, z) in self._split.pre_tokenize_str(part)]
        return found


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process; the tokenizer file must be at ``path`` on every node."""
    return Encoder(path)
