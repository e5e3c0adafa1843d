"""Public byte-level vocabularies, loaded once in each Python worker."""

from __future__ import annotations

import base64
import json
import re
import sys

import numpy as np

# The code points of white space in the public pattern.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = re.compile(f"[{WHITE}]{{4096,}}")


def worker_cache() -> dict:
    """A dictionary that lives as long as the worker process."""
    return sys.__dict__.setdefault("_docmill_cache", {})


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def rank_encoding(path: str):
    """A tiktoken encoding of a rank file, without special tokens."""
    import public_tokenizers
    import tiktoken

    key = ("ranks", path)
    if key not in (held := worker_cache()):
        held[key] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    return held[key]


def encode_text(encoding, text: str) -> np.ndarray:
    """The ids of a text without special tokens.

    The library's regex keeps a stack as long as a run of white space and fails on very long
    ones, so these are cut out first. The pattern makes one match of a run up to its last code
    point, which begins the next match, or of the whole run at the end of the text; a match
    never goes on from other characters into white space.
    """
    if len(text) < 4096:
        return encoding.encode_to_numpy(text, disallowed_special=())
    out, at = [], 0
    for run in LONG_RUN.finditer(text):
        begin, end = run.span()
        end -= end < len(text)
        out += [encoding.encode_to_numpy(text[at:begin], disallowed_special=()), np.array(encoding._encode_single_piece(text[begin:end]), np.uint32)]
        at = end
    out.append(encoding.encode_to_numpy(text[at:], disallowed_special=()))
    return np.concatenate(out) if len(out) > 1 else out[0]


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizers JSON file. Only plain ones, which match anywhere and as they are, are known here."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if wrong := [t["content"] for t in tokens if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]:
        raise ValueError(f"tokens with conditions of their own: {wrong}")
    return {t["content"]: t["id"] for t in tokens}


def encode_with_added(encoding, added: dict[str, int], text: str) -> np.ndarray:
    """The ids of a text in which the strings of added tokens, the longest first, stand for their ids; what lies between is encoded by itself."""
    if not any(t in text for t in added):
        return encode_text(encoding, text)
    out, at = [], 0
    for m in re.finditer("|".join(map(re.escape, sorted(added, key=len, reverse=True))), text):
        out += [encode_text(encoding, text[at : m.start()]), np.array([added[m.group()]], np.uint32)]
        at = m.end()
    return np.concatenate([*out, encode_text(encoding, text[at:])])
