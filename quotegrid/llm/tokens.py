"""Context-free units of a text and per-worker caches of their encodings.

The public tokenizers never make a token across the border of a unit, so a text's encoding is that of its units one
after the other; each distinct unit is encoded once per worker.  Caches hold at most ``CACHE`` units.
"""

from __future__ import annotations

import functools
import json
import operator
import os
import re
import unicodedata

CACHE = 200_000
# Characters that are certainly letters, or certainly neither letter, number, apostrophe nor white space.
LOWER, UPPER = "a-zß-öø-ÿ", "A-ZÀ-ÖØ-Þ"
MARKS = r'!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~'
SPACE = r" \n\r\t"

WORDS = re.compile(rf"[^{SPACE}]+")
#: Of a lower-case text: letters before a mark or space, marks before a letter, digit or space, else all up to a space.
LOWER_UNITS = re.compile(rf"[{LOWER}]+(?=[{SPACE}{MARKS}]|\Z)|[{MARKS}]+(?=[{SPACE}{LOWER}0-9]|\Z)|[^{SPACE}]+")
#: The same with the white space before it, case kept; a lone line end stands for itself.
SPACED_UNITS = re.compile(rf"\n(?=\S)|[{SPACE}]*[{LOWER}{UPPER}]+(?=[{SPACE}{MARKS}]|\Z)|[{MARKS}]+(?=[{SPACE}{LOWER}{UPPER}0-9]|\Z)|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
SPACED = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: White space other than blank, tab and line ends.
OTHER_SPACE = re.compile("[" + "".join(map(chr, (0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")


def word_units(text: str) -> list[str]:
    """Units for the lower-casing vocabulary.  Where lower-casing before normalising could differ (text not in
    composed form, final sigma) or special tokens may be meant, units are all between white space, as they stand."""
    if "<|" in text or "Σ" in text or not unicodedata.is_normalized("NFC", text):
        return WORDS.findall(text)
    return LOWER_UNITS.findall(text.lower())


def spaced_units(text: str) -> list[str] | None:
    """Units for the byte-level vocabulary, their concatenation is the text; None where white space of
    other kinds stands in it, such a text is one unit."""
    if OTHER_SPACE.search(text):
        return None
    return (SPACED if "<|" in text else SPACED_UNITS).findall(text)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: Longer units are left to the tokenizers library, whose merges take n log n steps.
LONG_UNIT = 256


@functools.lru_cache(maxsize=2)
def rank_encoder(path: str):
    """(encoder, added strings) of a byte-level vocabulary file, or None where the file is of another kind.

    Where every merge makes the next larger id, merging by the id of what results takes the same merges in the same
    order as the list of merges does, so tiktoken gives the tokenizers library's ids at a quarter of the time."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space") or spec.get("normalizer"):
        return None
    ids = model["vocab"]
    made = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(x >= y for x, y in zip(made, made[1:])):
        return None
    # bytes that print stand for themselves, the others for the code points from 256 on
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in prints]
    byte_of = {chr(b): b for b in prints} | {chr(256 + n): b for n, b in enumerate(hidden)}
    added = tuple(t["content"] for t in spec.get("added_tokens", []))
    ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in ids.items() if token not in added}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), added


def unit_ids(path: str, units: list[str]) -> list[list[int]]:
    """Ids of each unit as the tokenizers library gives them."""
    tokenizer, quick = library(path), rank_encoder(path)
    if quick is None:
        return [e.ids for e in tokenizer.encode_batch_fast(units, add_special_tokens=False)]
    encoder, added = quick
    return [encoder.encode_ordinary(u) if len(u) <= LONG_UNIT and not any(a in u for a in added) else tokenizer.encode(u, add_special_tokens=False).ids for u in units]


class Cache(dict):
    """unit -> value; ``encode(units)`` gives the values of units not seen yet."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def of(self, units: list[str]):
        """Values of loaded units, one after the other."""
        return operator.itemgetter(*units)(self) if len(units) > 1 else [self[u] for u in units]

    def load(self, units) -> None:
        wanted = units if isinstance(units, set) else set(units)
        fresh = [u for u in wanted if u not in self]  # a difference with the keys would walk the whole cache
        if len(self) + len(fresh) > CACHE:
            kept = {u: self[u] for u in wanted if u in self}
            self.clear()
            self.update(kept)
        for a in range(0, len(fresh), 4096):
            part = fresh[a:a + 4096]
            self.update(zip(part, self.encode(part)))
