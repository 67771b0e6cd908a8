"""Exact ids of a byte-level BPE tokenizer file, faster than the tokenizers library gives them.

Texts made of plain characters go whole to tiktoken, which holds the same vocabulary and splitting
pattern. Other texts are cut where a space stands between two characters that are no white space: there
a new word of the pattern always starts, whatever stands further away, and merges never cross words. So
the ids of the parts, put together, are the ids of the text; parts with unusual characters or special
tokens go to the tokenizers library itself.
"""

from __future__ import annotations

import base64
import json
import os
import re
from functools import cached_property

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: Characters on which both libraries' tables of letters, numbers and white space agree.
PLAIN = re.compile("[\t\n\r -~¡-¬®-ɏ]*").fullmatch
CUT = re.compile("(?<=[^\\s᠎​﻿]) (?=[^\\s᠎​﻿])").split

_made: dict[str, ByteBpe] = {}


def byte_bpe(name: str = "byte_bpe_50k.json") -> ByteBpe:
    """One encoder per Python worker and file."""
    if name not in _made:
        _made[name] = ByteBpe(name)
    return _made[name]


def library(name: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.no_truncation()
    found.no_padding()
    return found


class ByteBpe:
    def __init__(self, name: str):
        self.name = name
        self.special = [t["content"] for t in json.load(open(public_tokenizers.path(name)))["added_tokens"]]
        self.fast = None
        ranks = public_tokenizers.path(name).replace(".json", ".tiktoken")
        if os.path.exists(ranks):
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @cached_property
    def exact(self) -> Tokenizer:
        """Loaded when first needed: it takes some 100 MB of each worker."""
        return library(self.name)

    def encode_exact(self, text: str) -> list[int]:
        return self.exact.encode(text, add_special_tokens=False).ids

    def plain(self, text: str) -> bool:
        return self.fast is not None and PLAIN(text) is not None and not any(s in text for s in self.special)

    def encode(self, text: str) -> list[int]:
        if self.plain(text):
            return self.fast.encode_ordinary(text)
        parts = CUT(text)
        if len(parts) == 1:
            return self.encode_exact(text)
        out, run = [], parts[0]  # plain parts that follow each other go together
        good = self.plain(run)
        for part in parts[1:]:
            fine = self.plain(part)
            if fine == good and (good or len(run) < 4096):
                run += " " + part
            else:
                out += self.fast.encode_ordinary(run) if good else self.encode_exact(run)
                run, good = " " + part, fine
        return out + (self.fast.encode_ordinary(run) if good else self.encode_exact(run))

    def ids(self, text: str) -> np.ndarray:
        if self.plain(text):
            return self.fast.encode_to_numpy(text)
        return np.array(self.encode(text), np.uint32)
