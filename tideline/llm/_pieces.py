"""Token ids of whole texts by way of their distinct pieces, each coded once.

A tokenizer whose pre-tokenisation never joins what lies on both sides of a boundary
gives a text the ids of its pieces, one after the other. Two such boundaries are used:
any run of ASCII white space where the tokenizer drops white space, and, for byte-level
patterns that attach one space to the next word, the place before a space that a
character other than white space follows. Texts in which a space meets more white space
are split by the pattern as a whole. Ids are kept as little-endian unsigned 32-bit bytes.
"""

from __future__ import annotations

import itertools
import os
import re
from array import array
from collections.abc import Callable, Iterable

import pyarrow as pa

from ._text import HELD, chunks

#: A worker forgets the later half of its pieces when they take about so many bytes; early ones are common ones.
CACHE_BYTES = 180 << 20


class PieceCoder:
    """code() gives the ids of each of a list of strings, every one taken as a whole text.

    spaced: a piece is a word with one space before it, else a word between white space,
    for a tokenizer that lower-cases.
    """

    def __init__(self, code: Callable[[list[str]], Iterable[bytes]], spaced: bool, cache_bytes: int = CACHE_BYTES):
        self.code, self.spaced, self.cache_bytes = code, spaced, cache_bytes
        self.first: dict[bytes, bytes | None] = {}
        self.later: dict[bytes, bytes | None] = {}
        self.held = 0
        HELD.append(self.clear)

    def clear(self) -> None:
        self.first, self.later, self.held = {}, {}, 0

    def _trim(self) -> None:
        if self.held > self.cache_bytes:
            self.first = {}
            self.later = dict(itertools.islice(self.later.items(), len(self.later) // 2))
            self.held = sum(200 + len(p) + len(ids or b"") for p, ids in self.later.items())

    def _learn(self, known: dict, pieces: set[bytes], lead: str) -> None:
        new = [p for p in pieces if p not in known]
        if lead:
            texts = [p.decode("utf-8", "replace") for p in new]
            odd = [not t or t[0].isspace() for t in texts]
            if any(odd):
                known.update((p, None) for p, o in zip(new, odd, strict=True) if o)
                new = [p for p, o in zip(new, odd, strict=True) if not o]
            texts = [lead + t for t, o in zip(texts, odd, strict=True) if not o]
        else:
            texts = [p.decode("utf-8", "replace") for p in new]
        coded = list(self.code(texts))
        known.update(zip(new, coded, strict=True))
        self.held += 200 * len(new) + sum(map(len, coded)) + sum(map(len, new))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        self._trim()
        join = b"".join
        if not self.spaced:
            # the tokenizer lower-cases; doing so for A-Z first changes nothing unless a combining mark follows
            parts = [(t if b"\xcc" in t or b"\xcd" in t else t.lower()).split() for t in texts]
            self._learn(self.later, set().union(*parts), "")
            return [join(map(self.later.__getitem__, p)) for p in parts]
        parts = [t.split(b" ") for t in texts]
        self._learn(self.first, {p[0] for p in parts}, "")
        later = [p[1:] for p in parts]
        self._learn(self.later, set().union(*later), " ")
        out = []
        for text, p, rest in zip(texts, parts, later, strict=True):
            try:
                out.append(self.first[p[0]] + join(map(self.later.__getitem__, rest)))
            except TypeError:  # a piece is None: a space meets more white space
                out += self.code([text.decode("utf-8", "replace")])
        return out


def text_slices(column: pa.Array):
    """(first row, texts as bytes) of slices of bounded size; null counts as empty."""
    for row, data, offsets in chunks(column, keep=True):
        raw = data.tobytes()
        at = offsets.tolist()
        yield row, [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


#: What each tokenizer file's pre-tokenizer matches.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LIBRARY: dict[str, PieceCoder] = {}


def library_coder(path: str, spaced: bool) -> PieceCoder:
    """A coder by the tokenizers library, kept for all tasks of a worker.

    spaced: byte-level BPE by the public pattern; else BPE of lower-cased words. Strings
    with characters from U+0250 on go through the library's whole pipeline; for the rest,
    its model gets the words that the pattern gives.
    """
    if path in _LIBRARY:
        return _LIBRARY[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenize, alphabet = tokenizer.model.tokenize, byte_alphabet()
    find = regex.compile(public_tokenizers.PATTERN if spaced else WORD_PATTERN).findall

    def code(texts: list[str]) -> Iterable[bytes]:
        ids, ends = [], [0]
        for t in texts:
            if not spaced and (t.isascii() or max(t, default="") < "\u0250"):
                t = t.lower()
            word = t[spaced:]
            if word.isascii() and word.isalpha() and (not spaced or t[0] == " "):
                ids += [x.id for x in tokenize("\u0120" + word if spaced else word)]
            elif t.isascii() or max(t) < "\u0250":
                ids += [x.id for w in find(t) for x in tokenize(w.encode().decode("latin-1").translate(alphabet))]
            else:
                ids += tokenizer.encode(t, add_special_tokens=False).ids
            ends.append(4 * len(ids))
        raw = array("I", ids).tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    _LIBRARY[path] = PieceCoder(code, spaced)
    return _LIBRARY[path]


def merges_in_order(model: dict) -> bool:
    """Do the tokens that the merges make have ascending numbers, above those of all parts?"""
    vocabulary, last = model["vocab"], -1
    for merge in model["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        made = vocabulary.get(a + b, -1)
        if made <= max(last, vocabulary.get(a, made), vocabulary.get(b, made)):
            return False
        last = made
    return True


class WholeTextCoder:
    """Byte-level BPE of whole texts by tiktoken, from the vocabulary of a tokenizers file.

    Both libraries contract by rank, and where a file numbers its tokens in the order of their
    merges, ids are the same; this is checked, and a file of another order is left to the
    tokenizers library, as a whole. Where their character classes might differ (characters from
    U+0240 on) or the pattern would backtrack far (long runs of white space), the
    tokenizers library codes the text.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary = model["vocab"]
        byte_of = {c: b for b, c in byte_alphabet().items()}
        ranks = {bytes(map(byte_of.__getitem__, t)): n for t, n in vocabulary.items() if all(c in byte_of for c in t)}
        self.encode_ordinary = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.odd = re.compile(rb"[\xc9-\xff]|[\t-\r ]{300}").search
        self.path, self.ordered = path, merges_in_order(model)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out = []
        for t in texts:
            if not self.ordered or self.odd(t):
                out += library_coder(self.path, spaced=True).code([t.decode("utf-8", "replace")])
            else:
                out.append(array("I", self.encode_ordinary(t.decode())).tobytes())
        return out


_WHOLE: dict[str, WholeTextCoder] = {}


def whole_text_coder(path: str) -> WholeTextCoder:
    if path not in _WHOLE:
        _WHOLE[path] = WholeTextCoder(path)
    return _WHOLE[path]
