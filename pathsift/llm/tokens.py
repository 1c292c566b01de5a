"""Exact, cached byte-level BPE encoding for the tokenizer files of the cluster.

A file ``*.json`` is encoded as the ``tokenizers`` library encodes it, without
added begin/end tokens, special strings in the text becoming their one token.
Texts made only of the common Latin code points are cut into pieces with one
compiled pattern, and each distinct piece is encoded once per worker; any
other text goes to the library itself.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

#: Distinct pieces remembered per worker; the cache is emptied beyond it.
CACHE_PIECES = 400_000

#: Code points for which the piece pattern was checked against the library.
_SAFE_POINTS = [*range(0x250), *range(0x2010, 0x2028), 0x20AC]


def _char_class(points) -> str:
    """The inside of a character class, runs written as ranges."""
    out, runs = [], []
    for p in points:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    for a, b in runs:
        out.append(re.escape(chr(a)) + (f"-{re.escape(chr(b))}" if b > a else ""))
    return "".join(out)


def _piece_pattern() -> tuple[re.Pattern, re.Pattern]:
    letters = _char_class(p for p in _SAFE_POINTS if unicodedata.category(chr(p))[0] == "L")
    numbers = _char_class(p for p in _SAFE_POINTS if unicodedata.category(chr(p))[0] == "N")
    spaces = _char_class([*range(9, 14), 0x20, 0x85, 0xA0])
    pattern = (rf"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+"
               rf"|[{spaces}]+(?![^{spaces}])|[{spaces}]+")
    return re.compile(pattern), re.compile(f"[{_char_class(_SAFE_POINTS)}]*")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Pieces(dict):
    """piece -> ids, filled on demand."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece):
        if len(self) >= CACHE_PIECES:
            self.clear()
        out = self[piece] = self.encode(piece)
        return out


class Encoder:
    """Encoder of one tokenizer file (``.json`` or ``.model``)."""

    def __init__(self, path: str):
        self.path = path
        self.pieces = self.counts = None
        if path.endswith(".model"):
            import sentencepiece
            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda t: sp.encode(t, num_threads=1)
            return
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        self.whole = lambda t: tok.encode(t, add_special_tokens=False).ids
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        plain = (spec["model"].get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                 and not pre.get("add_prefix_space") and not spec.get("normalizer")
                 and not any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in added))
        if not plain:
            return
        import tiktoken
        alphabet = _byte_alphabet()
        special = {a["content"]: a["id"] for a in added}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        core = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.special = special
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") \
            if special else None
        self.pattern, self.safe = _piece_pattern()
        self.pieces = _Pieces(core.encode_ordinary)
        self.counts = _Pieces(lambda p: len(core.encode_ordinary(p)))

    def _parts(self, text: str):
        if self.split_special and any(s in text for s in self.special):
            return self.split_special.split(text)
        return (text,)

    def ids(self, text: str) -> list[int]:
        if self.pieces is None or not (text.isascii() or self.safe.fullmatch(text)):
            return self.whole(text)
        out: list[int] = []
        for part in self._parts(text):
            if part in self.special:
                out.append(self.special[part])
            else:
                for ids in map(self.pieces.__getitem__, self.pattern.findall(part)):
                    out += ids
        return out

    def count(self, text: str) -> int:
        if self.pieces is None or not (text.isascii() or self.safe.fullmatch(text)):
            return len(self.whole(text))
        return sum(1 if part in self.special else sum(map(self.counts.__getitem__, self.pattern.findall(part)))
                   for part in self._parts(text))


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def version_digest(path: str) -> str:
    """SHA-256 of the tokenizer file: the version that cached counts belong to."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def default_tokenizer() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))
