"""Token ids of whole texts, by the tokenizers library, with the words' ids kept.

No pattern of the vocabulary's pre-tokenizer crosses white space and it drops white space
itself, so a text's ids are those of its words in a row. Words repeat far more often than
they are new; the ids of a bounded number of them are kept as bytes. A word of plain Latin
letters goes straight to the library's model; any other is encoded by the whole library.

That holds for tokenizers whose file normalises and cuts texts as this one's does; the file is
compared with these steps at the start, and for any other the library encodes whole texts.
"""

from __future__ import annotations

import functools
import json
import re

from arbora.llm.common import SPACES

#: Printable ASCII and Latin-1 letters: composed already, and lower-cased letter by letter.
_PLAIN = re.compile("[!-~\xc0-\xff]*")
#: The pre-tokenizer's own pattern (fixed values).
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: The steps before the model for which a text's ids are those of its words (fixed values).
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [{"type": "Split", "pattern": {"Regex": _PIECES}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
    },
}


def _byte_letters() -> dict[int, int]:
    """Latin-1 code of a byte to the printable letter that stands for it in the vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}


class _Kept(dict):
    """Computes what is missing; two generations, so that frequent words survive a full one."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if (v := self.old.get(key)) is None:
            v = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = v
        return v


class WordEncoder:
    """ids(text): little-endian unsigned 32-bit ids of a whole text, as bytes."""

    def __init__(self, path: str, keep_words: int = 400_000):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        steps = json.loads(self.library.to_str())
        self.by_words = all(steps[k] == v for k, v in _STEPS.items()) and steps["model"]["type"] == "BPE"
        self.largest_id = max(self.library.get_vocab().values())
        self.model, self.pieces, self.letters = self.library.model, regex.compile(_PIECES), _byte_letters()
        self.words, self.parts = _Kept(self._word, keep_words), _Kept(self._part, keep_words)

    def _part(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join([self.parts[p] for p in self.pieces.findall(text.lower())])
        return b"".join([i.to_bytes(4, "little") for i in self.library.encode(text, add_special_tokens=False).ids])

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_words or "<|" in text and any(chr(s) in t for t in self.special for s in SPACES):  # a special token with a space would cross words
            return b"".join([i.to_bytes(4, "little") for i in self.library.encode(text, add_special_tokens=False).ids])
        return b"".join(map(self.words.__getitem__, text.encode("utf-8", "replace").split()))

    @functools.cached_property
    def special(self) -> list[str]:
        return [t.content for t in self.library.get_added_tokens_decoder().values()]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One for each Python worker."""
    return WordEncoder(path)
