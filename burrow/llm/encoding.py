"""Token ids of whole texts, with the tokenizers library called once for each distinct word.

White space never takes part in a token of the word vocabularies (they drop it), so the ids of a
text are those of its runs without ASCII white space, one after the other. Each worker remembers
the ids of the runs it has met, up to a bound and but for long ones, and asks the library for the others.

Defined results: a null or empty text, or one of white space alone, has no ids; runs of any length and script have the
library's ids; special strings inside texts are split off as the library does by default.
"""

from __future__ import annotations

import numpy as np

from burrow.llm.textual import per_worker

#: Marks that the word vocabularies split off, as one piece, from a letter before them.
_MARKS = ".,;:!?#$%&*"


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next free one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(other)) for b in range(256)]


class WordEncoder(dict):
    """bytes of a run -> its ids as little-endian uint16 bytes (uint32 for vocabularies over 65,536)."""

    LONG = 64

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(True) <= 1 << 16 else "<u4")
        self.most = most

    def __missing__(self, run: bytes) -> bytes:
        """Latin-1 letters alone go straight to the vocabulary's merges; marks at their end and capitals are taken off first."""
        s = run.decode()
        if max(s) < "Ā" and "<|" not in s:
            if s.isalpha() and (low := s.lower()) == s:
                ids = np.array([t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, run)))], self.dtype).tobytes()
            elif s.isalpha():
                return self[low.encode()]
            elif (stem := s.rstrip(_MARKS)) and stem != s and stem.isalpha():
                ids = self[stem.encode()] + self[s[len(stem) :].encode()]
            else:
                ids = self.encoded(s)
        else:
            ids = self.encoded(s)
        if len(run) > self.LONG:
            return ids
        if len(self) >= self.most:  # frequent runs came early and stay
            for late in list(self)[self.most // 2 :]:
                del self[late]
        self[run] = ids
        return ids

    def encoded(self, s: str) -> bytes:
        return np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, self.dtype).tobytes()

    def ids(self, text: bytes | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())) if text else b"", self.dtype)


def word_encoder(path: str) -> WordEncoder:
    """This worker's encoder for the file. Only for vocabularies that drop white space."""
    return per_worker(f"encoder {path}", lambda: WordEncoder(path))
