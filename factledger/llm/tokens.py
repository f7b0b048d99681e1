"""Token ids of whole texts, by the tokenizers library.

Most words repeat, so ids are kept by piece in each Python worker and the
library is asked for new pieces only, many in one call. Both vocabularies split
a text by a regular expression before they merge, never across a split, so the
ids of the pieces in order are the ids of the text. The pieces are found here
for texts of Latin-1 characters, whose classes are written out below; any other
text, and one that holds the string of a special token, goes to the library
whole. Tests compare both ways. New words go to the vocabulary's merges without
its other steps, which leave a single word as it is.
"""

from __future__ import annotations

import functools
import os
import re
from itertools import filterfalse

import numpy as np

# Letters, numbers and white space of Latin-1, and the split
# patterns of the two vocabularies in these classes.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_BLANK = " \t-\r\x85\xa0"
_BYTE_SPLIT = (
    f"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+"
    f"|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
_WORD_SPLIT = f"'(?:[stmd]|re|ve|ll)|[{_LETTER}]+|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+"

#: Pieces kept by a worker, besides those of one batch; beyond it the store starts anew. About 200 bytes each.
KEPT_PIECES = 600_000


class Encoder:
    """Ids of texts as little-endian bytes, ``width`` bytes an id.

    With ``special_as_text`` the strings of special tokens are ordinary text;
    without it the ids are those of the library as it is.
    """

    def __init__(self, path: str, kept: int = KEPT_PIECES, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = special_as_text
        special = [] if special_as_text else [t.content for t in self.model.get_added_tokens_decoder().values()]
        # in any case: the library may fold it before it looks for them
        self.special = re.compile("|".join(map(re.escape, special)), re.IGNORECASE).search if special else None
        vocabulary = self.model.get_vocab()
        largest = max(vocabulary.values())
        self.dtype = np.dtype("<u2" if largest < 1 << 16 else "<u4")
        self.by_word = any(piece.endswith("</w>") for piece in vocabulary)
        self.split = re.compile(_WORD_SPLIT if self.by_word else _BYTE_SPLIT).findall
        # ids that end (word vocabulary) or start (byte vocabulary) a joined piece
        self.edge = np.zeros(largest + 1, bool)
        self.edge[
            [i for p, i in vocabulary.items() if (p.endswith("</w>") if self.by_word else p.startswith("Ġ"))]
        ] = True
        # new words go to the merges spelled as the vocabulary spells their bytes, cut at spaces alone
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        letters = re.findall(f"[{_LETTER}]" if self.by_word else f"[ {_LETTER}]", "".join(map(chr, range(256))))
        self.spelling = {ord(c): spelled(c)[0][0] for c in letters}
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = None
        self.merges.pre_tokenizer = pre_tokenizers.Split(
            " " if self.by_word else spelled(" ")[0][0], "removed" if self.by_word else "merged_with_next"
        )
        self.kept, self.pieces = kept, {}

    def _direct(self, texts: list[str], model=None) -> list[bytes]:
        found = (model or self.model).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in found]

    def _learn(self, new: set[str]) -> None:
        words = [p for p in new if (p[0].isalpha() if self.by_word else p[0] == " " and p[1:2].isalpha())]
        others = list(new.difference(words))
        self.pieces.update(zip(others, self._direct(others), strict=True))
        joined = (" " if self.by_word else "").join(words).translate(self.spelling)
        ids = np.frombuffer(self._direct([joined], self.merges)[0], self.dtype)
        edges = np.flatnonzero(self.edge[ids])
        starts = [0, *(edges[:-1] + 1).tolist()] if self.by_word else edges.tolist()
        if words and len(starts) == len(words):
            data, size = ids.tobytes(), self.dtype.itemsize
            ends = [*starts[1:], len(ids)]
            self.pieces.update(
                (w, data[a * size : z * size]) for w, a, z in zip(words, starts, ends, strict=True)
            )
        else:
            self.pieces.update(zip(words, self._direct(words), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text, in order."""
        if len(self.pieces) > self.kept:
            self.pieces.clear()
        split: list[list[str] | None] = []
        new: set[str] = set()
        for text in texts:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                split.append(None)
                continue
            if self.special and self.special(text):
                split.append(None)
                continue
            pieces = self.split(text.lower() if self.by_word else text)
            new.update(filterfalse(self.pieces.__contains__, pieces))
            split.append(pieces)
        if new:
            self._learn(new)
        whole = iter(self._direct([t for t, p in zip(texts, split, strict=True) if p is None]))
        get = self.pieces.__getitem__
        return [next(whole) if pieces is None else b"".join(map(get, pieces)) for pieces in split]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker, with the ids of the library as it is."""
    return Encoder(path, special_as_text=False)
