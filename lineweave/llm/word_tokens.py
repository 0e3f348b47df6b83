"""Token ids of many texts by a public word-level BPE vocabulary of the tokenizers library.

The library encodes each distinct word once; texts are then put together from the ids of their words. Words are
found and looked up for a whole chunk of texts at once. Texts with characters beyond ASCII and the Latin-1
letters, or with an apostrophe, are encoded by the library as they are; so are all texts where the vocabulary splits
words by other rules than these, which a probe against the library finds out.
"""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from .common import span_hashes

_PLAIN = re.compile("[\n\t\r !-&(-~À-ÖØ-öø-ÿ]*").fullmatch
_SPECIAL = "<|"
#: By lower-cased character: 0 white space, 1 letter (runs together), 2 digit (stands alone), 3 other mark (runs together).
_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[[9, 10, 13, 32]] = 0
_KIND[[*range(97, 123), *range(0xC0, 0x100)]] = 1
_KIND[48:58] = 2
#: Characters handled at once, and words remembered: the bounds of memory.
CHUNK = 2_000_000
REMEMBERED = 800_000


class WordTokens:
    def __init__(self, vocabulary: str) -> None:
        self.whole = Tokenizer.from_file(vocabulary)
        # the same model for words that are already lower-cased and split
        self.by_word = Tokenizer(self.whole.model)
        self.by_word.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        names = self.whole.get_vocab()
        self.ends_word = np.zeros(max(names.values()) + 1, dtype=bool)
        self.ends_word[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.by_words = self._agrees()

    def _agrees(self) -> bool:
        """Whether words put together give the library's ids, for every plain character beside every kind of other."""
        plain = [chr(c) for c in range(256) if _PLAIN(chr(c))]
        beside = ["".join(f"{c}{x} {x}{c}{c} " for c in plain) for x in ("a", "B", "7", ".", " ", "\n", "é")]
        probes = [*beside, "The quick Brown fox, 12345 (3.14) jumps--over! <b>LAZY</b> naïve café_x  \t end", " lead", "trail ", "a", " "]
        out: list[np.ndarray | None] = [None] * len(probes)
        try:
            self._encode_chunk(probes, list(range(len(probes))), out)
        except (IndexError, ValueError):  # ids that do not fall into words
            return False
        return all(np.array_equal(got, self._whole(x)) for got, x in zip(out, probes, strict=True))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """ids of each text, as the library's encode gives them; null has none."""
        out: list[np.ndarray | None] = [None] * len(texts)
        chunk: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, dtype="<u4")
            elif not self.by_words or not _PLAIN(text) or _SPECIAL in text:
                out[i] = self._whole(text)
            else:
                if held and held + len(text) > CHUNK:
                    self._encode_chunk(texts, chunk, out)
                    chunk, held = [], 0
                chunk.append(i)
                held += len(text)
        if chunk:
            self._encode_chunk(texts, chunk, out)
        return out

    def _encode_chunk(self, texts: list[str | None], chunk: list[int], out: list) -> None:
        joined = "\n".join([texts[i] for i in chunk]).lower() + "\n"
        points = np.frombuffer(joined.encode("latin-1"), dtype=np.uint8)
        doc_sizes = np.fromiter((len(texts[i]) + 1 for i in chunk), dtype=np.int64, count=len(chunk))
        kind = _KIND[points]
        change = np.ones(len(points) + 1, dtype=bool)
        change[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        bounds = np.flatnonzero(change)
        real = kind[bounds[:-1]] > 0
        starts, ends = bounds[:-1][real], bounds[1:][real]
        if not len(starts):
            for i in chunk:
                out[i] = np.zeros(0, dtype="<u4")
            return
        (hashes,) = span_hashes(points, starts, ends)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        sums = np.concatenate(([0], np.cumsum(points, dtype=np.int64)))
        marks = np.stack((ends - starts, sums[ends] - sums[starts]))
        if not np.array_equal(marks[:, first[which]], marks):  # two words share a hash
            for i in chunk:
                out[i] = self._whole(texts[i])
            return
        keys = [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        missing = [k for k, key in enumerate(keys) if key not in self.known]
        if missing:
            words = [keys[k] for k in missing]
            ids = np.array(self.by_word.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
            raw, done = ids.tobytes(), 0
            for k, end in zip(missing, (np.flatnonzero(self.ends_word[ids]) + 1).tolist(), strict=True):
                self.known[keys[k]] = raw[4 * done : 4 * end]
                done = end
        parts = [self.known[key] for key in keys]
        store = np.frombuffer(b"".join(parts), dtype="<u4")
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        offsets = np.cumsum(sizes) - sizes
        own = sizes[which]
        stops = np.cumsum(own)
        ids = store[np.repeat(offsets[which] - (stops - own), own) + np.arange(stops[-1])]
        words_before = np.searchsorted(starts, np.concatenate(([0], np.cumsum(doc_sizes))))
        cuts = np.concatenate(([0], stops))[words_before]
        for k, i in enumerate(chunk):
            out[i] = ids[cuts[k] : cuts[k + 1]]
