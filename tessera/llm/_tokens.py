"""Token ids of whole texts with the tokenizers library, and a cache of word pieces."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

#: Segments whose ids a worker keeps: at most twice as many (a young and an old generation, some 200 bytes each).
CACHE, LONGEST = 700_000, 48
#: The same, where other operators' workers share the executor.
SMALL_CACHE = 150_000
#: Characters that Python takes for white space and the tokenizer's pattern does not.
_ODD = "[\x1c-\x1f]"
def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to ids, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    A byte-level tokenizer without normalizer never joins what stands before a change
    from other characters to white space with what follows, so texts are cut there and
    each distinct segment is encoded once. Other tokenizers, and texts with special tokens
    or odd control characters, go to the library whole.
    """

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.cuts = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        special = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([_ODD, *special]))
        vocabulary = self.library.get_vocab()
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self.cache = cache
        self.young: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def forget(self) -> None:
        """Empties the cache, where a worker's memory is wanted by what comes next."""
        self.young, self.old = {}, {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _cut(text: str) -> list[str]:
        """Segments by key: ``word`` for " word", a key with a line feed for itself, " word" for the first."""
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = " " + keys[0]
        return keys

    def _learn(self, wanted: set[str]) -> list[str]:
        """Puts the segments' ids in the young generation; returns the keys to forget after use (long ones).

        None marks a segment before whose end no cut may be made: it ends in white space, or is odd or special.
        """
        new, apart = [], []
        for key in wanted.difference(self.young):
            if key in self.old:
                self.young[key] = self.old[key]
                continue
            s = key[1:] if key[:1] == " " else key if key[:1] == "\n" else " " + key
            if (s and s[-1].isspace()) or self.odd.search(s):
                self.young[key] = None
            else:
                (apart if key[:1] == " " else new).append((key, s))
        for i in range(0, len(new), 20_000):  # one long text: each begins with white space and the one before ends without
            part = new[i : i + 20_000]
            ids = np.array(self.library.encode_batch_fast(["".join([s for _, s in part])], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.cumsum(self.width[ids])
            at = np.cumsum([len(s) if s.isascii() else len(s.encode()) for _, s in part])
            to = np.searchsorted(ends, at) + 1
            if to[-1] != len(ids) or not np.array_equal(ends[to - 1], at):
                apart += part
                continue
            raw, start = ids.tobytes(), 0
            for (key, _), end in zip(part, (4 * to).tolist()):
                self.young[key] = raw[start:end]
                start = end
        self.young.update(zip([key for key, _ in apart], self._whole([s for _, s in apart])))
        return [key for key, _ in (*new, *apart) if len(key) > LONGEST]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.cuts:
            return self._whole(texts)
        cut = [self._cut(t) for t in texts]
        forget = self._learn(set().union(*cut))
        out: list[bytes | None] = []
        for keys in cut:
            try:
                out.append(b"".join(map(self.young.__getitem__, keys)))
            except TypeError:  # a None among them
                out.append(None)
        whole = iter(self._whole([t for t, ids in zip(texts, out) if ids is None]))
        for key in forget:
            del self.young[key]
        if len(self.young) > self.cache:
            self.old, self.young = self.young, {}
        return [next(whole) if ids is None else ids for ids in out]


@functools.lru_cache(maxsize=2)
def encoder(path: str, cache: int = CACHE) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path, cache)
