"""Token ids of whole texts with a public byte-level BPE, sped up by encoding each distinct word once.

A byte-level pre-tokeniser never lets a piece reach over a blank that follows a non-blank, so a text
is the concatenation of "first word", " second word", ... and the ids of a text are the ids of these
pieces. Texts in which a blank follows other white space are encoded in one go instead. A full stop or comma
after a letter is a piece of its own, so "word." takes the ids of "word" and of ".".
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from claimweave.llm.batches import ragged

#: Words a worker keeps before it starts afresh.
MEMO_WORDS = 1_000_000
#: Text bytes encoded at a time: more than elsewhere, as words repeat.
TOKEN_SLICE = 4 << 20
#: Unknown words joined into one call of the tokenizer.
CALL_WORDS = 2_000


class Encoder:
    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.memo_words = memo_words
        self.ends = dict(zip(".,", self.whole(list(".,")), strict=True))
        #: By byte: the id of a full stop or comma that is a piece of its own.
        self.mark_ids = np.zeros(256, dtype=np.uint32)
        for mark, ids in self.ends.items():
            if len(ids) == 4:
                self.mark_ids[ord(mark)] = np.frombuffer(ids, dtype=np.uint32)[0]
        self.forget()

    def forget(self) -> None:
        """Known words: word -> its number; a leading blank in the key marks a word that opens its text."""
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64)
        self.loose = np.zeros(1 << 12, dtype=bool)  # empty or ending in white space: a blank after it may belong to it

    def _learn(self, keys: list[str], ids: list[bytes], loose: list[bool] | bool) -> None:
        n, m = len(self.known), len(keys)
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=m) // 4
        added = np.frombuffer(b"".join(ids), dtype=np.uint32)
        while n + m > len(self.starts):
            self.starts, self.lengths, self.loose = (np.resize(x, 2 * len(x)) for x in (self.starts, self.lengths, self.loose))
        while self.used + len(added) >= len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(added)] = added
        self.lengths[n : n + m] = lengths
        self.loose[n : n + m] = loose
        self.starts[n : n + m] = self.used + np.cumsum(lengths) - lengths
        self.used += len(added)
        self.known.update(zip(keys, range(n, n + m), strict=True))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _blank_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word with one blank before it; no word is empty or has white space at either end."""
        out: list[bytes] = []
        for a in range(0, len(words), CALL_WORDS):
            group = words[a : a + CALL_WORDS]
            (ids,) = self.whole([" " + " ".join(group)])
            starts = np.flatnonzero(self.opens[np.frombuffer(ids, dtype=np.uint32)]) * 4
            if len(starts) != len(group) or starts[0]:
                out += self.whole([" " + w for w in group])
            else:
                ends = [*starts[1:].tolist(), len(ids)]
                out += [ids[s:e] for s, e in zip(starts.tolist(), ends, strict=True)]
        return out

    def _ids(self, key: str) -> bytes:
        i = self.known[key]
        return self.flat[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes()

    def _numbers(self, keys: list[str]) -> np.ndarray:
        """The number of each key's word; unknown ones are encoded, each once."""
        get = self.known.get
        found = np.fromiter(map(get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            asked = [keys[i] for i in missing.tolist()]
            new = list(dict.fromkeys(asked))
            opening = [w for w in new if w[:1] == " "]
            self._learn(opening, self.whole([w[1:] for w in opening]), [w == " " or w[-1].isspace() for w in opening])
            ended = [w for w in new if w[-1:] in self.ends and w[-2:-1].isalpha() and w[0] != " "]
            bare = [w[:-1] if w[-1:] in self.ends and w[-2:-1].isalpha() else w for w in new if w[:1] != " "]
            bare = [w for w in dict.fromkeys(bare) if w not in self.known]
            plain = [w for w in bare if w and not w[0].isspace() and not w[-1].isspace()]
            self._learn(plain, self._blank_words(plain), False)
            others = [w for w in bare if w not in self.known]
            self._learn(others, self.whole([" " + w for w in others]), [not w or w[-1].isspace() for w in others])
            ended = [w for w in ended if w not in self.known]
            self._learn(ended, [self._ids(w[:-1]) + self.ends[w[-1]] for w in ended], False)
            found[missing] = np.fromiter(map(get, asked), dtype=np.int64, count=len(asked))
        return found

    def _bare(self, words: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Words without the full stop or comma after their last ASCII letter, and that byte (else 0); opening words stay whole."""
        offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
        marks = np.zeros(len(words), dtype=np.uint8)
        at = np.flatnonzero(np.diff(offsets) > 1)
        last, before = data[offsets[at + 1] - 1], data[offsets[at + 1] - 2] | 0x20
        at = at[(self.mark_ids[last] > 0) & (before >= 0x61) & (before <= 0x7A)]
        marks[at] = data[offsets[at + 1] - 1]
        marks[first] = 0
        return pc.if_else(pa.array(marks > 0), pc.utf8_rtrim(words, characters=".,"), words), marks

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (no nulls), and where each text starts among them (one more than texts)."""
        n = len(texts)
        if not n:
            return np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        if len(self.known) > self.memo_words:
            self.forget()
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten()
        first = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        opening = [" " + w for w in words.take(pa.array(first)).to_pylist()]
        words, marks = self._bare(words, first)
        coded = words.dictionary_encode()
        which = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        which[first] = self._numbers(opening)
        loose = self.loose[which]
        loose[np.append(first[1:], len(which)) - 1] = False
        odd_at = np.flatnonzero(np.logical_or.reduceat(loose, first))
        marked = marks > 0
        lengths = self.lengths[which] + marked
        flat = self.flat[ragged(self.starts[which], lengths)]  # a marked word takes one place more, filled here
        flat[np.cumsum(lengths)[marked] - 1] = self.mark_ids[marks[marked]]
        per_text = np.add.reduceat(lengths, first)
        if len(odd_at):
            odd = self.whole(texts.take(pa.array(odd_at)).to_pylist())
            own = np.cumsum(per_text) - per_text
            odd_lengths = np.array([len(x) // 4 for x in odd], dtype=np.int64)
            own[odd_at], per_text[odd_at] = len(flat) + np.cumsum(odd_lengths) - odd_lengths, odd_lengths
            flat = np.concatenate([flat, np.frombuffer(b"".join(odd), dtype=np.uint32)])[ragged(own, per_text)]
        return flat, np.concatenate([[0], np.cumsum(per_text)])

    def encode_with_end(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode, with one more id at the end of every text."""
        flat, at = self.encode(texts)
        n = len(at) - 1
        out_at = at + np.arange(n + 1)
        out = np.full(int(out_at[-1]), end, dtype=np.uint32)
        inside = np.ones(len(out), dtype=bool)
        inside[out_at[1:] - 1] = False
        out[inside] = flat
        return out, out_at


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file, kept from task to task."""
    return Encoder(path)
