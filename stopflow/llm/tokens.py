"""Token ids of whole texts with public tokenizers, remembering the ids of words."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import sys
from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words whose ids a worker remembers.
REMEMBERED = 1_500_000

# Text encoded at a time.
CHARS = 2_000_000

# A space or a line feed between two of these characters always lies between two
# pre-tokens of the supported tokenizers.
_SAFE = re.compile(r"[\w!-~]")

_LETTERS = "".join(filter(str.isalpha, map(chr, range(256))))
_BEYOND = re.compile(r"[^\0-\xff]")
# What may stand behind a word; an apostrophe may belong to the word.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PROBES = ["there", "There", "OTHER", "Straße", "señor", "Éclair", "Zürich", "français", "unknowable", "internationalisation", "xqzjkvw"]


def tokenizer_path(name: str) -> str:
    """A file's path: as given, or by name among the installed public files."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Places(dict):
    """Place of every piece in the table of ids; a new piece gets the next one."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        place = self[piece] = len(self)
        self.fresh.append(piece)
        return place


class _Known:
    """Ids by place, all in one array."""

    def __init__(self):
        self.ids = np.empty(1 << 16, "<u4")
        self.end = 0
        self.starts = np.zeros(1 << 14, np.int64)
        # negative where a piece has no ids of its own
        self.sizes = np.zeros(1 << 14, np.int32)

    def reserve(self, places: int) -> None:
        more = places - len(self.sizes)
        if more > 0:
            more = max(more, len(self.sizes) // 2)
            self.starts, self.sizes = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.starts, self.sizes))

    def put(self, places: list[int], sizes: np.ndarray, ids: np.ndarray) -> None:
        if self.end + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.end], np.empty(max(len(ids), self.end // 2), "<u4")])
        at = np.asarray(places, np.int64)
        self.starts[at] = self.end + np.cumsum(sizes, dtype=np.int64) - sizes
        self.sizes[at] = sizes
        self.ids[self.end:self.end + len(ids)] = ids
        self.end += len(ids)

    def get(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these places, joined, and where those of each one end."""
        sizes = np.maximum(self.sizes[places], 0)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = np.repeat(self.starts[places] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.ids[at], ends


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    A text is cut before single spaces and line feeds that stand between safe
    characters; the pieces are encoded once and remembered. Texts with anything
    else at a cut are encoded whole, so the ids are always those of the whole
    text. Strings of special tokens are ordinary text.

    Most pieces are a word of Latin letters, with or without punctuation behind
    it. Their ids are those of the folded word and of the punctuation, and a
    word's come from the tokenizer's model alone, unless the whole tokenizer is
    seen to say otherwise (`_letters`).
    """

    def __init__(self, name: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.remembered = remembered
        # what stands between words encoded together: a line feed where the
        # tokenizer keeps it, else a control character that is a word of its own
        self.line_feed = self._ids(["\n"])[0]
        self.mark = "\n" if self.line_feed else " \x01 "
        self.mark_id = array("I", self._ids([self.mark])[0])
        if len(self.mark_id) != 1:
            raise ValueError(f"{name}: no single id to separate words with")
        self.before = " " if self.line_feed else ""
        self.letters = self._letters()
        self._clear()

    def _clear(self) -> None:
        # of pieces, with their line feed or without the space before them, and of
        # punctuation behind words, with a space, which no piece has
        self.places = _Places()
        self.known = _Known()
        # of the first pieces of texts
        self.firsts: dict[str, bytes] = {}

    def _letters(self) -> tuple[dict[int, str], dict[int, str], str] | None:
        """What letters are folded to, what the model is given for them and for a
        space before a word. None where words and punctuation have other ids than
        these would give."""
        tok = self.tokenizer
        if tok.pre_tokenizer is None or not all(t.special for t in tok.get_added_tokens_decoder().values()):
            return None

        def shown(text: str) -> str | None:
            parts = tok.pre_tokenizer.pre_tokenize_str(text)
            return parts[0][0] if len(parts) == 1 else None

        fold = {ord(c): tok.normalizer.normalize_str(c) if tok.normalizer else c for c in _LETTERS}
        given = {c: shown(f) for c, f in fold.items()}
        spaced = shown(self.before + "a")
        if not (all(f in set(_LETTERS) for f in fold.values()) and all(given.values()) and spaced and spaced.endswith(given[ord("a")])):
            return None
        space = spaced.removesuffix(given[ord("a")])
        words = [*_LETTERS, *_PROBES, _LETTERS, _LETTERS[::-1]]
        for w, plain, behind in zip(words, self._ids(words), self._ids([self.before + w for w in words])):
            shapes = [w.translate(given), space + w.translate(given)]
            if [plain, behind] != [array("I", (t.id for t in self.model.tokenize(s))).tobytes() for s in shapes]:
                return None
        marks = [a + b for a in _MARKS if a != "'" for b in ("", *_MARKS)]
        at, ends = self._ids(["at", self.before + "at"]), self._ids(marks)
        if self._ids([f"at{m} at" for m in marks]) != [at[0] + m + at[1] for m in ends]:
            return None
        return fold, given, space

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], before: str) -> list[bytes]:
        """Ids of many words, encoded together in long texts."""
        out: list[bytes] = []
        for i in range(0, len(words), 8192):
            part = words[i:i + 8192]
            ids = np.asarray(self.tokenizer.encode_batch_fast([self.mark.join([before + w for w in part])], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark_id[0])
            if len(cuts) != len(part) - 1:
                raise ValueError("a word holds the separating id")
            raw, starts, ends = ids.tobytes(), [0, *((cuts + 1) * 4).tolist()], [*(cuts * 4).tolist(), len(ids) * 4]
            out += [raw[s:e] for s, e in zip(starts, ends)]
        return out

    def _learn(self) -> None:
        """Ids of the pieces that were met for the first time."""
        fresh, place = self.places.fresh, self.places.__getitem__
        # words as they are, behind a line feed, and punctuation
        words, places = ([], [], []), ([], [], [])
        shapes, plain, built, parts, without = ([], []), ([], []), [], [], []
        fold, given, space = self.letters or ({}, {}, "")
        # the words and the punctuation of pieces join the list while it is read
        for k, p in enumerate(fresh, len(self.places) - len(fresh)):
            if p[:1] == " ":
                places[2].append(k)
                words[2].append(p[1:])
                continue
            line = p[:1] == "\n"
            w = p[1:] if line else p
            letters = w.rstrip(_MARKS)
            marks = w[len(letters):]
            if fold and letters.isalpha() and marks[:1] != "'" and (letters.isascii() or not _BEYOND.search(letters)):
                letters = letters.translate(fold)
                root = "\n" + letters if line and self.line_feed else letters
                if root == p:
                    plain[line].append(k)
                    shapes[line].append(letters.translate(given) if line else space + letters.translate(given))
                else:
                    built.append(k)
                    parts.append(place(root))
                    parts.append(place(" " + marks))
            elif w and _SAFE.match(w[0]) and _SAFE.match(w[-1]) and "\x01" not in w:
                places[line].append(k)
                words[line].append(w)
            else:
                without.append(k)
        self.places.fresh = []
        self.known.reserve(len(self.places))
        self.known.sizes[without] = -1
        tokenize = self.model.tokenize
        for line, head in ((0, b""), (1, self.line_feed)):
            self._put(plain[line], [head + array("I", [t.id for t in tokenize(s)]).tobytes() for s in shapes[line]])
        for kind, before, head in ((0, self.before, b""), (1, "", self.line_feed), (2, "", b"")):
            self._put(places[kind], [head + ids for ids in self._words(words[kind], before)])
        # each from two places that are known by now
        ids, ends = self.known.get(np.asarray(parts, np.int64))
        self.known.put(built, np.diff(ends[1::2], prepend=0), ids)

    def _put(self, places: list[int], ids: list[bytes]) -> None:
        self.known.put(places, np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.frombuffer(b"".join(ids), "<u4"))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of a few texts; call it with batches of some megabytes."""
        if len(self.places) + len(self.firsts) > self.remembered:
            self._clear()
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        coded = cut.values.dictionary_encode()
        pieces, codes, bounds = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(), cut.offsets.to_numpy().astype(np.int64)
        # the first piece has no space before it
        firsts = pieces[codes[bounds[:-1]]].tolist()
        codes = np.delete(codes, bounds[:-1])
        bounds -= np.arange(len(bounds))
        used = np.zeros(len(pieces), bool)
        used[codes] = True
        places = np.zeros(len(pieces), np.int64)
        places[used] = list(map(self.places.__getitem__, pieces[used].tolist()))
        if self.places.fresh:
            self._learn()
        whole = np.zeros(len(texts), bool)
        # pieces without ids of their own
        whole[np.searchsorted(bounds, np.flatnonzero((self.known.sizes[places] < 0)[codes]), "right") - 1] = True
        whole |= np.array([not (f and _SAFE.match(f[0]) and _SAFE.match(f[-1])) for f in firsts], bool)
        new = list({f for f, w in zip(firsts, whole.tolist()) if not w and f not in self.firsts})
        self.firsts.update(zip(new, self._ids(new)))
        by_text = iter(self._ids(list(compress(texts, whole.tolist()))))
        ids, ends = self.known.get(places[codes])
        raw, at = ids.tobytes(), (4 * np.concatenate([[0], ends])[bounds]).tolist()
        return [next(by_text) if w else self.firsts[f] + raw[s:e] for f, w, s, e in zip(firsts, whole.tolist(), at, at[1:])]


def batches_of_text(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about `chars` characters, and their texts (null: empty)."""
    for batch in batches:
        texts = [t or "" for t in batch.column(column).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= chars or i == len(texts) - 1:
                yield batch.slice(start, i + 1 - start), texts[start:i + 1]
                start, size = i + 1, 0


def encoder(name: str) -> Encoder:
    """The worker's encoder for a tokenizer file. Functions come to a worker by
    value, their modules' variables anew for each task; what it keeps from task
    to task lies in `sys`."""
    held = sys.__dict__.setdefault("_stopflow_encoders", {})
    if name not in held:
        trim()
        held[name] = Encoder(name)
    return held[name]


def forget() -> None:
    """Gives the memory of remembered words back, for operators without tokens."""
    if sys.__dict__.pop("_stopflow_encoders", None) is not None:
        trim()


def trim() -> None:
    """Gives memory that an earlier task of this worker has freed back to the
    system: a worker goes on from operator to operator."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library
