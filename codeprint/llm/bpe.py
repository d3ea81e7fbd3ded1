"""BPE encoding by a depth-first walk over a trie of distinct words, and decoding.

The last token of a prefix's encoding is the one token t that ends there and may follow the last
token of the prefix without t.  The walk keeps these last tokens along the path from the root, so
what words share as a prefix is encoded once.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from hashlib import sha256
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from codeprint.llm.common import bounded

END = "\0"  # stands for the end-of-word mark behind a word's last symbol; the byte alphabet doesn't hold it
#: Fixed values of the tokenizer: its end-of-word mark and its pattern.
SUFFIX = "</w>"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes of the words and of the states that a codec keeps, roughly; of one state; of a word besides its characters.
CACHE_BYTES, KEPT_STATES, STATE_BYTES, WORD_BYTES = 20 << 20, 28 << 20, 180, 150
#: The share of a table's bytes from which on words that had come back must come back again.
PROVEN = 0.75
#: Words that are cut from texts before they are looked up together.
CUT_WORDS = 100_000
#: The first code point from which Unicode tables of different age may disagree.
NEWER = "\u07fd"
#: Bytes of a word that is merged in arrays at most; words that are worth arrays, and that are in them at once.
LONGEST, FEW, MANY = 32, 200, 1 << 14
#: The rank of a pair that does not merge.
NONE = (1 << 26) - 1


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


def newer(text: str) -> bool:
    """Whether a text holds a character from NEWER on."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return max(text) >= NEWER
    return False


def ranges(chars: list[int]) -> str:
    """These code points, in order, as ranges of a class of the re module."""
    runs: list[list[int]] = []
    for i in chars:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


#: Classes of characters, as in PATTERN.
BLANK, LETTER, DIGIT, OTHER = range(4)


def char_classes(cut: Callable[[str], list]) -> np.ndarray:
    """The class of each character before NEWER, as the library's own cutter has it."""
    of = np.array([len(cut(f"a{chr(c)}a")) for c in range(ord(NEWER))], np.uint8)
    alone = [c for c in np.flatnonzero(of == 3).tolist() if len(cut(f"!{chr(c)}!")) == 3]
    classes = np.choose(of, [OTHER, LETTER, BLANK, OTHER]).astype(np.uint8)
    classes[alone] = DIGIT
    return classes


def word_pattern(classes: np.ndarray) -> re.Pattern:
    """PATTERN for texts without newer characters, by these classes.

    No word that begins with a letter begins with an apostrophe, so letters may come first."""
    blank, letter, digit = (ranges(np.flatnonzero(classes == k).tolist()) for k in (BLANK, LETTER, DIGIT))
    return re.compile(f"[{letter}]+|'(?:[stmd]|re|ve|ll)|[{digit}]|[^{blank}{letter}{digit}]+")


def word_starts(text: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the word pattern finds in a text without newer characters, given as UTF-8 that ends in three blanks.

    For each byte: whether a word begins there, and whether it belongs to a word."""
    of = classes[text & 127]
    lead = np.flatnonzero(text >= 192)  # of two bytes, as all characters here beyond ASCII
    of[lead] = of[lead + 1] = classes[(text[lead].astype(np.int32) & 31) << 6 | text[lead + 1] & 63]
    starts = of == DIGIT
    starts[0] = True
    starts[1:] |= of[1:] != of[:-1]
    starts[lead + 1] = False
    inside = of != BLANK
    starts &= inside
    at = np.flatnonzero((text == ord("'")) & starts)
    for ending in (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"):
        found = at
        for k, c in enumerate(ending, 1):
            found = found[text[found + k] == c]
        starts[found + 1] = False
        behind = found + 1 + len(ending)
        starts[behind[of[behind] == LETTER]] = True
    return starts, inside


class TrieBpe:
    """Encoder and decoder of a word BPE vocabulary.

    ``limit`` bounds the bytes of the words kept between batches; beyond it, those that no second
    batch of texts has used are forgotten.  Beyond KEPT_STATES all states are.  Both are then found anew."""

    def __init__(self, path: str, limit: int = CACHE_BYTES, tables: bool = True) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        special = [a["content"] for a in spec["added_tokens"]]
        self.bytes, self.limit, self.held, self.states = byte_alphabet(), limit, 0, 0
        self.follows: dict[str | None, dict[str, bool]] = {}
        self.words = {" " + a["content"]: str(a["id"]) for a in spec["added_tokens"]}
        self.fixed = dict(self.words)
        #: Words that one batch of texts alone has used so far.
        self.once: set[str] = set()
        self.symbols = np.array([ord(c) for c in self.bytes], "<u2")
        self.symbols[32] = 32  # between words; no word holds a blank
        library = Tokenizer.from_file(path)
        self.library = (library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str)
        self.classes = char_classes(self.library[1])
        self.pattern = word_pattern(self.classes)
        self.model = None if tables else library.model
        self.cut = re.compile("|".join(map(re.escape, special))) if special else None
        self.names = {str(i): t for t, i in model["vocab"].items()} | {str(a["id"]): a["content"] for a in spec["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if not tables:
            self.arrays = ArrayBpe(model["vocab"], pairs, self.bytes)
            return
        inner = lambda t: t.removesuffix(SUFFIX) + END if t.endswith(SUFFIX) else t
        self.ids = {inner(t): i for i, t in self.names.items()}
        self.merges = {(inner(a), inner(b)): r for r, (a, b) in enumerate(pairs)}
        tails: dict[str, set[int]] = {}
        for t in self.ids:
            if len(t) > 2:
                tails.setdefault(t[-3:], set()).add(len(t))
        #: The lengths, longest first, that a token may have that ends in these three symbols.
        self.tails = {k: (*sorted(v, reverse=True), 2, 1) for k, v in tails.items()}
        #: The merge that makes a token first: its rank and its two parts.
        self.made: dict[str, tuple[int, tuple[str, str]]] = {}
        for pair, r in self.merges.items():
            self.made.setdefault("".join(pair), (r, pair))

    def merged(self, text: str) -> list[str]:
        """Plain BPE of a short string: merge the pair of lowest rank, leftmost first."""
        parts = list(text)
        if text.endswith(END) and len(text) > 1:
            parts[-2:] = [text[-2:]]
        while len(parts) > 1:
            rank, i = min((self.merges.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, last: str | None, token: str) -> bool:
        known = self.follows.setdefault(last, {})
        if (ok := known.get(token)) is None:
            ok = known[token] = self.merged(token) == [token] if last is None else self.stay_apart(last, token)
            self.states += STATE_BYTES
        return ok

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether BPE keeps these tokens side by side: undo their merges, latest first; no pair that
        meets at the border may merge before its parts are taken up by their own tokens."""
        limit, made, whole = 1 << 60, self.made, (-1, ("", ""))
        while True:
            if self.merges.get((left, right), limit) < limit:
                return False
            (a, of_left), (b, of_right) = made.get(left, whole), made.get(right, whole)
            if a > b:
                limit, left = a, of_left[1]
            elif b >= 0:
                limit, right = b + 1, of_right[0]
            else:
                return True

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, str]]:
        """Distinct words (in the byte alphabet) and their ids as decimals, joined by blanks.

        The sorted words are the trie's leaves in depth-first order: a word keeps the states of the
        prefix that it shares with the one before, and only its own nodes are computed."""
        ids, tails, table = self.ids, self.tails, self.follows
        last: list[str | None] = [None]  # of each prefix on the path; index: its length
        after = [table.setdefault(None, {})]  # what is known of the tokens behind it
        before = ""

        def state(path: str, end: int) -> str:
            for k in tails.get(path[max(end - 3, 0) : end], (2, 1)):
                if k <= end and (token := path[end - k : end]) in ids:
                    if (ok := after[end - k].get(token)) or ok is None and self.may_follow(last[end - k], token):
                        return token
            raise ValueError(f"no encoding of {path!r}")

        for word in sorted(words):
            same, top = 0, min(len(word) - 1, len(last) - 1)
            while same < top and word[same] == before[same]:
                same += 1
            del last[same + 1 :], after[same + 1 :]
            for end in range(same + 1, len(word)):
                for k in tails.get(word[max(end - 3, 0) : end], (2, 1)):  # as in state(), without the call
                    if k <= end and (token := word[end - k : end]) in ids and (ok := after[end - k].get(token)) is not False and (ok or self.may_follow(last[end - k], token)):
                        break
                else:
                    raise ValueError(f"no encoding of {word!r}")
                last.append(token)
                after.append(table.get(token) or table.setdefault(token, {}))
            leaf = word + END
            token = state(leaf, len(leaf))
            out, at = [token], len(leaf) - len(token)
            while at:
                out.append(last[at])
                at -= len(last[at])
            out.reverse()
            yield word, " ".join([ids[t] for t in out])
            before = word

    def pieces(self, text: str) -> list[str]:
        """The words of a text; a special token in it is an item of its own, behind a blank."""
        if self.cut and "<|" in text:
            out, at = [], 0
            for m in self.cut.finditer(text):
                out += [*self.plain(text[at : m.start()]), " " + m[0]]
                at = m.end()
            return out + self.plain(text[at:])
        return self.plain(text)

    def lowered(self, text: str) -> str | None:
        """The normalised text; none if characters are in it whose class depends on the age of Unicode tables."""
        lowered = normalize("NFC", text).replace("Σ", "σ").lower()  # each character by itself: no final sigma
        return None if newer(text) or newer(lowered) else lowered  # older characters may compose a newer one

    def plain(self, text: str) -> list[str]:
        """The words of a text without special tokens.

        Texts with characters whose class depends on the age of Unicode tables are cut by the library."""
        if (lowered := self.lowered(text)) is None:
            back = {c: bytes([i]) for i, c in enumerate(self.bytes)}
            cut = self.library[1](self.library[0](text))
            return [b"".join([back[c] for c in w]).decode("utf-8", "surrogateescape") for w, _ in cut]
        return self.pattern.findall(lowered)

    def forget(self) -> None:
        """Keep the words that have come back; where they fill most of the table, they must come back again to stay."""
        self.words = {w: ids for w, ids in self.words.items() if w not in self.once}
        self.held = sum(map(len, self.words)) + sum(map(len, self.words.values())) + WORD_BYTES * len(self.words)
        self.once = self.words.keys() - self.fixed.keys() if self.held > PROVEN * self.limit else set()

    def learn(self, words: set[str]) -> None:
        """Make the encodings of these words known."""
        self.once -= words
        self.make_room()
        if new := words.difference(self.words):
            self.add(list(new))
            self.once |= new

    def make_room(self) -> None:
        if self.held > self.limit:
            self.forget()
        if self.states > KEPT_STATES:
            self.follows, self.states = {}, 0

    def add(self, new: list[str]) -> None:
        """Encode these distinct words."""
        text = " ".join(new).encode("utf-8", "surrogateescape")
        mapped = self.symbols[np.frombuffer(text, np.uint8)].tobytes().decode("utf-16-le").split(" ")
        back = dict(zip(mapped, new, strict=True))
        for word, ids in self.encode_words(mapped):
            self.words[back[word]] = ids
            self.held += len(ids)
        self.held += len(text) + WORD_BYTES * len(new)

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[str, str, int]]:
        """For each text: its ids as decimals and its decoded tokens, joined by blanks, and the count."""
        names = self.names
        for ids in self.id_strings(texts):
            each = ids.split(" ") if ids else []
            yield ids, " ".join([names[x] for x in each]), len(each)

    def id_strings(self, texts: list[str | None]) -> Iterator[str]:
        """For each text its ids as decimals, joined by blanks."""
        return map(" ".join, self.by_word(texts))

    def by_word(self, texts: list[str | None]) -> Iterator[list]:
        """For each text the encodings of its words."""
        cut: list[list[str]] = []
        size = 0
        for i, text in enumerate(texts):
            cut.append(self.pieces(text) if text else [])
            size += len(cut[-1])
            if size > CUT_WORDS or i == len(texts) - 1:
                self.learn(set().union(*cut))
                known = self.words
                for words in cut:
                    yield [known[w] for w in words]
                size, cut = 0, []

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for x in next(self.encode_batch([text]))[0].split()]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by blanks, as the tokenizer's file names no decoder."""
        return " ".join(self.names[str(i)] for i in ids)


class PairTable:
    """The ranks of pairs of ids, found for arrays of them with one probe: keys of a bucket are moved together until all have slots of their own."""

    EMPTY, FACTOR, STEP = np.uint64(2**64 - 1), np.uint64(0x9E3779B97F4A7C15), 0xD1342543DE82EF95

    def __init__(self, ranks: dict[tuple[int, int], int]) -> None:
        pairs, values = np.array(list(ranks), np.uint64).reshape(-1, 2), np.array(list(ranks.values()), np.int32)
        bits = max(len(ranks).bit_length(), 2)
        self.bucket_shift, self.shift = np.uint64(65 - bits), np.uint64(63 - bits)
        self.moves, n = np.zeros(1 << bits - 1, np.uint64), 1 << bits + 1
        self.keys, self.values = np.full(n, self.EMPTY), np.full(n, NONE, np.int32)
        keys = pairs[:, 0] << np.uint64(32) | pairs[:, 1]
        mixed = keys * self.FACTOR
        buckets, left, tries = mixed >> self.bucket_shift, np.arange(len(keys)), 0
        while len(left):
            tries += 1
            move = np.uint64(tries * self.STEP % 2**64)
            slots = ((mixed[left] ^ move) * self.FACTOR >> self.shift).astype(np.int64)
            stuck = np.zeros(len(self.moves), bool)
            stuck[buckets[left[(self.keys[slots] != self.EMPTY) | (np.bincount(slots, minlength=n)[slots] > 1)]]] = True
            free = ~stuck[buckets[left]]
            self.moves[buckets[left[free]]] = move
            self.keys[slots[free]], self.values[slots[free]] = keys[left[free]], values[left[free]]
            left = left[~free]

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        mixed = keys * self.FACTOR
        slots = (mixed ^ self.moves[mixed >> self.bucket_shift]) * self.FACTOR >> self.shift
        return np.where(self.keys[slots] == keys, self.values[slots], NONE)


class ArrayBpe:
    """Plain BPE of many words of one length at once: each round merges one pair in each, so that their lengths stay equal."""

    def __init__(self, vocab: dict[str, int], merges: list, alphabet: list[str]) -> None:
        self.first, self.final = (np.array([vocab[c + end] for c in alphabet], np.int32) for end in ("", SUFFIX))
        self.pairs = PairTable({(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)})
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        both = np.broadcast_arrays(self.first[:, None], self.first), np.broadcast_arrays(self.first[:, None], self.final)
        self.inner, self.outer = (self.pairs.of(*x) for x in both)

    def merged(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of words (columns of bytes) and their ids (columns, too), those of fewest merges first."""
        rest, ids = np.arange(words.shape[1]), self.first[words]
        ids[-1] = self.final[words[-1]]
        ranks = self.inner[words[:-1], words[1:]]
        ranks[-1:] = self.outer[words[-2:-1], words[-1:]]
        while len(ids) > 1:
            row = np.arange(len(ranks), dtype=np.int32)[:, None]
            best = (ranks << 5 | row).min(axis=0)  # the lowest rank, leftmost first
            if not (going := best < NONE << 5).all():
                yield rest[~going], ids[:, ~going]
                rest, ids, ranks, best = rest[going], ids[:, going], ranks[:, going], best[going]
            if not len(rest):
                return
            at, new = best & 31, self.made[best >> 5]
            ids = np.where(row <= at, ids[:-1], ids[1:])
            ids[at, np.arange(len(at))] = new
            ranks = np.where(row[:-1] < at, ranks[:-1], ranks[1:])
            a, b = np.flatnonzero(at > 0), np.flatnonzero(at < len(ids) - 1)
            before, behind = at[a] - 1, at[b]
            found = self.pairs.of(np.concatenate((ids[before, a], new[b])), np.concatenate((new[a], ids[behind + 1, b])))
            ranks[before, a], ranks[behind, b] = found[: len(a)], found[len(a) :]
        yield rest, ids


class LibraryBpe(TrieBpe):
    """The same words and ids, as bytes of four an id; new words are merged in arrays, long or few ones by the tokenizers library's model.

    As it keeps no states, words have their room too."""

    def __init__(self, path: str, limit: int = CACHE_BYTES + KEPT_STATES) -> None:
        super().__init__(path, limit, tables=False)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        self.model = Tokenizer(self.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        self.fixed = {w: np.array([int(i)], "<i4").tobytes() for w, i in self.fixed.items()}
        self.words = dict(self.fixed)
        #: Whether a token ends a word.
        self.last = np.array([self.names.get(str(i), "").endswith(SUFFIX) for i in range(1 + max(map(int, self.names)))])

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Distinct words, as they are cut, and their ids in the words' order."""
        for k in range(0, len(words), MANY):
            part = words[k : k + MANY]
            yield from zip(part, self.by_arrays(part) if len(part) >= FEW else self.by_library(part), strict=True)

    def by_library(self, words: list[str]) -> list[bytes]:
        text = np.frombuffer(" ".join(words).encode("utf-8", "surrogateescape"), np.uint8)
        mapped = self.symbols[text].tobytes().decode("utf-16-le")
        ids = np.array(self.model.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, "<i4")
        flat, ends = ids.tobytes(), (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def by_arrays(self, words: list[str]) -> list[bytes]:
        text = np.frombuffer("\n".join([*words, ""]).encode("utf-8", "surrogateescape"), np.uint8)
        ends = np.flatnonzero(text == ord("\n"))
        sizes = np.diff(ends, prepend=-1) - 1
        out = [b""] * len(words)
        for size in np.unique(sizes[sizes <= LONGEST]).tolist():
            which = np.flatnonzero(sizes == size)
            for done, ids in self.arrays.merged(text[ends[which] - size + np.arange(size)[:, None]]):
                flat, step = ids.T.astype("<i4").tobytes(), 4 * len(ids)
                for i, a in zip(which[done].tolist(), range(0, len(flat), step), strict=True):
                    out[i] = flat[a : a + step]
        if len(long := np.flatnonzero(sizes > LONGEST).tolist()):
            for i, ids in zip(long, self.by_library([words[i] for i in long]), strict=True):
                out[i] = ids
        return out

    def add(self, new: list[str]) -> None:
        ids = [x for _, x in self.encode_words(new)]
        self.words.update(zip(new, ids, strict=True))
        self.held += sum(map(len, ids)) + sum(map(len, new)) + WORD_BYTES * len(new)

    def encodings(self, words: list[str]) -> list[bytes]:
        """The encodings of distinct words, each looked up once; they become known."""
        self.once.difference_update(words)
        ids = list(map(self.words.get, words))
        if new := [w for w, x in zip(words, ids, strict=True) if x is None]:
            self.make_room()
            self.add(new)
            self.once.update(new)
            ids = [x or self.words[w] for w, x in zip(words, ids, strict=True)]
        return ids

    def id_arrays(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """For each text its ids.

        Texts are cut and looked up together, each distinct word once.  Those with special tokens or
        newer characters are cut by themselves."""
        plain: list[bytes | None] = []
        for text in texts:
            lowered = None if text and self.cut and "<|" in text and self.cut.search(text) else self.lowered(text or "")
            plain.append(None if lowered is None else lowered.encode())
        alone = self.by_word([t for t, p in zip(texts, plain, strict=True) if p is None])
        together = self.ids_of([p for p in plain if p is not None])
        for p in plain:
            yield np.frombuffer(b"".join(next(alone)), "<i4") if p is None else next(together)

    def ids_of(self, plain: list[bytes]) -> Iterator[np.ndarray]:
        """For each normalised text, in UTF-8 and without newer characters, its ids."""
        text = np.frombuffer(b"\n".join([*plain, b"\n\n"]), np.uint8)
        starts, inside = word_starts(text, self.classes)
        at = np.flatnonzero(starts)
        ends = np.append(np.cumsum(inside, dtype=np.int32)[at] - 1, np.int32(np.count_nonzero(inside)))
        found = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(text[inside])).dictionary_encode()
        words = pc.binary_join(pa.ListArray.from_arrays([0, len(found.dictionary)], found.dictionary), "\n")[0].as_py().split("\n") if len(at) else []
        ids = self.encodings(words)
        own = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)], dtype=np.int32) >> 2), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        every = own.take(found.indices)
        flat, bounds = every.values.to_numpy(), every.offsets.to_numpy()
        behind = bounds[np.searchsorted(at, np.cumsum([0, *(len(p) + 1 for p in plain)]))].tolist()
        for a, b in zip(behind, behind[1:], strict=False):
            yield flat[a:b]

    def id_strings(self, texts: list[str | None]) -> Iterator[str]:
        for ids in self.id_arrays(texts):
            yield " ".join(map(str, ids.tolist()))


_known: dict[tuple[type, str], TrieBpe] = {}


def codec(path: str, kind: type[TrieBpe] = TrieBpe) -> TrieBpe:
    """This process's codec for a vocabulary file; its bounded word table serves all tasks."""
    if (kind, path) not in _known:
        _known[kind, path] = kind(path)
    return _known[kind, path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>, decoded string of every row.  Null is the empty text: no ids, empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            got = list(codec(path).encode_batch(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(map(int, g[0].split())) for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.string())], [id_col, "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every row; the digests are taken where the ids are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            n, a, b = [], [], []
            for ids, text, k in codec(path).encode_batch(batch.column(1).to_pylist()):
                n.append(k)
                a.append(sha256(ids.encode()).hexdigest())
                b.append(sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_documents(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, decoded of every row; null ids give the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec(path).decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], [id_col, "decoded"])

    return rows.select(id_col, F.col(ids_col)).mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, decoded string")
