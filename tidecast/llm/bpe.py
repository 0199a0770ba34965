"""Byte-pair encoding by a deterministic automaton over tokens.

The automaton starts with one state per byte and an arc from each state for each byte.
Compiling the merges in order, the gadget for (a, b) -> ab takes the arc b out of state
a, adds a state ab whose arcs are those of b at that moment, and gives every state that
then has an arc a one for ab too. The accepted label sequences are exactly the
segmentations that the merges produce, and a byte string has one of them.

The full table has a cell for each pair of tokens (2.5 thousand million for 50,000 merges),
so its cells are computed on demand: whether an arc ever was in a state follows from the one
arc that it was copied from, back to the bytes. Cells that were asked for stay in a table.

A word is read from left to right. ``last[i]`` is the label of the arc that ends at byte i
of the one accepted path; the next ones follow by table look-ups alone, and walking back
gives the labels. Words are read in order, so that common beginnings are read once. Decoding emits the byte strings of the labels.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tidecast.llm import base
from tidecast.llm.columnar import slices, texts

#: The public pattern that cuts text into words before any merge, with
#: white space spelled as the Unicode property.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: The pattern for ASCII text alone, in the terms of Python's own library, which is faster there.
ASCII_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
#: Code points that the installed regex library takes for letters and numbers,
#: and the tokenizers library, with older or other tables, does not (or the other way round).
OTHER_LETTERS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D "
    "107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 "
    "16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 "
    "191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF "
    "1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F "
    "2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
)
OTHER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
FIRST_OTHER = chr(int(OTHER_LETTERS.split()[0], 16)).encode()[0]
NEVER, FOREVER = -1, 1 << 60
#: Bytes of words and their ids that a task remembers.
REMEMBERED = 8 << 20
#: Text that is cut into words at once.
SLICE = 1 << 20
#: Arcs and computed transitions that a process keeps when a task ends; it finds them again when asked.
KEPT_ARCS = 250_000


def _class(ranges: str) -> str:
    ends = [[chr(int(x, 16)) for x in r.split("-")] for r in ranges.split()]
    return "[" + "".join("-".join(map(regex.escape, r)) for r in ends) + "]"


def strict_pattern() -> str:
    """The pattern with letters and numbers as the tokenizers library has them."""
    letters, numbers = rf"[\p{{L}}--{_class(OTHER_LETTERS)}]", rf"[\p{{N}}--{_class(OTHER_NUMBERS)}]"
    return "(?V1)" + PATTERN.replace(r"\p{L}", letters).replace(r"\p{N}", numbers)


def byte_alphabet() -> dict[str, int]:
    """Printable characters that stand for bytes in byte-level vocabularies.

    Bytes that print as they are stand for themselves; the others, in order, are the
    characters from 256 on.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Merges:
    """What is sent to the tasks: label of each id, merges as triples of ids (or rows of an array), added tokens."""

    labels: tuple[bytes, ...]
    merges: tuple[tuple[int, int, int], ...] | np.ndarray
    added: tuple[tuple[bytes, int], ...]
    digest: str


def load(path: str) -> Merges:
    """A byte-level ``tokenizer.json``."""
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    spec = json.loads(raw)
    alphabet = byte_alphabet()
    vocab: dict[str, int] = spec["model"]["vocab"]
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    labels = [b""] * (max(chain(vocab.values(), added.values())) + 1)
    for token, i in vocab.items():
        labels[i] = bytes(alphabet[c] for c in token)
    for token, i in added.items():
        labels[i] = token.encode()
    merges = []
    for pair in spec["model"]["merges"]:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges.append((vocab[a], vocab[b], vocab[a + b]))
    return Merges(tuple(labels), np.array(merges, np.int32).reshape(-1, 3), tuple((t.encode(), i) for t, i in added.items()),
                  hashlib.sha256(raw.encode()).hexdigest())


class Automaton:
    """States are tokens; ``arc(s, t)`` says whether label t may follow state s."""

    def __init__(self, spec: Merges) -> None:
        n = len(spec.labels)
        self.size = [len(x) for x in spec.labels]
        self.made = array("i", [NEVER]) * n  # the gadget that made a state; bytes are there from the start
        self.left, self.right = array("i", bytes(4 * n)), array("i", bytes(4 * n))  # the parts of a state
        self.merge: dict[int, int] = {}
        for k, (a, b, ab) in enumerate(np.asarray(spec.merges, np.int32).reshape(-1, 3)):
            a, b, ab = int(a), int(b), int(ab)
            self.made[ab], self.left[ab], self.right[ab] = k, a, b
            self.merge[a << 32 | b] = k
        self.first = n  # the state before any label
        self.table: dict[int, bool] = {}
        added = {i for _, i in spec.added}
        self._read({label: i for i, label in enumerate(spec.labels) if label and i not in added})

    def _read(self, ids: dict[bytes, int]) -> None:
        """Transitions over bytes: the labels that end at a byte, longest first, without searching.

        ``step`` leads from the longest label beginning that the text ends with to the next one,
        ``ending`` gives the longest whole label among its ends, ``shorter`` the next one.
        """
        self.step: dict[int, int] = {}
        depth, token = array("i", [0]), [-1]
        for label in sorted(ids):
            state = 0
            for k, c in enumerate(label):
                cell = state << 8 | c
                if cell not in self.step:
                    self.step[cell] = len(depth)
                    depth.append(k + 1)
                    token.append(-1)
                state = self.step[cell]
            token[state] = ids[label]
        self.cells = len(self.step)  # those of the labels; computed ones come after them
        self.back = array("i", bytes(4 * len(depth)))
        self.ending = token[:]
        self.shorter = [-1] * len(self.size)
        for cell in sorted(self.step, key=lambda x: depth[self.step[x]]):
            state, parent, c = self.step[cell], cell >> 8, cell & 255
            if parent:
                self.back[state] = self.onward(self.back[parent], c)
            end = self.ending[self.back[state]]
            if token[state] < 0:
                self.ending[state] = end
            else:
                self.shorter[token[state]] = end

    def onward(self, state: int, c: int) -> int:
        """The transition by byte c; computed once."""
        cell = state << 8 | c
        found = self.step.get(cell)
        if found is None:
            found = self.onward(self.back[state], c) if state else 0
            if state:
                self.step[cell] = found
        return found

    def there(self, s: int, t: int) -> bool:
        """Whether state s ever had an arc t: the arc that it was copied from was there and not yet removed."""
        made, left, right, removed = self.made, self.left, self.right, self.merge.get
        while True:
            born_s, born_t = made[s], made[t]
            if born_s == born_t == NEVER:
                return True
            if born_s >= born_t:  # state s took the arcs of its second part just before its gadget
                s, t, until = right[s], left[t] if born_s == born_t else t, born_s
            else:  # label t came to the states that kept its first part through its gadget
                t, until = left[t], born_t + 1
            if removed(s << 32 | t, FOREVER) < until:
                return False

    def whole(self, t: int) -> bool:
        """Whether the merges make token t of its own bytes: its gadget must find the arc it takes."""
        if self.made[t] == NEVER:
            return True
        a, b = self.left[t], self.right[t]
        return (self.arc(self.first, a) and self.arc(self.first, b)
                and self.merge[a << 32 | b] == self.made[t] and self.there(a, b))

    def arc(self, s: int, t: int) -> bool:
        cell = s << 32 | t
        found = self.table.get(cell)
        if found is None:
            found = self.whole(t) if s == self.first else (
                cell not in self.merge and self.there(s, t) and self.arc(self.first, t))
            self.table[cell] = found
        return found

    def shrink(self, most: int) -> None:
        """Without arcs and transitions that were computed on demand if they are more than ``most``."""
        if len(self.table) > most:
            self.table.clear()
        if len(self.step) - self.cells > most:
            while len(self.step) > self.cells:
                self.step.popitem()  # the last one that came
            self.step = dict(self.step)

    def encode(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of each word. Words should be sorted: what begins like the one before is not read again."""
        step, ending, shorter, table = self.step, self.ending, self.shorter, self.table
        size, onward, arc = self.size, self.onward, self.arc
        next_state, known_arc = step.get, table.get
        states, last, before = [0], [self.first], b""
        for word in words:
            n = 0
            for x, y in zip(before, word):  # noqa: B905
                if x != y:
                    break
                n += 1
            del states[n + 1:], last[n + 1:]
            state, end = states[n], n
            for c in word[n:]:
                end += 1
                found = next_state(state << 8 | c)
                state = onward(state, c) if found is None else found
                states.append(state)
                t = ending[state]
                while t >= 0:
                    s = last[end - size[t]]
                    ok = known_arc(s << 32 | t)
                    if ok or ok is None and arc(s, t):
                        break
                    t = shorter[t]
                last.append(t)
            before = word
            out, end = [], len(word)
            while end:
                t = last[end]
                out.append(t)
                end -= size[t]
            out.reverse()
            yield out


class Words(dict[str, bytes]):
    """Ids of words, with the bytes that they take."""

    n_bytes = 0

    def put(self, words: list[str], ids: list[bytes]) -> None:
        self.update(zip(words, ids, strict=True))
        self.n_bytes += WORD_BYTES * len(words) + sum(map(len, words)) + sum(map(len, ids))

    def forget(self) -> None:
        self.clear()
        self.n_bytes = 0


#: What Python adds to the text and the ids of a remembered word.
WORD_BYTES = 200
#: Automata and remembered words of this process, by digest of the merges.
_compiled: dict[str, tuple[Automaton, Words]] = {}


class Encoder:
    """Texts to packed ids, with a bounded memory of words."""

    def __init__(self, spec: Merges) -> None:
        if spec.digest not in _compiled:
            _compiled[spec.digest] = Automaton(spec), Words()
        self.automaton, self.known = _compiled[spec.digest]
        self.ascii = re.compile(ASCII_PATTERN, re.ASCII).findall
        self.plain = regex.compile(PATTERN).findall
        self.strict = regex.compile(strict_pattern()).findall
        self.other = regex.compile(_class(OTHER_LETTERS + OTHER_NUMBERS)).search
        self.labels = pa.array(spec.labels, pa.large_binary())
        self.added = {label.decode(): struct.pack("<I", i) for label, i in spec.added if label}
        names = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def split(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii(text)
        # the listed code points begin with a byte from FIRST_OTHER on
        if np.frombuffer(text.encode(), np.uint8).max() < FIRST_OTHER or not self.other(text):
            return self.plain(text)
        return self.strict(text)

    def pieces(self, text: str) -> list[str]:
        """Words and added tokens of a text."""
        if self.special is None or not any(t in text for t in self.added):
            return self.split(text)
        return list(chain.from_iterable(
            (p,) if p in self.added else self.split(p) for p in self.special.split(text)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers; added tokens in it are single ids."""
        pieces = [self.pieces(t) for t in texts]
        found = pa.array(list(chain.from_iterable(pieces)), pa.large_string()).dictionary_encode()
        words = found.dictionary.to_pylist()
        if self.known.n_bytes > REMEMBERED:
            self.known.forget()
        self.known.update(self.added)
        new = sorted(set(words).difference(self.known))  # code points sort as their UTF-8 does
        ids = list(self.automaton.encode(map(str.encode, new)))
        flat = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        ends = (4 * np.cumsum([0, *map(len, ids)])).tolist()
        self.known.put(new, [flat[a:b] for a, b in pairwise(ends)])
        taken = pa.array(list(map(self.known.__getitem__, words)), pa.large_binary()).take(found.indices)
        return [x.tobytes() for x in _joined(taken, [len(p) for p in pieces])]

    def shrink(self) -> None:
        """At the end of a task: its process keeps the automaton with a bounded number of arcs, and no words."""
        self.known.forget()
        self.automaton.shrink(KEPT_ARCS)

    def decode(self, packed: bytes) -> str:
        return self.decoded([packed])[0]

    def decoded(self, packed: list[bytes]) -> list[str]:
        """The text of each document's ids."""
        ids = pa.array(np.frombuffer(b"".join(packed), "<u4"))
        return [str(x, "utf-8", "replace") for x in _joined(self.labels.take(ids), [len(p) // 4 for p in packed])]


def _joined(parts: pa.LargeBinaryArray, sizes: list[int]) -> list[memoryview]:
    """Bytes of each run of so many parts."""
    _, ends, data = parts.buffers()
    if data is None or not len(parts):
        return [memoryview(b"")] * len(sizes)
    edges = np.frombuffer(ends, np.int64)[np.cumsum([0, *sizes])].tolist()
    whole = memoryview(data)
    return [whole[a:b] for a, b in pairwise(edges)]


def encode(docs: DataFrame, spec: Merges, key: str = "doc_id", text: str = "text",
           decoded: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids`` (packed little-endian 32-bit numbers) of every whole text.

    ``decoded`` adds the text that the ids give back. A null text counts as empty: no ids.
    """
    base.ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids binary" + (", decoded string" if decoded else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(spec)
        for batch in batches:
            for lo, hi in slices(texts(batch["text"])[1], SLICE):
                ids = encoder([t or "" for t in batch["text"].slice(lo, hi - lo).to_pylist()])
                out = {"doc_id": batch["doc_id"].slice(lo, hi - lo),
                       "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                       "ids": pa.array(ids, pa.binary())}
                if decoded:
                    out["decoded"] = pa.array(encoder.decoded(ids), pa.string())
                yield pa.RecordBatch.from_pydict(out)
        encoder.shrink()

    return base.documents(docs, key, text).mapInArrow(base.tidy(run), schema)


def decode(tokens: DataFrame, spec: Merges, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, text`` of packed ids; null ids give null."""
    base.ship(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(spec)
        for batch in batches:
            ids = batch["ids"]
            out = pa.array(encoder.decoded([x or b"" for x in ids.to_pylist()]), pa.string())
            out = pc.if_else(ids.is_valid(), out, None)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "text": out})

    return (tokens.selectExpr(f"CAST(`{key}` AS long) AS doc_id", f"`{ids}` AS ids")
            .mapInArrow(base.tidy(run), "doc_id long, text string"))
