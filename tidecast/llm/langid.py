"""Language of a text by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The
likelihood of a word is the sum, over all ways to cut it into pieces, of the product
of their probabilities; a forward pass over the word computes it. Pieces never cross
white space, so a text's likelihood is the product over its words, and each distinct
word of a batch is passed over once for all languages.

The probabilities are fitted by expectation-maximisation on word counts of a bounded,
hash-chosen sample of labelled documents (``max_documents``, as many of each language): forward and backward
passes in the tasks give expected piece counts, which Spark sums by language and piece.
Only vocabulary x languages numbers reach the driver.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm import base
from tidecast.llm.columnar import hashes
from tidecast.staging import stage

#: Words up to so many bytes are passed over many at a time. Longer ones are cut where no piece
#: could cross, which changes no sum; what is left without such a place is passed over alone.
LONGEST = 64
#: The fit cuts what is longer than this at any place.
LONGEST_FIT = 4096
WINDOW = 8192
#: Words remembered by a task, and words passed over at a time.
REMEMBERED, AT_ONCE = 400_000, 20_000
MAX_LANGUAGES = 1_000
TABLE = 1 << 20
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a SentencePiece model as bytes, the mark of a word's start as a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            piece = model.id_to_piece(i).replace("▁", " ").lower().encode()
            if len(piece) <= LONGEST:
                out[piece] = None
    return list(out)


def split_words(text: str) -> list[str]:
    return text.lower().split()


@dataclass
class Pieces:
    """Piece lookup by hash for many words at a time. Arc 0 is no piece; 1 to 256 single unknown bytes."""

    pieces: list[bytes]
    keys: np.ndarray = field(init=False)
    tables: list[np.ndarray] = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        joined = np.frombuffer(b"".join(self.pieces), np.uint8)
        ends = np.cumsum([len(p) for p in self.pieces])
        starts = ends - [len(p) for p in self.pieces]
        self.keys = np.concatenate([np.zeros(257, np.uint64), hashes(joined, starts, ends)])
        # tables by different bits of the hash; a piece that finds its place taken goes to the next one
        self.tables = []
        left = np.arange(257, len(self.keys), dtype=np.int32)
        while len(left):
            table = np.zeros(TABLE, np.int32)
            place = self._place(self.keys[left], len(self.tables))
            table[place] = left
            self.tables.append(table)
            left = left[table[place] != left]
        self.longest = int((ends - starts).max())

    @staticmethod
    def _place(h: np.ndarray, k: int) -> np.ndarray:
        return ((h >> np.uint64(44 - 20 * k % 40)) & np.uint64(TABLE - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Arc of the piece with each hash; 0 where there is none."""
        out = np.zeros(len(h), np.int32)
        for k, table in enumerate(self.tables):
            at = table[self._place(h, k)]
            hit = self.keys[at] == h
            out[hit] = at[hit]
        return out

    @property
    def size(self) -> int:
        return len(self.keys)

    def arcs(self, chars: np.ndarray) -> list[np.ndarray]:
        """For words of one length (words x bytes): piece ids by length and start."""
        n, width = chars.shape
        flat = np.ascontiguousarray(chars).ravel()
        row = np.arange(n, dtype=np.int64)[:, None] * width
        out = []
        for k in range(1, min(self.longest, width) + 1):
            starts = (row + np.arange(width - k + 1)).ravel()
            h = hashes(flat, starts, starts + k)
            found = self.find(h).reshape(n, -1)
            if k == 1:  # any byte can be read, if only as an unknown one
                found = np.where(found == 0, flat.reshape(n, width) + 1, found)
            out.append(found)
        return out


def forward(arcs: list[np.ndarray], prob: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Scaled forward sums by end position, and the logarithms of their scales.

    ``prob`` is (arc, column); with a list of columns per word it is already taken.
    """
    n, width = arcs[0].shape
    total = [np.ones((n, prob.shape[1]))]
    scale = [np.zeros((n, prob.shape[1]))]
    for j in range(1, width + 1):
        s = np.zeros_like(total[0])
        for k in range(1, min(j, len(arcs)) + 1):
            arc = arcs[k - 1][:, j - k]
            if k > 1 and not arc.any():
                continue
            s += total[j - k] * np.exp(scale[j - k] - scale[j - 1]) * prob[arc]
        total.append(s)
        shift = np.zeros_like(s)
        if j % 8 == 0:
            shift = np.log(s)
            total[-1] = np.ones_like(s)
        scale.append(scale[-1] + shift)
    return total, np.stack(scale)


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and bytes (words x length) of the words of each length, in bounded batches."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for group in np.split(order, cuts):
        for lo in range(0, len(group), AT_ONCE):
            at = group[lo:lo + AT_ONCE]
            if len(at):
                raw = np.frombuffer(b"".join(words[i] for i in at), np.uint8)
                yield at, raw.reshape(len(at), -1)


def log_likelihoods(words: list[bytes], pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Logarithm of each word's probability in each language, summed over all segmentations."""
    out = np.zeros((len(words), prob.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= LONGEST]
    own, text = [], []
    for i, w in enumerate(words):
        if len(w) > LONGEST:
            for part in cut(w, pieces):
                if len(part) > LONGEST:
                    out[i] += rolled(part, pieces, prob)
                else:
                    own.append(i)
                    text.append(part)
    text, own = [words[i] for i in short] + text, np.array(short + own, np.int64)
    for at, chars in by_length(text):
        total, scale = forward(pieces.arcs(chars), prob)
        np.add.at(out, own[at], np.log(total[-1]) + scale[-1])
    return out


def windows(word: bytes, pieces: Pieces) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Arcs by length of a long word, for some starts at a time; arcs may end beyond those."""
    for lo in range(0, len(word), WINDOW):
        chars = np.frombuffer(word[lo:lo + WINDOW + pieces.longest], np.uint8)
        yield lo, [a[0, :WINDOW] for a in pieces.arcs(chars[None, :])]


def cut(word: bytes, pieces: Pieces) -> list[bytes]:
    """A word, if it is long, cut at places that no piece crosses, into parts of ``LONGEST`` bytes or the
    least possible above. The product of the parts' sums is the word's."""
    if len(word) <= LONGEST:
        return [word]
    edge = np.zeros(len(word) + 1, np.int64)
    for lo, arcs in windows(word, pieces):
        for k, found in enumerate(arcs[1:], 2):
            at = np.flatnonzero(found) + lo
            np.add.at(edge, at + 1, 1)
            np.add.at(edge, at + k, -1)
    free = np.append(np.flatnonzero(np.cumsum(edge[:-1])[1:] == 0) + 1, len(word))
    out, start = [], 0
    while start < len(word):
        i = int(np.searchsorted(free, start + LONGEST, side="right")) - 1
        if i < 0 or free[i] <= start:
            i += 1
        out.append(word[start:int(free[i])])
        start = int(free[i])
    return out


def rolled(word: bytes, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """The same as ``forward`` for one word of any length, with only the last sums in memory."""
    longest = pieces.longest
    total = np.zeros((WINDOW + longest + 1, prob.shape[1]))
    total[longest] = 1  # row longest + j: the sum up to byte j of the window
    log = np.zeros(prob.shape[1])
    pending = [np.zeros((0, 3), np.int64)]
    for lo, arcs in windows(word, pieces):
        for k, found in enumerate(arcs, 1):
            at = np.flatnonzero(found)
            pending.append(np.stack([at + lo + k, at + lo, found[at]], axis=1))
        rows = np.concatenate(pending)
        last = min(lo + WINDOW, len(word))
        now, pending = rows[rows[:, 0] <= last], [rows[rows[:, 0] > last]]
        now = now[np.argsort(now[:, 0], kind="stable")]
        first = np.searchsorted(now[:, 0], np.arange(lo + 1, last + 2))
        for j in range(lo + 1, last + 1):
            mine = now[first[j - lo - 1]:first[j - lo]]
            row = longest + j - lo
            total[row] = (total[longest + mine[:, 1] - lo] * prob[mine[:, 2]]).sum(axis=0)
            if j % 8 == 0:
                log += np.log(total[row])
                total[row - longest:row + 1] /= total[row].copy()
        total[:longest + 1] = total[last - lo:last - lo + longest + 1].copy()
    return np.log(total[longest]) + log


def expected_counts(words: list[bytes], weight: np.ndarray, lang: np.ndarray,
                    pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Expected piece counts (arc, language) of weighted words under the current probabilities."""
    out = np.zeros_like(prob)
    for at, chars in by_length(words):
        arcs = pieces.arcs(chars)
        n, width = chars.shape
        own = lang[at]
        p = [prob[a, own[:, None]] for a in arcs]
        ahead, ahead_log = np.zeros((width + 1, n)), np.zeros((width + 1, n))
        back, back_log = np.zeros((width + 1, n)), np.zeros((width + 1, n))
        ahead[0] = back[width] = 1
        for j in range(1, width + 1):
            i = width - j
            ahead_log[j], back_log[i] = ahead_log[j - 1], back_log[i + 1]
            for k in range(1, min(j, len(arcs)) + 1):
                ahead[j] += ahead[j - k] * p[k - 1][:, j - k] * np.exp(ahead_log[j - k] - ahead_log[j])
                back[i] += back[i + k] * p[k - 1][:, i] * np.exp(back_log[i + k] - back_log[i])
            if j % 8 == 0:  # keep long words within the range of floating point
                for value, log, at_ in ((ahead, ahead_log, j), (back, back_log, i)):
                    log[at_] += np.log(value[at_])
                    value[at_] = 1
        total = np.log(ahead[width]) + ahead_log[width]
        for k, a in enumerate(arcs, 1):
            share = (weight[at] * ahead[:width - k + 1] * back[k:]
                     * np.exp(ahead_log[:width - k + 1] + back_log[k:] - total)).T * p[k - 1]
            seen = a > 0
            np.add.at(out, (a[seen], np.broadcast_to(own[:, None], a.shape)[seen]), share[seen])
    return out


@dataclass
class Model:
    languages: list[str]
    pieces: list[bytes]
    prob: np.ndarray
    prior: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def normalised(counts: np.ndarray, smoothing: float) -> np.ndarray:
    """Probabilities of the arcs; no arc has none, and unknown bytes share one in a million."""
    counts = counts + smoothing
    prob = counts / counts[257:].sum(axis=0)
    prob[1:257] = 1e-6 / 256
    prob[0] = 0
    return prob


def train(docs: DataFrame, pieces: list[bytes], key: str = "doc_id", text: str = "text",
          lang: str = "lang", max_documents: int = 6_000, rounds: int = 2,
          smoothing: float = 0.1) -> Model | None:
    """Piece probabilities by language from labelled rows; rows without text or label are skipped.

    None if nothing is left to learn from.
    """
    base.ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    share = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n"))
             .limit(MAX_LANGUAGES + 1).collect()}
    if not share:
        return None
    if len(share) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; check the label column")
    languages = sorted(share)
    index = {name: i for i, name in enumerate(languages)}

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for t, name in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                seen.setdefault(name, Counter()).update(split_words(t))
            for name, c in seen.items():
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([name] * len(c), pa.string()), "word": pa.array(list(c), pa.string()),
                     "n": pa.array(list(c.values()), pa.int64())})

    taken = base.sampled(rows, max_documents, "lang").select("lang", "text")
    counts = stage(
        taken.mapInArrow(base.tidy(count_words), "lang string, word string, n long")
        .groupBy("lang", "word").agg(F.sum("n").alias("n")), "word_counts")
    table = Pieces(pieces)
    prob = normalised(np.zeros((table.size, len(languages))), 1.0)

    def expect(prob: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, words, weight = [], [], []
                for name, w, n in zip(*(batch[c].to_pylist() for c in ("lang", "word", "n")), strict=True):
                    for part in cut(b" " + w.encode(), table):
                        for lo in range(0, len(part), LONGEST_FIT):
                            own.append(index[name])
                            words.append(part[lo:lo + LONGEST_FIT])
                            weight.append(n)
                got = expected_counts(words, np.array(weight, float), np.array(own, np.int64), table, prob)
                arc, col = np.nonzero(got)
                yield pa.RecordBatch.from_pydict({"arc": arc.astype(np.int32), "col": col.astype(np.int32),
                                                  "n": got[arc, col]})
        return run

    for _ in range(rounds):
        got = (counts.mapInArrow(base.tidy(expect(prob)), "arc int, col int, n double")
               .groupBy("arc", "col").agg(F.sum("n").alias("n")).toArrow())
        total = np.zeros_like(prob)
        total[got["arc"].to_numpy(), got["col"].to_numpy()] = got["n"].to_numpy()
        prob = normalised(total, smoothing)
    prior = np.log(np.array([share[x] for x in languages], float) / sum(share.values()))
    return Model(languages, pieces, prob, prior)


class Scorer:
    """Log-likelihoods of texts, with a bounded memory of words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.pieces = Pieces(model.pieces)
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages)))

    def learn(self, words: list[str]) -> None:
        total = log_likelihoods([b" " + w.encode() for w in words], self.pieces, self.model.prob)
        self.row.update(zip(words, range(len(self.table), len(self.table) + len(words)), strict=True))
        self.table = np.concatenate([self.table, total])

    def __call__(self, texts: list[str]) -> np.ndarray:
        split = [split_words(t) for t in texts]
        new = set().union(*split) if split else set()
        if len(self.row) + len(new) > REMEMBERED:
            self.forget()
        self.learn([w for w in new if w not in self.row])
        out = np.zeros((len(texts), self.table.shape[1]))
        get = self.row.__getitem__
        for i, ws in enumerate(split):
            if ws:
                out[i] = self.table[np.fromiter(map(get, ws), np.int64, len(ws))].sum(axis=0)
        return out


#: The scorer of the last model used in this process: tasks that follow know its words.
_scorers: dict[str, Scorer] = {}


def scorer_of(model: Model) -> Scorer:
    if model.name not in _scorers:
        _scorers.clear()
        _scorers[model.name] = Scorer(model)
    return _scorers[model.name]


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``: most probable language of each text and its posterior probability.

    A null text, a text without a letter and any text under a model of nothing get
    ``und`` with score 0. Repeated rows get a row each; a null key stays null.
    """
    base.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(model) if model else None
        for batch in batches:
            n = batch.num_rows
            pred, score = [UNKNOWN] * n, np.zeros(n)
            column = batch["text"]
            for lo in range(0, n if scorer else 0, 500):
                some = column.slice(lo, 500).to_pylist()
                known = [i for i, t in enumerate(some) if t is not None and LETTER.search(t)]
                if not known:
                    continue
                post = scorer([some[i] for i in known]) + model.prior
                post = np.exp(post - post.max(axis=1, keepdims=True))
                post /= post.sum(axis=1, keepdims=True)
                best = post.argmax(axis=1)
                for i, b, p in zip(known, best, post[np.arange(len(known)), best], strict=True):
                    pred[lo + i] = model.languages[b]
                    score[lo + i] = p
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "lang_pred": pa.array(pred, pa.string()), "score": score})

    return base.documents(docs, key, text).mapInArrow(base.tidy(run), "doc_id long, lang_pred string, score double")
