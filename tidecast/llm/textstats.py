"""Statistics of whole texts, counted over Arrow buffers: used by the rules and the classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidecast.llm import base
from tidecast.llm.columnar import (
    combine, hashes, lines, owner, parts, per_document, starts_of_runs, words,
)

NAMES = ("n_bytes n_chars n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words "
         "n_upper n_digits n_punct n_distinct n_top_word n_ends").split()
SCHEMA = "doc_id long, " + ", ".join(f"{n} long" for n in NAMES)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOL = _class(b"#*$%&|<>")
UPPER = _class(bytes(range(65, 91)))
DIGIT = _class(b"0123456789")
PUNCT = _class(bytes(c for c in range(33, 127) if not chr(c).isalnum())) & ~SYMBOL
END = _class(b".!?")
#: Bytes of text that are counted at once; a count takes up to ten numbers of 8 bytes for each.
SLICE = 1 << 19
FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80


def _sizes_of_equal(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts the keys, start of each run of equal ones, and its length."""
    order = np.argsort(keys, kind="stable")
    first = starts_of_runs(keys[order])
    return order, first, np.diff(np.append(first, len(keys)))


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """One number per name and document."""
    n = len(offsets) - 1
    out = {"n_bytes": np.diff(offsets)}
    code_point = FIRST_BYTE[data]
    out["n_chars"] = per_document(code_point, offsets)
    for name, kind in (("n_symbols", SYMBOL), ("n_upper", UPPER), ("n_digits", DIGIT), ("n_punct", PUNCT)):
        out[name] = per_document(kind[data], offsets)

    start, end, doc = words(data, offsets)
    out["n_words"] = np.bincount(doc, minlength=n)
    total = np.zeros(len(data) + 1, np.int32)
    np.cumsum(code_point, out=total[1:])
    out["word_chars"] = np.bincount(doc, total[end] - total[start], n).astype(np.int64)
    out["n_ends"] = np.bincount(doc[END[data[end - 1]]], minlength=n)

    h = hashes(data, start, end)
    order, first, size = _sizes_of_equal(combine(h, doc))
    of = doc[order[first]]
    out["n_distinct"] = np.bincount(of, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, of, size)
    out["n_top_word"] = top

    # words in 3-word windows that the text holds twice or more
    window = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, np.int64)
    order, first, size = _sizes_of_equal(combine(h[window], h[window + 1], h[window + 2], doc[window]))
    again = window[order[np.repeat(size > 1, size)]]
    covered = np.zeros(len(doc), bool)
    for k in range(3):
        covered[again + k] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)

    # lines with a word, and those of them that stood before
    lstart, lend, ldoc = lines(data, offsets)
    if len(lstart):
        has = np.bincount(owner(lstart, start), minlength=len(lstart)) > 0
        lstart, lend, ldoc = lstart[has], lend[has], ldoc[has]
    out["n_lines"] = np.bincount(ldoc, minlength=n)
    order, first, size = _sizes_of_equal(combine(hashes(data, lstart, lend), ldoc))
    out["n_dup_lines"] = np.bincount(ldoc[order[first]], size - 1, n).astype(np.int64)
    return out


def text_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and a count per name of NAMES for every whole text; a null text counts as empty."""
    base.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offsets in parts(batch["text"], SLICE):
                got = statistics(data, offsets)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch["doc_id"].slice(lo, len(offsets) - 1)}
                    | {name: got[name].astype(np.int64) for name in NAMES})

    return base.documents(docs, key, text).mapInArrow(base.tidy(run), SCHEMA)


def ratios(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Size-free features (documents x features) of the counts; texts without words get zeros."""
    x = {name: batch[name].to_numpy(zero_copy_only=False).astype(float) for name in NAMES}
    w, c, ln = (np.maximum(x[k], 1) for k in ("n_words", "n_chars", "n_lines"))
    return np.column_stack([
        np.log1p(x["n_words"]), x["word_chars"] / w, np.minimum(x["n_symbols"] / w, 10),
        x["n_dup_lines"] / ln, x["n_repeat_words"] / w, x["n_upper"] / c, x["n_digits"] / c,
        x["n_punct"] / c, np.log1p(w / ln), x["n_ends"] / w,
        np.log1p(x["n_distinct"]) / np.log1p(w), x["n_top_word"] / w,
    ])


FEATURES = ("log_words word_length symbols dup_lines repeat_words upper digits punct line_words "
            "sentence_ends distinct top_word").split()
