"""Token counts of sections by offset-mapped attribution.

The ids of a whole document are made once, from pieces that its tokenizer never joins (``pieces``), and give its tokens'
character spans. These are joined with its sections' spans, both being sorted, and a token that crosses a border is allocated by
a rule:

``first``    to the section that holds its first character,
``largest``  to the section that holds most of its characters, the earlier one at a tie,
``shared``   to each section by the part of its characters there.

Characters outside all sections form section -1. Under each rule a document's counts sum to its tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulo.llm.common import in_arrow, slices
from granulo.llm.pieces import span_encoder

SCHEMA = "doc_id long, section int, start_char long, end_char long, tokens_first long, tokens_largest long, tokens_shared double, doc_tokens long"
_LINE = re.compile(r"[^\n]*\n|[^\n]+")


def lines(text: str) -> list[tuple[int, int]]:
    """The spans of a text's lines, each with the newline that ends it; of an empty text, one empty span."""
    return [m.span() for m in _LINE.finditer(text)] or [(0, 0)]


def attribute(begin: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens ``[begin, end)`` counted under the three rules over the intervals between consecutive ``bounds``."""
    n = len(bounds) - 1
    first = np.searchsorted(bounds, begin, "right") - 1
    last = np.searchsorted(bounds, np.maximum(end - 1, begin), "right") - 1
    whole = first == last
    at_first = np.bincount(first, minlength=n)
    shared = np.bincount(first[whole], minlength=n).astype(float)
    largest = np.bincount(first[whole], minlength=n)
    for t in np.flatnonzero(~whole).tolist():
        over = np.arange(first[t], last[t] + 1)
        part = np.minimum(bounds[over + 1], end[t]) - np.maximum(bounds[over], begin[t])
        shared[over] += part / (end[t] - begin[t])
        largest[over[np.argmax(part)]] += 1
    return at_first, largest, shared


def count_tokens(docs: DataFrame, tokenizer: str, sections: Callable[[str], list[tuple[int, int]]] = lines, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and section (columns as SCHEMA); section -1 only where characters lie outside all sections.

    ``sections`` gives disjoint spans in order. No shuffle; a task holds a few megabytes of text at a time. A null text is
    empty, and an empty text has the one empty section that ``lines`` gives it, with no tokens. Repeated rows are counted
    again each; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = span_encoder(tokenizer)
        for batch in batches:
            for part in slices(batch):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False) if not part.column("doc_id").null_count else np.array(part.column("doc_id").to_pylist(), object)
                texts = [t or "" for t in part.column("text").to_pylist()]
                counts, begin, end = encoder(texts)
                edge, label, owner, base = [], [], [], 0
                token_base = []
                for i, t in enumerate(texts):
                    token_base.append(base)
                    at = 0
                    for k, (a, b) in enumerate(sections(t)):
                        if a > at:
                            edge.append(base + at), label.append(-1), owner.append(i)
                        edge.append(base + a), label.append(k), owner.append(i)
                        at = b
                    if at < len(t):
                        edge.append(base + at), label.append(-1), owner.append(i)
                    base += len(t) + 1  # no token reaches the next text
                shift = np.repeat(np.array(token_base, np.int64), counts)
                bounds = np.array([*edge, base], np.int64)
                first, largest, shared = attribute(begin + shift, end + shift, bounds)
                owner, label = np.array(owner), np.array(label, np.int32)
                start = bounds[:-1] - np.array(token_base, np.int64)[owner]
                length = np.array([len(t) for t in texts], np.int64)[owner]
                stop = np.minimum(bounds[1:] - np.array(token_base, np.int64)[owner], length)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids[owner], pa.int64()), "section": pa.array(label, pa.int32()), "start_char": start, "end_char": stop,
                    "tokens_first": first.astype(np.int64), "tokens_largest": largest.astype(np.int64), "tokens_shared": shared, "doc_tokens": counts[owner],
                })

    return in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, SCHEMA)
