"""Token counts per section by offset-mapped attribution.

Each document is encoded once, whole. The byte lengths of its tokens add up to their
character spans (a token that holds part of a character spans that character). Sections
are character spans too, and a sorted interval join gives each token the first and the
last section that it touches. A token inside one section counts there; one that crosses
a boundary is allocated by ``rule``:

* ``majority``: to the section that holds most of its characters, the earliest on ties;
* ``first``: to the section in which it starts;
* ``proportional``: to each section the share of its characters that lies there.

Defined results: a null text counts as empty; an empty text has one empty section with no
tokens; repeated rows are counted each; a null id stays null; other columns are ignored;
texts of any length are encoded whole; a token that two sections share equally is the first one's by ``majority``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from colloquy.llm import subwords
from colloquy.llm.common import id_text, map_batches

RULES = ("majority", "first", "proportional")
SCHEMA = "doc_id long, section int, char_start long, char_end long, n_tokens double, n_inside long, n_crossing long, doc_tokens long"


def section_starts(text: str, separator: str) -> np.ndarray:
    """Character offsets at which sections start; a section ends after each separator."""
    starts, at = [0], text.find(separator)
    while at >= 0:
        starts.append(at + len(separator))
        at = text.find(separator, starts[-1])
    if len(starts) > 1 and starts[-1] >= len(text):
        starts.pop()
    return np.array(starts, np.int64)


def token_spans(text: str, raw: bytes, byte_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end character of each token."""
    ends = np.cumsum(byte_lengths)
    starts = ends - byte_lengths
    if len(raw) == len(text):
        return starts, ends
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    char_of_byte = np.cumsum(lead) - 1
    return char_of_byte[starts], char_of_byte[ends - 1] + 1


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens allocated to each section, those inside it, and crossing ones that touch it."""
    n = len(bounds) - 1
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    inside = np.bincount(first[first == last], minlength=n)
    total, crossing = inside.astype(np.float64), np.zeros(n, np.int64)
    for k in np.flatnonzero(first != last):
        touched = np.arange(first[k], last[k] + 1)
        crossing[touched] += 1
        held = np.minimum(ends[k], bounds[touched + 1]) - np.maximum(starts[k], bounds[touched])
        if rule == "majority":
            total[touched[np.argmax(held)]] += 1
        elif rule == "first":
            total[touched[0]] += 1
        else:
            total[touched] += held / held.sum()
    return total, inside, crossing


def token_counts(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    separator: str = "\n",
    rule: str = "majority",
    tokenizer_path: str | None = None,
) -> DataFrame:
    """One row per section of each document, with the tokens allocated to it."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if not separator:
        raise ValueError("separator must not be empty")
    path = tokenizer_path or subwords.default_path()

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, parts = subwords.encoder(path), []
        for text in batch["text"].to_pylist():
            raw = text.encode()
            ids = np.array(bpe.encode(text), np.int64)
            starts, ends = token_spans(text, raw, bpe.byte_len[ids])
            bounds = np.append(section_starts(text, separator), len(text))
            parts.append((bounds, *allocate(starts, ends, bounds, rule), len(ids)))
        sections = [len(p[0]) - 1 for p in parts]
        long = lambda xs: pa.array(np.concatenate(xs).astype(np.int64))
        return pa.RecordBatch.from_arrays(
            [
                batch["doc_id"].take(pa.array(np.repeat(np.arange(len(parts)), sections))),
                pa.array(np.concatenate([np.arange(n) for n in sections]).astype(np.int32)),
                long([p[0][:-1] for p in parts]),
                long([p[0][1:] for p in parts]),
                pa.array(np.concatenate([p[1] for p in parts])),
                long([p[2] for p in parts]),
                long([p[3] for p in parts]),
                long([np.full(n, p[4]) for p, n in zip(parts, sections, strict=True)]),
            ],
            ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_inside", "n_crossing", "doc_tokens"],
        )

    return map_batches(id_text(docs, id_col, text_col), count, SCHEMA, rows=512)
