"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once. Each token's character span is found from the
bytes of the tokens before it, and the spans are joined to the document's
sections as intervals. A token that crosses a boundary goes to the section of
its first character (rule ``first``) or to the one that holds most of its
bytes, the earlier of equals (rule ``most``).
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellar.llm.kernels import chunks, text_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "most")
# Fixed value: the characters that Unicode calls white space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: longer runs of white space are encoded on their own: the pattern's look-ahead gives up on very long ones
LONG_RUN = 1000


def load_ranks(path: str = VOCABULARY) -> bytes:
    """The vocabulary file as it is; read on the driver and broadcast (some hundred kB)."""
    with open(path, "rb") as f:
        return f.read()


class _Encoder:
    """An encoding whose pattern may meet runs of white space of any length."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.enc = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.runs = tiktoken.Encoding("runs", pat_str=rf"[{SPACE}]+", mergeable_ranks=ranks, special_tokens={})
        # how a run is parted is known of the default pattern only; with another the text is encoded as it is
        self.long_run = re.compile(f"[{SPACE}]{{{LONG_RUN},}}") if pattern == PATTERN else None

    def encode_to_numpy(self, text: str) -> np.ndarray:
        """The pattern takes a run of white space but its last character as one piece, at the text's end the whole run."""
        ids, at = [], 0
        for m in self.long_run.finditer(text) if self.long_run else ():
            end = m.end() - (m.end() < len(text))
            ids += [self.enc.encode_to_numpy(text[at : m.start()]), self.runs.encode_to_numpy(text[m.start() : end])]
            at = end
        return np.concatenate([*ids, self.enc.encode_to_numpy(text[at:])]) if ids else self.enc.encode_to_numpy(text)

    def encode_ordinary(self, text: str) -> list[int]:
        return self.encode_to_numpy(text).tolist()


def _encoder(raw: bytes, pattern: str) -> tuple[_Encoder, np.ndarray]:
    """The encoding, and the size of each token in bytes."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for tok, i in ranks.items():
        size[i] = len(tok)
    return _Encoder(ranks, pattern), size


def _attribute(tok_end: np.ndarray, sec_end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and tokens that cross its end, of one document.

    Both arguments are ascending end offsets in bytes that cover the same text.
    """
    start = np.append(0, tok_end[:-1])
    first = np.searchsorted(sec_end, start, "right")
    last = np.searchsorted(sec_end, tok_end - 1, "right")
    crossing = np.bincount(first[last > first], minlength=len(sec_end))
    owner = first
    if rule == "most":
        for i in np.flatnonzero(last > first):
            cut = np.concatenate(([start[i]], sec_end[first[i] : last[i]], [tok_end[i]]))
            owner[i] = first[i] + int(np.argmax(np.diff(cut)))
    return np.bincount(owner, minlength=len(sec_end)), crossing


def _lines(raw: np.ndarray) -> np.ndarray:
    """Ends of the lines of a text: a line owns its line break; the rest after the last break is a line."""
    ends = np.flatnonzero(raw == 0x0A) + 1
    if not len(ends) or ends[-1] < len(raw):
        ends = np.append(ends, len(raw))
    return ends


def _count_task(raw_ranks, pattern: str, rule: str):
    def task(batches):
        enc, size = _encoder(raw_ranks.value, pattern)
        for batch in batches:
            for c in chunks(batch):
                col = c.column(c.schema.get_field_index("text"))
                data, off = text_bytes(col)
                row, no, chars, toks, cross = [], [], [], [], []
                for r, text in enumerate(col.to_pylist()):
                    if not text:
                        continue
                    ids = enc.encode_to_numpy(text)
                    own = data[off[r] : off[r + 1]]
                    ends = _lines(own)
                    t, x = _attribute(np.cumsum(size[ids]), ends, rule)
                    lead = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))[ends]
                    row.append(np.full(len(ends), r))
                    no.append(np.arange(len(ends)))
                    chars.append(np.diff(lead, prepend=0))
                    toks.append(t)
                    cross.append(x)
                if not row:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [c.column(c.schema.get_field_index("doc_id")).take(pa.array(np.concatenate(row))), *(pa.array(np.concatenate(x)) for x in (no, chars, toks, cross))],
                    names=["doc_id", "section", "n_chars", "n_tokens", "n_crossing"],
                )

    return task


def section_tokens(docs: DataFrame, id_col="doc_id", text_col="text", rule: str = "first", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row per line of each document: doc_id, section (from 0), n_chars, n_tokens, n_crossing.

    n_tokens sums to the tokens of the whole text, encoded once; n_crossing
    counts the tokens that begin in the section and end in a later one. A line
    break belongs to the line it ends. A null or empty text has no sections;
    repeated rows have their sections repeated. Runs of white space of any
    length have the tokens that the pattern gives them.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    raw = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = dict(d.dtypes)["doc_id"]
    return d.mapInArrow(_count_task(raw, pattern, rule), f"doc_id {id_type}, section long, n_chars long, n_tokens long, n_crossing long")


def _field_task(raw_ranks, pattern: str, rule: str, fields: list[str]):
    def task(batches):
        enc, size = _encoder(raw_ranks.value, pattern)
        for batch in batches:
            rows = []
            for rec in batch.to_pylist():
                parts = [(f, rec[f].encode()) for f in fields if rec[f]]
                if not parts:
                    continue
                ends = np.cumsum([len(p) for _, p in parts])
                ids = enc.encode_to_numpy(b"".join(p for _, p in parts).decode())
                t, x = _attribute(np.cumsum(size[ids]), ends, rule)
                rows += [(rec["id"], f, int(a), int(b)) for (f, _), a, b in zip(parts, t, x)]
            if rows:
                yield pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(("id", "field", "n_tokens", "n_crossing"))})

    return task


def field_tokens(rows: DataFrame, id_col: str, fields: list[str], rule: str = "first", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Tokens of each non-empty text field when the fields of a row are encoded as one text: id, field, n_tokens, n_crossing."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    raw = rows.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    d = rows.select(F.col(id_col).cast("string").alias("id"), *[F.col(f).cast("string").alias(f) for f in fields])
    return d.mapInArrow(_field_task(raw, pattern, rule, fields), "id string, field string, n_tokens long, n_crossing long")
