"""Token counts by offset-mapped attribution: whole documents are encoded once, tokens fall to sections.

A byte-level vocabulary loses no byte, so the running sum of its tokens' lengths
gives every token's span in the document. Sections are the lines of the text, or the
fields that make up the document, in order. Token spans and section spans are joined as
intervals, both in order, inside one document. A token that crosses a boundary
goes by an explicit rule:

- ``first``: to the section of its first character,
- ``last``: to the section of its last character,
- ``most``: to the section with most of its characters, the earlier one if tied.

A token that holds only some bytes of a character counts as holding it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffer, text_or_empty, worker_cache
from .fertility import PATTERN, TOKENIZERS, whole_pieces

VOCABULARY = "byte_bpe_50k.tiktoken"
RULES = ("first", "last", "most")
RULE = "most"


def load(folder: str):
    """The encoder and the byte length of each of its tokens."""
    cache = worker_cache()
    if ("attribution", folder) not in cache:
        import base64

        import tiktoken

        with open(f"{folder}/{VOCABULARY}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            sizes[i] = len(token)
        cache["attribution", folder] = tiktoken.Encoding("spans", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return cache["attribution", folder]


def line_starts(raw: np.ndarray) -> np.ndarray:
    """Starts of the lines of a text; a line keeps the break that ends it, and a break at the end opens no further line."""
    at = np.flatnonzero(raw == 10) + 1
    return np.r_[0, at[at < len(raw)]] if len(raw) else np.zeros(0, np.int64)


def attribute(raw: np.ndarray, ends: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a boundary. ``ends``: tokens' ends in bytes; ``starts``: sections'."""
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    begins = np.r_[0, ends[:-1]]
    first = lead[begins + 1] - 1  # the character that holds the first byte
    last = lead[ends] - 1
    opens = lead[starts]
    own = np.searchsorted(opens, first, "right") - 1
    end = np.searchsorted(opens, last, "right") - 1
    crossing = end > own
    to = own.copy()
    if rule == "last":
        to = end
    elif rule == "most" and crossing.any():
        closes = np.r_[opens[1:], lead[-1]]
        for i in np.flatnonzero(crossing).tolist():
            over = range(own[i], end[i] + 1)
            share = [min(last[i] + 1, closes[s]) - max(first[i], opens[s]) for s in over]
            to[i] = own[i] + share.index(max(share))
    elif rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    return np.bincount(to, minlength=len(starts)), np.bincount(to[crossing], minlength=len(starts))


def token_counts(docs: DataFrame, folder: str = TOKENIZERS, rule: str = RULE, id_col: str = "doc_id", text_col: str = "text", fields: tuple[str, ...] = ()) -> DataFrame:
    """(id, section, start, end, n_tokens, n_crossing) for every line of every row; start and end in characters.

    With ``fields`` (columns), the document is their texts one after another and sections
    are the fields, numbered from 0; a null field is empty and gets no token.

    An empty or null text has one section 0 of no characters and no tokens. The
    counts of a document sum to the tokens of its whole text. Rows repeated under
    one id each give their own rows; other columns are not read. Very long texts are
    encoded whole, but for runs of ``RUN`` characters that are all white space or
    none. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    parts = [text_or_empty(f"`{c}`") for c in fields]
    sized = F.array(*[F.octet_length(p) for p in parts]) if fields else F.array().cast("array<int>")
    given = docs.select(F.col(id_col).alias("id"), (F.concat(*parts) if fields else text_or_empty(text_col)).alias("text"), sized.alias("sizes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sizes = load(folder)
        for b in slices(batches, "text"):
            buf, offs = text_buffer(b.column("text"))
            texts = b.column("text").to_pylist()
            out: list[list[np.ndarray]] = []
            for i, text in enumerate(texts):
                raw = buf[offs[i] : offs[i + 1]]
                if not len(raw):
                    none = np.zeros(max(1, len(fields)), np.int64)
                    out.append([none + i, np.arange(len(none)), none, none, none, none])
                    continue
                tokens = [coder.encode_to_numpy(x, disallowed_special=()) for x in whole_pieces(text)]
                ends = np.cumsum(sizes[np.concatenate(tokens)])
                if ends[-1] != len(raw):
                    raise ValueError("the tokens do not cover the text")
                starts = np.r_[0, np.cumsum(b.column("sizes")[i].as_py())[:-1]] if fields else line_starts(raw)
                counts, crossing = attribute(raw, ends, starts, rule)
                lead = np.zeros(len(raw) + 1, np.int64)
                np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
                n = len(starts)
                out.append([np.full(n, i), np.arange(n), lead[starts], lead[np.r_[starts[1:], len(raw)]], counts, crossing])
            rows = [np.concatenate(x) for x in zip(*out)]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows[0])), *(pa.array(x.astype(np.int64)) for x in rows[1:])], ["id", "section", "start", "end", "n_tokens", "n_crossing"])

    return given.mapInArrow(run, f"id {kind}, section long, start long, end long, n_tokens long, n_crossing long").withColumnRenamed("id", id_col)
