"""Quality rules from tokeniser fertility: public vocabularies measure how text breaks into tokens.

Each word of a text is encoded by two public vocabularies. Three measures follow:
characters per token (how well a vocabulary knows the words), the share of
byte-fallback tokens (how many characters it does not know at all) and the entropy
of the token distribution. Each language has its own band for each measure: the
quartiles of all its documents that pass the base rules, widened by a multiple of
the quartile range. A document outside a band is rejected.

Words are encoded once for each worker and kept in a bounded cache; what is
gathered for the bands is a quantile sketch for each language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, powers, slices, span_hashes, text_buffer, text_or_empty, word_spans, worker_cache

TOKENIZERS = "/opt/tokenizers"
PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
#: A band reaches this many quartile ranges beyond the quartiles.
REACH = 2.5
#: Least half width of a band, by measure, so that a language of like documents is not cut to its median.
FLOORS = {"chars_per_token": 0.08, "bytes_per_token": 0.08, "fallback_share": 0.02, "entropy_gap": 0.08}
#: Below this many words a band widens by the root of how few there are: short texts vary more.
STEADY_WORDS = 200
#: Words that a worker keeps encoded.
CACHE_WORDS = 300_000
#: Runs of this many characters, all white space or none, are encoded in pieces: the pattern's matcher fails at about a million.
RUN = 400_000


def whole_pieces(text: str, run: int = RUN) -> Iterator[str]:
    """Cuts of a text that can be encoded one by one. Without a run of ``run`` characters there is one, the text.

    Runs are cut where the pattern cuts them, that is before their last character
    if a word follows white space, and inside only as pieces of ``run`` characters.
    """
    if len(text) < run:
        yield text
        return
    done = 0
    for found in re.finditer(r"\s++|\S++", text):
        start, end = found.span()
        if end - start < run:
            continue
        stop = end - 1 if text[start].isspace() and end < len(text) else end
        cuts = [done, *range(start, stop, run), stop]
        yield from (text[a:b] for a, b in zip(cuts, cuts[1:]) if a < b)
        done = stop
    if done < len(text):
        yield text[done:]


class Encoder:
    """Token ids of words under both vocabularies, kept for a bounded number of words."""

    def __init__(self, folder: str):
        import base64

        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECES}")
        with open(f"{folder}/{BYTES}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.fallback = np.array([self.pieces.is_byte(i) or self.pieces.is_unknown(i) for i in range(self.pieces.get_piece_size())])
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint16)
        self.at = np.zeros(1 << 14, np.int64)
        self.n = np.zeros(1 << 14, np.int64)
        self.n_bytes = np.zeros(1 << 14, np.int64)
        self.used = 0

    def lookup(self, hashes: np.ndarray, words) -> np.ndarray:
        """Places of distinct words; ``words(i)`` gives the text of the i-th."""
        if len(self.place) > CACHE_WORDS:
            self.clear()
        get = self.place.get
        found = np.array([get(h, -1) for h in hashes.tolist()], np.int64)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            texts = [words(i) for i in missing.tolist()]
            encoded = self.pieces.encode(texts, num_threads=1)
            begin, count = len(self.place), np.array([len(e) for e in encoded], np.int64)
            total, end = int(count.sum()), begin + len(missing)
            while self.used + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while end > len(self.at):
                self.at, self.n, self.n_bytes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.n, self.n_bytes))
            self.ids[self.used : self.used + total] = [i for e in encoded for i in e]
            self.at[begin:end] = self.used + np.cumsum(count) - count
            self.n[begin:end] = count
            encode = self.bytes.encode_ordinary
            self.n_bytes[begin:end] = [len(encode(" " + t)) if len(t) < RUN else sum(len(encode(x)) for x in whole_pieces(" " + t)) for t in texts]
            self.used += total
            found[missing] = np.arange(begin, end)
            self.place.update(zip(hashes[missing].tolist(), range(begin, end)))
        return found


def _by_row(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of a value for each byte over rows."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def repeats(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether its row holds its hash twice or more; whether an earlier item of the row has it."""
    order = np.lexsort((hashes, row))
    r, h = row[order], hashes[order]
    same = (r[1:] == r[:-1]) & (h[1:] == h[:-1])
    again, twice = np.zeros(len(row), bool), np.zeros(len(row), bool)
    again[order[1:]] = same  # lexsort is stable: the first of equals comes first
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice, again


def base_counts(buf: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The base measures of rows of text: words, their characters, symbols, repeated lines, words in repeated windows."""
    rows = len(offs) - 1
    lead = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out = {
        "n_words": np.bincount(row, minlength=rows),
        "word_chars": np.bincount(row, lead[ends] - lead[starts], minlength=rows).astype(np.int64),
        "n_symbols": _by_row(symbol[buf], offs),
    }
    breaks = np.flatnonzero(buf == 10)
    begin = np.unique(np.r_[offs[:-1][offs[:-1] < offs[1:]], breaks + 1])
    begin = begin[begin < len(buf)]
    of = np.searchsorted(offs, begin, "right") - 1
    nearest = np.r_[breaks, len(buf)][np.searchsorted(breaks, begin)]
    stop = np.minimum(nearest, offs[of + 1])
    worded = np.searchsorted(starts, begin) < np.searchsorted(starts, stop)
    begin, stop, of = begin[worded], stop[worded], of[worded]
    _, again = repeats(of, span_hashes(buf, begin, stop)) if len(of) else (None, np.zeros(0, bool))
    out["n_dup_lines"] = np.bincount(of[again], minlength=rows)
    out["n_repeat_words"] = np.zeros(rows, np.int64)
    if len(row) >= WINDOW:
        m = len(row) - WINDOW + 1
        whole = row[:m] == row[WINDOW - 1 :]
        gram = sum(hashes[k : k + m] * powers(np.uint64(0xD6E8FEB86659FD93), WINDOW)[k] for k in range(WINDOW))
        at = np.flatnonzero(whole)
        twice, _ = repeats(row[at], gram[at])
        hit = np.zeros(len(row) + 1, np.int64)
        np.add.at(hit, at[twice], 1)
        np.add.at(hit, at[twice] + WINDOW, -1)
        out["n_repeat_words"] = np.bincount(row[np.cumsum(hit)[:-1] > 0], minlength=rows)
    return out


def measure(docs: DataFrame, folder: str = TOKENIZERS, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(id, lang, base counts, n_tokens, n_byte_tokens, n_fallback, entropy) for every row, from whole texts."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens", "n_fallback"]
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        if ("fertility", folder) not in cache:
            cache["fertility", folder] = Encoder(folder)
        coder = cache["fertility", folder]
        for b in slices(batches, "text"):
            buf, offs = text_buffer(b.column("text"))
            rows = b.num_rows
            starts, ends, row = word_spans(buf, offs)
            hashes = span_hashes(buf, starts, ends)
            out = base_counts(buf, offs, starts, ends, row, hashes)
            out |= {k: np.zeros(rows, np.int64) for k in names[5:]}
            entropy = np.zeros(rows)
            if len(row):
                distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
                raw = buf.tobytes()
                s, e = starts[first].tolist(), ends[first].tolist()
                place = coder.lookup(distinct, lambda i: raw[s[i] : e[i]].decode("utf-8", "replace"))[back]
                n = coder.n[place]
                out["n_tokens"] = np.bincount(row, n, minlength=rows).astype(np.int64)
                out["n_byte_tokens"] = np.bincount(row, coder.n_bytes[place], minlength=rows).astype(np.int64)
                upto = np.cumsum(n)
                ids = coder.ids[np.repeat(coder.at[place] - upto + n, n) + np.arange(upto[-1])]
                of = np.repeat(row, n)
                out["n_fallback"] = np.bincount(of[coder.fallback[ids]], minlength=rows)
                keys = np.sort((of.astype(np.uint64) << np.uint64(16)) | ids)
                cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                count = np.diff(np.r_[cut, len(keys)])
                of = (keys[cut] >> np.uint64(16)).astype(np.int64)
                p = count / out["n_tokens"][of]
                entropy = np.bincount(of, -p * np.log2(p), minlength=rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), *(pa.array(out[k].astype(np.int64)) for k in names), pa.array(entropy)], ["id", "lang", *names, "entropy"])

    return given.mapInArrow(run, f"id {kind}, lang string, {', '.join(f'{k} long' for k in names)}, entropy double")


def quality_rules(docs: DataFrame, folder: str = TOKENIZERS, reach: float = REACH, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, base counts, measures, base_failed, reasons, kept.

    Null texts are empty (and fail the base rules); a null language is a language
    of its own; repeated rows stay; other columns are not read. A language none of
    whose documents pass the base rules has no band and rejects nothing more. Bands
    widen for short texts. Very long texts are measured whole (``RUN`` tells how
    very long words are encoded). An empty table gives an empty result.
    """
    measured = materialize(measure(docs, folder, id_col, lang_col, text_col), "fertility")
    rated = (
        measured.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .withColumn("chars_per_token", F.when(F.col("n_tokens") > 0, F.col("word_chars") / F.col("n_tokens")))
        .withColumn("bytes_per_token", F.when(F.col("n_byte_tokens") > 0, F.col("word_chars") / F.col("n_byte_tokens")))
        .withColumn("fallback_share", F.when(F.col("n_tokens") > 0, F.col("n_fallback") / F.col("n_tokens")))
        # how far the entropy falls short of that of as many tokens, all different; one token has no entropy to speak of
        .withColumn("entropy_gap", F.when(F.col("n_tokens") > 1, 1 - F.col("entropy") / F.log2(F.col("n_tokens").cast("double"))))
    )
    good = rated.where(~F.col("base_failed"))
    quartiles = good.groupBy("lang").agg(*[F.percentile_approx(m, [0.25, 0.5, 0.75], 10000).alias(f"q_{m}") for m in FLOORS])
    quartiles = broadcast_if_small(materialize(quartiles, "bands"), 512)
    reasons = []
    for m, floor in FLOORS.items():
        low, _, high = (F.col(f"q_{m}")[i] for i in range(3))
        width = F.greatest(reach * (high - low), F.lit(floor)) * F.greatest(F.lit(1.0), F.sqrt(STEADY_WORDS / F.greatest("n_words", F.lit(1))))
        if m == "fallback_share" or m == "entropy_gap":
            reasons.append(F.when(F.col(m) > high + width, m))
        else:
            reasons.append(F.when((F.col(m) < low - width) | (F.col(m) > high + width), m))
    judged = rated.join(quartiles, "lang", "left").withColumn("reasons", F.array_compact(F.array(*reasons)))
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"),
        "lang", "n_tokens", "n_byte_tokens", "n_fallback", "entropy", "chars_per_token", "bytes_per_token", "fallback_share", "entropy_gap", "reasons",
    )
