"""Alignment of two tokenizers over a corpus, each distinct text tokenised once.

Spark plan: documents are grouped by their full text (combined before the shuffle, so a
text held by a third of the rows is one row per task); each distinct text is encoded by
both tokenizers in a Python task over Arrow batches, long texts in pieces cut where both
must have a boundary; the links of each text are counted by Spark with the text's
multiplicity as weight; the best count of each B id comes from a grouping; the measures of
a text go back to its documents by a join on the text's key (two 64-bit hashes), salted
for texts with many copies.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triptych.llm.common import SLICE_BYTES, slices
from triptych.sources.shared import materialize

# Texts longer than this are encoded in pieces, cut before a single space between a
# non-blank character and a letter (a boundary of both tokenizers).
PIECE_CHARS = 1 << 18
# Copies of one text that share one salt of the join back to documents.
COPIES_PER_SALT = 10_000
# Rows that a broadcast side may have: pair counts, texts of many copies.
BROADCAST_PAIRS = 1_000_000
_CUT = re.compile(r"(?<=\S) (?=[^\W\d_])")
_BYTE_PIECE = re.compile(r"<0x([0-9A-Fa-f]{2})>")


def text_key() -> tuple:
    """A text's key: two independent 64-bit hashes of it (128 bits), so that each of the many
    pair rows carries two longs rather than a digest string."""
    return F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("\x1f"), "text").alias("k2")


def byte_level_table() -> dict[str, int]:
    """The byte of each character of a byte-level BPE vocabulary: printable bytes stand for
    themselves, the others (0-32, 127-160, 173) for 256, 257, ... in byte order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {}, 0
    for b in range(256):
        if b in own:
            table[chr(b)] = b
        else:
            table[chr(256 + extra)] = b
            extra += 1
    return table


class Aligner:
    """Both tokenizers, and the bytes of each of their ids."""

    def __init__(self, a_path: str, b_path: str, a_ranks: tuple[str, str] | None = None):
        import sentencepiece

        self.a = self.fast = None
        if a_ranks:  # the same vocabulary as tiktoken ranks and its split pattern: the same ids, faster
            import base64

            import tiktoken

            with open(a_ranks[0], "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("a", pat_str=a_ranks[1], mergeable_ranks=ranks, special_tokens={})
            # A rank's bytes are its entry of A's file, byte-level decoded (the tests hold them equal),
            # so the tokenizers library is not loaded at all: a worker holds one vocabulary less.
            self.a_bytes = [b""] * (max(ranks.values()) + 1)
            for token, rank in ranks.items():
                self.a_bytes[rank] = token
            del ranks
        else:
            from tokenizers import Tokenizer

            self.a = Tokenizer.from_file(a_path)
            self.a.encode_special_tokens = True
            chars = byte_level_table()
            size = self.a.get_vocab_size(with_added_tokens=True)
            self.a_bytes = [bytes(chars.get(c, 0) for c in (self.a.id_to_token(i) or "")) for i in range(size)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            found = _BYTE_PIECE.fullmatch(piece)
            self.b_bytes.append(bytes([int(found.group(1), 16)]) if found else piece.replace("▁", " ").encode())
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.a_names = np.array([str(i).encode() for i in range(len(self.a_bytes))], "S")
        self.b_names = np.array([str(i).encode() for i in range(len(self.b_bytes))], "S")
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)

    def pieces(self, text: str) -> list[str]:
        """The text in pieces of about PIECE_CHARS, each but the first starting with the cut's space."""
        if len(text) <= PIECE_CHARS:
            return [text]
        out, start = [], 0
        while len(text) - start > PIECE_CHARS:
            found = _CUT.search(text, start + PIECE_CHARS)
            if not found:
                break
            out.append(text[start:found.start()])
            start = found.start()
        out.append(text[start:])
        return out

    def align(self, text: str | None) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, groups_sha256, and the A and B ids of the links (one per group)."""
        empty = (0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        if not text:
            return empty
        parts = self.pieces(text)
        a_texts = [" " + parts[0], *parts[1:]]
        b_texts = [parts[0], *(p[1:] for p in parts[1:])]
        if self.fast:
            a_ids = [np.array(self.fast.encode_ordinary(t), np.int64) for t in a_texts]
        else:
            a_ids = [np.array(self.a.encode(t, add_special_tokens=False).ids, np.int64) for t in a_texts]
        b_ids = [np.array(x, np.int64) for x in self.b.encode(b_texts, num_threads=1)]
        digest = hashlib.sha256()
        n_a = n_b = n_groups = 0
        link_a, link_b = [], []
        for text_part, a, b in zip(a_texts, a_ids, b_ids, strict=True):
            data = text_part.encode()
            a_list, b_list = a.tolist(), b.tolist()
            if b"".join([self.a_bytes[i] for i in a_list]) != data or b"".join([self.b_bytes[i] for i in b_list]) != data:
                return empty
            a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
            common = np.intersect1d(a_end, b_end, assume_unique=True)
            a_cut = np.searchsorted(a_end, common, side="right")
            b_cut = np.searchsorted(b_end, common, side="right")
            # `a1,a2|b1;a3|b2,b3` at once: each id with the mark after it, A's ids of a group
            # before B's, groups in order (a stable sort by group, then side).
            a_after = np.full(len(a), b",", "S1")
            a_after[a_cut - 1] = b"|"
            b_after = np.full(len(b), b",", "S1")
            b_after[b_cut - 1] = b";"
            group = np.concatenate([np.searchsorted(a_cut, np.arange(len(a)), side="right"),
                                    np.searchsorted(b_cut, np.arange(len(b)), side="right")])
            side = np.concatenate([np.zeros(len(a), np.int8), np.ones(len(b), np.int8)])
            items = np.char.add(np.concatenate([self.a_names[a], self.b_names[b]]),
                                np.concatenate([a_after, b_after]))[np.lexsort((side, group))]
            if n_groups:
                digest.update(b";")
            digest.update(b"".join(items.tolist())[:-1])
            n_groups += len(common)
            link_a.append(a[a_cut - 1])
            link_b.append(b[b_cut - 1])
            n_a += len(a)
            n_b += len(b)
        return n_a, n_b, n_groups, digest.hexdigest(), np.concatenate(link_a), np.concatenate(link_b)


def _link_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (A id, B id) pairs of a text's links and how often each is linked."""
    codes, times = np.unique((a << 32) | b, return_counts=True)
    return codes >> 32, codes & 0xFFFFFFFF, times.astype(np.int64)


def _aligning(a_path: str, b_path: str, a_ranks: tuple[str, str] | None, slice_bytes: int):
    """Per text one row with its measures (a, b, m NULL), and one row per distinct pair of
    its links (a, b, m: how often), both flat, so no list of a long text is held at once."""
    names = ["k1", "k2", "copies", "n_a", "n_b", "n_groups", "groups_sha256", "a", "b", "m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path, a_ranks)
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                k1, k2 = (part.column(c).to_numpy() for c in ("k1", "k2"))
                copies = part.column("copies").to_numpy()
                done = [aligner.align(t) for t in part.column("text").to_pylist()]
                none = pa.nulls(len(done), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(copies, pa.int64()),
                     *(pa.array([d[i] for d in done], pa.int64()) for i in range(3)),
                     pa.array([d[3] for d in done], pa.string()), none, none, none], names)
                pairs = [_link_pairs(d[4], d[5]) for d in done]
                sizes = np.array([len(p[0]) for p in pairs], np.int64)
                many = int(sizes.sum())
                if many:
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(np.repeat(c, sizes), pa.int64()) for c in (k1, k2, copies)),
                         pa.nulls(many, pa.int64()), pa.nulls(many, pa.int64()), pa.nulls(many, pa.int64()),
                         pa.nulls(many, pa.string()),
                         *(pa.array(np.concatenate([p[i] for p in pairs]), pa.int64()) for i in range(3))], names)
    return run


def align(docs: DataFrame, a_tokenizer: str, b_tokenizer: str, id_column: str = "doc_id",
          text_column: str = "text", salts: int = 64, slice_bytes: int = SLICE_BYTES,
          a_ranks: tuple[str, str] | None = None) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is `a_tokenizer` (a byte-level BPE file of the tokenizers library) on space + text, B
    is `b_tokenizer` (a sentencepiece model, which adds the space) on the text; neither adds
    special tokens, and their strings in a text are plain text. Token bytes are A's entry
    byte-level decoded and B's piece in UTF-8 with U+2581 as space and <0xHH> as byte HH.
    Offsets where A and B tokens both end cut the tokens into groups; a link is an A and a B
    token ending at the same offset (so one per group); a pair's count is its links over the
    corpus, each document counted (copies of a text count each). `n_best` counts links whose
    count is the highest of any pair with their B id (ties included); `count_sum` adds their
    counts. `groups_sha256` is the lowercase hex SHA-256 of `a1,a2|b1;a3|b2,b3`.

    `a_ranks` (a tiktoken ranks file of A's vocabulary and A's split pattern) makes A's
    ids by tiktoken, which gives the same ids several times faster, and the bytes of each id
    from the ranks; the tests hold both encoders and both byte tables equal.

    A text that is NULL or empty, or whose A or B bytes joined differ from space + text,
    has zeros and '' (not hashed). Each distinct text is encoded once; long texts in pieces
    of about PIECE_CHARS characters cut before a space between a non-blank and a letter
    (a text without such a place is encoded whole). Rows with a NULL or repeated id each
    get their row. Empty table: no rows. Other columns are not carried.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc"), text.alias("text"))
    distinct = rows.groupBy("text").agg(F.count(F.lit(1)).alias("copies")).select(
        *text_key(), "text", "copies")
    out = ("k1 long, k2 long, copies long, n_a long, n_b long, n_groups long, groups_sha256 string, "
           "a long, b long, m long")
    aligned = distinct.mapInArrow(_aligning(a_tokenizer, b_tokenizer, a_ranks, slice_bytes), out)
    aligned = materialize(aligned, "aligned_texts")
    links = aligned.filter(F.col("a").isNotNull()).select("k1", "k2", "copies", "a", "b", "m")
    counts = links.groupBy("a", "b").agg(F.sum(F.col("m") * F.col("copies")).alias("count"))
    counts = materialize(counts.withColumn("best", F.max("count").over(Window.partitionBy("b"))), "pair_counts")
    # Pairs of ids that end together are bounded by the two vocabularies, not by the corpus;
    # a frequent pair is a hot key of `links`, so the counts go to every task if they are few.
    if counts.count() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    measured = links.join(counts, ["a", "b"]).groupBy("k1", "k2").agg(
        F.sum("m").alias("n_links"),
        F.sum(F.when(F.col("count") == F.col("best"), F.col("m")).otherwise(0)).alias("n_best"),
        F.sum(F.col("m") * F.col("count")).alias("count_sum"))
    per_text = aligned.filter(F.col("a").isNull()).drop("a", "b", "m").join(measured, ["k1", "k2"], "left").withColumn(
        "spread", F.least(F.lit(salts), F.ceil(F.col("copies") / COPIES_PER_SALT)).cast("long"))
    per_text = materialize(per_text, "aligned_measures")
    # Texts of many copies: their row is repeated `spread` times and their documents dealt over them.
    hot = per_text.filter(F.col("spread") > 1).select("k1", "k2", "spread")
    keyed = rows.select("doc", *text_key())
    if hot.count() <= BROADCAST_PAIRS:
        keyed = keyed.join(F.broadcast(hot), ["k1", "k2"], "left").withColumn(
            "salt", F.pmod(F.xxhash64("doc"), F.coalesce("spread", F.lit(1))))
        per_text = per_text.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("spread") - 1)))
    else:  # Spark's own split of skewed partitions takes over
        keyed, per_text = keyed.withColumn("salt", F.lit(0)), per_text.withColumn("salt", F.lit(0))
    joined = keyed.select("doc", "k1", "k2", "salt").join(per_text, ["k1", "k2", "salt"])
    return joined.select(
        F.col("doc").cast("long").alias(id_column), "n_a", "n_b", "n_groups",
        *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")),
        "groups_sha256")
