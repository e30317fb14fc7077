"""Removal of passages that repeat across documents, by minimizers at borders of runs and pairs of words, and window hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triptych.llm.common import slices, whole_text
from triptych.sources.shared import materialize

WINDOW = 13
# Words in a name by which repeats are revealed.
REVEAL = 6
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
# An id that is NULL comes after all others.
LAST = (1 << 63) - 1

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * ODD[0]
    return x ^ x >> np.uint64(29)


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The names of pairs of names."""
    return mixed(left * ODD[1] + mixed(right) * ODD[2])


def stretches(names: np.ndarray, length: int) -> np.ndarray:
    """At each place, the name of `length` names from there: pairs, pairs of pairs, and so on, put together."""
    out, done, block, size = None, 0, names, 1
    while size <= length:
        if length & size:
            n = len(names) - done - size + 1
            part = block[done:done + max(n, 0)]
            out = part if out is None else paired(out[:len(part)], part)
            done += size
        if size * 2 <= length:
            block = paired(block[:len(block) - size], block[size:])
        size *= 2
    return out


class WordNames:
    """A name for each word of a text, the same for the same bytes anywhere."""

    def __init__(self, seed: int = 42):
        self.table = np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64)
        self.blank = np.zeros(256, bool)
        self.blank[[32, *range(9, 14)]] = True
        self.table[self.blank] = 0
        self.powers = self._powers(256)

    @staticmethod
    def _powers(n: int) -> np.ndarray:
        return np.cumprod(np.full(n, ODD[3], np.uint64), dtype=np.uint64)

    def of(self, data: np.ndarray) -> np.ndarray:
        blank = self.blank[data]
        starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
        if not len(starts):
            return np.zeros(0, np.uint64)
        place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.r_[starts, len(data)]))
        longest = int(place.max()) + 1
        if longest > len(self.powers):
            self.powers = self._powers(2 * longest)
        return mixed(np.add.reduceat(self.table[data[starts[0]:]] * self.powers[place], starts - starts[0]))


def borders(names: np.ndarray) -> np.ndarray:
    """Where a symbol would begin after a round of recompression: runs of one name, then pairs, become one symbol.

    No symbol is put in their place: only the borders are used.

    Names are dealt into left and right ones; a left one and a right one after it are a pair.
    Whether there is a border depends on the two names beside it alone, so equal stretches
    have equal borders but at their ends.
    """
    left = names >> np.uint64(17) & np.uint64(1) == 1
    out = np.ones(len(names), bool)
    out[1:] = (names[1:] != names[:-1]) & ~(left[:-1] & ~left[1:])
    return out


def revealing(names: np.ndarray, window: int, reveal: int) -> np.ndarray:
    """For each window a name of some of its words, so that equal windows have equal names, and neighbours often one.

    It is the smallest name of `reveal` words that begin at a border inside the window. A
    window inside a long run has no border, and is known by a name of all its words.
    """
    n = len(names) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    short = stretches(names, reveal)
    short = np.where(borders(names)[:len(short)], mixed(short), NONE)
    least = short[1:1 + n].copy()
    for shift in range(2, window - reveal + 1):
        np.minimum(least, short[shift:shift + n], out=least)
    bare = least == NONE
    if bare.any():
        least[bare] = mixed(stretches(names, window)[bare])
    return least


def _bytes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(t.as_buffer(), np.uint8) for t in column]


def _heads(columns: list[np.ndarray], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of their names and documents, without repeats; where names begin; how many rows each has."""
    order = np.lexsort([docs, *columns[::-1]])
    columns, docs = [c[order] for c in columns], docs[order]
    new = np.ones(len(docs), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    fresh = new.copy()
    fresh[1:] |= docs[1:] != docs[:-1]
    return order[fresh], np.flatnonzero(new[fresh]), np.diff(np.r_[np.flatnonzero(new[fresh]), fresh.sum()])


def _digesting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [t.as_buffer().to_pybytes().split() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(map(len, words), pa.int64()),
             pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string())],
            [*batch.schema.names[1:], "n_words", "sha"])


def _naming(window: int, reveal: int) -> Batches:
    """Rows of a revealing name and a document that has it.

    Of rows with one name in a run of documents, one goes to where all rows of the name
    meet; that all of them share it is `known` already.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordNames()
        for batch in batches:
            for part in slices(batch, "text"):
                docs = part.column("doc").to_numpy()
                found = [np.unique(revealing(names.of(data), window, reveal)) for data in _bytes(part.column("text"))]
                owner = np.repeat(docs, [len(f) for f in found])
                key = np.concatenate(found) if found else np.zeros(0, np.uint64)
                rows, starts, sizes = _heads([key], owner)
                key, owner = key[rows].view(np.int64), owner[rows]
                shared = np.repeat(sizes > 1, sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[key[starts], key[shared]]), pa.array(np.r_[owner[starts], owner[shared]]),
                     pa.array(np.r_[np.zeros(len(starts), bool), np.ones(int(shared.sum()), bool)])],
                    ["key", "doc", "known"])
    return run


def _meeting(columns: list[str], later_only: bool) -> Batches:
    """Of rows in the order of `columns` and `doc`, those whose names several documents have.

    With `later_only` the first document of each name is left out. A name may have any
    number of rows: what is held of it is its first document.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # of the last name: its columns, first document, whether that has been given
        for batch in batches:
            known = batch.column("known").to_numpy(zero_copy_only=False)
            doc = batch.column("doc").to_numpy()
            name = [batch.column(c).to_numpy() for c in columns]
            out_doc, out_key = [doc[known]], [name[0][known]]
            doc, name = doc[~known], [c[~known] for c in name]
            if len(doc):
                given = False
                if held is not None:
                    name = [np.r_[h, c] for h, c in zip(held[0], name, strict=True)]
                    doc, given = np.r_[held[1], doc], held[2]
                new = np.ones(len(doc), bool)
                new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in name])
                starts = np.flatnonzero(new)
                sizes = np.diff(np.r_[starts, len(doc)])
                several = np.maximum.reduceat(doc, starts) != doc[starts]
                wanted = np.repeat(several, sizes)
                if later_only:
                    wanted &= doc != np.repeat(doc[starts], sizes)
                held = [c[starts[-1]] for c in name], doc[starts[-1]], bool(several[-1]) or given and len(starts) == 1
                if given:
                    wanted[0] = False
                out_doc.append(doc[wanted])
                out_key.append(name[0][wanted])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_doc)), pa.array(np.concatenate(out_key))],
                                             ["doc", "key"])
    return run


def _meet(rows: DataFrame, columns: list[str], later_only: bool) -> DataFrame:
    """Each document's names that it shares, as `doc` and `keys`; rows that are known already meet nobody."""
    spot = F.when(F.col("known"), F.xxhash64("doc")).otherwise(F.col(columns[0]))
    return rows.repartition(spot).sortWithinPartitions(*columns, "doc").mapInArrow(
        _meeting(columns, later_only), "doc long, key long").groupBy("doc").agg(F.collect_list("key").alias("keys"))


def _keys(column: pa.Array) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    return [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _windows(window: int, reveal: int) -> Batches:
    """Rows of a window's name, in two columns, and its document, for windows that may repeat."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordNames()
        for batch in batches:
            for part in slices(batch, "text"):
                docs = part.column("doc").to_numpy()
                found = []
                for data, keys in zip(_bytes(part.column("text")), _keys(part.column("keys")), strict=True):
                    words = names.of(data)
                    maybe = np.isin(revealing(words, window, reveal), keys)
                    both = np.zeros((2, 0), np.uint64)
                    if maybe.any():
                        both = np.stack([stretches(w, window)[maybe] for w in (words, mixed(words ^ ODD[0]))])
                    found.append(both)
                owner = np.repeat(docs, [f.shape[1] for f in found])
                one, two = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.uint64)
                one, two = one.view(np.int64), (two >> np.uint64(32)).astype(np.int64)
                rows, starts, sizes = _heads([one, two], owner)
                one, two, owner = one[rows], two[rows], owner[rows]
                later = np.ones(len(one), bool)
                later[starts] = False
                later &= owner != np.repeat(owner[starts], sizes)
                at = np.r_[starts, np.flatnonzero(later)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one[at]), pa.array(two[at]), pa.array(owner[at]),
                     pa.array(np.arange(len(at)) >= len(starts))], ["one", "two", "doc", "known"])
    return run


def covered(names: np.ndarray, repeated: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a window whose name is repeated."""
    steps = np.zeros(len(names) + 1, np.int64)
    starts = np.flatnonzero(np.isin(stretches(names, window), repeated)) if len(names) >= window else []
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.asarray(starts, np.int64) + window, -1)
    return np.cumsum(steps[:-1]) > 0


def _removing(window: int) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordNames()
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[list] = [[], [], []]
                for data, keys in zip(_bytes(part.column("text")), _keys(part.column("keys")), strict=True):
                    gone = covered(names.of(data), keys, window)
                    words = data.tobytes().split()
                    kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                    for column, value in zip(out, (hashlib.sha256(b" ".join(words)).hexdigest(), int(gone.sum()), kept.decode()), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                    ["doc", "sha", "n_removed", "kept_text"])
    return run


def substring_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    window: int = WINDOW, reveal: int = REVEAL, keep_text: bool = False) -> DataFrame:
    """One row per document: its id, `n_words`, `n_removed`, `kept_sha256` and, with `keep_text`, `kept_text`.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged; a window is `window` consecutive words of one
    document. A word is removed if it is in a window whose words also start in a document
    with a smaller id. Windows are judged on the input. The kept words are joined by one
    space. NULL and blank texts have no words, and documents of less than `window` words
    lose none. Rows with one id do not count as smaller than one another; NULL ids come
    after all others. Other columns are not carried.

    1. Documents of the same words are known by one hash; all but the smallest id go whole.
    2. A round of recompression would name runs and pairs of words; it only gives every
       stretch borders that depend on the words beside them alone. Each window is known by
       its minimizer, the least hash of `reveal` words at one of its borders, about one for four words; those that
       several documents have reveal where repeats may be.
    3. There, windows are hashed by pairs of pairs of words, in 96 bits; where equal names
       meet, all but the smallest id are repeats.
    4. Documents with repeats are read once more and lose their words.

    Names are made from the words by arithmetic, so they are the same everywhere without a
    dictionary. Rows of one name in a run of documents are put together before they go
    where all rows of the name meet; there they pass in order, and one is held.
    """
    if not 0 < reveal < window:
        raise ValueError("reveal must be less than window")
    rows = docs.select(whole_text(text_column).alias("text"),
                       F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)).alias("doc"))
    kind = docs.schema[id_column].dataType.simpleString()
    keyed = docs.select(whole_text(text_column).alias("text"), F.col(id_column).alias("key"),
                        F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)).alias("doc"))
    digests = materialize(keyed.mapInArrow(_digesting, f"key {kind}, doc long, n_words long, sha string"), "digests")
    smallest = digests.groupBy("sha").agg(F.min("doc").alias("low"))
    digests = materialize(digests.join(smallest, "sha"), "copies")
    whole = (F.col("doc") > F.col("low")) & (F.col("n_words") >= window)

    shared = _meet(rows.mapInArrow(_naming(window, reveal), "key long, doc long, known boolean"), ["key"], False)
    firsts = digests.filter(~whole).select("doc").distinct()
    suspects = materialize(rows.join(shared.join(firsts, "doc"), "doc"), "suspects", "zstd")
    repeated = _meet(suspects.select("text", "doc", "keys").mapInArrow(
        _windows(window, reveal), "one long, two long, doc long, known boolean"), ["one", "two"], True)
    cut = suspects.select("text", "doc").join(repeated, "doc").select("text", "doc", "keys").mapInArrow(
        _removing(window), "doc long, sha string, n_removed long, kept_text string")
    cut = cut.withColumn("kept", F.sha2(F.col("kept_text").cast("binary"), 256))
    # Repeated rows have equal results.
    columns = ["n_removed", "kept", *["kept_text"] * keep_text]
    cut = cut.groupBy("doc", "sha").agg(*(F.first(c).alias(c) for c in columns))
    found = digests.join(cut, ["doc", "sha"], "left")
    result = found.select(
        F.col("key").alias(id_column), "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        *[F.when(whole, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] * keep_text)
    return result
