"""Spelling variants of a corpus's words, found by variable-length grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.llm.spans import eights, mixed
from merchantry.session import store

# Fixed values of the word rule: letters are A-Z, a-z and U+00C0 to U+00FF, so every word fits Latin-1.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SHORTEST, LONGEST = 3, 7  # characters of a gram; eight bytes hold a gram and its length
MIN_LENGTH = 7  # of words: below it an edit can leave no gram whole
_PLACES = 64  # of a word where grams are chosen
_SALTED_FROM = 5_000  # words with a gram; more are dealt over several keys


def word_counts(docs: DataFrame, damaged_every: int | None = 31) -> DataFrame:
    """(word, n): the lower-cased runs of letters of at least 7 characters, and how often each occurs in all texts.

    With h the crc32 of `<doc_id>:<run>`, a run whose h `damaged_every` divides first loses its
    character at h % length (None: no run does). A null text has no words, a null doc_id counts as empty text.
    """
    run = F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(RUN), F.lit(0))).alias("run")
    runs = docs.select("doc_id", run).where(F.length("run") >= MIN_LENGTH)
    word = F.col("run")
    if damaged_every:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
        runs = runs.withColumn("h", h).withColumn("at", (F.col("h") % F.length("run")).cast("int"))
        shorter = F.concat(F.col("run").substr(F.lit(1), F.col("at")), F.col("run").substr(F.col("at") + 2, F.length("run")))
        word = F.when(F.col("h") % damaged_every == 0, shorter).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n"))


def _joined(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of words, one byte a character."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8), ends - np.diff(ends, prepend=0), ends


def _gram(whole: np.ndarray, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Grams as numbers: their bytes, and their length in the highest."""
    size = np.asarray(size, np.uint64)
    return whole[at] & ((np.uint64(1) << np.uint64(8) * size) - np.uint64(1)) | size << np.uint64(56)


def frequent_grams(words: DataFrame, max_grams: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram dictionary: sorted grams of 3 to 6 characters that occur more often than a threshold, and how often.

    The threshold is `min_words` or as much more as keeps the dictionary within `max_grams`
    at any size: no more grams of one length can pass it than there are places divided by it.
    """
    levels = range(SHORTEST, LONGEST)
    places = words.agg(F.sum(F.length("word") - SHORTEST + 1)).first()[0] or 0
    threshold = max(min_words, -(-places * len(levels) // max_grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends = _joined(batch.column(0).to_pylist())
            whole, left = eights(data), np.repeat(ends, ends - starts) - np.arange(len(data))
            grams = np.concatenate([_gram(whole, np.flatnonzero(left >= size), size) for size in levels])
            found, counts = np.unique(grams, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts, pa.int64())], names=["gram", "n"])

    counted = words.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > threshold)
    rows = counted.toPandas()
    grams, counts = rows["gram"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(grams)
    return grams[order], counts[order]


class Grams:
    """Variable-length grams of many words: at each place the shortest gram of 3 to 7 characters that isn't frequent,
    or the longest that the word allows.

    A gram depends on its own characters and the word's end alone. So an edit before it leaves it
    whole at its distance from the end, one behind it leaves it whole at its distance from the
    start; of two grams that don't overlap, one edit affects at most one. Only grams of a word's first characters are used.
    """

    def __init__(self, words: list[str], dictionary: tuple[np.ndarray, np.ndarray]):
        self._frequent, self._counts = dictionary
        data, self.starts, self.ends = _joined(words)
        self.lengths = self.ends - self.starts
        self._whole = eights(data)
        self.letters = np.bitwise_or.reduceat(np.uint64(1) << (data & 63).astype(np.uint64), self.starts)
        left = np.repeat(self.ends, self.lengths) - np.arange(len(data))  # characters from each place to the word's end
        self.size = np.minimum(SHORTEST, left)
        self.n = np.zeros(len(data), np.int64)  # words with the gram, or a bound above, where the dictionary has it
        walking = np.flatnonzero(left >= SHORTEST)
        for length in range(SHORTEST, LONGEST):
            self.n[walking] = counts = self.words_with(_gram(self._whole, walking, length))
            walking = walking[(counts > 0) & (left[walking] > length)]
            self.size[walking] = length + 1

    def words_with(self, grams: np.ndarray) -> np.ndarray:
        if not len(self._frequent):
            return np.zeros(len(grams), np.int64)
        at = np.minimum(np.searchsorted(self._frequent, grams), len(self._frequent) - 1)
        return np.where(self._frequent[at] == grams, self._counts[at], 0)

    def grams(self, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return _gram(self._whole, places, sizes)

    def cut_count(self, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Words with grams of these sizes, or with their first six characters."""
        return self.words_with(self.grams(places, np.minimum(sizes, LONGEST - 1)))

    def chosen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place and size of the left gram, place of the right gram) of each word: two grams that don't overlap, in
        the fewest words that are known. Every near word has the left one at its distance from the start or the right one at its distance from the end.

        Where even the first gram reaches into the last three characters, it is cut to end before them.
        """
        left, sizes, right = self.starts.copy(), self.lengths - SHORTEST, self.ends - SHORTEST
        none = np.iinfo(np.int64).max // 4
        cost = np.full(len(left), none)
        best, best_cost = self.starts.copy(), np.full(len(left), none)  # of the grams that end by the place reached
        for distance in range(SHORTEST, min(int(self.lengths.max(initial=0)), _PLACES)):
            words = np.flatnonzero(self.lengths >= distance + SHORTEST)
            for size in range(SHORTEST, min(LONGEST, distance) + 1):
                begin = self.starts[words] + distance - size
                better = (self.size[begin] == size) & (self.n[begin] < best_cost[words])
                best[words[better]], best_cost[words[better]] = begin[better], self.n[begin[better]]
            place = self.starts[words] + distance
            total = best_cost[words] + self.n[place]
            better = total < cost[words]
            at = words[better]
            cost[at], left[at], sizes[at], right[at] = total[better], best[at], self.size[best[at]], place[better]
        return left, sizes, right


def _salts(n: np.ndarray) -> np.ndarray:
    return n // _SALTED_FROM + 1


_INDEX = "gram long, spot long, salt long, word string, n long, letters long"
_PROBES = "gram long, spot long, salts long, word string, letters long, left_at int, left_size int, by_left boolean"


def _arrays(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [field.strip().split(" ") for field in schema.split(",")]
    return pa.RecordBatch.from_arrays([
        column if isinstance(column, pa.Array) else pa.array(column.view(np.int64) if column.dtype == np.uint64 else column, kinds[kind])
        for column, (_, kind) in zip(columns, fields, strict=True)
    ], names=[name for name, _ in fields])


def gram_index(words: DataFrame, dictionary: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """A row for every word, gram and side: the gram at its distance from the start (even spots) or from the end (odd ones).

    Short words whose first gram is long are also listed under it as cut for words of their length, one less and one more.
    Grams in many words are dealt over several salts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).to_pylist()
            grams = Grams(names, dictionary)
            used = np.minimum(grams.lengths - SHORTEST + 1, _PLACES + 2)
            word = np.repeat(np.arange(len(names)), used)
            offset = np.arange(len(word)) - np.repeat(np.cumsum(used) - used, used)
            place = grams.starts[word] + offset
            size = grams.size[place]
            parts = [(word, place, size, 2 * offset), (word, place, size, 2 * (grams.lengths[word] - offset) + 1)]
            for cut in range(SHORTEST, LONGEST):
                short = np.flatnonzero((np.abs(grams.lengths - SHORTEST - cut) <= 1) & (grams.size[grams.starts] > cut))
                parts.append((short, grams.starts[short], np.full(len(short), cut), np.zeros(len(short), np.int64)))
            word, place, size, spot = (np.concatenate(part) for part in zip(*parts))
            salts = _salts(grams.cut_count(place, size))
            salt = mixed(np.arange(len(names), dtype=np.uint64) + grams.letters)[word] % salts.astype(np.uint64)
            at = pa.array(word)
            yield _arrays(_INDEX, [grams.grams(place, size), spot, salt, batch.column(0).take(at), batch.column(1).take(at), grams.letters[word]])

    return words.select("word", "n").mapInArrow(run, _INDEX)


def gram_probes(words: DataFrame, dictionary: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Two rows for every word: its chosen left gram by distance from the start, its right one by distance from the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            grams = Grams(batch.column(0).to_pylist(), dictionary)
            left, size, right = grams.chosen()
            left_at = (left - grams.starts).astype(np.int32)
            for place, sizes, spot, by_left in (
                (left, size, 2 * (left - grams.starts), True), (right, grams.size[right], 2 * (grams.ends - right) + 1, False),
            ):
                yield _arrays(_PROBES, [
                    grams.grams(place, sizes), spot, _salts(grams.cut_count(place, sizes)), batch.column(0), grams.letters, left_at,
                    size.astype(np.int32), np.full(len(left), by_left),
                ])

    return words.select("word").mapInArrow(run, _PROBES)


def near_words(words: DataFrame, max_grams: int = 500_000, min_words: int = 20) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words that differ by exactly one inserted, deleted or replaced character.

    `words` holds distinct Latin-1 words of at least 7 characters with their n, stored. Candidates meet under a gram;
    letters that both hold, then the edit distance itself, decide. A pair is found once: under the left gram, or
    under the right one where the near word doesn't have the left one in its place.
    """
    dictionary = frequent_grams(words, max_grams, min_words)
    index = gram_index(words, dictionary).select("gram", "spot", "salt", F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("letters").alias("near_letters"))
    probes = gram_probes(words, dictionary).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))

    def left_part(column: str) -> Column:
        return F.col(column).substr(F.col("left_at") + 1, F.col("left_size"))

    return probes.join(index, ["gram", "spot", "salt"]).where(
        (F.abs(F.length("word") - F.length("near")) <= 1) & (F.bit_count(F.col("letters").bitwiseXOR(F.col("near_letters"))) <= 2)
        & (F.col("by_left") | (left_part("word") != left_part("near"))) & (F.levenshtein("word", "near", 1) == 1)
    ).select("word", "near", "near_n")


def variants(words: DataFrame, times: int = 10, **limits: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of `words` (word, n).

    A word's form is its near word of largest n, of equal ones the first in code-point order,
    where that n is at least `times` its own; root follows forms to the last. An empty table gives none.
    """
    words = store(words.select("word", "n"), "words")
    near = near_words(words, **limits).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus_n"), "near")).alias("best"))
    is_form = -F.col("best.minus_n") >= times * F.col("n")
    found = store(words.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, -F.col("best.minus_n")).alias("form_n"),
    ), "word-forms")
    # Each step multiplies n, so a chain has at most 63 of them: six doublings reach every root.
    roots = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        roots = store(roots, "word-roots")
        after = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(after, "root", "left_semi").isEmpty():
            break
        roots = roots.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, damaged_every: int | None = 31, min_count: int = 2, **limits: int) -> DataFrame:
    """`variants` of the words of whole texts that occur at least `min_count` times; other columns of `docs` are ignored."""
    return variants(word_counts(docs, damaged_every).where(F.col("n") >= min_count), **limits)
