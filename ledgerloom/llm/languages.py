"""Language of texts by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of its code point, so any script works and no alphabet is
stored. An n-gram's vector binds those of its letters: each is rotated by its distance from the n-gram's end, and they are
multiplied. A text's vector bundles (adds) its n-grams' vectors; a language's prototype bundles those of all its texts.
A text gets the language whose prototype has the largest cosine with its own vector.

All sums are of whole numbers and exact, so a result doesn't depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut_lineage, mix64, slices, table, text_bytes
from ledgerloom.llm.quality import held_out

#: Numbers of a vector (a multiple of 64), letters of an n-gram.
DIMS, LETTERS = 1024, 3
#: n-grams whose vectors are made at once, n-grams and prototypes that a task counts before it passes them on.
BLOCK, COUNTED, PROTOTYPES = 4096, 1 << 18, 1024
UNKNOWN = "und"
_SPACE = 32
_CODE = 21  # bits of a code point


def letter_vectors(codes: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """A row of `dims` numbers +1 or -1 for each code point."""
    words = mix64(mix64(codes.astype(np.uint64) + np.uint64(1))[:, None] + np.arange(1, dims // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bits = np.unpackbits(words.astype("<u8").view(np.uint8), axis=1)
    return (bits.astype(np.int8) << 1) - 1


def gram_vectors(grams: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Bound vectors of n-grams, whose letters lie in 21 bits each."""
    out = np.ones((len(grams), dims), dtype=np.int8)
    for k in range(LETTERS):
        codes, at = np.unique(grams >> (_CODE * k) & ((1 << _CODE) - 1), return_inverse=True)
        out *= np.roll(letter_vectors(codes, dims), k, axis=1)[at]
    return out


#: What each code point reads as; -1 until it is first met.
_READ = np.full(0x110000, -1, dtype=np.int32)


def _read(codes: np.ndarray) -> np.ndarray:
    """Letters in lower case, anything else as a space."""
    out = _READ[codes]
    if (fresh := out < 0).any():
        for code in np.unique(codes[fresh]).tolist():
            c = chr(code)
            _READ[code] = ord(c.lower()[0]) if c.isalpha() else _SPACE
        out = _READ[codes]
    return out


def gram_counts(texts: list[bytes], owners: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, count) of the n-grams of each text, or of all texts of an owner. Letters are in lower case; a stretch of
    other characters counts as one space, and so do both ends. A text without a letter has none."""
    shown = [t.decode("utf-8", "replace") for t in texts]
    # a space before each text and behind it
    codes = np.frombuffer(" ".join(["", *[x for t in shown for x in (t, "")]]).encode("utf-32-le"), dtype=np.uint32)
    text = np.repeat(np.arange(len(shown)), [len(t) + 2 for t in shown])
    letters = _read(codes[: len(text)])
    space = letters == _SPACE
    kept = ~space
    kept[1:] |= ~space[:-1] | (text[1:] != text[:-1])
    kept[:1] = True
    letters, text = letters[kept], text[kept]
    alphabet = _distinct(letters)
    k = len(alphabet)
    owners = np.arange(len(texts)) if owners is None else owners
    if len(texts) > 1 and (int(owners.max()) + 1) * k**LETTERS >= 1 << 62:  # too many letters for one number a pair
        half = len(texts) // 2
        parts = [gram_counts(texts[:half], owners[:half]), gram_counts(texts[half:], owners[half:])]
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))
    place = np.zeros(int(alphabet[-1]) + 1 if k else 1, dtype=np.int64)
    place[alphabet] = np.arange(k)
    letters = place[letters]
    n = max(0, len(letters) - LETTERS + 1)
    grams = np.zeros(n, dtype=np.int64)
    for j in range(LETTERS):
        grams = grams * k + letters[j : j + n]
    own = text[:n] == text[LETTERS - 1 :][:n]
    pairs, counts = np.unique(owners[text[:n][own]] * k**LETTERS + grams[own], return_counts=True)
    rest = pairs % max(1, k**LETTERS)
    grams = np.zeros(len(pairs), dtype=np.int64)
    for j in range(LETTERS):
        grams |= alphabet[rest % max(1, k)].astype(np.int64) << (_CODE * j)
        rest //= max(1, k)
    return pairs // max(1, k**LETTERS), grams, counts


def _distinct(letters: np.ndarray) -> np.ndarray:
    seen = np.zeros(len(_READ), dtype=bool)
    seen[letters] = True
    return np.flatnonzero(seen)


def text_vectors(texts: list[bytes], dims: int = DIMS) -> np.ndarray:
    """Bundled vectors, one row a text; zero for a text without letters."""
    return _bundle(*gram_counts(texts), len(texts), dims)


def _bundle(row: np.ndarray, gram: np.ndarray, count: np.ndarray, rows: int, dims: int) -> np.ndarray:
    out = np.zeros((rows, dims))
    if not len(gram):
        return out
    names, number = np.unique(gram, return_inverse=True)
    # whole numbers below 2**24 are exact in single precision, in any order of summation
    kind = np.float32 if np.bincount(row, weights=count, minlength=1).max() < 1 << 24 else np.float64
    for begin in range(0, len(names), BLOCK):
        block = names[begin : begin + BLOCK]
        here = (number >= begin) & (number < begin + len(block))
        table = np.zeros((rows, len(block)), dtype=kind)
        table[row[here], number[here] - begin] = count[here]
        out += table @ gram_vectors(block, dims).astype(kind)
    return out


def language_prototypes(df: DataFrame, lang_col: str = "lang", text_col: str = "text", dims: int = DIMS) -> DataFrame:
    """(lang, sums): the prototype of each language of `df`, bundled from all its rows.

    A task counts n-grams by language, binds and adds each vector once, and passes prototypes on; those are added up by language
    and place, so a language with most of the rows is no hot key: each task has one row of it for each place. Rows without a
    language don't count, null texts are empty; a language without letters has no prototype. No rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        held: list[tuple[np.ndarray, ...]] = []

        def joined() -> tuple[np.ndarray, ...]:
            owner, gram, count = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((gram, owner))
            owner, gram, count = owner[order], gram[order], count[order]
            first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])])[: len(gram)])
            return owner[first], gram[first], np.add.reduceat(count, first) if len(first) else count

        def settled() -> pa.RecordBatch:
            sums = _bundle(*joined(), len(number), dims)
            real = sums.any(axis=1)
            rows = [x.astype(np.int64) for x in sums[real]]
            names = [name for name, i in number.items() if real[i]]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(rows, pa.list_(pa.int64()))], ["lang", "sums"])

        size = 0
        for batch in (part for whole in batches for part in slices(whole, 1)):
            owners = np.array([number.setdefault(x, len(number)) for x in batch.column(0).to_pylist()], dtype=np.int64)
            held.append(gram_counts(text_bytes(batch.column(1)), owners))
            size += len(held[-1][0])
            if size > COUNTED:
                held = [joined()]
                size = len(held[0][0])
            if size > COUNTED // 2 or len(number) > PROTOTYPES:
                yield settled()
                number, held, size = {}, [], 0
        if held:
            yield settled()

    known = df.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("body"))
    parts = known.mapInArrow(run, "lang string, sums array<long>")
    summed = parts.select("lang", F.posexplode("sums").alias("place", "s")).groupBy("lang", "place").agg(F.sum("s").alias("s"))
    placed = F.array_sort(F.collect_list(F.struct("place", "s")))  # dims numbers
    return summed.groupBy("lang").agg(placed.alias("placed")).select("lang", F.transform("placed", lambda x: x["s"]).alias("sums"))


def predict_languages(
    df: DataFrame, prototypes: DataFrame, text_col: str = "text", name: str = "lang_pred", score: str = "lang_score", most: int = PROTOTYPES
) -> DataFrame:
    """`df` with the language whose prototype is nearest to each whole text, and their cosine (0 where it is negative).

    Equal cosines (to nine places) give the language that comes first by code points. A text that is null or has no letter is
    `und` with 0, and so are all if there is no prototype. Every row stays, judged by its own text, repeated or not; other
    columns are kept, and the two new names must not be there yet.

    About half of `most` prototypes are compared at a time, so neither the driver nor a task ever holds more than a few
    megabytes of them; with more languages than that, texts are compared with one part of them after another.
    """
    for column in (name, score):
        if column in df.columns:
            raise ValueError(f"there is a column {column} already")
    prototypes = cut_lineage(prototypes)
    parts = max(1, -(-prototypes.count() * 2 // most)) if prototypes.count() > most else 1
    at = df.columns.index(text_col)
    out = df.select("*", F.lit(None).cast("string").alias(name), F.lit(None).cast("double").alias(score))
    for part in range(parts):
        here = prototypes.where(F.pmod(F.xxhash64("lang"), F.lit(parts)) == part).orderBy("lang").toArrow()
        if not here.num_rows:
            continue
        langs = here["lang"].to_pylist()
        table = here["sums"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(langs), -1).astype(float)
        out = out.mapInArrow(_nearest(langs, table / np.linalg.norm(table, axis=1)[:, None], at), out.schema)
        out = cut_lineage(out) if parts > 1 else out
    return out.withColumns({name: F.coalesce(name, F.lit(UNKNOWN)), score: F.greatest(F.lit(0.0), F.coalesce(score, F.lit(0.0)))})


def _nearest(langs: list[str], prototypes: np.ndarray, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces the last two columns, the nearest language so far and its cosine, where one of `langs` (in order) is nearer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            vectors = text_vectors(text_bytes(batch.column(at)), prototypes.shape[1])
            length = np.linalg.norm(vectors, axis=1)
            cosine = np.round(vectors @ prototypes.T / np.maximum(length, 1)[:, None], 9)
            best = cosine.argmax(axis=1)
            names, scores = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for i in np.flatnonzero(length):
                c, lang = min(1.0, float(cosine[i, best[i]])), langs[best[i]]
                if scores[i] is None or (-c, lang) < (-scores[i], names[i]):
                    names[i], scores[i] = lang, c
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(names, pa.string()), pa.array(scores, pa.float64())], batch.schema.names)

    return run


def op11_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = language_prototypes(docs.where(~held_out()).select("lang", "text"))
    told = predict_languages(docs.select("doc_id", "text"), prototypes)
    return told.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
