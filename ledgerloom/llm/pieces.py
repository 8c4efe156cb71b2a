"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies, in Arrow batches.

Encoding keeps an agenda of adjacent symbol pairs that form a piece, ordered by score and then position, and merges the
best until none is left; symbols that are no piece fall back to bytes. Pieces never hold a space mark after another
character and never a line feed, so texts are cut there first and each distinct cut is worked out once while a task
remembers it. The agendas of all new cuts of a batch are the rows of one matrix, merged in step; a long cut has a heap.
A vocabulary for which that doesn't hold is worked out on whole texts.

Every cut that is worked out is also encoded by the sentencepiece library, and a sample of whole texts, spread by hash, is
encoded and decoded by it; a difference ends the job.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import slices, table

MARK = "▁"
#: Distinct cuts whose pieces a task remembers, in two generations of as many: those that come up again are carried over
#: when a generation is full. Bounds a task's memory (about 220 bytes each); nothing is kept from task to task.
REMEMBERED = 200_000
#: Longest cut, in characters, that is remembered and merged in a matrix; rows of such a matrix.
LONGEST_KEPT, ROWS = 64, 4096
#: One whole text in so many, by CRC of the text, is held against the library.
SAMPLED = 64
_NEVER = np.iinfo(np.int32).max


class PieceCodec:
    """A merge-type sentencepiece vocabulary: the model file's pieces and scores, our encoder and decoder."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        sp, n = self.library, self.library.get_piece_size()
        if sp.normalize(" A ﬁ  ") != MARK * 2 + "A ﬁ" + MARK * 2:
            raise ValueError("only vocabularies without normalisation, with a space mark in front, are known here")
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.cost = {p: -sp.get_score(i) for p, i in self.ids.items()}  # the lowest is merged first
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.rare = special
        self.control = {i for i in special if i not in self.bytes_of}
        #: What an id decodes to wherever it stands, by the id in decimal: pieces, and bytes below 128.
        self.plain = {str(i): p.replace(MARK, " ") for p, i in self.ids.items()}
        self.plain |= {str(i): chr(b) for b, i in enumerate(self.byte_ids[:128])}
        whole = any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids)
        self.cuts = re.compile(".+" if whole else " *[^ \n]+| +|\n", re.DOTALL).findall
        self.lead = None if whole else sp.encode("\n")
        self._pair_table()
        self.known: dict[str, str] = {}
        self.before = self.known

    def _pair_table(self) -> None:
        """Codes of characters and pieces, and what each pair of codes merges to: sorted keys, merged codes, cost ranks."""
        n = len(self.pieces)
        code = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p}):
            code.setdefault(c, n + len(code))  # a character that only pieces hold
        self.base = max(code.values()) + 1
        self.of_char = np.arange(-2, -2 - 0x110000, -1, dtype=np.int32)  # -2 - c: no piece holds it
        for p, i in code.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        _, ranks = np.unique([self.cost[p] for p in self.ids], return_inverse=True)
        rank = dict(zip(self.ids, ranks.tolist(), strict=True))
        pairs = {
            code[p[:k]] * self.base + code[p[k:]]: (i, rank[p])
            for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in code and p[k:] in code
        }
        self.keys = np.array(sorted(pairs) or [-1], dtype=np.int64)
        self.merged = np.array([pairs[k][0] for k in sorted(pairs)] or [-1], dtype=np.int32)
        self.ranks = np.array([pairs[k][1] for k in sorted(pairs)] or [_NEVER], dtype=np.int32)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair of codes: the code that they merge to, and the rank of its cost (_NEVER if they don't)."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.base + right, -2)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.merged[at], np.int32(-1)), np.where(hit, self.ranks[at], np.int32(_NEVER))

    def forget(self) -> None:
        self.known = self.before = {}

    def _numbers(self, codes: list[int]) -> list[int]:
        """Codes as ids: a character without a piece becomes its bytes."""
        out = []
        for c in codes:
            if 0 <= c < len(self.pieces):
                out.append(c)
            else:
                char = chr(-2 - c) if c < 0 else chr(int(np.flatnonzero(self.of_char == c)[0]))
                out += [self.byte_ids[b] for b in char.encode()]
        return out

    def _merged_rows(self, words: list[str]) -> list[list[int]]:
        """Ids of words whose spaces are marks already. Each row of the matrix is a word's agenda: costs by position."""
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max())
        mat = np.full((len(words), width + 1), -1, dtype=np.int32)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        mat[:, :width][np.arange(width) < sizes[:, None]] = self.of_char[flat]
        into, cost = self._pairs(mat[:, :-1], mat[:, 1:])
        out = mat.copy()
        rows, place = np.arange(len(words)), np.arange(width + 1)
        while len(rows):
            best = cost.argmin(axis=1)
            every = np.arange(len(rows))
            open_ = cost[every, best] != _NEVER
            if not open_.all():
                out[rows[~open_]] = mat[~open_]
                rows, mat, into, cost, best = rows[open_], mat[open_], into[open_], cost[open_], best[open_]
                every = np.arange(len(rows))
                if not len(rows):
                    break
            mat[every, best] = into[every, best]
            # what stands behind the merged pair moves up by one, in the word and in its agenda
            behind = np.minimum(place + (place > best[:, None]), width)
            mat = np.take_along_axis(mat, behind, axis=1)
            mat[:, -1] = -1
            behind = np.minimum(place[:-1] + (place[:-1] >= best[:, None]), width - 1)
            into, cost = np.take_along_axis(into, behind, axis=1), np.take_along_axis(cost, behind, axis=1)
            cost[:, -1] = _NEVER
            now = mat[every, best]
            into[every, best], cost[every, best] = self._pairs(now, mat[every, best + 1])
            prior = np.maximum(best - 1, 0)
            merged, ranks = self._pairs(mat[every, prior], now)
            some = best > 0
            into[every[some], prior[some]], cost[every[some], prior[some]] = merged[some], ranks[some]
        ends = (out != -1).sum(axis=1)
        common = (((out >= 0) & (out < len(self.pieces))) | (out == -1)).all(axis=1)
        listed = [r[:e] for r, e in zip(out.tolist(), ends.tolist(), strict=True)]
        return [r if c else self._numbers(r) for r, c in zip(listed, common.tolist(), strict=True)]

    def _merged_many(self, text: str) -> list[int]:
        """The agenda as a heap over linked symbols: time n log n for a cut of any length."""
        symbols, cost = list(text), self.cost
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(cost[p], i, i + 1, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in cost]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, p = heapq.heappop(agenda)
            if not symbols[i] or after[i] != j or symbols[i] + symbols[j] != p:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = p, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (q := p + symbols[k]) in cost:
                    heapq.heappush(agenda, (cost[q], i, k, q))
            h = before[i]
            if h >= 0 and (q := symbols[h] + p) in cost:
                heapq.heappush(agenda, (cost[q], h, i, q))
        return [k for s in symbols if s for k in ([self.ids[s]] if s in self.ids else [self.byte_ids[b] for b in s.encode()])]

    def _worked_out(self, cuts: list[str]) -> list[str]:
        """The ids of each cut, joined by commas; each is held against the library's."""
        words = [c.replace(" ", MARK) for c in cuts]
        ids: list[list[int]] = [[]] * len(cuts)
        order = sorted((i for i, w in enumerate(words) if len(w) <= LONGEST_KEPT), key=lambda i: len(words[i]))
        for begin in range(0, len(order), ROWS):
            part = order[begin : begin + ROWS]
            for i, got in zip(part, self._merged_rows([words[i] for i in part]), strict=True):
                ids[i] = got
        for i, w in enumerate(words):
            if len(w) > LONGEST_KEPT:
                ids[i] = self._merged_many(w)
        if self.lead is not None:  # behind a line feed a cut stands as it does inside a text
            lead = self.lead
            for cut, own, want in zip(cuts, ids, self.library.encode(["\n" + c for c in cuts], num_threads=1), strict=True):
                if want != lead + own:
                    raise AssertionError(f"encoded unlike the library: {cut[:200]!r}")
        return [",".join(map(str, x)) for x in ids]

    def encode_many(self, texts: list[str]) -> list[str]:
        """For each text its ids joined by commas."""
        cut = [self.cuts(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        ids: dict[str, str | None] = dict.fromkeys(chain.from_iterable(cut))
        known, before = self.known.get, self.before.get
        ids = {c: known(c) or before(c) for c in ids}
        fresh = [c for c, got in ids.items() if got is None]
        if fresh:
            ids.update(zip(fresh, self._worked_out(fresh), strict=True))
        out = [",".join(map(ids.__getitem__, cs)) for cs in cut]
        self.known.update(ids if max(map(len, ids), default=0) <= LONGEST_KEPT else {c: x for c, x in ids.items() if len(c) <= LONGEST_KEPT})
        if len(self.known) >= REMEMBERED:
            self.before, self.known = self.known, {}
        return out

    def _joined(self, ids: list[int]) -> str:
        """Pieces side by side, runs of bytes read as UTF-8 and spaces where marks are."""
        if self.rare.isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        out, run = [], bytearray()
        for i in ids:
            b = self.bytes_of.get(i)
            if b is None:  # a piece, or a control id, which also ends a run of bytes
                if run:
                    out.append(_read(run))
                    run.clear()
                if i not in self.control:
                    out.append(self.pieces[i].replace(MARK, " "))
            else:
                run.append(b)
        if run:
            out.append(_read(run))
        return "".join(out)

    def encode(self, text: str) -> list[int]:
        joined = self.encode_many([text])[0]
        return list(map(int, joined.split(","))) if joined else []

    def decode(self, ids: list[int]) -> str:
        """As the library does: the mark in front of the first piece goes, malformed bytes become U+FFFD."""
        text = self._joined(ids)
        first = next((i for i in ids if i not in self.control), None)
        return text[1:] if first is not None and self.pieces[first].startswith(MARK) else text

    def decode_joined(self, ids: str) -> str:
        """`decode` of ids in decimal, joined by commas. Pieces and bytes below 128 decode alike wherever they stand."""
        if not ids:
            return ""
        plain = self.plain
        try:
            text = "".join([plain[i] for i in ids.split(",")])
        except KeyError:
            return self.decode(list(map(int, ids.split(","))))
        return text[1:] if self.pieces[int(ids.partition(",")[0])].startswith(MARK) else text

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the text that those ids decode to."""
        return [(x.count(",") + 1 if x else 0, _sha(x), _sha(self.decode_joined(x))) for x in self.encode_many(texts)]

    def check(self, texts: list[str], ids: list[list[int]]) -> None:
        """Raise if the library encodes any of the texts otherwise, or decodes the ids otherwise."""
        if not texts:
            return
        if (want := self.library.encode(texts, num_threads=1)) != ids:
            bad = next(t for t, a, b in zip(texts, want, ids, strict=True) if a != b)
            raise AssertionError(f"encoded unlike the library: {bad[:200]!r}")
        if self.library.decode(ids, num_threads=1) != [self.decode(x) for x in ids]:
            raise AssertionError("decoded unlike the library")

    def check_sample(self, texts: list[str], joined: list[str]) -> None:
        """`check` of one text in SAMPLED, chosen by what it says and not by where it stands."""
        chosen = [k for k, t in enumerate(texts) if zlib.crc32(t.encode()) % SAMPLED == 0]
        self.check([texts[k] for k in chosen], [_split(joined[k]) for k in chosen])


def _read(run: bytearray) -> str:
    """Bytes as UTF-8, each byte of a malformed stretch as one U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


_CODECS: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """The codec of a model file, loaded once in each Python worker."""
    if model_path not in _CODECS:
        _CODECS[model_path] = PieceCodec(model_path)
    return _CODECS[model_path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: Text bytes that are encoded at once.
PORTION = 1 << 20


def _split(joined: str) -> list[int]:
    return list(map(int, joined.split(","))) if joined else []


def _id_lists(joined: list[str]) -> pa.Array:
    """Ids joined by commas as lists, read by numpy all at once instead of one by one."""
    flat = np.array(",".join(x for x in joined if x).split(","), dtype=np.int32) if any(joined) else np.zeros(0, dtype=np.int32)
    ends = np.cumsum([x.count(",") + 1 if x else 0 for x in joined], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))


def encode_column(df: DataFrame, text_col: str = "text", name: str = "ids", model_path: str | None = None) -> DataFrame:
    """`df` with the ids of `text_col` in an array column `name` (which must not be there yet).

    Null text is empty and has no ids; no begin or end ids; every row stays, repeated or not; a table without rows gives
    none. Every distinct cut and a sample of texts are held against the library, and a difference ends the job.
    """
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    at, model = df.columns.index(text_col), model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in (part for whole in batches for part in slices(whole, at, PORTION)):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            joined = own.encode_many(texts)
            own.check_sample(texts, joined)
            yield pa.RecordBatch.from_arrays([*batch.columns, _id_lists(joined)], [*batch.schema.names, name])
        own.forget()

    return df.mapInArrow(run, df.select("*", F.array().cast("array<int>").alias(name)).schema)


def decode_column(df: DataFrame, ids_col: str = "ids", name: str = "decoded", model_path: str | None = None) -> DataFrame:
    """`df` with the text that `ids_col` decodes to in a column `name`; null or no ids give an empty text."""
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    at, model = df.columns.index(ids_col), model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            texts = [own.decode(x or []) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return df.mapInArrow(run, df.select("*", F.lit("").alias(name)).schema)


def piece_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: its ids, and the text that these decode to. See
    `encode_column` for nulls and for what is held against the library."""
    model = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model)
        for batch in (part for whole in batches for part in slices(whole, 1, PORTION)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            joined = coder.encode_many(texts)
            coder.check_sample(texts, joined)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x.count(",") + 1 if x else 0 for x in joined], pa.int64()),
                    pa.array([_sha(x) for x in joined], pa.string()),
                    pa.array([_sha(coder.decode_joined(x)) for x in joined], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        coder.forget()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    return own.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"))
