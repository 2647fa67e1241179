"""SentencePiece encoding and decoding by a forward pass over a trie of words.

A text becomes marked words: blanks turn into the mark, one mark is put in
front, and a word begins at each run of marks. No piece has a mark after
another character, so words are encoded one by one. The distinct words of a
batch are sorted, which is the depth-first order of their trie; the forward
cells of a prefix are computed once and kept for all words that share it.

For a unigram model a cell holds the best sum of scores (Viterbi). For a merge
(BPE) model sums of scores give wrong pieces, so there a cell holds the last
piece of the prefix's own encoding: the one piece that ends there and stays
next to the piece before it when both are merged anew. It too depends on the
prefix alone, and following the cells back gives exactly the merges' result.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import compress, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: Where the public tokenizers lie; a parameter of every function here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes for each generation of words in a worker of digest, which runs alone; encode's default leaves room for stages beside it.
DIGEST_CACHE = 96_000_000


@dataclass
class Vocabulary:
    """Pieces by text with id and score; ids of the 256 byte pieces, if any; the unknown id."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    unknown: int = 0
    kind: str = "bpe"
    beside: dict[str, dict[str, bool]] = field(default_factory=dict)  # by right piece, then left piece ("" at a word's start)
    spines: dict[str, tuple | None] = field(default_factory=dict)
    checked: int = 0

    def __post_init__(self) -> None:
        self.ids = {p: i for p, (i, _) in self.pieces.items()}
        self.ends: dict = {}  # a trie of the pieces read backwards; "" marks a piece
        for piece in self.pieces:
            self.beside[piece], node = {}, self.ends
            for c in reversed(piece):
                node = node.setdefault(c, {})
            if len(piece) > 1:
                node[""] = (piece, self.beside[piece], self.pieces[piece][1])
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece holds a mark inside; words can't be encoded one by one")
        if self.kind not in ("bpe", "unigram"):
            raise ValueError("kind must be bpe or unigram")
        lone_lines = "\n" not in "".join(self.pieces)
        self.words = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+" if lone_lines else f"{MARK}+[^{MARK}]*")
        self.least = min((s for _, s in self.pieces.values()), default=0.0) - 10.0

    def merged(self, text: str) -> tuple[list[str], str]:
        """The pieces of a short text by merging, best score first, leftmost of equals; and the left half of the last merge."""
        parts, half = list(text), ""
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.pieces.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found[1] > best):
                    best, at = found[1], i
            if at < 0:
                return parts, half
            half = parts[at]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def edges(self, piece: str) -> tuple[list[tuple[str, float]], list[tuple[str, float]]] | None:
        """What stands at the left and at the right edge of a piece while it is merged.

        Each is a list of growing parts, with the score of the merge that ends
        the part's time (-inf for the piece itself). None if merging does not
        give this one piece, or not in the order of falling scores.
        """
        if piece not in self.spines:
            last = (piece, -math.inf)
            if len(piece) == 1:
                self.spines[piece] = [last], [last]
            else:
                parts, half = self.merged(piece)
                left, right = (self.edges(half), self.edges(piece[len(half) :])) if parts == [piece] else (None, None)
                score = self.pieces.get(piece, (0, 0.0))[1]
                if left is None or right is None or any(len(h) > 1 and self.pieces[h][1] <= score for h in (half, piece[len(half) :])):
                    self.spines[piece] = None
                else:
                    self.spines[piece] = [*left[0][:-1], (half, score), last], [*right[1][:-1], (piece[len(half) :], score), last]
        return self.spines[piece]

    def check(self, left: str, right: str) -> bool:
        """Whether right stays one piece behind left when both are merged anew; the answer is kept.

        It does unless some part at left's right edge and some part at right's
        left edge, while both stand there, make a piece whose score comes first.
        """
        if self.checked > 100_000:
            self.checked = 0
            for known in self.beside.values():
                known.clear()
        self.checked += 1
        own, other = self.edges(right), self.edges(left) if left else None
        if own is None or left and other is None:
            out = self.merged(left + right)[0] == ([left, right] if left else [right])
        else:
            out = True
            if left:
                a, b, i, j = other[1], own[0], 0, 0
                while True:
                    (x, x_ends), (y, y_ends) = a[i], b[j]
                    crossing = self.pieces.get(x + y)
                    if crossing is not None and crossing[1] > x_ends and crossing[1] >= y_ends:
                        out = False
                        break
                    if x_ends == y_ends == -math.inf:
                        break
                    if x_ends >= y_ends:
                        i += 1
                    else:
                        j += 1
        self.beside[right][left] = out
        return out

    def ids_of(self, piece: str) -> list[int]:
        if (found := self.pieces.get(piece)) is not None:
            return [found[0]]
        return [self.byte_ids[b] for b in piece.encode("utf-8", "replace")] if self.byte_ids else [self.unknown]

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Each of the sorted words with its ids. lasts[i] and totals[i] are the forward cell of the current path's first i characters."""
        pieces, ends, bpe, ids = self.pieces, self.ends, self.kind == "bpe", self.ids
        lasts, totals, before = [""], [0.0], ""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del lasts[shared + 1 :], totals[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                last, node, start, found = word[i - 1], ends, i, []
                while start and (node := node.get(word[start - 1])) is not None:
                    start -= 1
                    if "" in node:
                        found.append((start, node[""]))
                if bpe:
                    for start, (piece, known, _) in reversed(found):
                        left = lasts[start]
                        if (stays := known.get(left)) is None:
                            stays = self.check(left, piece)
                        if stays:
                            last = piece
                            break
                else:
                    best = totals[i - 1] + pieces.get(last, (0, self.least))[1]
                    for start, (piece, _, score) in found:
                        if totals[start] + score > best:
                            best, last = totals[start] + score, piece
                    totals.append(best)
                lasts.append(last)
            back, i = [], len(word)
            while i:
                back.append(lasts[i])
                i -= len(lasts[i])
            back.reverse()
            try:
                yield word, [ids[piece] for piece in back]
            except KeyError:
                yield word, [x for piece in back for x in self.ids_of(piece)]
            before = word

    def split(self, text: str) -> Iterator[str]:
        """The marked words of a text without a mark in front; a line end that no piece holds stands alone."""
        return map(re.Match.group, self.words.finditer(text))


_loaded: dict[tuple[str, str], Vocabulary] = {}
_tables: dict[str, list[bytes]] = {}
_known: dict[tuple[str, str], WordCache] = {}


def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def vocabulary(path: str = MODEL, kind: str = "bpe") -> Vocabulary:
    """The pieces of a SentencePiece model file; `kind` says how it was trained."""
    if (path, kind) not in _loaded:
        model = _model(path)
        n = model.get_piece_size()
        usual = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        byte_ids = [i for i in range(n) if model.is_byte(i)]
        _loaded[path, kind] = Vocabulary({model.id_to_piece(i): (i, model.get_score(i)) for i in usual}, byte_ids if len(byte_ids) == 256 else [], model.unk_id(), kind)
    return _loaded[path, kind]


def byte_table(path: str = MODEL) -> list[bytes]:
    """The bytes that each id stands for; all that decoding needs of a model."""
    if path not in _tables:
        model = _model(path)
        table = []
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                table.append(bytes([int(model.id_to_piece(i)[1:-1], 16)]))
            elif model.is_unknown(i):
                table.append(" \u2047 ".encode())
            elif model.is_control(i):
                table.append(b"")
            else:
                table.append(model.id_to_piece(i).replace(MARK, " ").encode("utf-8", "replace"))
        _tables[path] = table
    return _tables[path]


class WordCache:
    """Ids of words met before, in two generations of about `most` bytes each.

    What the young one holds is the old one when it is full, and what is met
    again becomes young. Long words are never kept, so the bound holds for
    texts without blanks too.
    """

    LONGEST, ENTRY = 64, 250

    def __init__(self, model: Vocabulary, most: int):
        self.model, self.most, self.held = model, most, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _keep(self, word: str, ids: bytes) -> None:
        if len(word) <= self.LONGEST:
            self.young[word] = ids
            self.held += self.ENTRY + len(word) + len(ids)

    def ids_of(self, rows: list[list[str]]) -> list[bytes]:
        """The ids of each list of words, as little-endian 32-bit numbers."""
        if self.held > self.most:
            self.young, self.old, self.held = {}, self.young, 0
        # one lookup a word; only words that the young generation lacks are gathered
        known = [list(map(self.young.get, words)) for words in rows]
        missing = set().union(*(compress(words, [x is None for x in found]) for words, found in zip(rows, known, strict=True) if None in found))
        fresh, once = [], {}
        for word in missing:
            if (found := self.old.get(word)) is None:
                fresh.append(word)
            else:
                once[word] = found
                self._keep(word, found)
        fresh.sort()
        for word, found in self.model.encode_words(fresh):
            once[word] = ids = array("i", found).tobytes()
            self._keep(word, ids)
        return [b"".join([once[w] if x is None else x for w, x in zip(words, found, strict=True)] if None in found else found) for words, found in zip(rows, known, strict=True)]


def _marked_rows(model: Vocabulary, raw: bytes, offs: list[int], most: int) -> Iterator[tuple[int, list[list[str]]]]:
    """Marked words by rows, as (rows that end here, words): a row beyond `most` words comes in several parts."""
    rows: list[list[str]] = []
    held = 0
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        words: list[str] = []
        if b > a:
            text = MARK + raw[a:b].decode("utf-8", "replace").replace(" ", MARK)
            if len(text) < most:  # it has no more words than characters
                words = model.words.findall(text)
            else:
                words = list(islice(found := model.split(text), most))
                while len(words) == most:
                    yield len(rows), [*rows, words]
                    rows, held, words = [], 0, list(islice(found, most))
        rows.append(words)
        held += len(words)
        if held > most:
            yield len(rows), rows
            rows, held = [], 0
    if rows:
        yield len(rows), rows


def _text_of(table: list[bytes], ids: list[int]) -> str:
    joined = b"".join(map(table.__getitem__, ids))
    return (joined[1:] if joined[:1] == b" " else joined).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str = MODEL, kind: str = "bpe", ids: str = "ids", decoded: str | None = None, cache_bytes: int = 24_000_000) -> DataFrame:
    """docs with an array<int> of piece ids added; null and empty texts have none.

    `decoded` names a further column: the text that the ids give back, made in
    the same pass. Whole texts of any length are encoded, in slices of words,
    so that a worker holds the ids of a text but never all its words; a word's
    ids are kept for later batches of the worker, within cache_bytes for each
    of two generations. The file at `path` is read where the tasks run. Columns
    of these names are replaced, others pass through, rows that repeat are
    encoded alike, and an empty table gives an empty result.
    """
    docs = docs.drop(ids, *([decoded] if decoded else []))
    at = docs.columns.index("text")
    added = f"`{ids}` array<int>" + (f", `{decoded}` string" if decoded else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(path, kind)
        cache = _known.setdefault((path, kind), WordCache(model, cache_bytes))
        cache.most = cache_bytes
        for batch in batches:
            for first, end, text, offs in common.chunks(batch.column(at)):
                out: list[bytes] = []
                parts: list[bytes] = []
                for ended, rows in _marked_rows(model, text.tobytes(), offs.tolist(), 1 << 17):
                    found = cache.ids_of(rows)
                    if ended:
                        out.append(b"".join([*parts, found[0]]))
                        out += found[1:ended]
                        parts = []
                    parts += found[ended:]
                values = np.frombuffer(b"".join(out), "<i4")
                cuts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in out])]).astype(np.int32)
                more = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(values))]
                if decoded:
                    table = byte_table(path)
                    more.append(pa.array([_text_of(table, values[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string()))
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*batch.schema.names, ids, *([decoded] if decoded else [])])

    return docs.mapInArrow(run, common.widened(docs, added))


def decode(encoded: DataFrame, path: str = MODEL, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """encoded with the text of its ids added; null ids give the empty text, and bytes that are no UTF-8 become U+FFFD."""
    encoded = encoded.drop(text)
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(path)
        for batch in batches:
            column = batch.column(at).fill_null([]) if batch.column(at).null_count else batch.column(at)
            values, offs = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            out = [_text_of(table, values[a:b].tolist()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, text])

    return encoded.mapInArrow(run, common.widened(encoded, f"`{text}` string"))


def digest(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_hash (xxhash64 of the ids), decoded_sha256 and round_trip (the decoded text equals the text).

    Nothing else runs in these workers, so they keep four times the words that encode keeps by default.
    """
    both = encode(docs.select("doc_id", "text"), path, decoded="decoded", cache_bytes=DIGEST_CACHE)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), same.alias("round_trip"))
