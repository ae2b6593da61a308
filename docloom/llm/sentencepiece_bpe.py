"""Operator 6: SentencePiece BPE encoding and decoding in vectorised merge rounds.

The symbols of many words lie in one flat numpy array, beside the rank of each with its right neighbour.
A round takes the minimum rank of each word, merges from the left all pairs of that rank in all words at
once, compacts the array and looks up the new neighbours' ranks; words without a pair leave it, until
none remains. Words of a text are what no piece of the vocabulary crosses, so each is independent; longer
ones are cut wherever two characters stand side by side in no piece. A worker keeps the words that it has
met, up to a number of bytes. The merge rules come from the vocabulary file; the library only normalises
and reads that file.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import steps, table
from docloom.llm.word_cache import WordCache

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Longer words are looked through for places that no piece crosses.
LONG_WORD = 32
NO_RANK = 1 << 40


def model_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class PieceTable:
    """Symbols, pair ranks and byte pieces of a SentencePiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.byte_ids = np.full(256, self.unknown, np.int64)
        self.silent, self.byte_of = set(), {}
        normal = []
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_of[i] = int(piece[3:5], 16)
                self.byte_ids[self.byte_of[i]] = i
            elif sp.is_control(i):
                self.silent.add(i)
            elif not sp.is_unknown(i):
                normal.append(i)
        self.has_bytes = bool(self.byte_of)
        if any(re.search(f"[^{MARK}]{MARK}", self.pieces[i]) for i in normal):
            raise ValueError("a piece goes on after the end of a word; words of this model are not independent")
        ids = {self.pieces[i]: i for i in normal}
        for c in sorted({c for i in normal for c in self.pieces[i]} - ids.keys()):
            ids[c] = n + len(ids)  # part of pieces but none itself
        self.symbols = {c: i for c, i in ids.items() if len(c) == 1}
        self.stranger = max(ids.values()) + 1
        self.bits = int(self.stranger).bit_length()
        scores = np.array([sp.get_score(i) for i in normal], np.float32)
        rank = dict(zip(normal, np.unique(-scores, return_inverse=True)[1].tolist(), strict=True))
        pairs = {}
        for i in normal:
            piece = self.pieces[i]
            for cut in range(1, len(piece)):
                if (a := ids.get(piece[:cut])) is not None and (b := ids.get(piece[cut:])) is not None:
                    pairs[a << self.bits | b] = (rank[i], i)
        self.unsafe = self._unsafe_ranks(pairs)
        longest = max((len(self.pieces[i]) for i in normal), default=1)
        self.apart = 2 * longest + 2
        sides = {piece[i : i + 2] for piece in (self.pieces[i] for i in normal) for i in range(len(piece) - 1)}
        self.sides = np.array(sorted(ord(a) << 32 | ord(b) for a, b in sides), np.int64)
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.int64(1) << 62)
        self.ranks = np.array([*(pairs[int(k)][0] for k in keys), NO_RANK], np.int64)
        self.merged = np.array([*(pairs[int(k)][1] for k in keys), -1], np.int64)
        joined = {c for i in normal if len(self.pieces[i]) > 1 for c in self.pieces[i]}
        alone = "".join(c for c in "\n\t\r\x0b\x0c" if c not in joined)
        gap = f"[{re.escape(alone)}]|" if alone else ""
        words = f"{gap}{MARK}+[^{MARK}{re.escape(alone)}]*|[^{MARK}{re.escape(alone)}]+"
        self.words = re.compile(words).findall
        if most := self._even_rows(normal, rank):
            self.words = re.compile(f"{MARK}{{{most}}}(?={MARK})|{words}").findall
        self.cache = WordCache(self._packed)

    def _even_rows(self, normal: list[int], rank: dict[int, int]) -> int:
        """The marks of the longest piece of nothing else, if every longer row of marks is cut into these from the left: their
        merges come after all others, and rows of up to four times as many show it. Else 0."""
        rows = {len(self.pieces[i]): i for i in normal if len(self.pieces[i]) > 1 and not self.pieces[i].strip(MARK)}
        most = max(rows, default=0)
        last = most and all(rank[i] == max(rank.values()) for i in rows.values()) and not any(re.match(f"{MARK}{MARK}+[^{MARK}]", self.pieces[i]) for i in normal)
        if not last:
            return 0
        ids = self.merge_words([MARK * n for n in range(1, 4 * most + 1)])
        cut = [[rows[most]] * ((n - 1) // most) + ids[(n - 1) % most] for n in range(1, 4 * most + 1)]
        return most if ids == cut else 0

    def _unsafe_ranks(self, pairs: dict[int, tuple[int, int]]) -> np.ndarray:
        """By rank, whether a merge of this rank can make a pair of the same rank or a lower one. A new pair of x and a
        piece put together of l and r cannot where x and l, or r and x, are a pair of a lower rank: it would be gone."""
        mask = (1 << self.bits) - 1
        made_of: dict[int, list[tuple[int, int]]] = {}
        for key, (_, i) in pairs.items():
            made_of.setdefault(i, []).append((key >> self.bits, key & mask))
        rank = {i: r for r, i in pairs.values()}
        unsafe = np.zeros(max(rank.values(), default=0) + 1, bool)
        low = lambda a, b, r: (hit := pairs.get(a << self.bits | b)) is not None and hit[0] < r
        for key, (r, _) in pairs.items():
            a, b = key >> self.bits, key & mask
            if b in rank and r <= rank[b] and not all(low(a, left, rank[b]) for left, _ in made_of[b]):
                unsafe[rank[b]] = True
            if a in rank and r <= rank[a] and not all(low(right, b, rank[a]) for _, right in made_of[a]):
                unsafe[rank[a]] = True
        return unsafe

    # -- encoding

    def _final(self, symbols: list[int], chars: str) -> list[int]:
        """Symbols of a word, merged -> ids. ``chars``: the word, for symbols that are no piece."""
        if max(symbols) < len(self.pieces):
            return symbols
        out, at = [], 0
        for s in symbols:
            if s < len(self.pieces):
                out.append(s)
                at += len(self.pieces[s])
            else:
                out += self.byte_ids[list(chars[at].encode())].tolist() if self.has_bytes else [self.unknown]
                at += 1
        return out

    def _parts(self, word: str) -> list[str]:
        """A long word, cut where its two neighbours stand side by side in no piece."""
        points = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.int64)
        side = points[:-1] << 32 | points[1:]
        at = np.minimum(np.searchsorted(self.sides, side), len(self.sides) - 1)
        cuts = [0, *(np.flatnonzero(self.sides[at] != side) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def merge_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, by simultaneous merge rounds."""
        parts = [self._parts(w) if len(w) > LONG_WORD and len(self.sides) else [w] for w in words]
        merged = iter(self._merge_parts([p for of in parts for p in of]))
        return [next(merged) if len(of) == 1 else [i for _ in of for i in next(merged)] for of in parts]

    def _merge_parts(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(words)
        get, stranger = self.symbols.get, self.stranger
        sym = np.array([get(c, stranger) for word in words for c in word], np.int64)
        owner = np.repeat(np.arange(len(words)), np.array([len(word) for word in words], np.int64))
        rank, to = np.empty(len(sym), np.int64), np.empty(len(sym), np.int64)

        def rank_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            key = a << self.bits | b
            at = np.searchsorted(self.keys, key)
            return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

        def look_up(i: np.ndarray) -> None:
            """The ranks of the symbols at i with their right neighbours, and what they make; the last one of a word has none."""
            j = np.minimum(i + 1, len(sym) - 1)
            key = sym[i] << self.bits | sym[j]
            at = np.searchsorted(self.keys, key)
            pair = (self.keys[at] == key) & (owner[i] == owner[j]) & (i != j)
            rank[i], to[i] = np.where(pair, self.ranks[at], NO_RANK), self.merged[at]

        look_up(np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(sym)])
            if (done := least == NO_RANK).any():
                ended = np.repeat(done, sizes)
                flat, ends = sym[ended].tolist(), np.cumsum(sizes[done]).tolist()
                for i, a, b in zip(owner[first[done]].tolist(), [0, *ends], ends, strict=False):
                    out[i] = self._final(flat[a:b], words[i])
                sym, owner, rank, to = (x[~ended] for x in (sym, owner, rank, to))
                least, sizes = least[~done], sizes[~done]
                if not len(sym):
                    break
            best = np.flatnonzero(rank == np.repeat(least, sizes))
            # of pairs that overlap in a row every other one goes, from the left
            gap, nth = np.diff(best, prepend=-2), np.arange(len(best))
            chosen = (nth - np.maximum.accumulate(np.where(gap > 1, nth, 0))) % 2 == 0
            if len(risky := best[chosen & self.unsafe[rank[best]]]):
                # in words where a merge makes a pair that comes before the rest of this rank, only the first one goes of
                # those that are too near each other to be independent
                made = sym.copy()
                made[best[chosen]] = to[best[chosen]]
                before = np.where((risky > 1) & (made[risky - 2] != sym[risky - 2]), risky - 2, risky - 1)
                after = np.minimum(risky + 2, len(sym) - 1)
                early = (rank_of(made[before], to[risky]) <= rank[risky]) & (risky > 0) & (owner[before] == owner[risky])
                early |= (rank_of(to[risky], sym[after]) <= rank[risky]) & (risky + 2 < len(sym)) & (owner[after] == owner[risky])
                words_of = np.isin(owner[best], owner[risky[early]])
                chosen = np.where(words_of, (gap > self.apart) | (np.diff(owner[best], prepend=-1) != 0), chosen)
            left = best[chosen]
            sym[left] = to[left]
            stays = np.ones(len(sym), bool)
            stays[left + 1] = False
            left = (np.cumsum(stays) - 1)[left]
            sym, owner, rank, to = (x[stays] for x in (sym, owner, rank, to))
            look_up(left)
            look_up(left[left > 0] - 1)
        return out

    def _packed(self, words: list[str]) -> dict[str, bytes]:
        out = {}
        for word, ids in zip(words, self.merge_words(words), strict=True):
            packed = array("I", ids)
            if sys.byteorder == "big":
                packed.byteswap()
            out[word] = packed.tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, begin and end included, as little-endian unsigned 32-bit integers."""
        split = [self.words(self.processor.normalize(t)) if t else [] for t in texts]
        get = self.cache.learn(set().union(*split))
        begin, end = np.uint32(self.begin).tobytes(), np.uint32(self.end).tobytes()
        return [b"".join([begin, *map(get, words), end]) for words in split]

    # -- decoding

    def decoding_tables(self) -> tuple[list[str], set[int]]:
        if not hasattr(self, "text_of"):
            self.text_of = [" ⁇ " if i == self.unknown else "" if i in self.silent else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
            self.is_byte = np.zeros(len(self.pieces), bool)
            self.is_byte[list(self.byte_of)] = True
        return self.text_of, self.is_byte

    def _bytes(self, raw: bytes) -> str:
        try:
            return raw.decode()
        except UnicodeDecodeError:
            pass
        out, i = [], 0  # each byte that starts no whole character becomes one replacement character
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)

    def decode(self, ids: bytes) -> str:
        text_of, is_byte = self.decoding_tables()
        got = np.frombuffer(ids, "<u4")
        texts = list(map(text_of.__getitem__, got.tolist()))
        if len(bytes_at := np.flatnonzero(is_byte[got])):
            for run in np.split(bytes_at, np.flatnonzero(np.diff(bytes_at) > 1) + 1):
                texts[run[0]] = self._bytes(bytes(self.byte_of[int(i)] for i in got[run]))
                for i in run[1:].tolist():
                    texts[i] = ""
        for i, s in enumerate(got.tolist()):  # the mark that was put before the text goes
            if s in self.silent:
                continue
            if self.pieces[s].startswith(MARK) and s != self.unknown:
                texts[i] = texts[i][1:]
            break
        return "".join(texts)


_TABLES: dict[str, PieceTable] = {}


def piece_table(path: str | None = None) -> PieceTable:
    path = model_path(path)
    if path not in _TABLES:
        _TABLES[path] = PieceTable(path)
    return _TABLES[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, ids array<int>, begin and end included. A null text is empty: begin and end."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        pieces = piece_table(path)
        for batch in batches:
            for part in steps(batch):
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in pieces.encode([t or "" for t in part.column("text").to_pylist()])]
                at = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(at, np.concatenate(ids))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """tokens(doc_id, ids, ...) -> doc_id, text. Null ids give a null text; an id that the model has not is an error."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        pieces = piece_table(path)
        for batch in batches:
            texts = [None if x is None else pieces.decode(np.array(x, "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], schema=schema)

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what encode() and decode() give.

    Rows are independent: repeated rows give repeated rows, an empty table an empty one.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        pieces = piece_table(path)
        for batch in batches:
            for part in steps(batch):
                ids = pieces.encode([t or "" for t in part.column("text").to_pylist()])
                arrays = [
                    part.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(pieces.decode(x).encode()).hexdigest() for x in ids]),
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
