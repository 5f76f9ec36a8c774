"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs, ordered by the score of the piece that they would
form, then by place: the best pair is merged, its new neighbours join the agenda, and entries whose
symbols have changed meanwhile are passed over. The new words of a batch work off their agendas in step, one
row of a matrix each; what words encode to is remembered, up to a fixed number.
Long words and texts that are not plain are cut where two characters stand that no piece holds side by side,
since nothing is ever merged across, and take a heap.

In every Arrow batch the agenda's ids are checked against the sentencepiece library: those of each
word not at hand, and those of each text that is not plain words between single blanks as a
whole. A difference fails the task. Decoding is the library's.

Null texts count as empty and give the end id alone. Texts of any length are encoded whole;
nothing is sampled. Repeated rows and null ids are kept. Other columns are not read unless carried.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklens.llm.common import PUT_BY, small_batches, text_of

if TYPE_CHECKING:
    import numpy as np

SPACE = "▁"  # stands for a blank within pieces
BITS = 20  # of a symbol's number
MASK = (1 << BITS) - 1
NEVER = 1 << 62  # of a pair that forms no piece
LAST = (1 << 31) - 1  # its rank
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 48)  # characters of the words that are merged in step, by matrix

Ids = list[int]


class Encoder:
    """Ids of texts under one model file."""

    def __init__(self, model: str, max_parts: int = 300_000):
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=model)
        ids = range(sp.vocab_size())
        special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.id_of = {sp.id_to_piece(i): i for i in ids if i not in special}
        self.reserved = {sp.id_to_piece(i): i for i in special}
        self.fallback = any(sp.is_byte(i) for i in ids)
        self._number()
        self.pairs = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        # Words that start at a blank are parts of their own unless a piece goes on past one.
        whole = any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        self.cut_at_blanks = self.fallback and not whole
        self.words = re.compile(r".+" if whole else rf"{SPACE}*[^{SPACE}]+|{SPACE}+", re.DOTALL)
        self.end = sp.eos_id()
        self.max_parts = max_parts
        self.known: dict[str, Ids] = {}
        self.older: dict[str, Ids] = {}
        self.small: dict[str, Ids] = {}
        self.digits = [str(i) for i in ids]

    def _number(self) -> None:
        """Numbers for all pieces and their characters, and for every pair that forms a piece its rank and number."""
        pieces = sorted(self.id_of, key=lambda p: (-self.library.get_score(self.id_of[p]), self.id_of[p]))
        scores = sorted({-self.library.get_score(i) for i in self.id_of.values()})
        rank_of = dict(zip(scores, range(len(scores)), strict=True))
        alone = sorted({c for p in pieces for c in p} - self.id_of.keys())
        number = {p: k for k, p in enumerate([*pieces, *alone])}
        if len(number) >= MASK:
            raise ValueError("more pieces than numbers")
        self.symbol_of = {p: k for p, k in number.items() if len(p) == 1}
        self.other = len(number)  # stands for every other character
        self.symbol_size = [*map(len, number), 1]
        self.symbol_ids: list[int | None] = [*(self.id_of.get(p) for p in number), None]
        self.merges = {}
        for p in pieces:
            rank = rank_of[-self.library.get_score(self.id_of[p])]
            for i in range(1, len(p)):
                a, b = number.get(p[:i]), number.get(p[i:])
                if a is not None and b is not None:
                    self.merges[a << BITS | b] = rank << BITS | number[p]
        self._arrays()

    def _arrays(self) -> None:
        """The numbers and merges as arrays: symbols by code point, ids by symbol, merges by sorted pair."""
        import numpy as np

        self.symbol_at = np.full(0x110000, self.other, "i4")
        for c, k in self.symbol_of.items():
            self.symbol_at[ord(c)] = k
        self.padding = len(self.symbol_ids)
        self.no_piece = np.array([*(i is None for i in self.symbol_ids), False])
        self.id_at = np.array([*self.symbol_ids, None], object)  # one int object per id, shared by all words
        self.pair_keys = np.array(sorted(self.merges) or [-1], "i8")
        merges = [self.merges.get(k, NEVER) for k in self.pair_keys.tolist()]
        self.pair_ranks = np.array([min(m >> BITS, LAST) for m in merges], "i4")
        self.pair_numbers = np.array([m & MASK for m in merges], "i4")

    def _found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each pair among the merges, and whether it is one."""
        import numpy as np

        pairs = left.astype("i8") << BITS | right
        at = np.searchsorted(self.pair_keys, pairs)
        at[at == len(self.pair_keys)] = 0
        return at, self.pair_keys[at] == pairs

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that each pair forms."""
        import numpy as np

        at, there = self._found(left, right)
        return np.where(there, self.pair_ranks[at], np.int32(LAST))

    def in_step(self, words: list[str], width: int) -> list[Ids]:
        """Ids of words of up to ``width`` characters. Rows that still merge have merged as often, so they stay a matrix."""
        import numpy as np

        out: list[Ids] = [[]] * len(words)
        size = np.fromiter(map(len, words), "i8", len(words))
        flat = "".join([w.ljust(width) for w in words]).encode("utf-32-le", "surrogatepass")
        symbols = self.symbol_at[np.frombuffer(flat, "u4").reshape(-1, width)]
        symbols[np.arange(width) >= size[:, None]] = self.padding  # forms no piece and stays at the end
        own, agenda = np.arange(len(words)), self._ranked(symbols[:, :-1], symbols[:, 1:])
        for merged in range(width):
            rows = np.arange(len(own))
            if merged < width - 1:
                best = agenda.argmin(1)  # the leftmost of equals
                over = agenda[rows, best] == LAST
            else:
                over = np.ones(len(own), bool)
            if over.any():
                left, ended = symbols[over], own[over].tolist()
                odd = self.no_piece[left].any(1).tolist()
                for k, (i, row, n) in enumerate(zip(ended, self.id_at[left].tolist(), size[over].tolist(), strict=True)):
                    del row[n - merged :]
                    out[i] = self._spelled(words[i], left[k, : n - merged].tolist()) if odd[k] else row
                go = ~over
                own = own[go]
                if not len(own):
                    break
                symbols, agenda, best, size = symbols[go], agenda[go], best[go], size[go]
                rows = np.arange(len(own))
            at, _ = self._found(symbols[rows, best], symbols[rows, best + 1])
            symbols[rows, best] = self.pair_numbers[at]
            place = np.arange(symbols.shape[1] - 1)
            symbols = np.where(place > best[:, None], symbols[:, 1:], symbols[:, :-1])
            agenda = np.where(place[:-1] >= best[:, None], agenda[:, 1:], agenda[:, :-1])
            for side, some in ((best - 1, best > 0), (best, best < agenda.shape[1])):
                r, at = rows[some], side[some]
                agenda[r, at] = self._ranked(symbols[r, at], symbols[r, at + 1])
        return out

    def _unknown(self, char: str) -> list[int]:
        if char in self.reserved:
            return [self.reserved[char]]
        if self.fallback:
            return [self.reserved[f"<0x{b:02X}>"] for b in char.encode()]
        return [self.library.unk_id()]

    def merged(self, part: str) -> list[int]:
        """The symbols that the agenda leaves of one part."""
        symbols = [self.symbol_of.get(c, self.other) for c in part]
        return self._merged_long(symbols) if len(symbols) > 48 else self._merged_short(symbols)

    def _merged_short(self, symbols: list[int]) -> list[int]:
        """The agenda as a list beside the symbols: the least rank comes first, the leftmost of equals."""
        merge = self.merges.get
        agenda = [merge(a << BITS | b, NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)
            symbols[i] = joined = best & MASK
            del symbols[i + 1], agenda[i]
            if i:
                agenda[i - 1] = merge(symbols[i - 1] << BITS | joined, NEVER)
            if i < len(agenda):
                agenda[i] = merge(joined << BITS | symbols[i + 1], NEVER)
        return symbols

    def _merged_long(self, symbols: list[int]) -> list[int]:
        """The agenda as a heap, so that a part of any length takes n log n steps."""
        n, merge = len(symbols), self.merges.get
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        agenda = [(m, i, i + 1) for i in range(n - 1) if (m := merge(symbols[i] << BITS | symbols[i + 1], NEVER)) != NEVER]
        heapify(agenda)
        while agenda:
            m, left, right = heappop(agenda)
            if gone[left] or gone[right] or after[left] != right:
                continue
            if merge(symbols[left] << BITS | symbols[right], NEVER) != m:  # a neighbour has grown meanwhile
                continue
            symbols[left], gone[right] = m & MASK, True
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            for x, y in ((left, after[left]), (before[left], left)):
                if x >= 0 and y < n and (m := merge(symbols[x] << BITS | symbols[y], NEVER)) != NEVER:
                    heappush(agenda, (m, x, y))
        return [s for s, out in zip(symbols, gone, strict=True) if not out]

    def _spelled(self, part: str, symbols: list[int]) -> Ids:
        """The ids of the symbols of a part; characters without a piece as the model spells them."""
        out: list[int] = []
        at = 0
        for s in symbols:
            i = self.symbol_ids[s]
            if i is None:
                out += self._unknown(part[at])
            else:
                out.append(i)
            at += self.symbol_size[s]
        return out

    def _joined(self, word: str) -> list[int]:
        """The ids of a run of symbols, from those of its parts."""
        pairs, small, out, start = self.pairs, self.small, [], 0
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in pairs]
        cuts.append(len(word))
        for end in cuts:
            part = word[start:end]
            start = end
            if (ids := small.get(part)) is None:
                if len(small) >= self.max_parts:
                    small.clear()
                ids = small[part] = self._spelled(part, self.merged(part))
            out += ids
        return out

    def _learn(self, words: list[str]) -> dict[str, Ids]:
        """Words that come after one blank: by the agenda, all of them compared with the library."""
        by_width, new = defaultdict(list), {}
        for word in words:
            by_width[bisect_left(WIDTHS, len(word) + 1)].append(word)
        for k, some in by_width.items():
            if k < len(WIDTHS):
                new.update(zip(some, self.in_step([SPACE + w for w in some], WIDTHS[k]), strict=True))
            else:
                new.update((w, self._joined(SPACE + w)) for w in some)
        for word, ids in zip(words, self.library.encode(words, num_threads=1), strict=True):
            if new[word] != ids:
                raise ValueError(f"agenda and library differ on {word!r}")
        return new

    def _whole(self, text: str) -> Ids:
        """Any text, compared with the library as a whole."""
        ids = [i for w in self.words.findall(self.library.normalize(text)) for i in self._joined(w)]
        if not self.fallback:  # the library reports a run of unknowns once
            unk = self.library.unk_id()
            ids = [i for j, i in enumerate(ids) if i != unk or j == 0 or ids[j - 1] != i]
        if ids != self.library.encode(text, num_threads=1):
            raise ValueError(f"agenda and library differ on {text[:200]!r}")
        return ids

    def encode(self, texts: list[str]) -> list[tuple[str, list[int]]]:
        """The ids of each text, in decimal joined by blanks and as numbers, the end id included.

        In a plain text, words are set apart by one blank each and nothing else is changed before
        encoding: such texts are put together from words that are at hand or learned for this batch.
        """
        parts: list[list[Ids]] = [[] for _ in texts]
        todo, missing, get = {}, set(), self.known.get
        for k, text in enumerate(texts):
            words = text.split(" ")
            plain = self.cut_at_blanks and "" not in words and SPACE not in text
            if not plain or self.library.normalize(text) != SPACE + text.replace(" ", SPACE):
                parts[k] = [self._whole(text)] if text else []
                continue
            parts[k] = found = list(map(get, words))
            if None in found:
                todo[k] = words
                missing.update([w for w, ids in zip(words, found, strict=True) if ids is None])
        old = {w: ids for w in missing if (ids := self.older.get(w)) is not None}
        new = old | self._learn([w for w in missing if w not in old])
        for k, words in todo.items():
            parts[k] = [p or new[w] for p, w in zip(parts[k], words, strict=True)]
        if len(self.known) + len(new) > self.max_parts:  # what was not asked for since the last time goes
            self.known, self.older = new, self.known
        else:
            self.known.update(new)
        end, digits, out = [self.end], self.digits, []
        for each in parts:
            ids = list(chain.from_iterable([*each, end]))
            out.append((" ".join([digits[i] for i in ids]), ids))
        return out


@lru_cache(maxsize=2)
def encoder(model: str) -> Encoder:
    """One encoder per process and model, until another operator's task needs the room."""
    PUT_BY.append(encoder.cache_clear)
    return Encoder(model)


def encode_decode(docs: DataFrame, carry: list[str], model: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """The carried columns, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``ids`` and ``decoded``."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield one(own, batch.slice(at, 256))

    def one(own: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.columns[-1].to_pylist()
        said, ids = zip(*own.encode(texts), strict=True)
        plain = own.library.decode(list(ids), num_threads=1)
        digest = lambda xs: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in xs], pa.string())
        made = [pa.array([len(x) for x in ids], pa.int64()), digest(said), digest(plain)]
        if keep_ids:
            made += [pa.array(list(ids), pa.list_(pa.int32())), pa.array(plain, pa.string())]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*carry, *(f.name for f in fields)])

    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    if keep_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    small_batches(docs.sparkSession)
    rows = docs.select(*carry, text_of(text).alias("__text"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *fields]))
