"""Merge-type piece encoding with seeded dropout, and lossless decoding.

Encoding is the agenda algorithm of merge-type piece models: adjacent symbols
that form a piece are candidates (best score first, then leftmost); the best is
merged and its new neighbours become candidates. With dropout each candidate
is skipped with probability ``dropout``, decided by a keyed hash of (seed,
doc_id, place of the word, position, piece), so a run can be repeated anywhere
with the same result. As the decision is a function of the candidate, a skipped
one may as well be left out of the agenda. A text is cut before every word (no
piece of such a model spans a blank after a non-blank), and every occurrence of
a word draws its own skips.

Short words of a slice of texts run their agendas side by side on ragged
arrays, one merge per word and round; long ones use a priority queue. Workers
remember, in bounded space, the segmentation of a short word with one exact set
of skipped candidates: it depends on nothing else, so an occurrence that draws
this set again needs no second run. Long words are never shared.

Characters without a piece become byte pieces. A literal U+2581, which pieces
use for the blank, also becomes byte pieces, so that every text decodes to
itself. With ``dropout=0`` the ids are those of the library (for texts without
that character).

Defined cases: a null text gives null ids, an empty text no ids; repeated rows
are encoded alike when doc_id and text agree; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import ByteBpe
from .words import hash_words, mix, read_columns, text_slices

BLANK = "▁"
DROPOUT = 0.1
SEED = 17
REMEMBERED = 250_000      # segmentations a worker remembers, and words with their candidates
REMEMBERED_IDS = 1 << 24  # and their ids in all
LONG = 64                 # characters from which a word uses the priority queue
_POS, _PIECE = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_MASK = (1 << 64) - 1


def load_pieces(path: str) -> dict:
    """Pieces, scores and byte pieces of a model file; of fixed size."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return {"pieces": {sp.id_to_piece(i): (i, sp.get_score(i)) for i in plain},
            "bytes": [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]}


def _uniform(key: int) -> float:
    """A keyed hash as a number in [0, 1)."""
    key = (key ^ key >> 33) * 0xFF51AFD7ED558CCD & _MASK
    key = (key ^ key >> 33) * 0xC4CEB9FE1A85EC53 & _MASK
    return ((key ^ key >> 33) >> 11) * 2.0 ** -53


def _draw_keys(draw: np.ndarray, seed: int) -> np.ndarray:
    """One key per word occurrence, from the seed and the number of its draw."""
    return mix(draw.astype(np.uint64) + np.uint64(seed * 1000003 * 0xD6E8FEB86659FD93 & _MASK))


def characters(buf: bytes, starts, ends) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first character, number of characters) of words at byte ranges, and all characters."""
    head = np.flatnonzero((np.frombuffer(buf, dtype=np.uint8) & 0xC0) != 0x80)
    first = np.searchsorted(head, starts)
    return first, np.searchsorted(head, ends) - first, np.frombuffer(buf.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)


class Encoder:
    """Agenda encoder over the tables of ``load_pieces``."""

    def __init__(self, tables: dict, dropout: float = DROPOUT, seed: int = SEED):
        self.pieces, self.bytes = tables["pieces"], tables["bytes"]
        self.dropout, self.seed = dropout, seed
        self.names = {i: p for p, (i, _) in self.pieces.items()}
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}

    def segment(self, unit: str, draw: int = 0, shift: int = 0) -> list[int]:
        """Ids of one unit, which begins at position ``shift`` of its word: the
        agenda with the skips of one draw."""
        pieces, n = self.pieces, len(unit)
        whole = pieces.get(unit)
        if n == 1:
            return [whole[0]] if whole else [self.bytes[b] for b in unit.encode("utf-8")]
        key = int(_draw_keys(np.array([draw], dtype=np.uint64), self.seed)[0])
        end = list(range(1, n + 1))              # symbol i covers unit[i:end[i]]; 0: merged away
        left = list(range(-1, n - 1))
        agenda: list[tuple] = []

        def offer(i: int, j: int) -> None:
            found = pieces.get(unit[i: end[j]])
            if found:
                heapq.heappush(agenda, (-found[1], i, j, end[j], found[0]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, stop, ident = heapq.heappop(agenda)
            if end[i] != j or end[j] != stop:    # one of the two has changed since
                continue
            if self.dropout and _uniform((key + (i + shift) * int(_POS) + ident * int(_PIECE)) & _MASK) < self.dropout:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                left[stop] = i
                offer(i, stop)
            if left[i] >= 0:
                offer(left[i], i)
        out: list[int] = []
        i = 0
        while i < n:
            found = pieces.get(unit[i: end[i]])
            out += [found[0]] if found else [self.bytes[b] for b in unit[i: end[i]].encode("utf-8")]
            i = end[i]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids."""
        parts, raw = [], bytearray()
        names, byte_of = self.names, self.byte_of
        for i in ids:
            b = byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
                raw.clear()
            parts.append(names[i].replace(BLANK, " "))
        if raw:
            parts.append(raw.decode("utf-8", "replace"))
        return "".join(parts)[1:]


class Places:
    """Places of int64 keys in a table: a key lies in its slot; those whose slot was taken lie in a
    small sorted rest."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * keys.size).bit_length())
        slot = self._slot(keys)
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.at = np.zeros(1 << self.bits, dtype=np.int64)
        first = np.unique(slot, return_index=True)[1]
        self.keys[slot[first]], self.at[slot[first]] = keys[first], first
        rest = np.setdiff1d(np.arange(keys.size), first)
        rest = rest[np.argsort(keys[rest], kind="stable")]
        self.rest, self.rest_at = keys[rest], rest
        self.crowded = np.zeros(1 << self.bits, dtype=bool)
        self.crowded[slot[rest]] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of every key; -1 for the others."""
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.at[slot], -1)
        more = np.flatnonzero((out < 0) & self.crowded[slot])
        if more.size:
            i = np.minimum(np.searchsorted(self.rest, keys[more]), self.rest.size - 1)
            out[more] = np.where(self.rest[i] == keys[more], self.rest_at[i], -1)
        return out


class Options(ByteBpe):
    """The candidates that the agenda of a word can ever hold, remembered per word."""

    def __init__(self, tables: dict):
        self.remembered = REMEMBERED
        self.size = max(i for i, _ in tables["pieces"].values()) + 1
        nodes, steps, piece = {"": 0}, {}, [-1]              # a trie of the pieces
        for name, (ident, _) in tables["pieces"].items():
            for k, char in enumerate(name):
                if name[:k + 1] not in nodes:
                    nodes[name[:k + 1]] = len(piece)
                    steps[nodes[name[:k]] * 0x110000 + ord(char)] = len(piece)
                    piece.append(-1)
            if len(name) > 1:
                piece[nodes[name]] = ident
        self.step = Places(np.array(list(steps), dtype=np.int64))
        self.child = np.array(list(steps.values()), dtype=np.int64)
        self.piece = np.array(piece, dtype=np.int64)
        self._forget()

    def list_all(self, buf: bytes, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """(position * size + piece of every candidate, their number) of short words."""
        first, n, cps = characters(buf, starts, ends)
        n = np.where(n > LONG, 0, n)
        seq = np.repeat(np.arange(n.size), n)
        pos = np.arange(seq.size) - np.repeat(np.cumsum(n) - n, n)
        cp = cps[pos + first[seq]].astype(np.int64)
        cp = np.where(cp == 32, ord(BLANK), np.where(cp == ord(BLANK), 10, cp))    # no piece holds a line end
        left = n[seq] - pos                                  # characters from here to the end of the word
        at, node, found = np.arange(seq.size), np.zeros(seq.size, dtype=np.int64), []
        k = 0
        while at.size and self.child.size:
            to = self.step.find(node * 0x110000 + cp[at + k])
            go = to >= 0
            at, node = at[go], self.child[to[go]]
            hit = self.piece[node] >= 0
            found.append((at[hit], self.piece[node[hit]]))
            k += 1
            go = left[at] > k
            at, node = at[go], node[go]
        place = np.concatenate([x[0] for x in found]) if found else np.zeros(0, dtype=np.int64)
        piece = np.concatenate([x[1] for x in found]) if found else place
        order = np.argsort(place, kind="stable")
        place, piece = place[order], piece[order]
        return pos[place] * self.size + piece, np.bincount(seq[place], minlength=n.size)


class Arrays(ByteBpe):
    """The same encoder on slices of texts, agendas of short words in parallel."""

    def __init__(self, tables: dict, dropout: float = DROPOUT, seed: int = SEED):
        self.one = Encoder(tables, dropout, seed)
        self.options = Options(tables)
        self.dropout, self.seed = dropout, seed
        self.remembered = REMEMBERED
        pieces = tables["pieces"]
        self.size = max(i for i, _ in pieces.values()) + 1
        by = sorted((a[0] * self.size + b[0], i, score) for p, (i, score) in pieces.items() for k in range(1, len(p))
                    if (a := pieces.get(p[:k])) and (b := pieces.get(p[k:])))
        self.pairs = Places(np.array([x[0] for x in by], dtype=np.int64))
        self.made = np.array([x[1] for x in by], dtype=np.int64)
        self.cost = np.array([-x[2] for x in by])
        self.symbol = np.full(0x110000, -1, dtype=np.int64)
        for p, (i, _) in pieces.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[32], self.symbol[ord(BLANK)] = self.symbol[ord(BLANK)], -1
        raw = {i: p.replace(BLANK, " ").encode("utf-8") for p, (i, _) in pieces.items()} | {
            i: bytes([b]) for b, i in enumerate(tables["bytes"])}
        each = [raw.get(i, b"") for i in range(max(raw) + 1)]
        n = np.array([len(x) for x in each], dtype=np.int64)
        self.bytes_of = n, np.cumsum(n) - n, np.frombuffer(b"".join(each), dtype=np.uint8)
        self._forget()

    def _candidates(self, a, b, unit_key, pos) -> tuple[np.ndarray, np.ndarray]:
        """(cost, piece) of adjacent symbols; infinite if none or skipped."""
        at = self.pairs.find(np.where((a >= 0) & (b >= 0), a * self.size + b, -2))
        ok = at >= 0
        made = self.made[at]
        if self.dropout:
            x = mix(unit_key + pos.astype(np.uint64) * _POS + made.astype(np.uint64) * _PIECE)
            ok &= (x >> np.uint64(11)) * 2.0 ** -53 >= self.dropout
        return np.where(ok, self.cost[at], np.inf), made

    def segment_all(self, buf: bytes, starts, ends, draw) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, sizes) of words at byte ranges, each with the skips of its draw."""
        first, n, cps = characters(buf, starts, ends)
        long = n > LONG
        size = np.where(long, 0, n)
        seq = np.repeat(np.arange(size.size), size)
        pos = np.arange(seq.size) - np.repeat(np.cumsum(size) - size, size)
        cp = cps[pos + first[seq]].astype(np.int64)
        sym = self.symbol[cp]
        sym = np.where(sym < 0, -cp - 1, sym)
        key = _draw_keys(draw, self.seed)
        inner = np.zeros(seq.size, dtype=bool)
        inner[:-1] = seq[1:] == seq[:-1]
        cost, made = np.full(seq.size, np.inf), np.zeros(seq.size, dtype=np.int64)
        at = np.flatnonzero(inner)
        cost[at], made[at] = self._candidates(sym[at], sym[at + 1], key[seq[at]], pos[at])
        done: list[tuple] = []
        while sym.size:
            begin = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            count = np.diff(np.append(begin, seq.size))
            low = np.minimum.reduceat(cost, begin)
            live = np.repeat(np.isfinite(low), count)
            if not live.all():
                done.append((seq[~live], sym[~live]))
                seq, sym, pos, cost, made = (x[live] for x in (seq, sym, pos, cost, made))
                if not sym.size:
                    break
                count, low = count[np.isfinite(low)], low[np.isfinite(low)]
                begin = np.cumsum(count) - count
            hits = np.flatnonzero(cost == np.repeat(low, count))
            hits = hits[np.append(True, seq[hits][1:] != seq[hits][:-1])]      # the leftmost of each word
            sym[hits] = made[hits]
            stay = np.ones(sym.size, dtype=bool)
            stay[hits + 1] = False
            seq, sym, pos, cost, made = (x[stay] for x in (seq, sym, pos, cost, made))
            at = hits - np.arange(hits.size)
            again = np.zeros(sym.size, dtype=bool)
            again[at] = True
            again[at[at > 0] - 1] = True
            again = np.flatnonzero(again)
            cost[again] = np.inf
            again = again[again + 1 < sym.size]
            again = again[seq[again] == seq[again + 1]]
            cost[again], made[again] = self._candidates(sym[again], sym[again + 1], key[seq[again]], pos[again])
        for k in np.flatnonzero(long).tolist():
            unit = buf[starts[k]: ends[k]].decode("utf-8")
            ids, at = [], 0
            for j, part in enumerate(unit.split(BLANK)):
                ids += [-ord(BLANK) - 1] if j else []
                ids += self.one.segment(part.replace(" ", BLANK), int(draw[k]), at) if part else []
                at += len(part) + 1
            done.append((np.full(len(ids), k), np.array(ids, dtype=np.int64)))
        seq = np.concatenate([x[0] for x in done])
        sym = np.concatenate([x[1] for x in done])
        order = np.argsort(seq, kind="stable")
        seq, sym = seq[order], sym[order]
        odd = np.flatnonzero(sym < 0)                                          # characters without a piece
        if odd.size:
            raw_ids = [[self.one.bytes[b] for b in chr(int(-x - 1)).encode("utf-8")] for x in sym[odd]]
            width = np.ones(sym.size, dtype=np.int64)
            width[odd] = [len(x) for x in raw_ids]
            seq, sym = np.repeat(seq, width), np.repeat(sym, width)
            sym[sym < 0] = [i for x in raw_ids for i in x]
        return sym, np.bincount(seq, minlength=starts.size)

    def _skip_hashes(self, buf: bytes, starts, ends, draw) -> np.ndarray:
        """A hash of every word and the set of candidates that its draw skips;
        of a long word and its draw."""
        words = hash_words(buf, starts, ends)
        if not self.dropout:
            return words
        own = self.options
        idx = own._lookup(words, lambda pick: own.list_all(buf, starts[pick], ends[pick]))
        n, head = own.lens[idx].astype(np.int64), own.heads[idx]
        total = np.concatenate(([0], np.cumsum(n)))
        cand = own.ids[np.arange(total[-1]) - np.repeat(total[:-1] - head, n)]
        pos, piece = np.divmod(cand, np.int32(own.size))
        key = _draw_keys(draw, self.seed)
        x = mix(np.repeat(key, n) + pos.astype(np.uint64) * _POS + piece.astype(np.uint64) * _PIECE)
        skip = np.flatnonzero((x >> np.uint64(11)) * 2.0 ** -53 < self.dropout)
        if skip.size:
            seq = np.searchsorted(total, skip, side="right") - 1
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            words[seq[first]] += np.add.reduceat(mix(cand[skip].astype(np.uint64) + _POS), first)
        raw = np.frombuffer(buf, dtype=np.uint8)
        heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        long = heads[ends] - heads[starts] > LONG
        words[long] += mix(key[long])
        return mix(words)

    def encode(self, col: pa.Array, keys: np.ndarray):
        """Yield (first row, flat ids, offsets per text) for slices of a column."""
        for row, buf, offs in text_slices(col, lower=False):
            # the blank that the model puts before a text; an empty text gets none
            full = np.diff(offs) > 0
            raw = np.insert(np.frombuffer(buf, dtype=np.uint8), offs[:-1][full], 32)
            offs = offs + np.concatenate(([0], np.cumsum(full)))
            if not raw.size:
                yield row, np.zeros(0, dtype=np.int32), offs
                continue
            buf = raw.tobytes()
            blank = raw == 32
            start = blank.copy()
            start[1:] &= ~blank[:-1]
            start[offs[:-1][full]] = True
            starts = np.flatnonzero(start)
            ends = np.append(starts[1:], raw.size)
            place = np.searchsorted(starts, offs)
            doc = np.repeat(np.arange(full.size), np.diff(place))
            draw = np.arange(starts.size).astype(np.uint64) - place[doc].astype(np.uint64) + keys[row + doc] * _PIECE
            if self.used > REMEMBERED_IDS:
                self._forget()
            idx = self._lookup(self._skip_hashes(buf, starts, ends, draw),
                               lambda pick: self.segment_all(buf, starts[pick], ends[pick], draw[pick]))
            n, head = self.lens[idx].astype(np.int64), self.heads[idx]
            total = np.concatenate(([0], np.cumsum(n)))
            yield row, self.ids[np.arange(total[-1]) - np.repeat(total[:-1] - head, n)], total[place]


    def lossless(self, ids: np.ndarray, offs: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Which texts their ids decode to: the pieces' bytes, joined, are a blank and the text's bytes."""
        n, first, flat = self.bytes_of
        size = n[ids]
        ends = np.concatenate(([0], np.cumsum(size)))[offs]
        joined = flat[np.arange(int(ends[-1])) - np.repeat(np.cumsum(size) - size - first[ids], size)]
        out = np.zeros(offs.size - 1, dtype=bool)
        for row, buf, at in text_slices(texts, lower=False):
            for d in range(at.size - 1):
                s, e, want = int(ends[row + d]), int(ends[row + d + 1]), at[d + 1] - at[d]
                # an empty text has no ids, and no blank before it
                out[row + d] = e == s if not want else (
                    e - s == want + 1 and joined[s] == 32 and joined[s + 1: e].tobytes() == buf[at[d]: at[d + 1]])
        return out


_ENCODERS: dict = {}


def _encoder(tables: dict, *settings) -> Arrays:
    """The worker's encoder, kept between tasks (its memory is bounded)."""
    key = (len(tables["pieces"]), tuple(tables["bytes"][:2]), settings)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Arrays(tables, *settings)
    return _ENCODERS[key]


def encode(docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, ids, n_ids, lossless) of every row of ``docs``."""
    tables = load_pieces(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tables, dropout, seed)
        for batch in batches:
            ident, text = read_columns(batch, "doc_id", "text")
            keys = ident.cast(pa.int64()).fill_null(-1).to_numpy().astype(np.uint64)
            for row, ids, offs in enc.encode(text, keys):
                n = offs.size - 1
                null = text.slice(row, n).is_null().to_numpy(zero_copy_only=False)
                same = enc.lossless(ids, offs, text.slice(row, n))
                lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [ident.slice(row, n), pc.if_else(pa.array(null), pa.scalar(None, lists.type), lists),
                     pa.array(np.diff(offs), mask=null), pa.array(same, mask=null)],
                    names=["doc_id", "ids", "n_ids", "lossless"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_ids long, lossless boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""
    tables = load_pieces(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Encoder(tables)
        for batch in batches:
            ident, ids = read_columns(batch, "doc_id", "ids")
            yield pa.RecordBatch.from_arrays(
                [ident, pa.array([None if x is None else one.decode(x) for x in ids.to_pylist()], pa.string())],
                names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
