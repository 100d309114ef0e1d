"""Byte-level BPE on arrays: rank-synchronous merging of ragged pre-tokens.

All pre-tokens of a slice of texts are held as one flat symbol array plus
offsets. In every round each pre-token finds its lowest-rank adjacent pair and
applies all its occurrences (left to right where they overlap), all pre-tokens
at once; a pre-token without a known pair is finished. The surviving symbols
are its ids. Results of distinct pre-tokens are remembered by 64-bit hash, in
bounded space.

Pre-tokens follow the byte-level pattern (contractions, an optional space
before letters, numbers or other characters, and white space). Whether a
character is a letter, a number or white space is asked of the installed
tokenizer itself, so that both agree on every character.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa

from .words import hash_words, text_slices

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
SLICE = 2 << 20           # bytes of text handled at once
REMEMBERED = 600_000      # a worker forgets after so many distinct pre-tokens
_SLOT_BITS = 20
_SLOTS = 1 << _SLOT_BITS
_NONE = np.int32(2**31 - 1)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary:
    printable Latin-1 bytes stand for themselves, the others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def character_classes(tokenizer) -> bytes:
    """Compressed table of one class per code point, as ``tokenizer`` splits them."""
    import regex

    table = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for cls, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        table[[ord(c) for c in regex.findall(pattern, every)]] = cls
    split = tokenizer.pre_tokenizer.pre_tokenize_str

    lead = {LETTER: "a", NUMBER: "1", OTHER: "!", SPACE: "\t"}

    def settle(chars: list[int], cls: int) -> None:
        if not chars or len(split(lead[cls] + "".join(map(chr, chars)))) == 1:
            return
        if len(chars) == 1:
            table[chars[0]] = next((k for k in lead if len(split(lead[k] + chr(chars[0]))) == 1), SPACE)
            return
        half = len(chars) // 2
        settle(chars[:half], cls)
        settle(chars[half:], cls)

    for cls in (LETTER, NUMBER, SPACE, OTHER):
        chars = [c for c in np.flatnonzero(table == cls).tolist() if not 0xD800 <= c < 0xE000]
        for i in range(0, len(chars), 4096):
            settle(chars[i: i + 4096], cls)
    return zlib.compress(table.tobytes())


def load_tables(path: str) -> dict:
    """What workers need of a byte-level BPE file, as plain arrays of fixed size."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
    key = np.array([vocab[a] * size + vocab[b] for a, b in pairs], dtype=np.int64)
    order = np.argsort(key, kind="stable")
    merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
    letters = byte_alphabet()
    first = np.zeros(256, dtype=np.int32)
    for ch, b in letters.items():
        first[b] = vocab[ch]
    return {"size": size, "key": key[order], "rank": order.astype(np.int32), "merged": merged, "first": first,
            "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
            "classes": character_classes(Tokenizer.from_file(path))}


_ENCODERS: dict[int, ByteBpe] = {}


def encoder(tables: dict) -> ByteBpe:
    """The worker's encoder for these tables; kept between tasks, of bounded size."""
    mark = zlib.crc32(tables["key"].tobytes(), zlib.crc32(tables["classes"]))
    if mark not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[mark] = ByteBpe(tables)
    return _ENCODERS[mark]


class ByteBpe:
    """Encoder over the arrays of ``load_tables``."""

    def __init__(self, tables: dict, remembered: int = REMEMBERED):
        self.t = tables
        self.classes = np.frombuffer(zlib.decompress(tables["classes"]), dtype=np.uint8)
        self.special = {k.encode(): v for k, v in tables["special"].items()}
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(_SLOTS, dtype=np.uint64)       # hash remembered in each slot
        self.place = np.zeros(_SLOTS, dtype=np.int32)       # and its row in lens and heads
        self.lens = np.zeros(1 << 12, dtype=np.int32)
        self.heads = np.zeros(1 << 12, dtype=np.int64)
        self.ids = np.zeros(1 << 14, dtype=np.int32)
        self.rows = self.used = 0

    # --- pre-tokens -------------------------------------------------------------

    def _segments(self, buf: bytes, offs: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """Byte cuts at texts and special strings; {start of a special string: id}."""
        special, cuts = {}, []
        for mark, ident in self.special.items():
            at = buf.find(mark)
            while at >= 0:
                # a string that runs over the border of two texts is none
                if np.searchsorted(offs, at, side="right") == np.searchsorted(offs, at + len(mark), side="left"):
                    special[at] = ident
                    cuts += [at, at + len(mark)]
                    at = buf.find(mark, at + len(mark))
                else:
                    at = buf.find(mark, at + 1)
        cuts = np.unique(np.concatenate((offs, np.array(cuts, dtype=np.int64)))) if cuts else np.unique(offs)
        return cuts, special

    def pretokens(self, buf: bytes, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        """(byte starts, byte ends, special starts) of all pre-tokens, in order."""
        raw = np.frombuffer(buf, dtype=np.uint8)
        if not raw.size:
            z = np.zeros(0, dtype=np.int64)
            return z, z, {}
        cuts, special = self._segments(buf, offs)
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        cps = np.frombuffer(buf.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        n = cps.size
        cls = self.classes[cps]
        edge = np.zeros(n + 1, dtype=bool)
        edge[np.searchsorted(at, cuts)] = True
        edge[n] = True
        same = np.zeros(n, dtype=bool)      # same class as the character before, in the same segment
        same[1:] = (cls[1:] == cls[:-1]) & ~edge[1:n]
        start = ~same
        blank = cls == SPACE
        # white space before something else: the last one stands apart
        lead = np.zeros(n, dtype=bool)
        lead[:-1] = blank[:-1] & ~blank[1:] & ~edge[1:n]
        start |= lead
        # ... and a plain space joins what follows
        joins = np.flatnonzero(lead & (cps == 32)) + 1
        start[joins] = False
        # contractions: an apostrophe that begins a pre-token
        quote = np.flatnonzero((cps == 39) & start)
        if quote.size:
            pad = np.concatenate((cps, np.zeros(2, dtype=np.uint32)))
            far = np.concatenate((edge, np.ones(2, dtype=bool)))
            a, b = pad[quote + 1], pad[quote + 2]
            ok1, ok2 = ~far[quote + 1], ~far[quote + 1] & ~far[quote + 2]
            one = ok1 & np.isin(a, [ord(c) for c in "stmd"])
            two = ok2 & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
            for hit, size in ((quote[one], 2), (quote[two], 3)):
                start[hit + 1] = False
                after = hit + size
                after = after[after < n]
                start[after[(cls[after] == LETTER) | edge[after]]] = True
        for s in special:
            i, j = np.searchsorted(at, [s, s + len(next(m for m, v in self.special.items() if v == special[s]))])
            start[i] = True
            start[i + 1: j] = False
        firsts = np.flatnonzero(start)
        starts = at[firsts]
        return starts, np.append(starts[1:], raw.size), special

    # --- merging ----------------------------------------------------------------

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.t["size"] + b
        i = np.searchsorted(self.t["key"], key)
        i[i == self.t["key"].size] = 0
        return np.where(self.t["key"][i] == key, self.t["rank"][i], _NONE)

    def merge(self, buf: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, sizes) of the pre-tokens at these byte ranges."""
        size = ends - starts
        seq = np.repeat(np.arange(starts.size), size)
        head = np.cumsum(size) - size
        pos = np.arange(seq.size) - head[seq] + starts[seq]
        sym = self.t["first"][np.frombuffer(buf, dtype=np.uint8)[pos]]
        done_sym, done_seq = [], []
        rank = np.full(sym.size, _NONE, dtype=np.int32)
        if sym.size > 1:
            inner = np.flatnonzero(seq[1:] == seq[:-1])
            rank[inner] = self._ranks(sym[inner], sym[inner + 1])
        while sym.size:
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            low = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, seq.size))
            live = np.repeat(low < _NONE, count)
            if not live.all():
                done_sym.append(sym[~live])
                done_seq.append(seq[~live])
                low = low[low < _NONE]
                sym, seq, rank = sym[live], seq[live], rank[live]
                if not sym.size:
                    break
                first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
                count = np.diff(np.append(first, seq.size))
            hit = np.flatnonzero(rank == np.repeat(low, count))
            if hit.size > 1:  # in a run of overlapping hits every other one applies
                run = np.append(True, np.diff(hit) != 1)
                begin = np.flatnonzero(run)
                hit = hit[(np.arange(hit.size) - np.repeat(begin, np.diff(np.append(begin, hit.size)))) % 2 == 0]
            sym[hit] = self.t["merged"][rank[hit]]
            stay = np.ones(sym.size, dtype=bool)
            stay[hit + 1] = False
            at = hit - np.arange(hit.size)      # places of the new symbols after removal
            sym, seq, rank = sym[stay], seq[stay], rank[stay]
            changed = np.zeros(sym.size, dtype=bool)
            changed[at] = True
            changed[at[at > 0] - 1] = True
            again = np.flatnonzero(changed)
            rank[again] = _NONE
            again = again[again + 1 < sym.size]
            again = again[seq[again] == seq[again + 1]]
            rank[again] = self._ranks(sym[again], sym[again + 1])
        if not done_sym:
            return np.zeros(0, dtype=np.int32), np.zeros(starts.size, dtype=np.int64)
        seqs = np.concatenate(done_seq)
        order = np.argsort(seqs, kind="stable")
        return np.concatenate(done_sym)[order], np.bincount(seqs, minlength=starts.size)

    def _remember(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        n = self.rows + sizes.size
        while n > self.lens.size:
            self.lens, self.heads = (np.concatenate((x, np.zeros_like(x))) for x in (self.lens, self.heads))
        while self.used + ids.size > self.ids.size:
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.lens[self.rows: n] = sizes
        self.heads[self.rows: n] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used: self.used + ids.size] = ids
        self.used += ids.size
        self.rows = n

    def _lookup(self, h: np.ndarray, merge) -> np.ndarray:
        """Row of the remembered result for every pre-token, given their hashes;
        ``merge(places)`` computes those that are missing. A hash has one slot; a newcomer takes the slot over, which costs
        another merge when the former one comes back, never a wrong result."""
        if self.rows > self.remembered:
            self._forget()
        slot = (h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        rows = self.place[slot].astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != h)
        if miss.size:
            u, where, inv = np.unique(h[miss], return_index=True, return_inverse=True)
            pick = miss[where]
            ids, sizes = merge(pick)
            at = self.rows + np.arange(u.size)
            self._remember(ids, sizes)
            self.keys[slot[pick]], self.place[slot[pick]] = u, at
            rows[miss] = at[inv]
        return rows

    # --- texts ------------------------------------------------------------------

    def counts(self, col: pa.Array) -> np.ndarray:
        """Tokens of every text of a column; a null counts as empty."""
        out = np.zeros(len(col), dtype=np.int64)
        for row, buf, offs in text_slices(col, SLICE, lower=False):
            starts, ends, special = self.pretokens(buf, offs)
            if starts.size:
                idx = self._lookup(hash_words(buf, starts, ends), lambda pick: self.merge(buf, starts[pick], ends[pick]))
                n = self.lens[idx].astype(np.int64)
                if special:
                    n[np.searchsorted(starts, sorted(special))] = 1
                total = np.concatenate(([0], np.cumsum(n)))
                out[row: row + offs.size - 1] = np.diff(total[np.searchsorted(starts, offs)])
        return out

    def encode(self, col: pa.Array):
        """Yield (first row, flat ids, offsets per text) for slices of a column."""
        for row, buf, offs in text_slices(col, SLICE, lower=False):
            starts, ends, special = self.pretokens(buf, offs)
            if not starts.size:
                yield row, np.zeros(0, dtype=np.int32), np.zeros(offs.size, dtype=np.int64)
                continue
            idx = self._lookup(hash_words(buf, starts, ends), lambda pick: self.merge(buf, starts[pick], ends[pick]))
            n, head = self.lens[idx].astype(np.int64), self.heads[idx]
            marks = np.searchsorted(starts, sorted(special)) if special else np.zeros(0, dtype=np.int64)
            n[marks] = 1
            total = np.concatenate(([0], np.cumsum(n)))
            ids = self.ids[np.arange(total[-1]) - np.repeat(total[:-1] - head, n)]
            if special:
                ids[total[marks]] = [special[s] for s in sorted(special)]
            yield row, ids, total[np.searchsorted(starts, offs)]
