"""An adaptive context-mixing range coder of token ids, many independent blocks in step."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

#: Tokens of a block, and blocks that are coded in step.
BLOCK, LANES = 2048, 4096
#: Slots of the order-2 table of a block.
SLOTS = 256
#: Ids are below this.
MOST_ID = 1 << 16

# The probability of an id mixes two predictions: the id that lately followed the last two ids in the block (order 2, learned in
# each block anew), and the id's frequency in the whole run of blocks (tables that go with it), of 2**PRIOR_BITS: its frequency
# after the last id, or its order-0 frequency where the last id has no table of its own, and at a block's start. How much of
# 2**MIX_BITS order 2 gets is counted over the run for each state of its slot (how often in a row it was right lately, or that it
# is empty), and goes with the tables; the frequencies have the rest. An id has a table of its own if that saves more bits than its
# entries take, of ENTRY_BITS each, about.
PRIOR_BITS, MIX_BITS, ENTRY_BITS = 18, 10, 12
#: States of a slot: successes in a row, 6 at most, and the empty slot, whose prediction is never right but for the highest id.
STATES, _EMPTY = 8, ((MOST_ID - 1) << 3) + 7
#: Steps for which the encoder works out intervals at once.
_AHEAD = 32
#: A table has 2**_FINE buckets or more for each entry, by which the decoder looks places up.
_FINE = 1
_HALF = np.uint64(1 << 32)
_HASH = np.uint32(40503)
_U = np.uint64
_WORD, _UNIT, _SHARE = _U(32), _U(PRIOR_BITS + MIX_BITS), _U(PRIOR_BITS + 1)


def _shares(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each entry of the tables (runs of `lengths` entries) its share of 2**PRIOR_BITS by counts, at least 1."""
    whole = np.repeat(np.add.reduceat(counts, np.cumsum(lengths) - lengths), lengths)
    return 1 + counts * ((1 << PRIOR_BITS) - np.repeat(lengths, lengths)) // whole


class Tables:
    """Frequencies of a run of ids: table 0 of all ids, and one of what follows each of `after` (ascending); ids ascend in a table."""

    def __init__(self, after: np.ndarray, lengths: np.ndarray, ids: np.ndarray, counts: np.ndarray, weights: np.ndarray | None = None):
        self.after, self.lengths, self.ids, self.counts = (x.astype(np.int64) for x in (after, lengths, ids, counts))
        shares = _shares(self.counts, self.lengths) if self.ids.size else self.counts
        ends, self.first = np.cumsum(shares), np.cumsum(self.lengths) - self.lengths
        table = np.repeat(np.arange(self.lengths.size), self.lengths)
        start = ends - shares - (ends[self.first] - shares[self.first])[table] if self.ids.size else ends
        self.places, self.start, self.size = (table << PRIOR_BITS) + start, start.astype(_U), shares.astype(_U)
        self.both = self.start << _SHARE | self.size  # one look-up for the two
        self.weights = np.zeros(STATES, np.int64) if weights is None else weights.astype(np.int64)  # of 2**MIX_BITS, order 2's by state
        self.table_of = np.zeros(MOST_ID, np.int64)
        self.table_of[self.after] = np.arange(1, self.after.size + 1)

    def to_bytes(self) -> bytes:
        """Numbers of tables and entries (u32 each), weights (u16 each), byte planes of `after` and of lengths, of ids as gaps, and of counts (u32 each)."""
        gaps = np.diff(self.ids, prepend=0)
        gaps[self.first] = self.ids[self.first]
        planes = [np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in (self.after, self.lengths, gaps, self.counts)]
        return np.array([self.lengths.size, self.ids.size], "<u4").tobytes() + self.weights.astype("<u2").tobytes() + b"".join(planes)

    def buckets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first bucket, shift) of each table and the entry that a bucket of 2**shift places lies in; -1 where it lies in several."""
        log = np.minimum(np.ceil(np.log2(np.maximum(self.lengths, 1))).astype(np.int64) + _FINE, PRIOR_BITS)
        shift, many = PRIOR_BITS - log, 1 << log
        base = np.cumsum(many) - many
        table, out = np.repeat(np.arange(log.size), self.lengths), np.zeros(many.sum(), np.int32)
        own = base[table] + (self.start.astype(np.int64) >> shift[table])
        out[own] = np.arange(own.size)
        np.maximum.accumulate(out, out=out)
        out[own[self.start.astype(np.int64) & (1 << shift[table]) - 1 > 0]] = -1
        return base, shift.astype(_U), out

    @classmethod
    def from_bytes(cls, data: bytes) -> Tables:
        tables, entries = np.frombuffer(data, "<u4", 2).tolist()
        out, at = [], 8 + 2 * STATES
        for n in (max(0, tables - 1), tables, entries, entries):
            out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel().astype(np.int64))
            at += 4 * n
        after, lengths, gaps, counts = out
        sums = np.cumsum(gaps)
        first = np.cumsum(lengths) - lengths
        return cls(after, lengths, sums - np.repeat(sums[first] - gaps[first], lengths), counts, np.frombuffer(data, "<u2", STATES, 8))


def tables_of(ids: np.ndarray, block: int) -> tuple[Tables, np.ndarray]:
    """The tables of a run of ids, and the entry that each id has in them."""
    if not ids.size:
        none = np.empty(0, np.int64)
        return Tables(none, none, none, none), none
    ids = ids.astype(np.uint32)
    pairs = np.empty(ids.size, np.uint32)
    np.multiply(ids[:-1], np.uint32(MOST_ID), out=pairs[1:])
    pairs[1:] += ids[1:]
    first = ids[::block].astype(np.int64)  # nothing stands before them
    pairs[::block] = pairs[1] if block > 1 and ids.size > 1 else 0  # some pair that is counted; their entries are set below
    coded = pa.array(pairs).dictionary_encode()
    found, of_pair = coded.dictionary.to_numpy().astype(np.int64), coded.indices.to_numpy()
    counts = np.bincount(of_pair, minlength=found.size)
    counts[of_pair[0]] -= first.size
    order = np.argsort(found)
    order = order[counts[order] > 0]
    pairs, counts = found[order], counts[order]
    before, own = pairs // MOST_ID, pairs % MOST_ID
    all_counts = np.bincount(ids, minlength=MOST_ID)
    used = np.flatnonzero(all_counts)
    place = np.cumsum(all_counts > 0) - 1
    rare = np.zeros(MOST_ID)
    rare[used] = np.log2(_shares(all_counts[used], np.array([used.size])))
    at = np.flatnonzero(np.diff(before, prepend=-2))
    lengths = np.diff(np.append(at, before.size))
    gain = np.add.reduceat(counts * (np.log2(_shares(counts, lengths)) - rare[own]), at) - ENTRY_BITS * (lengths + 1) if at.size else np.empty(0)
    keeps = gain > 0
    kept = np.repeat(keeps, lengths)
    tables = Tables(before[at][keeps], np.append(used.size, lengths[keeps]), np.append(used, own[kept]), np.append(all_counts[used], counts[kept]))
    entry = np.zeros(found.size, np.int32)
    entry[order] = np.where(kept, used.size + np.cumsum(kept) - 1, place[own])
    entries = entry[of_pair]
    entries[::block] = place[first]
    return tables, entries


def _states(columns: np.ndarray) -> np.ndarray:
    """Of ids (step, block) the state of the slot that order 2 has for each, and STATES more where its prediction is wrong."""
    steps, n = columns.shape
    hashed, cells = columns * _HASH, np.zeros((steps, n), np.uint8)
    cells[1:2] = hashed[:1] >> 4
    cells[2:] = (hashed[:-2] * np.uint32(5) + hashed[1:-1]) >> 4
    slot, table, out, wrong = np.arange(n) * SLOTS, np.full(n * SLOTS, _EMPTY, np.uint32), np.empty((steps, n), np.uint8), np.empty((steps, n), bool)
    at, entry, fresh = np.empty(n, np.int64), np.empty(n, np.uint32), np.empty(n, np.uint32)
    for t in range(steps):
        np.add(slot, cells[t], out=at)
        np.take(table, at, out=entry, mode="clip")
        np.bitwise_and(entry, 7, out=out[t], casting="unsafe")
        np.left_shift(columns[t], 3, out=fresh)
        entry -= fresh
        np.greater(entry, 7, out=wrong[t])
        np.minimum(entry, 5, out=entry)
        entry += 1
        np.putmask(entry, wrong[t], 0)
        entry += fresh
        table[at] = entry
    out += wrong.view(np.uint8) << 3
    return out


def _weights(kinds: np.ndarray) -> np.ndarray:
    """Of 2**MIX_BITS the share of successes by state; none where there are none, and 63/64 at most."""
    right, wrong = kinds[:STATES], kinds[STATES:]
    share = ((right << MIX_BITS) + (right + wrong) // 2) // np.maximum(right + wrong, 1)
    return np.clip(share, right > 0, (1 << MIX_BITS) - (1 << MIX_BITS - 6))


def _encode_lanes(states: np.ndarray, entries: np.ndarray, tables: Tables) -> list[bytes]:
    """A range coder of 64 bits that gives out 32 at a time; a carry goes into the words that are out."""
    steps, n = states.shape
    low, size = np.zeros(n, _U), np.full(n, (1 << 64) - 1, _U)
    words, at = np.zeros(n * (steps + 4), "<u4"), np.arange(n) * (steps + 4)
    part, flags, unit = np.empty(n, _U), np.empty(n, bool), np.empty(n, _U)
    guess = np.tile(tables.weights.astype(_U) << _U(PRIOR_BITS), 2)
    rest = np.tile(_U(1 << MIX_BITS) - tables.weights.astype(_U), 2)
    for t in range(0, steps, _AHEAD):
        kinds = states[t : t + _AHEAD]
        own, tops, right = tables.both[entries[t : t + _AHEAD]], guess[kinds], kinds < STATES
        sizes = rest[kinds]
        starts = own >> _SHARE
        starts *= sizes
        starts += tops
        own &= _U((1 << (PRIOR_BITS + 1)) - 1)
        sizes *= own
        np.putmask(starts, right, 0)
        np.copyto(sizes, tops, where=right)
        for start, share in zip(starts, sizes, strict=True):
            np.right_shift(size, _UNIT, out=unit)
            np.multiply(unit, start, out=part)
            low += part
            np.less(low, part, out=flags)
            i = flags.nonzero()[0]
            if i.size:
                i = at[i] - 1
                while i.size:
                    words[i] += np.uint32(1)
                    i = i[words[i] == 0] - 1
            np.multiply(unit, share, out=size)
            np.less(size, _HALF, out=flags)
            i = flags.nonzero()[0]
            if i.size:
                top, to = low[i], at[i]
                words[to] = top >> _WORD
                to += 1
                at[i] = to
                top <<= _WORD
                low[i] = top
                size[i] <<= _WORD
    for _ in range(2):
        words[at] = low >> _WORD
        at += 1
        low <<= _WORD
    ends = at.tolist()
    return [words[k * (steps + 4) : ends[k]].tobytes() for k in range(n)]


def _decode_lanes(blobs: list[bytes], sizes: list[int], tables: Tables) -> np.ndarray:
    """A row of ids for each blob; ValueError where a blob has fewer words than its own ids are coded in."""
    steps, ends = max(sizes), {}
    for k, size in enumerate(sizes):
        ends.setdefault(size - 1, []).append(k)
    n, longest = len(blobs), max(len(b) // 4 for b in blobs)
    own = np.zeros((n, longest + 2), "<u4")
    for k, b in enumerate(blobs):
        own[k, : len(b) // 4] = np.frombuffer(b, "<u4", len(b) // 4)
    words, row = own.reshape(-1), np.arange(n) * (longest + 2)
    code, size = own[:, 0].astype(_U) << _WORD | own[:, 1].astype(_U), np.full(n, (1 << 64) - 1, _U)
    used, last, slot, memory = row + 2, row + longest + 1, np.arange(n) * SLOTS, np.full(n * SLOTS, _EMPTY, np.uint32)
    guess, rest = tables.weights.astype(_U) << _U(PRIOR_BITS), _U(1 << MIX_BITS) - tables.weights.astype(_U)
    table, at, entries, places, own_ids = np.zeros(n, np.int64), slot.copy(), np.empty(n, np.int64), np.empty(n, np.int64), tables.ids.astype(np.uint32)
    state, known, fresh, hashed, before = np.empty(n, np.int64), np.empty(n, np.uint32), np.empty(n, np.uint32), np.empty(n, np.uint32), np.zeros(n, np.uint32)
    ids, v, unit, top, both, hit, flags = np.empty((steps, n), np.uint32), np.empty(n, _U), np.empty(n, _U), np.empty(n, _U), np.empty(n, _U), np.empty(n, bool), np.empty(n, bool)
    (base, shift, bucket), search, found = tables.buckets(), tables.places.searchsorted, np.empty(n, np.int32)
    follows = np.minimum(np.arange(STATES, dtype=np.uint32), 5) + np.uint32(1)  # the state after a success
    for t in range(steps):
        now = ids[t]
        np.take(memory, at, out=known, mode="clip")
        np.bitwise_and(known, 7, out=state)
        np.right_shift(size, _UNIT, out=unit)
        np.take(guess, state, out=top, mode="clip")
        top *= unit
        np.take(rest, state, out=v, mode="clip")
        unit *= v
        np.less(code, top, out=hit)
        np.subtract(code, top, out=size)  # what is left of the code where order 2 is wrong
        np.floor_divide(size, unit, out=v)
        np.minimum(v, _U((1 << PRIOR_BITS) - 1), out=v)
        np.take(shift, table, out=both, mode="clip")
        np.right_shift(v, both, out=both)
        np.take(base, table, out=places, mode="clip")
        places += both.view(np.int64)
        np.take(bucket, places, out=found, mode="clip")
        np.less(found, 0, out=flags)
        np.copyto(entries, found)
        i = flags.nonzero()[0]
        if i.size:
            entries[i] = search((table[i] << PRIOR_BITS) + v[i].view(np.int64), side="right") - 1
        np.take(own_ids, entries, out=now, mode="clip")
        np.take(tables.both, entries, out=both, mode="clip")
        np.right_shift(both, _SHARE, out=v)
        v *= unit
        size -= v
        np.copyto(code, size, where=~hit)
        both &= _U((1 << (PRIOR_BITS + 1)) - 1)
        np.multiply(both, unit, out=size)
        np.copyto(size, top, where=hit)
        np.right_shift(known, 3, out=fresh)
        np.copyto(now, fresh, where=hit)
        np.take(tables.table_of, now, out=table, mode="clip")
        np.less(size, _HALF, out=flags)
        i = flags.nonzero()[0]
        if i.size:
            to = used[i]
            code[i] = code[i] << _WORD | words[np.minimum(to, last[i])]
            to += 1
            used[i] = to
            size[i] = np.maximum(size[i], _U(1)) << _WORD
        np.take(follows, state, out=known, mode="clip")
        known *= hit
        np.left_shift(now, 3, out=fresh)
        known += fresh
        memory[at] = known
        np.multiply(now, _HASH, out=hashed)
        before *= np.uint32(5)
        before += hashed
        before >>= np.uint32(4)
        before &= np.uint32(SLOTS - 1)
        np.add(slot, before, out=at)
        before, hashed = hashed, before
        if t in ends and any(used[k] - row[k] > len(blobs[k]) // 4 for k in ends[t]):
            raise ValueError("a block that is cut short")
    return ids.T


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[Tables, list[tuple[int, int, bytes]]]:
    """The tables of ids, and (tokens, crc32 of the ids as little-endian 32-bit integers, coded bytes) of each block."""
    ids = np.ascontiguousarray(ids, "<u4")
    if ids.size and int(ids.max()) >= MOST_ID:
        raise ValueError(f"ids must be below {MOST_ID}")
    (tables, entries), out, n = tables_of(ids, block), [], -(-ids.size // block)
    kinds, groups = np.zeros(2 * STATES, np.int64), []
    for first in range(0, n, LANES):
        part = ids[first * block : (first + LANES) * block]
        lanes, steps = -(-part.size // block), min(block, part.size)
        full = np.full((lanes, steps), part[-1], "<u4")
        full.reshape(-1)[: part.size] = part
        groups.append((part, _states(np.ascontiguousarray(full.T))))
        kinds += np.bincount(groups[-1][1].reshape(-1), minlength=2 * STATES)
    tables.weights = _weights(kinds)
    for first, (part, states) in zip(range(0, n, LANES), groups, strict=True):
        places = np.zeros(states.shape[::-1], np.int32)
        places.reshape(-1)[: part.size] = entries[first * block : (first + LANES) * block]
        for i, blob in enumerate(_encode_lanes(states, places.T, tables)):
            own = part[i * block : (i + 1) * block]
            out.append((own.size, zlib.crc32(own.tobytes()), blob))
    return tables, out


def decode_blocks(tables: Tables, blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The ids of encode_blocks, or of any run of its blocks; ValueError where a block's checksum doesn't hold."""
    out = []
    for first in range(0, len(blocks), LANES):
        part = blocks[first : first + LANES]
        ids = _decode_lanes([b for _, _, b in part], [n for n, _, _ in part], tables)
        for own, (n, crc, _) in zip(ids, part, strict=True):
            own = own[:n].astype("<u4")
            if zlib.crc32(own.tobytes()) != crc:
                raise ValueError("a block's checksum doesn't hold")
            out.append(own)
    return np.concatenate(out) if out else np.empty(0, "<u4")
