"""Static range asymmetric numeral system over interleaved lanes, with checkpoints."""

from __future__ import annotations

import zlib

import numpy as np

#: A lane's state stays in [2**31, 2**63); renormalisation moves 32 bits.
LOW = 31
WORD = np.uint64(32)
LANES = 4096
#: Steps between checkpoints.
EVERY = 128


def quantize(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 for every symbol that occurs."""
    total, size = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.int64)
    freq = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * size / total).astype(np.int64)), 0)
    freq[np.argmax(counts)] += max(0, size - int(freq.sum()))
    while (over := int(freq.sum()) - size) > 0:
        give = np.minimum(np.maximum(freq - 1, 0), np.ceil(freq * (over / freq.sum())).astype(np.int64))
        order = np.argsort(-freq, kind="stable")
        upto = np.minimum(np.cumsum(give[order]), over)
        freq[order] -= np.diff(np.concatenate([[0], upto]))
    return freq


class Table:
    """A shared frequency table."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.bits, self.freq = bits, freq.astype(np.uint64)
        self.below = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq)), freq)


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = EVERY) -> dict[str, object]:
    """One independent block. Symbol i belongs to lane i % lanes and step i // lanes."""
    n, bits = len(ids), np.uint64(table.bits)
    lanes = max(1, min(lanes, n // EVERY))
    freq, below = table.freq[ids], table.below[ids]
    limit = freq << (np.uint64(LOW) + WORD - bits)
    x = np.full(lanes, 1 << LOW, np.uint64)
    chunks: list[np.ndarray] = []
    marks, states, sent = [], [], 0
    for t in range((n - 1) // lanes, -1, -1) if n else ():
        part = slice(t * lanes, min(n, (t + 1) * lanes))
        f, state = freq[part], x[:part.stop - part.start]
        full = state >= limit[part]
        out = state[full].astype(np.uint32)
        chunks.append(out)
        sent += len(out)
        state = np.where(full, state >> WORD, state)
        times = state // f
        x[:len(f)] = (times << bits) + (state - times * f) + below[part]
        if t and t % every == 0:
            marks.append((t, sent))
            states.append(x.copy())
    payload = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
    raw = payload.astype("<u4").tobytes()
    first = np.concatenate([[0], [t for t, _ in marks[::-1]]]).astype("<i4")
    offset = np.concatenate([[0], [sent - s for _, s in marks[::-1]]]).astype("<i8")
    state = np.concatenate([x, *states[::-1]]).astype("<u8")
    return {
        "lanes": lanes, "payload": raw, "steps": first.tobytes(), "offsets": offset.tobytes(), "states": state.tobytes(),
        "payload_crc": zlib.crc32(raw + first.tobytes() + offset.tobytes() + state.tobytes()), "ids_crc": zlib.crc32(ids.astype("<u4").tobytes()),
    }


def decode(block: dict, n: int, table: Table, checkpoint: int = 0, until: int | None = None) -> np.ndarray:
    """Symbols from a checkpoint on, up to another one (`until`) or the end; checksums are verified."""
    raw = block["payload"]
    if zlib.crc32(raw + block["steps"] + block["offsets"] + block["states"]) != block["payload_crc"]:
        raise ValueError("block checksum does not match")
    lanes, bits = block["lanes"], np.uint64(table.bits)
    words = np.frombuffer(raw, "<u4").astype(np.uint64)
    steps, offsets = np.frombuffer(block["steps"], "<i4"), np.frombuffer(block["offsets"], "<i8")
    x = np.frombuffer(block["states"], "<u8").reshape(-1, lanes)[checkpoint].astype(np.uint64)
    at, begin = int(offsets[checkpoint]), int(steps[checkpoint])
    end = -(-n // lanes) if until is None else int(steps[until])
    out, mask, low = np.empty(max(0, min(n, end * lanes) - begin * lanes), np.int64), np.uint64((1 << table.bits) - 1), np.uint64(1 << LOW)
    for t in range(begin, end):
        k = min(n - t * lanes, lanes)
        state = x[:k]
        slot = state & mask
        sym = table.symbol[slot.astype(np.int64)]
        state = table.freq[sym] * (state >> bits) + slot - table.below[sym]
        need = state < low
        more = int(need.sum())
        state[need] = state[need] << WORD | words[at:at + more]
        at += more
        x[:k] = state
        out[(t - begin) * lanes:(t - begin) * lanes + k] = sym
    if checkpoint == 0 and until is None and zlib.crc32(out.astype("<u4").tobytes()) != block["ids_crc"]:
        raise ValueError("ids checksum does not match")
    return out
