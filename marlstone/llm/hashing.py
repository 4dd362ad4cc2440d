"""Words of many texts at once, as numpy arrays of their places and 64-bit hashes, and bitmaps of hashes. White space is ASCII's, as in ``marlstone.llm.text``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)  # the bytes of an 8-byte lane that belong to a word


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX[0]
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of some texts with one space between them, their places, and their 64-bit hashes. ``first`` has each text's first word, and the number of all at its end."""

    def __init__(self, texts: list[str | bytes | None]) -> None:
        parts, sizes = [], [0]
        for text in texts:
            part = ((text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text) if text else b"").translate(_SPACES).strip(b" ")
            if b"  " in part:
                raw = np.frombuffer(part, dtype=np.uint8)
                space = raw == 32
                space[1:] &= space[:-1]
                space[0] = False
                part = raw[~space].tobytes()
            if part:
                parts.append(part)
            sizes.append(len(part) + 1 if part else 0)
        self.packed = b" ".join(parts)
        raw = np.frombuffer(self.packed, dtype=np.uint8)
        spaces = np.flatnonzero(raw == 32)
        self.starts = np.concatenate([[0], spaces + 1]) if len(raw) else np.empty(0, dtype=np.int64)
        self.ends = np.concatenate([spaces, [len(raw)]]) if len(raw) else self.starts
        self.first = np.searchsorted(self.starts, np.cumsum(sizes))
        self._hashes: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """One 8-byte lane of each word at a time; words that have no more bytes drop out."""
        if self._hashes is not None:
            return self._hashes
        lanes = np.ndarray(len(self.packed) + 1, dtype="<u8", buffer=self.packed + bytes(8), strides=(1,))  # one from each byte on
        at, left = self.starts, self.ends - self.starts
        out = left.astype(np.uint64)
        which = None
        while len(at):
            lane = lanes[at] & _LANE[np.minimum(left, 8)]
            if which is None:
                out = mixed(out * MIX[2] + lane)
            else:
                out[which] = mixed(out[which] * MIX[2] + lane)
            more = np.flatnonzero(left > 8)
            which = more if which is None else which[more]
            at, left = at[more] + 8, left[more] - 8
        self._hashes = out
        return out

    def part(self, at: int, n: int) -> bytes:
        """The words from ``at`` on, ``n`` of them, packed."""
        return self.packed[self.starts[at] : self.ends[at + n - 1]]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words, put together from runs of 1, 2, 4, ... words."""
    size, run, factor = len(hashes) - n + 1, hashes, int(MIX[1])
    out, have, width = None, 0, 1
    while have < n:
        if n & width:
            part = run[have : have + size]
            out = part if out is None else out * np.uint64(factor) + part
            have += width
        if have < n:
            run = run[:-width] * np.uint64(factor) + run[width:]
            factor, width = factor * factor % (1 << 64), 2 * width
    return mixed(out)


def least(keys: np.ndarray, span: int) -> np.ndarray:
    """The minimum of each ``span`` keys in a row, from those of 1, 2, 4, ... keys."""
    size, width = len(keys) - span + 1, 1
    while 2 * width <= span:
        keys, width = np.minimum(keys[:-width], keys[width:]), 2 * width
    return np.minimum(keys[:size], keys[span - width : span - width + size])


def parts(texts: list[str | None], most: int = 1 << 22) -> Iterator[tuple[int, list[str | None]]]:
    """The texts in parts of about ``most`` characters, with the first one's number: bounded memory however many share a batch."""
    low, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield low, texts[low : k + 1]
            low, size = k + 1, 0
    if low < len(texts):
        yield low, texts[low:]


def bitmap(held: DataFrame, columns: dict[str, object], bits: int) -> list[np.ndarray]:
    """A bitmap of 2^bits bits for each column of flags: of the upper bits of ``h`` where the flag holds. At most 2^(bits - 6) rows come to the driver."""
    slot = F.shiftrightunsigned("h", 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    rows = held.select(F.shiftright(slot, 6).cast("int").alias("word"), *[F.when(flag, bit).otherwise(F.lit(0).cast("long")).alias(name) for name, flag in columns.items()])
    table = rows.groupBy("word").agg(*[F.bit_or(name).alias(name) for name in columns]).toArrow()
    out = []
    for name in columns:
        made = np.zeros(1 << (bits - 6), dtype=np.uint64)
        made[table.column("word").to_numpy()] = table.column(name).to_numpy().view(np.uint64)
        out.append(made)
    return out


def held(made: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Which of the 64-bit hashes ``h`` a bitmap has, by their upper bits."""
    slot = h >> np.uint64(64 - bits)
    return (made[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
